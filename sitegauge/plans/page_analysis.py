"""The main flow: pages -> features -> issues -> page scores -> site score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegauge.functions.scores import grade, page_score, severity
from sitegauge.functions.text import content_hash
from sitegauge.operators.content import microdata_types
from sitegauge.operators.fetched import with_answers, with_findings, with_robots
from sitegauge.operators.graph import crawl_graph
from sitegauge.operators.rules import Rule, content_rules, evaluate, judge, site_rules
from sitegauge.sources.dom import parse_dom
from sitegauge.sources.html import page_features
from sitegauge.sources.scratch import saved
from sitegauge.sources.signals import page_signals

# Signals that no rule reads; left out, they are not computed.
UNREAD = ("analytics", "hreflangs", "paragraphs", "n_tables", "n_lists", "n_list_items", "doctype", "viewport", "has_header", "has_footer", "has_main", "html_bytes", "text_bytes", "mixed_count")


def page_issues(pages: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Issues that a page shows by itself.  Features are written once, so that no rule computes them again."""
    return evaluate(saved(page_features(pages)), rules or content_rules())


def full_analysis(pages: DataFrame, folder: str, fetches: DataFrame | None = None, robots: DataFrame | None = None, findings: DataFrame | None = None) -> DataFrame:
    """Issues of the whole catalog, with inbound links, click depth and copies joined on, and what was fetched where there are tables of it (see operators.fetched).

    Only pages that name an itemtype are parsed for items.  Copies are joined only where there are any, from a written table, so that
    pages that all share one content (blank ones) can be split over tasks."""
    typed = parse_dom(pages.withColumn("_typed", F.when(F.contains(F.lower("html"), F.lit("itemtype")), F.col("html"))), html="_typed")
    typed = typed.withColumn("microdata_types", microdata_types(F.col("dom"))).drop("dom", "_typed")
    unread = UNREAD if robots is not None else (*UNREAD, "resources")
    features = saved(page_signals(typed).drop(*unread).withColumn("_h", content_hash(F.col("title"), F.lit(""), F.col("text"))), folder)
    if fetches is not None:
        features = with_answers(features, fetches, folder)
    if robots is not None:
        features = with_robots(features, robots)
    if findings is not None:
        features = with_findings(features, findings)
    graph = saved(crawl_graph(features, folder).groupBy("url").agg(F.max("inbound_links").alias("inbound_links"), F.max("click_depth").alias("click_depth")), folder)
    copies = saved(features.groupBy("_h").agg(F.count("*").alias("copies")).filter("copies > 1"), folder)
    return evaluate(features.join(copies, "_h", "left").drop("_h").join(graph, "url", "left"), content_rules() + site_rules())


def scored_pages(pages: DataFrame, issues: DataFrame, score_cap: float = 100.0) -> DataFrame:
    """-> page_id, url, word_count, issue counts, page_score, page_grade.  pages: page_id, url, word_count."""
    level = severity(F.col("severity"))
    counts = issues.groupBy("page_id").agg(*[F.count_if(level == s).alias(f"{s}_issues") for s in ("high", "medium", "low")], F.count("*").alias("issues"))
    zero = lambda n: F.coalesce(n, F.lit(0)).alias(n)
    out = pages.select("page_id", "url", "word_count").join(counts, "page_id", "left").select("page_id", "url", "word_count", *[zero(n) for n in ("high_issues", "medium_issues", "low_issues", "issues")])
    score = page_score(F.col("high_issues"), F.col("medium_issues"), F.col("low_issues"), F.col("word_count"))
    return out.withColumn("page_score", F.least(score, F.lit(score_cap))).withColumn("page_grade", grade(F.col("page_score")))


def page_scores(pages: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Like scored_pages, in one pass over the pages: each page's issues are counted in place."""
    judged = judge(page_features(pages), rules or content_rules(), ("page_id", "url", "word_count"))
    count = lambda s: F.size(F.filter("issues", lambda i: severity(i["severity"]) == s)).cast("long").alias(f"{s}_issues")
    out = judged.select("page_id", "url", "word_count", count("high"), count("medium"), count("low"), F.size("issues").cast("long").alias("issues"))
    out = out.withColumn("page_score", page_score(F.col("high_issues"), F.col("medium_issues"), F.col("low_issues"), F.col("word_count")))
    return out.withColumn("page_grade", grade(F.col("page_score")))


def site_score(scores: DataFrame) -> DataFrame:
    return scores.agg(F.avg("page_score").alias("site_score"), F.count("*").alias("n_pages"))
