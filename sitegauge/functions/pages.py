"""Small page functions: the keyword to look for, which pages count, which URLs get no screenshot, lengths of loose values, and the score of a page's whole record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitegauge.functions.scores import let
from sitegauge.functions.urls import path

# Endings that get no screenshot, and the weights of the record's score (in percent).
NO_SCREENSHOT = (".xml", ".pdf", ".zip", ".jpg", ".jpeg", ".png", ".gif", ".css", ".js", ".ico", ".svg", ".webp")
RECORD_WEIGHTS = {"metadata": 10, "structured_data": 20, "content_quality": 15, "entity_signals": 10, "author_eat": 15, "local_seo": 10, "answer_engine": 10, "technical_seo": 5, "ai_readiness": 5}


def chosen_keyword(target: Column, primary: Column, meta_keywords: Column, first_h1: Column) -> Column:
    """The first of the project's keyword, the job's, the first of the meta keywords, and a first level heading that looks like one; in small letters, three at least; null if none is.

    A heading of over 40 characters or five words, with a separated site name or a domain at its end, is none."""
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    long_enough = lambda c: F.when(F.length(c) >= 3, c)
    title = lambda t: F.when((F.length(t) <= 40) & (F.size(F.filter(F.split(t, r"\s+"), lambda w: w != "")) <= 5) & ~t.contains(" - ") & ~t.contains(" | ") & ~t.rlike(r"\.(com|net|org)$"), t)
    return F.coalesce(long_enough(low(target)), long_enough(low(primary)), long_enough(low(F.split(F.coalesce(meta_keywords, F.lit("")), ",")[0])), let(low(first_h1), lambda t: long_enough(title(t))))


def counts_for_score(scrape_status: Column, http_status: Column, robots: Column) -> Column:
    """Whether a page counts: scraped, answered with 200 to 299, and not kept out of the index."""
    return F.coalesce((scrape_status == "SUCCESS") & http_status.between(200, 299), F.lit(False)) & ~F.lower(F.coalesce(robots, F.lit(""))).contains("noindex")


def gets_screenshot(url: Column) -> Column:
    return ~F.lower(path(F.coalesce(url, F.lit("")))).rlike("(" + "|".join(e.replace(".", r"\.") for e in NO_SCREENSHOT) + ")$")


def loose_length(value: Column) -> Column:
    """The length of a JSON list, the whole part of a number or of a text that is a whole number (long); 0 for all else, numbers beyond 64 bits included."""
    v = F.trim(F.coalesce(value, F.lit("")))
    inner = F.trim(F.get_json_object(F.concat(F.lit('{"v":'), F.when(v.startswith('"'), v), F.lit("}")), "$.v"))
    number = F.when(v.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"), v.try_cast("double").try_cast("bigint")).when(inner.rlike(r"^[+-]?\d+$"), inner.try_cast("bigint"))
    return F.coalesce(F.when(v.startswith("["), F.json_array_length(v).cast("bigint")), number, F.lit(0).cast("bigint"))


def record_scores(title: Column, description: Column, canonical: Column, alternates: Column, blocks: Column, entities: Column, crumbs: Column, questions: Column, **others: Column) -> Column:
    """struct of the score of each part of a page's record and overall, their weighted mean to one decimal.

    metadata has 25 for each of title, description, canonical address and alternates; structured data 30 for blocks, 30 for entities, 20 for a trail and 20 for questions (counts, or whether there
    are any).  The other parts are 0 unless given."""
    there = lambda c, n: F.when(c, float(n)).otherwise(0.0)
    said = lambda c: F.coalesce(c, F.lit("")) != ""
    unknown = sorted(set(others) - set(RECORD_WEIGHTS))
    if unknown:
        raise ValueError(f"no parts of the record: {unknown}")
    parts = {n: F.lit(0.0) for n in RECORD_WEIGHTS} | others
    parts["metadata"] = there(said(title), 25) + there(said(description), 25) + there(said(canonical), 25) + there(alternates > 0, 25)
    parts["structured_data"] = there(blocks > 0, 30) + there(entities > 0, 30) + there(crumbs, 20) + there(questions, 20)
    overall = sum((c * RECORD_WEIGHTS[n] for n, c in parts.items()), F.lit(0.0)) / 100
    return F.struct(*[c.alias(n) for n, c in parts.items()], F.round(overall, 1).alias("overall"))
