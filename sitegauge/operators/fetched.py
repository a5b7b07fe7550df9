"""What was fetched for a site, joined to its pages: statuses, redirects, links and images that fail, robots files, and browser findings.

Every function takes the page table and a table of answers, and returns the pages
with the columns that the rules read; pages without an answer get nulls.  URLs meet
by lookup_key.  Answers are one row for each key (the latest), so a join never
makes rows; links to one hot target are split by Spark's skew join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.functions.urls import SKIPPED_LINKS, host, lookup_key, path, query, resolve_link
from sitegauge.operators.links import robots_rules
from sitegauge.operators.tables import latest
from sitegauge.sources.scratch import saved

CRAWLER = "googlebot"
FINDINGS = ("forms", "inputs", "focus_trap", "unreachable_elements", "missing_focus_outline", "small_click_targets", "axe_violations", "lang_checked")


def answers(fetches: DataFrame) -> DataFrame:
    """-> key, status, timed_out, bytes, next: the latest answer of each URL; next is the key that a redirect leads to.  fetches: url, at, status, timed_out, bytes, location."""
    last = latest(fetches.filter("url is not null").withColumn("key", lookup_key(F.col("url"))), ["key"], "at")
    redirect = F.col("status").between(300, 399) & (F.coalesce("location", F.lit("")) != "")
    return last.select("key", F.col("status").cast("int").alias("status"), "timed_out", F.col("bytes").cast("long").alias("bytes"), F.when(redirect, lookup_key(resolve_link(F.col("url"), F.col("location")))).alias("next"))


def redirect_ends(found: DataFrame, folder: str | None = None) -> DataFrame:
    """-> key, hops, end, loop of each URL that redirects: how many redirects lead to its end, or loop where they never end (hops and end are null then).

    Pointer jumping: each round joins every open chain to where its end points and doubles its reach, so n redirects take log2(n) rounds; a chain longer than all redirects is a loop."""
    steps = saved(found.filter("next is not null").select("key", F.lit(1).cast("long").alias("hops"), F.col("next").alias("end")), folder)
    total, state = steps.count(), steps
    while True:
        ahead = state.select(F.col("key").alias("end"), F.col("hops").alias("more"), F.col("end").alias("far"))
        joined = state.join(ahead, "end", "left")
        state = saved(joined.select("key", (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), F.coalesce("far", "end").alias("end"), F.col("far").isNotNull().alias("moved")), folder)
        seen = state.agg(F.count_if("moved").alias("moved"), F.count_if(F.col("moved") & (F.col("hops") <= total)).alias("open")).first()
        if not seen["open"]:
            loop = F.col("hops") > total
            return state.select("key", F.when(~loop, F.col("hops").cast("int")).alias("hops"), F.when(~loop, F.col("end")).alias("end"), loop.alias("loop"))
        state = state.drop("moved")


def with_answers(pages: DataFrame, fetches: DataFrame, folder: str | None = None, id: str = "page_id") -> DataFrame:
    """pages (id, url, anchors, images) with status_code, is_404, timed_out, redirect_chain, redirect_loop, link_states, redirected_links, broken_links_count, image_states, broken_images, heavy_images."""
    found = saved(answers(fetches), folder)
    ends = redirect_ends(found, folder)
    own = found.join(ends, "key", "left").select("key", F.col("status").alias("status_code"), (F.col("status") == 404).alias("is_404"), "timed_out", F.col("hops").alias("redirect_chain"), F.coalesce("loop", F.lit(False)).alias("redirect_loop"))
    pages = pages.withColumn("_key", lookup_key(F.col("url")))
    targets = pages.select(F.col(id).alias("_id"), "url", "anchors", "images")
    links = targets.select("_id", F.posexplode(F.filter(F.transform("anchors", lambda a: a["href"]), lambda h: (h != "") & ~h.rlike(SKIPPED_LINKS))).alias("at", "href"), "url").select(
        "_id", "at", F.lit("link").alias("kind"), resolve_link(F.col("url"), F.col("href")).alias("target"), F.col("href").alias("shown"))
    images = targets.select("_id", F.posexplode(F.filter(F.transform("images", lambda i: i["src"]), lambda s: s != "")).alias("at", "src"), "url").select(
        "_id", "at", F.lit("image").alias("kind"), resolve_link(F.col("url"), F.col("src")).alias("target"), F.col("src").alias("shown"))
    known = links.unionByName(images).withColumn("key", lookup_key(F.col("target"))).join(found.select("key", "status", "bytes", F.col("timed_out").alias("late")), "key")
    # as many as the page has links; rows that repeat a page have each once
    states = known.groupBy("_id", "kind").agg(F.array_sort(F.collect_set(F.struct("at", "target", "shown", "status", "bytes", "late"))).alias("s"))
    of = lambda kind: F.coalesce(F.max(F.when(F.col("kind") == kind, F.col("s"))), F.array().cast("array<struct<at: int, target: string, shown: string, status: int, bytes: bigint, late: boolean>>"))
    states = states.groupBy("_id").agg(of("link").alias("_l"), of("image").alias("_i")).select(
        F.col("_id").alias(id), F.transform("_l", lambda x: F.struct(x["target"].alias("url"), x["status"].alias("status"))).alias("link_states"), F.transform("_i", lambda x: F.struct(x["shown"].alias("src"), x["status"].alias("status"), x["bytes"].alias("bytes"))).alias("image_states"),
        F.size(F.filter("_l", lambda x: (x["status"] >= 400) | F.coalesce(x["late"], F.lit(False)))).alias("broken_links_count"), F.size(F.filter("_l", lambda x: x["status"].isin(301, 302))).alias("redirected_links"),
        F.size(F.filter("_i", lambda x: x["status"] >= 400)).alias("broken_images"), F.size(F.filter("_i", lambda x: x["bytes"] > 102400)).alias("heavy_images"))
    made = ("status_code", "is_404", "timed_out", "redirect_chain", "redirect_loop", "link_states", "image_states", "broken_links_count", "redirected_links", "broken_images", "heavy_images")
    return pages.drop(*made).join(own.withColumnRenamed("key", "_key"), "_key", "left").drop("_key").join(states, id, "left")


def _pattern(value: Column) -> Column:
    """A robots path as a regular expression: * stands for anything, a closing $ for the end."""
    plain = F.regexp_replace(value, r"([\\.+?^(){}|\[\]])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(plain, r"\$(?!$)", r"\\\$"), r"\*", ".*"))


def is_blocked(url: Column, rules: Column) -> Column:
    """Whether rules (array of struct<allow, pattern, length>) forbid a URL: the longest that fits counts, of equals the one that allows."""
    asked = F.concat(F.when(path(url) == "", "/").otherwise(path(url)), F.when(query(url) != "", F.concat(F.lit("?"), query(url))).otherwise(""))
    best = F.array_max(F.transform(F.filter(rules, lambda r: F.rlike(asked, r["pattern"])), lambda r: F.struct(r["length"].alias("n"), r["allow"].alias("a"))))
    return F.coalesce(~best["a"], F.lit(False))


def with_robots(pages: DataFrame, files: DataFrame) -> DataFrame:
    """pages (url, resources) with robots_blocked and blocked_resources (scripts and style sheets of the page's own host).  files: host, robots.

    The rules are those for the crawler, or for all where it has none of its own."""
    rows = robots_rules(files).filter(F.col("directive").isin("allow", "disallow") & (F.col("value") != "")).withColumn("agent", F.lower("agent")).filter(F.col("agent").isin(CRAWLER, "*"))
    rule = F.struct((F.col("directive") == "allow").alias("allow"), _pattern(F.col("value")).alias("pattern"), F.length("value").alias("length"))
    named = F.col("agent") == CRAWLER
    own = rows.groupBy(F.lower("host").alias("_host")).agg(F.collect_set(F.when(named, rule)).alias("_own"), F.collect_set(F.when(~named, rule)).alias("_all"))
    own = own.select("_host", F.when(F.size("_own") > 0, F.col("_own")).otherwise(F.col("_all")).alias("_rules"))
    out = pages.drop("robots_blocked", "blocked_resources").withColumn("_host", host(F.col("url"))).join(own, "_host", "left")
    loaded = F.filter("resources", lambda r: r["tag"].isin("script", "link") & (host(resolve_link(F.col("url"), r["url"])) == F.col("_host")))
    held = F.col("_rules").isNotNull()
    return out.withColumns({"robots_blocked": F.when(held, is_blocked(F.col("url"), F.col("_rules"))),
                            "blocked_resources": F.when(held, F.size(F.filter(loaded, lambda r: is_blocked(resolve_link(F.col("url"), r["url"]), F.col("_rules")))))}).drop("_host", "_rules")


def with_findings(pages: DataFrame, findings: DataFrame) -> DataFrame:
    """pages with the browser's latest findings (those of FINDINGS that the table has).  findings: url, at."""
    names = [n for n in FINDINGS if n in findings.columns]
    last = latest(findings.filter("url is not null").select(lookup_key(F.col("url")).alias("_key"), "at", *[F.col(n).alias(f"_f_{n}") for n in names]), ["_key"], "at").drop("at")
    out = pages.withColumn("_key", lookup_key(F.col("url"))).join(last, "_key", "left")
    own = {n: F.coalesce(F.col(f"_f_{n}"), F.col(n)) if n in pages.columns else F.col(f"_f_{n}") for n in names}
    return out.withColumns(own).drop("_key", *[f"_f_{n}" for n in names])
