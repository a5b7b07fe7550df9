"""Queries of sitemaps as files, rule results with errors, and the keyed sink."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sitegauge.functions.scores import round2
from sitegauge.operators import fetched, rule_results
from sitegauge.registry import query
from sitegauge.sources import sitemaps
from sitegauge.sources.scratch import saved, shared_folder
from sitegauge.sources.signals import page_signals
from sitegauge.sources.tables import table
from sitegauge.streaming import sink

SITE = "https://shop.example/"
R2 = "CAST(floor(({0}) * 100 + 0.5) / 100 AS DOUBLE)".format


def _sitemap_walk(spark, sf_dir):
    """An index of regions, an index of nations for each region, and a list of suppliers for each nation, written as gzip files and read back as bytes."""
    loc = lambda tag, name: F.concat(F.lit(f"<{tag}><loc>{SITE}"), name, F.lit(f"</loc></{tag}>"))
    name = lambda kind, key: F.concat(F.lit(kind), key.cast("string"), F.lit(".xml"))
    index = lambda parts: F.concat(F.lit('<?xml version="1.0"?><sitemapindex>'), F.array_join(F.transform(F.array_sort(parts), lambda p: p["t"]), ""), F.lit("</sitemapindex>"))
    region, nation, supplier = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    part = lambda key, text: F.collect_list(F.struct(key.alias("k"), text.alias("t")))
    top = region.agg(index(part(F.col("r_regionkey"), loc("sitemap", name("r", F.col("r_regionkey"))))).alias("body")).select(F.lit("top.xml").alias("file"), "body")
    middle = nation.groupBy("n_regionkey").agg(index(part(F.col("n_nationkey"), loc("sitemap", name("n", F.col("n_nationkey"))))).alias("body")).select(name("r", F.col("n_regionkey")).alias("file"), "body")
    leaves = supplier.groupBy("s_nationkey").agg(F.array_join(F.array_sort(F.collect_list(loc("url", name("s", F.col("s_suppkey"))))), "").alias("b")).select(
        name("n", F.col("s_nationkey")).alias("file"), F.concat(F.lit("<urlset>"), "b", F.lit("</urlset>")).alias("body"))
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    top.unionByName(middle).unionByName(leaves).repartition("file").write.partitionBy("file").option("compression", "gzip").text(folder)
    files = sitemaps.decoded(sitemaps.sitemap_files(spark, folder, F.concat(F.lit(SITE), F.col("file"))))
    return sitemaps.walk(spark.createDataFrame([(SITE + "top.xml",), (SITE + "gone.xml",)], "sitemap string"), files, depth=3, children=4)


TAKEN = "n AS (SELECT n_nationkey, n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS place, count(*) OVER (PARTITION BY n_regionkey) AS n FROM nation), r AS (SELECT r_regionkey, row_number() OVER (ORDER BY r_regionkey) AS place, count(*) OVER () AS n FROM region)"


@query(f"WITH {TAKEN} SELECT '{SITE}s' || s_suppkey || '.xml' AS url, '{SITE}n' || n_nationkey || '.xml' AS sitemap, CAST(2 AS INTEGER) AS level FROM supplier JOIN n ON s_nationkey = n_nationkey AND n.place <= 4 JOIN r ON r_regionkey = n_regionkey AND r.place <= 4")
def sitemap_file_pages(spark, sf_dir):
    return _sitemap_walk(spark, sf_dir)[0]


@query(f"""WITH {TAKEN}, c AS (SELECT s_nationkey, count(*) AS c FROM supplier GROUP BY 1)
SELECT '{SITE}top.xml' AS sitemap, 0::INTEGER AS level, 'index' AS state, 0::INTEGER AS n_urls, max(n)::INTEGER AS n_children, greatest(0, max(n) - 4)::INTEGER AS children_left_out FROM r UNION ALL SELECT '{SITE}gone.xml', 0, 'missing', 0, 0, 0
UNION ALL SELECT '{SITE}r' || r_regionkey || '.xml', 1, 'index', 0, max(n.n)::INTEGER, greatest(0, max(n.n) - 4)::INTEGER FROM r JOIN n ON r_regionkey = n_regionkey WHERE r.place <= 4 GROUP BY r_regionkey
UNION ALL SELECT '{SITE}n' || n_nationkey || '.xml', 2, CASE WHEN c IS NULL THEN 'missing' ELSE 'urls' END, coalesce(c, 0)::INTEGER, 0, 0 FROM n JOIN r ON r_regionkey = n_regionkey AND r.place <= 4 LEFT JOIN c ON s_nationkey = n_nationkey WHERE n.place <= 4""")
def sitemap_file_report(spark, sf_dir):
    return _sitemap_walk(spark, sf_dir)[1]


def _rules():
    c = F.col
    return [rule_results.ScoreRule("balance", "money", F.try_divide(c("c_acctbal"), F.lit(1000.0)), 2.0, 10.0, ((c("c_acctbal") >= 0, "negative balance"),)),
            rule_results.ScoreRule("share", "money", F.try_divide(c("c_acctbal"), c("c_nationkey")), 1.0, 10_000.0), rule_results.ScoreRule("segment", "kind", F.length("c_mktsegment").cast("double"), 1.0, 9.0)]


RULES_SQL = """e AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'negative balance' WHEN c_acctbal / 1000 > 10 THEN 'score out of range' END AS e1, c_acctbal / 1000.0 * 100 / 10 AS s1, CASE WHEN c_nationkey = 0 THEN 'no score' WHEN c_acctbal / c_nationkey < 0 OR c_acctbal / c_nationkey > 10000 THEN 'score out of range' END AS e2,
CASE WHEN c_nationkey <> 0 THEN c_acctbal / c_nationkey * 100 / 10000 END AS s2, CASE WHEN length(c_mktsegment) > 9 THEN 'score out of range' END AS e3, length(c_mktsegment) * 100 / 9.0 AS s3 FROM customer),
s AS (SELECT c_custkey, e1, e2, e3, CASE WHEN e1 IS NULL THEN s1 ELSE 0 END AS s1, CASE WHEN e2 IS NULL THEN s2 ELSE 0 END AS s2, CASE WHEN e3 IS NULL THEN s3 ELSE 0 END AS s3 FROM e)"""
WEIGHTS = {"money": 60.0, "kind": 40.0}


@query(f"WITH {RULES_SQL} SELECT c_custkey, {R2('(s3 * 40 + (s1 * 2 + s2) / 3 * 60) / 100')} AS final_score, array_to_string(list_filter(['balance: ' || e1, 'share: ' || e2, 'segment: ' || e3], lambda x: x IS NOT NULL), ', ') AS errors, true AS valid FROM s")
def rule_errors(spark, sf_dir):
    """Rules over customers that fail on some of them: a failed rule scores 0 and keeps its weight."""
    rules = _rules()
    rule_results.check(rules, WEIGHTS)
    out = rule_results.page_totals(rule_results.with_results(table(spark, sf_dir, "customer"), rules), WEIGHTS)
    return out.select("c_custkey", round2(F.col("final_score")).alias("final_score"), F.array_join(F.transform("errors", lambda e: F.concat_ws(": ", e["rule_id"], e["error"])), ", ").alias("errors"), "valid")


@query("""WITH e AS (SELECT *, event_id % 3 AS b, CAST(ts AS DATE) AS day FROM events), g AS (SELECT user_id, event_type, day, min(b) AS b FROM e WHERE value >= 10 GROUP BY ALL)
SELECT CAST(b AS BIGINT) AS batch, count(*) AS n, count(DISTINCT user_id) AS users FROM g GROUP BY 1""")
def keyed_sink(spark, sf_dir):
    """All events, dealt into three batches by id, go through the sink keyed by user, type and day; batch 1 is run again, as after a lost driver."""
    events = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    out = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    for number in (0, 1, 1, 2):
        sink.store(events.filter(F.col("event_id") % 3 == number), number, out, ("user_id", "event_type", "day"), {"small_value": lambda: F.col("value") >= 10})
    return sink.table(spark, events.schema, out).groupBy("batch").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


def _fetches(spark, sf_dir):
    """Answers for all pages and for the links of their navigation: missing, failing, late and redirecting ones by page id and by the link's length; some redirects lead in circles."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    k, none = F.col("page_id"), F.lit(None).cast("string")
    hop = lambda n: F.concat(F.lit("https://hop.example/"), k.cast("string"), F.lit("/"), n.cast("string"))
    own = pages.select("url", k.alias("at"), F.when(k % 8 == 0, 404).when(k % 8 == 1, 503).when(k % 8 == 2, 301).otherwise(200).alias("status"), (k % 8 == 3).alias("timed_out"), F.when(k % 8 == 2, hop(F.lit(1))).alias("location"))
    turns = pages.filter(k % 8 == 2).select("page_id", F.explode(F.sequence(F.lit(1), (k % 3 + 1).cast("int"))).alias("n"))
    last = F.col("n") == k % 3 + 1
    hops = turns.select(hop(F.col("n")).alias("url"), k.alias("at"), F.when(~last | (k % 16 == 2), 302).otherwise(200).alias("status"), F.lit(False).alias("timed_out"), F.when(~last, hop(F.col("n") + 1)).when(k % 16 == 2, hop(F.lit(1))).alias("location"))
    href = F.explode(F.array_distinct(F.regexp_extract_all(F.regexp_extract("html", "(?s)<nav>(.*?)</nav>", 1), F.lit('<a href="([^"]*)"'), F.lit(1)))).alias("href")
    links = pages.select("url", href).select(F.concat(F.regexp_extract("url", "^(https?://[^/]*)", 1), "href").alias("url"), F.length("href").alias("n")).distinct()
    links = links.select("url", F.lit(-1).cast("long").alias("at"), F.when(F.col("n") % 4 == 0, 404).when(F.col("n") % 5 == 0, 301).otherwise(200).alias("status"), F.lit(False).alias("timed_out"), none.alias("location"))
    return own.unionByName(hops).unionByName(links).withColumn("bytes", F.lit(0))


@query(r"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '/+(\?|$)', '\1') AS key, url, list_distinct(regexp_extract_all(regexp_extract(coalesce(html, ''), '(?s)<nav>(.*?)</nav>', 1), '<a href="([^"]*)"', 1)) AS d, regexp_extract_all(regexp_extract(coalesce(html, ''), '(?s)<nav>(.*?)</nav>', 1), '<a href="([^"]*)"', 1) AS hrefs FROM pages),
o AS (SELECT key, max(page_id) AS k FROM p GROUP BY 1)
SELECT page_id, CASE k % 8 WHEN 0 THEN 404 WHEN 1 THEN 503 WHEN 2 THEN 301 ELSE 200 END::INTEGER AS status_code, k % 8 = 3 AS timed_out, CASE WHEN k % 8 = 2 AND k % 16 <> 2 THEN k % 3 + 1 END::INTEGER AS redirect_chain, k % 16 = 2 AS redirect_loop,
len(list_filter(hrefs, lambda h: length(h) % 4 = 0))::INTEGER AS broken_links_count, len(list_filter(hrefs, lambda h: length(h) % 4 <> 0 AND length(h) % 5 = 0))::INTEGER AS redirected_links FROM p JOIN o USING (key)""")
def fetched_states(spark, sf_dir):
    pages = page_signals(table(spark, sf_dir, "pages")).select("page_id", "url", "anchors", "images")
    out = fetched.with_answers(saved(pages), _fetches(spark, sf_dir))
    return out.select("page_id", "status_code", "timed_out", "redirect_chain", "redirect_loop", "broken_links_count", "redirected_links")
