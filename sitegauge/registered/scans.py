"""Queries of scans, gates, durations and job chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitegauge.functions.scores import round2
from sitegauge.operators import extracts, graph, tables
from sitegauge.registry import query
from sitegauge.sources.html import page_features
from sitegauge.sources.signals import needs_script, page_guard
from sitegauge.sources.tables import table

R2 = "CAST(floor(({0}) * 100 + 0.5) / 100 AS DOUBLE)".format


@query("SELECT page_id, url FROM pages WHERE html IS NOT NULL ORDER BY url, page_id LIMIT 25")
def pages_with_html(spark, sf_dir):
    return tables.with_html(table(spark, sf_dir, "pages")).select("page_id", "url")


@query("SELECT DISTINCT url FROM pages WHERE url <> '' ORDER BY url LIMIT 40")
def explicit_urls(spark, sf_dir):
    return tables.first_urls(table(spark, sf_dir, "pages"), 40)


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 7 LIMIT 1")
def order_by_key(spark, sf_dir):
    return tables.lookup(table(spark, sf_dir, "orders"), o_orderkey=7).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT o_custkey, min_by(o_orderkey, o_orderkey) AS o_orderkey, min_by(o_totalprice, o_orderkey) AS o_totalprice FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1")
def first_of_each_key(spark, sf_dir):
    return tables.in_order_once(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_orderkey")


@query("""SELECT page_id, CASE WHEN NOT (contains(lower(coalesce(html, '')), '<!doctype') OR contains(lower(coalesce(html, '')), '<html')) THEN 'not_html' WHEN strlen(html) > 5000000 THEN 'too_large' WHEN len(regexp_extract_all(lower(html), '<[a-z]')) > 15000 THEN 'too_many_nodes' END AS guard,
contains(lower(coalesce(html, '')), 'shopify') AS shop FROM pages""")
def page_guards(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", page_guard(F.col("html")).alias("guard"), F.contains(F.lower(F.coalesce("html", F.lit(""))), F.lit("shopify")).alias("shop"))


@query()
def page_gates(spark, sf_dir):
    """Pages that script is likely to draw, and those too empty to judge."""
    source = table(spark, sf_dir, "pages")
    parts = page_features(source).select("page_id", "title", "text", "headings", "images")
    return source.select("page_id", "html").join(parts, "page_id").select("page_id", needs_script(F.coalesce("html", F.lit("")), F.col("text"), F.col("title")).alias("needs_script"),
                                                                          extracts.is_complete(F.col("title"), F.col("text"), F.col("headings"), F.col("images")).alias("complete"))


@query("""SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '2030-06-30') AS days_left, CAST(epoch_ms(TIMESTAMP '2030-06-30 00:00:00') - epoch_ms(o_orderdate) AS BIGINT) AS ms_left FROM orders""")
def days_left(spark, sf_dir):
    end = F.lit("2030-06-30 00:00:00").cast("timestamp")
    days = F.date_diff(end.cast("date"), F.col("o_orderdate").cast("date")).cast("long")
    return table(spark, sf_dir, "orders").select("o_orderkey", days.alias("days_left"), F.timestamp_diff("MILLISECOND", F.col("o_orderdate").cast("timestamp"), end).alias("ms_left"))


@query("SELECT doc_id, CAST((length(lower(coalesce(text, ''))) - length(replace(lower(coalesce(text, '')), 'licen', ''))) / 5 AS INTEGER) AS mentions FROM documents")
def mention_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_count(F.lower(F.coalesce("text", F.lit(""))), F.lit("licen")).alias("mentions"))


@query("""WITH j AS (SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey - 1 END AS source_id FROM orders)
SELECT a.job_id, a.source_id AS scraping_id, b.source_id AS discovery_id FROM j a LEFT JOIN j b ON b.job_id = a.source_id""")
def job_chains(spark, sf_dir):
    k = F.col("o_orderkey")
    return tables.job_chain(table(spark, sf_dir, "orders").select(k.alias("job_id"), F.when(k % 3 > 0, k - 1).alias("source_id")))


@query(f"SELECT p_partkey, {R2('CASE WHEN p_size > 1 THEN least((p_partkey % 300) * 2 / (p_size * (p_size - 1)), 1) ELSE 0 END')} AS strength FROM part")
def cross_link_strengths(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", round2(graph.cross_link_strength(F.col("p_size"), F.col("p_partkey") % 300)).alias("strength"))


@query("SELECT page_id, regexp_matches(coalesce(html, ''), '(?i)<link[^>]*canonical') AS present, false AS matches FROM pages")
def canonical_states(spark, sf_dir):
    """The pages' canonical addresses against their own; the test pages have none."""
    p = page_features(table(spark, sf_dir, "pages")).select("page_id", extracts.canonical_state(F.col("url"), F.col("canonical")).alias("c"))
    return p.select("page_id", "c.present", "c.matches")
