"""Queries of the page extracts.  Audit answers and response headers are made of the tables part and nation, in Spark and in SQL alike."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sitegauge.functions.scores import round2
from sitegauge.operators import extracts
from sitegauge.registry import query
from sitegauge.sources.signals import page_signals
from sitegauge.sources.tables import spread, table

R2 = "CAST(floor(({0}) * 100 + 0.5) / 100 AS DOUBLE)".format


@query(f"""SELECT p_partkey, {R2('p_size')} AS score, {R2('p_retailprice / 1000')} AS fcp, {R2('p_size * 100 / 1000')} AS lcp, {R2('p_size / 50')} AS cls, array_to_string(list_filter([CASE WHEN p_size % 2 = 0 THEN 'render-blocking-resources' END, CASE WHEN p_size < 25 THEN 'unused-javascript' END], lambda x: x IS NOT NULL), ',') AS opportunities FROM part""")
def lighthouse_metrics(spark, sf_dir):
    c, audit = F.col, lambda value, score: F.struct(value.cast("double").alias("numericValue"), score.cast("double").alias("score"))
    audits = F.struct(audit(c("p_retailprice"), F.lit(1)).alias("first-contentful-paint"), audit(c("p_size") * 100, F.lit(1)).alias("largest-contentful-paint"), audit(c("p_size") / 50, F.lit(1)).alias("cumulative-layout-shift"),
                      audit(F.lit(0), c("p_size") % 2).alias("render-blocking-resources"), audit(F.lit(0), c("p_size") / 25).alias("unused-javascript"))
    body = F.to_json(F.struct(F.struct(F.struct(F.struct((c("p_size") / 100).alias("score")).alias("performance")).alias("categories"), audits.alias("audits")).alias("lighthouseResult")))
    out = spread(table(spark, sf_dir, "part")).select("p_partkey", body.alias("body")).select("p_partkey", extracts.performance(F.col("body")).alias("m"))
    return out.select("p_partkey", *[round2(F.col(f"m.{n}")).alias(n) for n in ("score", "fcp", "lcp", "cls")], F.array_join("m.opportunities", ",").alias("opportunities"))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'default-src' END AS csp, CASE WHEN n_nationkey % 3 = 0 THEN 'max-age=1' END AS hsts, CAST(CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN n_nationkey % 3 = 0 THEN 1 ELSE 0 END + 1 AS INTEGER) AS detected FROM nation""")
def security_header_counts(spark, sf_dir):
    k = F.col("n_nationkey")
    headers = F.map_filter(F.create_map(F.lit("Content-Security-Policy"), F.when(k % 2 == 0, "default-src"), F.lit(" strict-transport-security"), F.when(k % 3 == 0, "max-age=1"), F.lit("X-FRAME-OPTIONS"), F.lit("DENY"), F.lit("server"), F.lit("x")), lambda n, v: v.isNotNull())
    return table(spark, sf_dir, "nation").select("n_nationkey", extracts.security_headers(headers).alias("h")).select("n_nationkey", "h.csp", "h.hsts", "h.detected")


@query(rf"""WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages)
SELECT page_id, {R2(f"len(regexp_extract_all(h, '(?i)<(?:{extracts.SEMANTIC})\\b')) * 100 / len(regexp_extract_all(h, '(?i)<[a-z]'))")} AS semantic_percent, md5(substring(regexp_extract(h, '(?is)<body\b[^>]*>(.*)</body\s*>', 1), 1, 5000)) AS fingerprint,
CAST(10 + CASE WHEN regexp_matches(h, '(?i)<main\b') THEN 15 ELSE 0 END + CASE WHEN regexp_matches(h, '(?i)<header\b') THEN 10 ELSE 0 END + CASE WHEN len(regexp_extract_all(h, '(?i)<(?:{extracts.SEMANTIC})\b')) * 100 / len(regexp_extract_all(h, '(?i)<[a-z]')) > 20 THEN 10 ELSE 0 END + 5 AS DOUBLE) AS technical_score,
CAST(greatest(0, len(regexp_extract_all(h, '(?i)<(?:div|p|section|article|table|ul|ol)\b')) - len(regexp_extract_all(h, '(?i)</(?:div|p|section|article|table|ul|ol)\b'))) AS INTEGER) AS unclosed, CAST(len(list_filter(regexp_extract_all(regexp_extract(h, '(?is)<head\b[^>]*>(.*?)</head\s*>', 1), '(?i)<script\b[^>]*\ssrc\s*=[^>]*>'), lambda t: NOT regexp_matches(t, '(?i)\s(?:async|defer)\b')))
+ len(list_filter(regexp_extract_all(regexp_extract(h, '(?is)<head\b[^>]*>(.*?)</head\s*>', 1), '(?i)<link\b[^>]*>'), lambda t: regexp_matches(lower(t), '\srel\s*=\s*["'']?[^"''>]*stylesheet') AND NOT regexp_matches(lower(t), 'preload|\smedia\s*=\s*["'']?print["''\s>]'))) AS INTEGER) AS blocking FROM p""".replace("\\\\b", "\\b"))
def page_structure(spark, sf_dir):
    h = F.coalesce("html", F.lit(""))
    source = table(spark, sf_dir, "pages")
    signals = page_signals(source).select("page_id", "metas", "canonical", "images")
    return source.join(signals, "page_id").select("page_id", round2(extracts.semantic_percent(h)).alias("semantic_percent"), extracts.page_fingerprint(h).alias("fingerprint"), extracts.technical_score(F.col("metas"), F.col("canonical"), h, F.col("images")).alias("technical_score"),
                                                  extracts.unreadable(h).alias("unclosed"), (extracts.render_blocking(h)["css"] + extracts.render_blocking(h)["js"]).alias("blocking"))


@query(f"""WITH d AS (SELECT count_if(o_orderstatus = 'F') AS successful, count_if(o_orderstatus = 'O') AS failed FROM orders), l AS (SELECT count_if(c_mktsegment = 'BUILDING') AS internal_links, count_if(c_mktsegment NOT IN ('BUILDING', 'MACHINERY')) AS social_links FROM customer)
SELECT CAST(successful AS BIGINT) AS successful, CAST(failed AS BIGINT) AS failed, {R2('successful * 100 / (successful + failed)')} AS success_percent, CAST(internal_links AS BIGINT) AS internal_links, CAST(social_links AS BIGINT) AS social_links FROM d, l""")
def crawl_totals(spark, sf_dir):
    pages = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "F", "SUCCESS").when(F.col("o_orderstatus") == "O", "FAILED").otherwise("SKIPPED").alias("scrape_status"))
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "internal").when(F.col("c_mktsegment") == "MACHINERY", "external").otherwise("facebook")
    out = extracts.crawl_summary(pages, table(spark, sf_dir, "customer").select(kind.alias("kind")))
    return out.select("successful", "failed", round2(F.col("success_percent")).alias("success_percent"), "internal_links", "social_links")


@query()
def turn_likeness(spark, sf_dir):
    """difflib's ratio of each question and its answer: an Arrow function, as no built-in distance equals it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations").withColumn("answer", F.lead("text").over(w)).filter("role = 'user' and answer is not null")
    return turns.select("conv_id", "turn", extracts.matching_ratio("text", "answer").alias("ratio"))
