"""Queries of links, sitemaps, robots files, companion tables and site scores.

Links, sitemaps, robots files and category scores are made of the tables
lineitem, customer, nation and part, in Spark and in SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegauge.functions.scores import round2
from sitegauge.functions.urls import lookup_key
from sitegauge.operators import links, site_metrics, tables
from sitegauge.registry import query
from sitegauge.sources.tables import table

R2 = "CAST(floor(({0}) * 100 + 0.5) / 100 AS DOUBLE)".format
LINKS = """l AS (SELECT 'https://a' || (l_orderkey % 40) || '.example/p' AS src, l_partkey AS p, CASE l_partkey % 6 WHEN 0 THEN '/docs/guide/' || (l_partkey % 50) WHEN 1 THEN 'https://a' || (l_orderkey % 40) || '.example/shop/item' || (l_partkey % 20)
  WHEN 2 THEN 'http://b' || (l_suppkey % 30) || '.example/x' WHEN 3 THEN 'https://c' || (l_suppkey % 10) || '.example/error/' WHEN 4 THEN 'mailto:x@y.example' ELSE '#top' END AS url,
  CASE l_linenumber % 4 WHEN 0 THEN 'Click here' WHEN 1 THEN 'A study of words' WHEN 2 THEN 'Go' ELSE 'Prices and sizes' END AS text, CASE l_suppkey % 3 WHEN 0 THEN 'nofollow' WHEN 1 THEN 'sponsored noopener' ELSE '' END AS rel FROM lineitem),
k AS (SELECT *, CASE p % 6 WHEN 0 THEN 'relative' WHEN 1 THEN 'internal' WHEN 2 THEN 'external' WHEN 3 THEN 'external' WHEN 4 THEN 'mailto' ELSE 'fragment' END AS kind FROM l)"""


def link_table(spark, sf_dir) -> DataFrame:
    s = lambda c, m: (F.col(c) % m).cast("string")
    p = F.col("l_partkey") % 6
    url = (F.when(p == 0, F.concat(F.lit("/docs/guide/"), s("l_partkey", 50))).when(p == 1, F.concat(F.lit("https://a"), s("l_orderkey", 40), F.lit(".example/shop/item"), s("l_partkey", 20)))
           .when(p == 2, F.concat(F.lit("http://b"), s("l_suppkey", 30), F.lit(".example/x"))).when(p == 3, F.concat(F.lit("https://c"), s("l_suppkey", 10), F.lit(".example/error/"))).when(p == 4, "mailto:x@y.example").otherwise("#top"))
    n, r = F.col("l_linenumber") % 4, F.col("l_suppkey") % 3
    anchor = F.struct(url.alias("href"), F.when(r == 0, "nofollow").when(r == 1, "sponsored noopener").otherwise("").alias("rel"), F.lit("").alias("target"), F.lit("").alias("title"),
                      F.when(n == 0, "Click here").when(n == 1, "A study of words").when(n == 2, "Go").otherwise("Prices and sizes").alias("text"))
    return links.link_rows(table(spark, sf_dir, "lineitem").select(F.concat(F.lit("https://a"), s("l_orderkey", 40), F.lit(".example/p")).alias("url"), F.array(anchor).alias("anchors")))


@query(rf"""WITH {LINKS}, u AS (SELECT src, url, kind IN ('internal', 'relative') AS internal, count(*) AS n, count_if(length(text) < 3 OR regexp_matches(lower(text), 'click here|read more|learn more|here|more|link|page|website|site|url|download')) AS generic,
  count_if(kind = 'external') AS external, count_if(kind = 'external' AND url LIKE 'https://%') AS secure, count_if(kind = 'external' AND text = 'A study of words') AS citations, count_if(kind = 'external' AND url LIKE '%error%') AS doubtful FROM k GROUP BY ALL),
s AS (SELECT src, sum(n) AS total, sum(CASE WHEN internal THEN n ELSE 0 END) AS internal, sum(external) AS external, count_if(internal AND n > 1) AS repeated, sum(generic) AS generic, sum(secure) AS secure, sum(citations) AS citations, sum(doubtful) AS doubtful FROM u GROUP BY 1)
SELECT src, CAST(total AS BIGINT) AS total, CAST(internal AS BIGINT) AS internal, CAST(external AS BIGINT) AS external, repeated, CAST(generic AS BIGINT) AS generic, CAST(secure AS BIGINT) AS secure, CAST(citations AS BIGINT) AS citations, CAST(doubtful AS BIGINT) AS doubtful,
{R2('(total - generic) * 100 / total')} AS descriptive_percent FROM s""")
def link_summaries(spark, sf_dir):
    return links.link_summary(link_table(spark, sf_dir)).withColumn("descriptive_percent", round2(F.col("descriptive_percent")))


@query(rf"WITH {LINKS} SELECT src, CASE WHEN p % 6 = 0 THEN '/docs/guide' ELSE regexp_extract(url, '(/shop/item[0-9]+)$', 1) END AS pattern, count(*) AS n FROM k WHERE kind IN ('internal', 'relative') GROUP BY ALL")
def link_paths(spark, sf_dir):
    return links.path_distribution(link_table(spark, sf_dir))


@query(rf"WITH {LINKS} SELECT regexp_extract(url, '//([^/]*)', 1) AS domain, count(*) AS n, bool_or(rel LIKE '%nofollow%') AS any_nofollow, bool_or(rel LIKE '%sponsored%') AS any_sponsored FROM k WHERE kind = 'external' GROUP BY 1")
def link_domains(spark, sf_dir):
    return links.external_domains(link_table(spark, sf_dir))


@query(rf"WITH {LINKS} SELECT regexp_extract(url, '//([^/]*)', 1) AS domain, count(*) AS n FROM k WHERE kind = 'external' GROUP BY 1 ORDER BY n DESC, domain LIMIT 10")
def link_top_domains(spark, sf_dir):
    return links.top_domains(link_table(spark, sf_dir)).select("domain", "n")


@query("""WITH c AS (SELECT 'https://m.example/' || CASE c_custkey % 7 WHEN 0 THEN 'cart/' WHEN 1 THEN 'wp-admin/' ELSE 'p/' END || c_custkey AS url, 'https://m.example/' || CASE c_nationkey % 3 WHEN 0 THEN 'service' WHEN 1 THEN 'page' ELSE 'zone' END || '-sitemap' || c_nationkey || '.xml' AS sitemap, c_nationkey % 3 AS kind, c_custkey FROM customer)
SELECT url, sitemap, CASE kind WHEN 0 THEN 'service' WHEN 1 THEN 'main' ELSE 'other' END AS kind FROM c WHERE c_custkey % 7 > 1""")
def sitemap_pages(spark, sf_dir):
    """A root index names an index for each region, those the nations' sitemaps, and these the customers' pages."""
    base = "https://m.example/"
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    loc = lambda u: F.concat(F.lit("<url><loc>"), u, F.lit("</loc></url>"))
    of = lambda key: F.concat(F.lit(base), F.when(key % 3 == 0, "service").when(key % 3 == 1, "page").otherwise("zone"), F.lit("-sitemap"), key.cast("string"), F.lit(".xml"))
    page = F.concat(F.lit(base), F.when(F.col("c_custkey") % 7 == 0, "cart/").when(F.col("c_custkey") % 7 == 1, "wp-admin/").otherwise("p/"), F.col("c_custkey").cast("string"))
    body = lambda tag, inner: F.concat(F.lit(f"<?xml version='1.0'?><{tag}>"), F.array_join(F.collect_list(loc(inner)), ""), F.lit(f"</{tag}>")).alias("body")
    leaves = customer.groupBy(of(F.col("c_nationkey")).alias("sitemap")).agg(body("urlset", page))
    middle = nation.groupBy(F.concat(F.lit(base + "region"), F.col("n_regionkey").cast("string"), F.lit(".xml")).alias("sitemap")).agg(body("sitemapindex", of(F.col("n_nationkey"))))
    top = nation.select("n_regionkey").distinct().groupBy(F.lit(base + "sitemap.xml").alias("sitemap")).agg(body("sitemapindex", F.concat(F.lit(base + "region"), F.col("n_regionkey").cast("string"), F.lit(".xml"))))
    root = spark.createDataFrame([(base + "sitemap.xml",)], "sitemap string")
    return links.expand_sitemaps(root, leaves.unionByName(middle).unionByName(top))


ROBOTS = "concat_ws(chr(10), 'User-agent: *', 'Disallow: /tmp/', 'Sitemap: https://' || lower(n_name) || '/s.xml', CASE WHEN n_nationkey % 2 = 0 THEN 'User-agent: GPTBot' || chr(10) || 'Disallow: /' END, CASE WHEN n_nationkey % 3 = 0 THEN 'User-agent: PerplexityBot' || chr(10) || 'Disallow: /api/' || chr(10) || 'Allow: /ok' END)"


@query("""SELECT lower(n_name) AS host, CASE WHEN n_nationkey % 6 = 0 THEN 'GPTBot,PerplexityBot' WHEN n_nationkey % 2 = 0 THEN 'GPTBot' ELSE 'PerplexityBot' END AS agents,
CAST(2 + CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN n_nationkey % 3 = 0 THEN 2 ELSE 0 END AS BIGINT) AS n_rules, 'https://' || lower(n_name) || '/s.xml' AS sitemap FROM nation WHERE n_nationkey % 2 = 0 OR n_nationkey % 3 = 0""")
def robots_blocks(spark, sf_dir):
    files = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("host"), F.expr(ROBOTS).alias("robots"))
    rules = links.robots_rules(files)
    agents = links.blocked_agents(rules).select("host", F.array_join("agents", ",").alias("agents"))
    maps = files.select("host", links.robots_sitemaps(F.col("robots"))[0].alias("sitemap"))
    return agents.join(rules.groupBy("host").agg(F.count("*").alias("n_rules")), "host").join(maps, "host").select("host", "agents", "n_rules", "sitemap")


@query("""WITH p AS (SELECT page_id, url || CASE page_id % 4 WHEN 0 THEN '/cart/' WHEN 1 THEN '/Preview/' ELSE '' END AS url FROM pages)
SELECT page_id, page_id % 4 > 1 AS content, regexp_replace(lower(regexp_extract(url, '//([^/?#]*)', 1)), '^www\\.', '') LIKE '%example.com' AS same_site FROM p""")
def content_urls(spark, sf_dir):
    url = F.concat("url", F.when(F.col("page_id") % 4 == 0, "/cart/").when(F.col("page_id") % 4 == 1, "/Preview/").otherwise(""))
    return table(spark, sf_dir, "pages").select("page_id", links.is_content_url(url).alias("content"), links.same_site(url, F.lit("https://www.example.com/")).alias("same_site"))


@query("""WITH p AS (SELECT DISTINCT url, CASE page_id % 5 WHEN 0 THEN 'main' WHEN 1 THEN 'service' WHEN 2 THEN NULL ELSE 'other' END AS type FROM pages),
b AS (SELECT url, min(CASE WHEN type IN ('main', 'service') THEN 0 ELSE 1 END) AS r FROM p GROUP BY 1)
SELECT url, type FROM p JOIN b USING (url) WHERE r = CASE WHEN type IN ('main', 'service') THEN 0 ELSE 1 END QUALIFY row_number() OVER (PARTITION BY url ORDER BY type NULLS FIRST) = 1 ORDER BY r, type NULLS FIRST, url LIMIT 150""")
def page_selection(spark, sf_dir):
    k = F.col("page_id") % 5
    return links.select_pages(table(spark, sf_dir, "pages").select("url", F.when(k == 0, "main").when(k == 1, "service").when(k == 2, None).otherwise("other").alias("type")), 150)


@query("""WITH h AS (SELECT DISTINCT url FROM pages WHERE page_id % 3 <> 0), s AS (SELECT DISTINCT url FROM pages WHERE page_id % 2 = 0)
SELECT url, CASE WHEN h.url IS NOT NULL AND s.url IS NOT NULL THEN 'both' WHEN h.url IS NOT NULL THEN 'html' ELSE 'sitemap' END AS source FROM h FULL JOIN s USING (url)""")
def url_sources(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return links.with_sitemap(p.filter("page_id % 3 <> 0").select("url"), p.filter("page_id % 2 = 0").select("url"))


CATEGORIES = {"ai_impact": "p_size * 2.0", "aeo_score": "p_size * 1.5", "citation_probability": "(p_partkey % 100) * 1.0", "llm_readiness": "(p_partkey % 37) * 2.5", "topical_authority": "(p_size % 7) * 12.0", "voice_intent": "(p_partkey % 11) * 9.0"}
CATS = ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in CATEGORIES.items())


def category_scores(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", *[F.expr(f"cast({e} as double)").alias(n) for n, e in CATEGORIES.items()])


@query(f"WITH s AS (SELECT p_partkey, {CATS} FROM part) SELECT p_partkey, {', '.join(R2('greatest(0, least(100, ' + ' + '.join(f'{c} * {w}' for c, w in f.items()) + '))') + f' AS {m}' for m, f in site_metrics.METRICS.items())} FROM s")
def dashboard_metrics(spark, sf_dir):
    return site_metrics.dashboard(category_scores(spark, sf_dir), "p_partkey")


@query(f"WITH s AS (SELECT {CATS}, p_size * 1.0 AS final_score FROM part) SELECT {', '.join(f'{R2(f'avg({c})')} AS {c}' for c in sorted(CATEGORIES))}, {R2('avg(final_score)')} AS site_score, count(*) AS n_pages FROM s")
def site_category_scores(spark, sf_dir):
    out = site_metrics.site_categories(category_scores(spark, sf_dir).withColumn("final_score", F.col("p_size") * F.lit(1.0)))
    return out.select(*[round2(F.col(c)).alias(c) for c in sorted(CATEGORIES)], round2(F.col("site_score")).alias("site_score"), "n_pages")


@query(f"""WITH r AS (SELECT CASE WHEN l_partkey % 4 = 0 THEN 'schema_valid_jsonld' ELSE 'x' END AS rule_id, l_quantity * 2 AS score FROM lineitem), c AS (SELECT count_if(score < 70) AS total_issues, count_if(score < 70 AND rule_id <> 'x') AS valid_issues FROM r)
SELECT total_issues, valid_issues, total_issues - valid_issues AS filtered_issues, {R2('(total_issues - valid_issues) * 100 / total_issues')} AS filtered_percent FROM c""")
def failed_rule_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_partkey") % 4 == 0, "schema_valid_jsonld").otherwise("x").alias("rule_id"), (F.col("l_quantity") * 2).alias("score"))
    return site_metrics.validation_summary(rows).withColumn("filtered_percent", round2(F.col("filtered_percent")))


DAMP = f"""s AS (SELECT p_partkey, {CATS}, p_size % 40 AS n_entities, p_partkey % 1500 + 50 AS word_count, p_partkey % 30 AS questions, p_partkey % 6 AS qa_pairs, p_size % 9 AS h2, p_size % 5 AS h3, p_size % 12 AS n_paragraphs, p_partkey % 25 AS step_count,
  p_size % 16 AS n_nodes, (p_partkey % 10) / 10 AS cross_links, (p_partkey % 13) / 13 AS authority, (p_size % 5) * 1.0 AS spam, (p_partkey % 9) / 9 AS uniqueness, p_partkey % 2 = 0 AS has_organization, p_partkey % 1500 < 250 AS low_word_count FROM part),
i AS (SELECT *, CASE WHEN n_entities > 0 AND n_entities * 1000 / word_count > 15 THEN least(1, (n_entities * 1000 / word_count - 15) / 20) ELSE 0 END AS entity_inflation, CASE WHEN questions > 10 AND qa_pairs / questions < 0.3 THEN least(1, (questions - 10) / 20 * (1 - qa_pairs / questions)) ELSE 0 END AS faq_inflation,
  CASE WHEN n_paragraphs > 0 AND (h2 + h3) / n_paragraphs > 0.8 THEN least(1, ((h2 + h3) / n_paragraphs - 0.8) / 0.5) ELSE 0 END AS heading_inflation, CASE WHEN word_count < 1000 AND step_count > 10 THEN least(1, (step_count - 10) / 15) ELSE 0 END AS step_inflation,
  CASE WHEN n_nodes > 10 AND cross_links < 0.3 THEN least(1, (5 - cross_links * 10) / 5) ELSE 0 END AS structured_inflation,
  CASE WHEN authority > 0.85 THEN 0.2 WHEN authority > 0.75 THEN 0.4 WHEN authority > 0.65 THEN 0.6 ELSE 1.0 END AS ease, CASE WHEN authority > 0.85 THEN 1.2 WHEN authority > 0.75 THEN 1.1 ELSE 1.0 END AS boost,
  CASE WHEN spam > 2.5 THEN 1 / (1 + exp(spam - 3)) ELSE 1 END AS spammed, CASE WHEN low_word_count THEN 0.3 + 0.7 / (1 + exp(-(word_count - 200) / 100)) ELSE 1 END AS thin FROM s),
d AS (SELECT *, 1 - entity_inflation * CASE WHEN uniqueness > 0.8 THEN ease * 0.2 WHEN uniqueness > 0.7 THEN ease * 0.4 WHEN uniqueness > 0.5 THEN ease * 0.7 ELSE 1 END AS d_topical,
  1 - structured_inflation * CASE WHEN has_organization AND cross_links > 0.7 THEN ease * 0.3 WHEN has_organization THEN ease * 0.6 ELSE 1 END AS d_impact FROM i)"""
_D = {"topical_authority": "d_topical", "ai_impact": "d_impact"}


@query(f"""WITH {DAMP} SELECT p_partkey, {', '.join(f'{R2(f"{n}_inflation")} AS {n}_inflation' for n in ('entity', 'faq', 'heading', 'step', 'structured'))},
{', '.join(f"{R2(f'CASE WHEN boost > 1 THEN least(100, {c} * {_D.get(c, 1)} * boost) ELSE {c} * {_D.get(c, 1)} END * ' + ('1' if c == 'voice_intent' else 'spammed') + ' * thin')} AS {c}" for c in sorted(CATEGORIES))} FROM d""")
def damped_scores(spark, sf_dir):
    n = F.col
    rows = category_scores(spark, sf_dir).select("*", (n("p_size") % 40).alias("n_entities"), (n("p_partkey") % 1500 + 50).alias("word_count"), (n("p_partkey") % 30).alias("questions"), (n("p_partkey") % 6).alias("qa_pairs"), (n("p_size") % 9).alias("h2"),
                                                 (n("p_size") % 5).alias("h3"), (n("p_size") % 12).alias("n_paragraphs"), (n("p_partkey") % 25).alias("step_count"), (n("p_size") % 16).alias("n_nodes"), (n("p_partkey") % 10 / 10).alias("cross_links"),
                                                 (n("p_partkey") % 13 / 13).alias("authority"), (n("p_size") % 5 * F.lit(1.0)).alias("spam"), (n("p_partkey") % 9 / 9).alias("uniqueness"), (n("p_partkey") % 2 == 0).alias("has_organization"), (n("p_partkey") % 1500 < 250).alias("low_word_count"))
    kinds = ("entity", "faq", "heading", "step", "structured")
    out = site_metrics.damped(site_metrics.inflation(rows))
    return out.select("p_partkey", *[round2(n(f"{k}_inflation")).alias(f"{k}_inflation") for k in kinds], *[round2(n(c)).alias(c) for c in sorted(CATEGORIES)])


KEY = r"""lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)) || regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '')
|| CASE WHEN regexp_extract(url, '^[^?#]*\?([^#]*)', 1) = '' THEN '' ELSE '?' || regexp_extract(url, '^[^?#]*\?([^#]*)', 1) END"""


@query(f"""WITH p AS (SELECT min(page_id) AS page_id FROM pages GROUP BY {KEY})
SELECT p.page_id, CAST(CASE WHEN page_id % 3 = 0 THEN page_id % 100 END AS BIGINT) AS desktop_score, CAST(CASE WHEN page_id % 2 = 0 THEN page_id % 90 END AS BIGINT) AS mobile_score, CAST(CASE WHEN page_id % 5 = 0 THEN 7 END AS INTEGER) AS violations, 'tls' AS report FROM p""")
def page_companions(spark, sf_dir):
    """Pages with their performance on two devices (stored under the raw or the looked-up URL), headless findings and the site's one report."""
    rows = table(spark, sf_dir, "pages").groupBy(lookup_key(F.col("url")).alias("key")).agg(F.min(F.struct("page_id", "url")).alias("r"))
    p = rows.select("r.page_id", "r.url", "key")
    stored = F.when(F.col("page_id") % 4 == 0, F.col("url")).otherwise(F.col("key"))
    score = lambda device, every, most: p.filter(F.col("page_id") % every == 0).select(stored.alias("page_url"), F.lit(device).alias("device_type"), (F.col("page_id") % most).alias("performance_score"))
    headless = p.filter("page_id % 5 = 0").select(F.col("key").alias("url"), F.col("page_id").alias("at"), F.lit(7).alias("violations"))
    report = spark.createDataFrame([("x", "tls")], "project_id string, report string")
    out = tables.with_companions(p.select("page_id", "url", F.lit("x").alias("project_id")), score("desktop", 3, 100).unionByName(score("mobile", 2, 90)), headless, report)
    return out.select("page_id", "desktop_score", "mobile_score", "violations", "report")
