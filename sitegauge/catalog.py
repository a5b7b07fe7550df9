"""Registered queries of the library and their SQL.  Each runs over its whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sitegauge.functions import scores, text, urls
from sitegauge.operators import ai_rules, entities, graph, legacy_rules, rules, tables
from sitegauge.plans import page_analysis
from sitegauge.registered import content as _content, entities as _entities, extracts as _extracts, flows as _flows, keyed as _keyed, presence as _presence, scans as _scans, sites as _sites, texts as _texts  # noqa: F401
from sitegauge.registry import ORACLE_SQL, QUERIES, query  # noqa: F401
from sitegauge.sources.html import page_features, parse_pages
from sitegauge.sources.scratch import saved, shared_folder
from sitegauge.sources.signals import page_signals
from sitegauge.sources.tables import table


VISIBLE = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<(?:noscript|template)\b.*?</(?:noscript|template)\s*>', ' ', 'g')"""


def _stripped(expr: str) -> str:
    """SQL for sources.html.strip_tags of text without scripts."""
    out = rf"regexp_replace({expr}, '(?s)<[^>]*>', ' ', 'g')"
    for name, char in (("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        out = f"replace({out}, '{name}', '{char}')"
    return rf"trim(regexp_replace({out}, '\s+', ' ', 'g'))"


PAGE_CTE = rf"""p0 AS (SELECT page_id, url, {VISIBLE} AS v FROM pages),
p1 AS (SELECT page_id, url, v, coalesce(regexp_extract_all(v, '(?is)<meta\b[^>]*name\s*=\s*["'']description["''][^>]*>'), []) AS descriptions, regexp_extract(v, '(?is)<link\b[^>]*rel\s*=\s*["'']canonical["''][^>]*>', 0) AS canon, {_stripped("regexp_extract(v, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title, {_stripped("v")} AS body,
  list_transform(regexp_extract_all(v, '(?is)<h1\b[^>]*>(.*?)</h1\s*>', 1), lambda h: {_stripped("h")}) AS h1r FROM p0),
p2 AS (SELECT page_id, url, title, body, descriptions, canon, trim(coalesce(regexp_extract(descriptions[1], '(?is)content\s*=\s*["'']([^"'']*)["'']', 1), '')) AS description,
  list_transform(regexp_extract_all(v, '(?is)<h[1-6]\b'), lambda h: CAST(h[3] AS INTEGER)) AS levels, list_filter(h1r, lambda h: h <> '') AS h1s, len(list_filter(string_split(body, ' '), lambda w: w <> '')) AS word_count,
  regexp_extract(lower(url), '/contact|/support|/help', 0) <> '' OR (regexp_extract(lower(url), '/blog|/article|/post|/service|/solution|/about|/team', 0) = ''
  AND regexp_matches(lower(body), 'contact form|email us|get in touch|contact us')) AS contact FROM p1),
issues AS (
  SELECT page_id, url, 'title_missing' AS rule_id, 'high' AS severity FROM p2 WHERE title = ''
  UNION ALL SELECT page_id, url, 'meta_description_missing', 'high' FROM p2 WHERE description = ''
  UNION ALL SELECT page_id, url, 'multiple_meta_descriptions', 'medium' FROM p2 WHERE len(descriptions) > 1
  UNION ALL SELECT page_id, url, 'meta_description_too_short', 'medium' FROM p2 WHERE length(description) BETWEEN 1 AND 119
  UNION ALL SELECT page_id, url, 'meta_description_too_long', 'medium' FROM p2 WHERE length(description) > 158
  UNION ALL SELECT page_id, url, 'heading_hierarchy_skipped', 'medium' FROM p2 WHERE len(list_filter(range(1, len(levels)), lambda i: levels[i + 1] - levels[i] > 1)) > 0
  UNION ALL SELECT page_id, url, 'title_too_short', 'high' FROM p2 WHERE length(title) BETWEEN 1 AND 29
  UNION ALL SELECT page_id, url, 'title_too_long', 'medium' FROM p2 WHERE length(title) > 60
  UNION ALL SELECT page_id, url, 'h1_missing', 'high' FROM p2 WHERE len(h1s) = 0
  UNION ALL SELECT page_id, url, 'multiple_h1_tags', 'high' FROM p2 WHERE len(h1s) > 1
  UNION ALL SELECT page_id, url, 'thin_content', 'high' FROM p2 WHERE word_count < 300 AND NOT contact
  UNION ALL SELECT page_id, url, 'keyword_not_in_title', 'high' FROM p2 WHERE len(h1s) > 0 AND len(list_filter(string_split(h1s[1], ' '), lambda w: w <> '')) > 2 AND NOT contains(lower(title), lower(h1s[1])) AND NOT contact
  UNION ALL SELECT page_id, url, 'https_not_enforced', 'high' FROM p2 WHERE starts_with(url, 'http://')
  UNION ALL SELECT page_id, url, 'canonical_tag_errors', 'high' FROM p2 WHERE canon = ''
  UNION ALL SELECT page_id, url, 'noindex_on_admin_pages', 'high' FROM p2 WHERE regexp_matches(lower(url), '/admin|/login|/dashboard|/wp-admin|/wp-login'))"""
SCORE_CTE = PAGE_CTE + """,
counted AS (SELECT p2.page_id, p2.url, CAST(p2.word_count AS INTEGER) AS word_count, count_if(severity = 'high') AS high_issues, count_if(severity = 'medium') AS medium_issues, count(rule_id) AS issues
  FROM p2 LEFT JOIN issues USING (page_id) GROUP BY ALL),
scored AS (SELECT *, greatest(25.0, least(100.0, 100 - 15 * ln(1 + (high_issues * 3 + medium_issues * 2) / greatest(1.0, word_count / 300.0)))) AS score FROM counted)"""


@query(f"WITH {PAGE_CTE} SELECT page_id, url, rule_id, severity FROM issues")
def page_issues(spark, sf_dir):
    return page_analysis.page_issues(table(spark, sf_dir, "pages")).select("page_id", "url", "rule_id", "severity")


@query(f"WITH {SCORE_CTE} SELECT page_id, url, word_count, high_issues, medium_issues, issues, CAST(floor(score * 100 + 0.5) / 100 AS DOUBLE) AS page_score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END AS page_grade FROM scored")
def page_scores(spark, sf_dir):
    out = page_analysis.page_scores(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "word_count", "high_issues", "medium_issues", "issues", scores.round2(F.col("page_score")).alias("page_score"), "page_grade")


@query(f"WITH {SCORE_CTE} SELECT CAST(floor(avg(score) * 100 + 0.5) / 100 AS DOUBLE) AS site_score, count(*) AS n_pages FROM scored")
def site_score(spark, sf_dir):
    out = page_analysis.site_score(page_analysis.page_scores(table(spark, sf_dir, "pages")))
    return out.select(scores.round2(F.col("site_score")).alias("site_score"), "n_pages")


@query(f"WITH {SCORE_CTE} SELECT page_id, url, CAST(floor(score * 100 + 0.5) / 100 AS DOUBLE) AS page_score FROM scored ORDER BY score, page_id LIMIT 20")
def worst_pages(spark, sf_dir):
    out = page_analysis.page_scores(table(spark, sf_dir, "pages")).orderBy("page_score", "page_id").limit(20)
    return out.select("page_id", "url", scores.round2(F.col("page_score")).alias("page_score"))


@query(f"WITH {PAGE_CTE} SELECT rule_id, severity, count(*) AS n FROM issues GROUP BY ALL")
def issue_counts(spark, sf_dir):
    return page_analysis.page_issues(table(spark, sf_dir, "pages")).groupBy("rule_id", "severity").agg(F.count("*").alias("n"))


@query(f"""WITH {PAGE_CTE}, r AS (SELECT unnest(['multiple_meta_descriptions', 'multiple_title_tags', 'title_missing', 'meta_description_missing', 'title_too_short', 'title_too_long', 'meta_description_too_short', 'meta_description_too_long', 'h1_missing', 'multiple_h1_tags',
  'heading_hierarchy_skipped', 'thin_content', 'keyword_not_in_title', 'keyword_not_in_h1', 'duplicate_content', 'https_not_enforced', 'canonical_tag_errors', 'noindex_on_admin_pages']) AS rule_id),
k AS (SELECT CASE WHEN rule_id IN ('https_not_enforced', 'canonical_tag_errors', 'noindex_on_admin_pages') THEN 'Crawlability' ELSE 'Content' END AS category, rule_id FROM r),
f AS (SELECT category, count(*) AS failed FROM issues JOIN k USING (rule_id) GROUP BY 1), c AS (SELECT category, count(*) AS n_rules FROM k GROUP BY 1)
SELECT category, n_rules, coalesce(failed, 0) AS failed, n_rules * (SELECT count(*) FROM p2) - coalesce(failed, 0) AS passed FROM c LEFT JOIN f USING (category)""")
def rule_coverage(spark, sf_dir):
    features = saved(page_features(table(spark, sf_dir, "pages")))
    return rules.coverage(features, rules.evaluate(features, rules.content_rules()), rules.content_rules())


@query(r"""SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\.', '') AS domain,
regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS query FROM pages""")
def url_parts(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", urls.host(u).alias("host"), urls.registrable_domain(u).alias("domain"), urls.path(u).alias("path"), urls.query(u).alias("query"))


@query(r"""WITH q AS (SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS h, regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS p,
list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: contains(x, '=') AND NOT regexp_matches(lower(regexp_extract(x, '^([^=]*)=', 1)), 'utm_|fbclid|gclid|msclkid|campaign|source|medium')) AS kept FROM pages)
SELECT page_id, 'https://' || h || CASE WHEN p = '' THEN '/' ELSE p END || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS normalized FROM q""")
def url_normalized(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.normalize_url(F.col("url")).alias("normalized"))


@query(r"""SELECT page_id, CASE WHEN regexp_matches(lower(url), '/pages/|/services/|/service/|/about|/contact') THEN 'main' WHEN contains(lower(url), '/collections/') THEN 'collection' WHEN contains(lower(url), '/products/') THEN 'product'
WHEN contains(lower(url), '/blogs/') THEN 'blog' ELSE 'other' END AS url_type, CASE WHEN contains(lower(url), 'service') THEN 'service' WHEN regexp_matches(lower(url), 'blog|post') THEN 'blog' WHEN regexp_matches(lower(url), 'page|standard') THEN 'main'
WHEN contains(lower(url), 'category') THEN 'category' ELSE 'other' END AS sitemap_type FROM pages""")
def url_types(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.url_type(F.col("url")).alias("url_type"), urls.sitemap_type(F.col("url")).alias("sitemap_type"))


@query(r"""WITH u AS (SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS h, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS p, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS q FROM pages)
SELECT page_id, 'https://' || regexp_replace(h, '^www\.', '') || regexp_replace(lower(p), '/+$', '') AS bare, CASE WHEN p = '/' THEN 'https://' || h || p || CASE WHEN q = '' THEN '' ELSE '?' || q END ELSE regexp_replace('https://' || h || p || CASE WHEN q = '' THEN '' ELSE '?' || q END, '/+$', '') END AS sitemap_form, regexp_replace(h, '^www\.', '') AS domain,
'https://' || h || '/a/c/x' || CASE page_id % 2 WHEN 0 THEN '' ELSE '/' END AS dotted, 'https://' || h || '/a/k' AS target FROM u""")
def url_forms(spark, sf_dir):
    u = F.regexp_replace("url", "^http://", "https://")
    base = F.concat(F.regexp_extract(u, "^([a-z]+://[^/?#]*)", 1), F.lit("/a/b/page.html"))
    dotted = urls.resolve_link(base, F.when(F.col("page_id") % 2 == 0, "../c/./x").otherwise("../c/x/."))
    return table(spark, sf_dir, "pages").select("page_id", urls.bare_url(u).alias("bare"), urls.sitemap_url(u).alias("sitemap_form"), urls.plain_domain(u).alias("domain"), dotted.alias("dotted"), urls.link_target(base, F.lit("../%6B/?q=1#f")).alias("target"))


@query(r"""WITH t AS (SELECT url, CASE WHEN regexp_matches(lower(url), '/pages/|/services/|/service/|/about|/contact') THEN 1 WHEN contains(lower(url), '/collections/') THEN 2 WHEN contains(lower(url), '/products/') THEN 3 WHEN contains(lower(url), '/blogs/') THEN 4 ELSE 5 END AS r FROM pages)
SELECT url, ['main', 'collection', 'product', 'blog', 'other'][r] AS url_type FROM t ORDER BY r, regexp_replace(trim(lower(url)), '/+$', ''), url LIMIT 25""")
def url_selection(spark, sf_dir):
    return tables.select_urls(table(spark, sf_dir, "pages"), 25)


LINKS = rf"""l0 AS (SELECT url AS src, unnest(regexp_extract_all({VISIBLE}, '(?is)<a\b[^>]*\shref\s*=\s*["'']([^"'']+)["'']', 1)) AS href FROM pages), l1 AS (SELECT src, href FROM l0 WHERE NOT regexp_matches(href, '^(#|mailto:|tel:|javascript:|ftp:|file:)'))"""


@query(f"WITH {LINKS} SELECT src, count(*) AS n_links, count(DISTINCT href) AS n_targets, count_if(starts_with(href, '/')) AS n_rooted FROM l1 GROUP BY src")
def page_links(spark, sf_dir):
    pages = page_features(table(spark, sf_dir, "pages")).select(F.col("url").alias("src"), F.explode("links").alias("href")).filter(~F.col("href").rlike(urls.SKIPPED_LINKS))
    return pages.groupBy("src").agg(F.count("*").alias("n_links"), F.count_distinct("href").alias("n_targets"), F.count_if(F.col("href").startswith("/")).alias("n_rooted"))


@query(r"SELECT regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\.', '') AS domain, count(*) AS n, bool_or(starts_with(url, 'https')) AS any_https FROM pages GROUP BY 1")
def domain_distribution(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(urls.registrable_domain(F.col("url")).alias("domain")).agg(F.count("*").alias("n"), F.bool_or(F.col("url").startswith("https")).alias("any_https"))


@query("SELECT md5(substring(coalesce(text, ''), 1, 1000)) AS content_hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_hash_duplicates(spark, sf_dir):
    h = text.content_hash(F.lit(""), F.lit(""), F.col("text"))
    return table(spark, sf_dir, "documents").groupBy(h.alias("content_hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


@query(r"""SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '[ \t\n\r\f\v]+'), lambda w: w <> '')) AS INTEGER) AS n_words, CAST(len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: trim(s) <> '')) AS INTEGER) AS n_sentences,
CAST(len(text) AS INTEGER) AS n_characters FROM documents""")
def text_metrics(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", text.word_count(t).alias("n_words"), F.size(text.sentences(t)).alias("n_sentences"), F.length(t).alias("n_characters"))


@query(r"""WITH w AS (SELECT word, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\pL+')) AS word FROM documents) WHERE length(word) > 3 GROUP BY word)
SELECT word, n, n_docs FROM w ORDER BY n DESC, word LIMIT 100""")
def top_words(spark, sf_dir):
    """Documents are counted for the 100 words alone, so the pairs of word and document that move are 100 for a document at most."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{4,}"), F.lit(0)).alias("words"))
    top = docs.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(100)
    found = docs.join(F.broadcast(top.agg(F.collect_list("word").alias("top")))).select("doc_id", F.explode(F.array_intersect("words", "top")).alias("word"))
    return top.join(found.groupBy("word").agg(F.count_distinct("doc_id").alias("n_docs")), "word").select("word", "n", "n_docs").orderBy(F.desc("n"), "word")


@query("""SELECT conv_id, turn, CASE WHEN regexp_matches(lower(coalesce(text, '')), 'buy|price|cost|cheap|best|review|deal|discount') THEN 'commercial' WHEN regexp_matches(lower(coalesce(text, '')), 'login|website|official|contact|near me') THEN 'navigational' ELSE 'informational' END AS intent FROM conversations""")
def turn_intents(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.keyword_intent(F.col("text")).alias("intent"))


@query("""WITH t AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
s AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '')) AS a, list_distinct(list_filter(regexp_split_to_array(lower(answer), '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '')) AS b FROM t WHERE role = 'user' AND next_role = 'assistant')
SELECT conv_id, turn, CAST(len(list_intersect(a, b)) AS INTEGER) AS shared, CAST(len(list_distinct(list_concat(a, b))) AS INTEGER) AS united FROM s""")
def question_answer_overlap(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations").withColumns({"next_role": F.lead("role").over(w), "answer": F.lead("text").over(w)}).filter("role = 'user' and next_role = 'assistant'")
    a, b = (F.array_distinct(text.words(F.lower(c))) for c in ("text", "answer"))
    return turns.select("conv_id", "turn", F.size(F.array_intersect(a, b)).alias("shared"), F.size(F.array_union(a, b)).alias("united"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM r WHERE n = 1""")
def latest_by_key(spark, sf_dir):
    out = tables.latest(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey")
    return out.select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")


@query("""WITH c AS (SELECT l_orderkey AS k, 'shipped' AS status, 2 AS created_at FROM lineitem GROUP BY 1) SELECT k, coalesce(c.status, o_orderstatus) AS status, CASE WHEN o_orderkey IS NOT NULL THEN 1 ELSE 2 END AS created_at FROM orders FULL JOIN c ON o_orderkey = k""".replace("SELECT k,", "SELECT coalesce(o_orderkey, k) AS k,"))
def keyed_upsert(spark, sf_dir):
    """All orders, with those that have line items as changes."""
    target = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), F.lit(1).alias("created_at"))
    changes = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")).distinct().select("k", F.lit("shipped").alias("status"), F.lit(2).alias("created_at"))
    return tables.upsert(target, changes, ["k"])


@query("SELECT c_custkey, c_name, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has_orders FROM customer")
def semi_anti_members(spark, sf_dir):
    customer, orders = table(spark, sf_dir, "customer").select("c_custkey", "c_name"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return customer.join(orders, "c_custkey", "left_semi").withColumn("has_orders", F.lit(True)).unionByName(customer.join(orders, "c_custkey", "left_anti").withColumn("has_orders", F.lit(False)))


@query("SELECT o_custkey, max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS f, max(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS o FROM orders GROUP BY o_custkey")
def pivot_by_status(spark, sf_dir):
    out = table(spark, sf_dir, "orders").groupBy("o_custkey").pivot("o_orderstatus", ["F", "O"]).agg(F.max("o_totalprice"))
    return out.select("o_custkey", F.col("F").alias("f"), F.col("O").alias("o"))


@query("""WITH a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g FROM events)
SELECT user_id, event_type, min(event_id) AS first_event, count(*) AS run FROM a GROUP BY user_id, event_type, g HAVING count(*) >= 3""")
def event_runs(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    n = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("ts", "event_id"))
    return e.withColumn("g", n("user_id", "event_type") - n("user_id")).groupBy("user_id", "event_type", "g").agg(F.min("event_id").alias("first_event"), F.count("*").alias("run")).filter("run >= 3").drop("g")


@query("SELECT o_custkey, o_orderdate, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 1")
def duplicate_key_audit(spark, sf_dir):
    return tables.duplicate_keys(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate")


@query(r"""SELECT page_id, CAST(len(regexp_extract_all(coalesce(html, ''), '(?i)"@type"')) AS INTEGER) AS entities FROM pages""")
def page_entities(spark, sf_dir):
    """The number of entities in each page's JSON-LD."""
    return page_features(table(spark, sf_dir, "pages")).select("page_id", F.size(entities.graph(F.col("jsonld"))).alias("entities"))


@query()
def all_issues(spark, sf_dir):
    """The whole rule catalog, with link graph and copies."""
    return page_analysis.full_analysis(table(spark, sf_dir, "pages"), shared_folder(spark))


@query()
def shipped_issues(spark, sf_dir):
    """Issues under the shipped wiring, which drops many signals before the rules read them."""
    return rules.shipped_issues(saved(page_signals(table(spark, sf_dir, "pages"))))


KEY = r"""lower(regexp_extract({0}, '^([A-Za-z][A-Za-z0-9+.-]*://)', 1)) || lower(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) || regexp_replace(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '')
|| CASE WHEN regexp_extract({0}, '^[^?#]*\?([^#]*)', 1) = '' THEN '' ELSE '?' || regexp_extract({0}, '^[^?#]*\?([^#]*)', 1) END""".format


@query(rf"""WITH RECURSIVE {LINKS}, n AS (SELECT url, {KEY('url')} AS key, lower(regexp_extract(url, '//([^/?#]*)', 1)) AS host, regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') = '' AS home FROM pages),
e0 AS (SELECT src, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href ELSE regexp_extract(src, '^([A-Za-z]+://[^/?#]*)', 1) || CASE WHEN href LIKE '/%' THEN href ELSE '/' || href END END AS dst FROM l1),
e AS (SELECT {KEY('src')} AS src, {KEY("regexp_replace(dst, '#.*$', '')")} AS dst FROM e0), x AS (SELECT DISTINCT src, dst FROM e JOIN (SELECT DISTINCT key, host FROM n) a ON a.key = src JOIN (SELECT DISTINCT key, host FROM n) b ON b.key = dst WHERE a.host = b.host AND src <> dst),
d AS (SELECT min(key) AS key, 0 AS depth FROM n WHERE home GROUP BY host UNION SELECT x.dst, depth + 1 FROM d JOIN x ON x.src = d.key WHERE depth < 60), m AS (SELECT key, min(depth) AS depth FROM d GROUP BY key),
i AS (SELECT dst AS key, count(*) AS c FROM e GROUP BY 1), o AS (SELECT src AS key, count(*) AS c FROM e GROUP BY 1)
SELECT url, coalesce(i.c, 0) AS inbound_links, coalesce(o.c, 0) AS outbound_links, CAST(coalesce(depth, -1) AS INTEGER) AS click_depth, i.c IS NULL AND NOT home AS is_orphan FROM n LEFT JOIN i USING (key) LEFT JOIN o USING (key) LEFT JOIN m USING (key)""")
def crawl_graph(spark, sf_dir):
    return graph.crawl_graph(page_features(table(spark, sf_dir, "pages")).select("url", "links"), shared_folder(spark))


@query()
def ai_page_scores(spark, sf_dir):
    return ai_rules.page_scores(saved(ai_rules.features(page_features(table(spark, sf_dir, "pages")))))


@query()
def ai_score_issues(spark, sf_dir):
    return ai_rules.score_issues(ai_rules.rule_scores(saved(ai_rules.features(page_features(table(spark, sf_dir, "pages"))))))


@query()
def legacy_page_scores(spark, sf_dir):
    """Categories of the older rule pack."""
    out = legacy_rules.legacy_categories(saved(legacy_rules.legacy_features(page_signals(table(spark, sf_dir, "pages")))), "page_id", "url")
    return out.select("page_id", "url", *[scores.round2(F.col(c)).alias(c) for c in out.columns[2:]])


@query(rf"""WITH p0 AS (SELECT page_id, url, html, {VISIBLE} AS v FROM pages), p AS (SELECT page_id, url, html, v, {_stripped("v")} AS body, regexp_extract_all(v, '(?is)<a\b[^>]*>(.*?)</a\s*>', 1) AS a, regexp_extract_all(v, '(?is)<p\b[^>]*>(.*?)</p\s*>', 1) AS ps FROM p0),
q AS (SELECT page_id, url, html, v, strlen(coalesce(html, '')) AS hb, strlen(body) AS tb, list_transform(a, lambda t: {_stripped("t")}) AS texts, list_filter(list_transform(ps, lambda t: {_stripped("t")}), lambda t: t <> '') AS paras FROM p)
SELECT page_id, CAST(hb AS INTEGER) AS html_bytes, CAST(tb AS INTEGER) AS text_bytes, CAST(floor(tb * 100 / hb * 100 + 0.5) / 100 AS DOUBLE) AS html_ratio, CAST(len(texts) AS INTEGER) AS n_anchors, CAST(len(paras) AS INTEGER) AS n_paragraphs,
CAST(floor(coalesce(len(list_filter(texts, lambda t: length(t) < 3 OR regexp_matches(lower(t), 'click here|read more|learn more|here|more|link|page|website|site|url|download'))) * 100 / nullif(len(texts), 0), 0) * 100 + 0.5) / 100 AS DOUBLE) AS generic_anchor_ratio,
len(list_filter(texts, lambda t: t <> '')) >= 5 AND len(list_distinct(list_transform(list_filter(texts, lambda t: t <> ''), lambda t: lower(t)))) * 2 < len(list_filter(texts, lambda t: t <> '')) AS anchor_diversity_issue,
url LIKE 'https://%' AND regexp_matches(regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->', ' ', 'g'), '(?i)<(?:(?:img|script|iframe|video|audio)\b[^>]*\ssrc|link\b[^>]*\shref)\s*=\s*["'']?http://') AS mixed_content,
len(list_filter(regexp_extract_all(v, '(?is)<iframe\b[^>]*>'), lambda t: regexp_matches(lower(t), '\swidth\s*=\s*["'']?(100%|100vw|1000px|1200px|1920px)["''\s>]') AND regexp_matches(lower(t), '\sheight\s*=\s*["'']?(100%|100vh|800px|900px|1080px)["''\s>]'))) > 0 AS iframe_wrapped FROM q""")
def page_signal_values(spark, sf_dir):
    out = page_signals(table(spark, sf_dir, "pages"))
    return out.select("page_id", "html_bytes", "text_bytes", scores.round2(F.col("html_ratio")).alias("html_ratio"), F.size("anchors").alias("n_anchors"), F.size("paragraphs").alias("n_paragraphs"),
                      scores.round2(F.col("generic_anchor_ratio")).alias("generic_anchor_ratio"), "anchor_diversity_issue", "mixed_content", "iframe_wrapped")


@query(rf"""WITH p AS (SELECT page_id, url, {VISIBLE} AS v FROM pages)
SELECT page_id, url, {_stripped("regexp_extract(v, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title, regexp_extract(v, '(?i)<html[^>]*\slang="([^"]*)"', 1) AS html_lang,
coalesce(regexp_extract(list_filter(regexp_extract_all(v, '(?is)<link\b[^>]*>'), lambda t: regexp_matches(lower(t), '\srel\s*=\s*["'']?canonical["''\s>]'))[1], '(?i)\shref\s*=\s*["'']?([^"''\s>]+)', 1), '') AS canonical,
CAST(len(regexp_extract_all(v, '(?i)<a\s[^>]*href=')) AS INTEGER) AS n_links, CAST(len(regexp_extract_all(v, '(?is)<h[1-6]\b')) AS INTEGER) AS n_headings, CAST(len(list_filter(string_split({_stripped("v")}, ' '), lambda w: w <> '')) AS INTEGER) AS word_count FROM p""")
def html_features(spark, sf_dir):
    """Page features by the parser."""
    return parse_pages(table(spark, sf_dir, "pages")).select("page_id", "url", "title", "html_lang", "canonical", F.size("links").alias("n_links"), F.size("headings").alias("n_headings"), "word_count")
