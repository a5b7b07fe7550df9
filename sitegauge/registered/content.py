"""Queries of the DOM tree: over the crawled pages, and over product pages that Spark renders from the part table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitegauge.functions import pages
from sitegauge.operators import content, page_types
from sitegauge.operators.schema_repair import entity_graph
from sitegauge.registry import query
from sitegauge.sources.signals import page_signals
from sitegauge.sources.tables import spread, table

STRINGS = r"list_filter(list_transform(string_split(regexp_replace({0}, '(?s)<(script|style)\b.*?</(?:script|style)>|<!--.*?-->|<[^>]*>', chr(1), 'g'), chr(1)), lambda x: regexp_replace(replace(replace(replace(replace(replace(regexp_replace(x, '&amp;?', '&', 'g'), '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '^\s+|\s+$', '', 'g')), lambda x: x <> '')".format


@query(rf"""WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), a AS (SELECT page_id, {STRINGS(r"regexp_extract(h, '(?s)<article>(.*?)</article>', 1)")} AS article,
{STRINGS(r"regexp_replace(regexp_extract(h, '(?s)<body>(.*)</body>', 1), '(?s)<(nav|footer)>.*?</(?:nav|footer)>', '', 'g')")} AS body FROM p)
SELECT page_id, CASE WHEN length(array_to_string(article, '')) > 100 THEN 'article' ELSE 'body' END AS selector, left(array_to_string(CASE WHEN length(array_to_string(article, '')) > 100 THEN article ELSE body END, ' '), 5000) AS text FROM a""")
def page_main_content(spark, sf_dir):
    return content.with_dom(table(spark, sf_dir, "pages"), "unmeasured", "removed", "content").select("page_id", content.main_content(F.col("dom")).alias("m")).select("page_id", "m.selector", "m.text")


@query(rf"""WITH p AS (SELECT page_id, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS h FROM pages), b AS (SELECT page_id, {STRINGS("h")} AS s, string_split(h, '<b>') AS parts FROM p),
k AS (SELECT page_id, s, parts, coalesce(list_filter(range(2, len(parts) + 1), lambda i: length(array_to_string({STRINGS("array_to_string(parts[i:], '<b>')")}, '')) < 30)[1], len(parts) + 1) AS k FROM b)
SELECT page_id, 'article' AS container, CAST(length(array_to_string(s, '')) AS INTEGER) AS chars, CASE WHEN length(array_to_string(s, '')) < 30 THEN '' ELSE array_to_string({STRINGS("array_to_string(parts[1:k - 1], '<b>')")}, ' ') END AS text FROM k""")
def page_clean_content(spark, sf_dir):
    """Articles hold headings, paragraphs and bold elements that are never closed: the last ones go where they have under 30 characters."""
    return content.with_dom(table(spark, sf_dir, "pages"), "noise").select("page_id", content.clean_content(F.col("dom")).alias("c")).select("page_id", "c.container", "c.chars", "c.text")


@query(r"""WITH o AS (SELECT o_custkey, CAST(left(o_orderpriority, 1) AS INTEGER) AS level, o_orderstatus AS text, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS place FROM orders),
u AS (SELECT a.o_custkey, a.place, max(b.place) AS parent FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND b.place < a.place AND b.level < a.level GROUP BY ALL), f AS (SELECT a.o_custkey, a.place, min(b.place) AS first_at FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND b.place < a.place AND b.text = a.text GROUP BY ALL)
SELECT o.o_custkey, o.place, o.level, o.text, u.parent, b.level AS parent_level, f.first_at, CAST(greatest(0, coalesce(o.level - lag(o.level) OVER (PARTITION BY o.o_custkey ORDER BY o.place) - 1, 0)) AS INTEGER) AS n_skipped
FROM o LEFT JOIN u ON u.o_custkey = o.o_custkey AND u.place = o.place LEFT JOIN o b ON b.o_custkey = o.o_custkey AND b.place = u.parent LEFT JOIN f ON f.o_custkey = o.o_custkey AND f.place = o.place""")
def heading_parents(spark, sf_dir):
    """A customer's orders as an outline: the priority is the level, the status the heading."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", F.left("o_orderpriority", F.lit(1)).cast("int").alias("level"), F.col("o_orderstatus").alias("text")))).alias("h"))
    heads = o.select("o_custkey", F.explode(content.heading_tree(F.transform("h", lambda x: F.struct(x["level"].alias("level"), x["text"].alias("text"))))).alias("t"))
    return heads.select("o_custkey", "t.place", "t.level", "t.text", "t.parent", "t.parent_level", "t.first_at", F.size("t.skipped").alias("n_skipped"))


@query(rf"""WITH p AS (SELECT page_id, coalesce(html, '') AS h, regexp_extract(coalesce(html, ''), '(?s)<nav>(.*?)</nav>', 1) AS nav FROM pages), l AS (SELECT page_id, regexp_extract_all(nav, '(?s)<a href="([^"]*)">', 1) AS links, list_transform(regexp_extract_all(nav, '(?s)<a href="[^"]*">(.*?)</a>', 1), lambda x: regexp_replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g')) AS names,
floor(len(regexp_extract_all(regexp_replace(h, '(?s)<!--.*?-->|(<script)>.*?</script>', '\1', 'g'), '<[a-z]')) * 0.3) AS top, len(regexp_extract_all(regexp_extract(h, '(?s)^(.*?)<ul>', 1), '<[a-z]')) AS position FROM p)
SELECT page_id, CAST(CASE WHEN ok THEN 3 ELSE 0 END AS INTEGER) AS way, array_to_string(CASE WHEN ok THEN names ELSE [] END, '|') AS names, array_to_string(CASE WHEN ok THEN links ELSE [] END, '|') AS links FROM (SELECT *, len(list_distinct(links)) >= 2 AND position <= top AS ok FROM l)""")
def page_trails(spark, sf_dir):
    """The crawled pages have no labelled breadcrumbs: their first list of links counts where it stands early enough."""
    out = content.with_dom(table(spark, sf_dir, "pages"), "frame").select("page_id", content.dom_trail(F.col("dom")).alias("t"))
    return out.select("page_id", "t.way", F.array_join("t.names", "|").alias("names"), F.array_join("t.links", "|").alias("links"))


def product_pages(spark, sf_dir) -> DataFrame:
    """A page for each part: a product with an offer inside, the brand's RDFa item, and media in and outside figures."""
    c = F.col
    html = F.concat(
        F.lit('<body><header><img src="/logo.png" alt="logo" width="90" height="30"></header><main itemscope itemtype="https://schema.org/Product" itemid="'), c("p_partkey"), F.lit('"><h1 itemprop="name">'), c("p_name"),
        F.lit('</h1><span itemprop="category keywords">'), c("p_type"), F.lit('</span><div itemprop="offers" itemscope itemtype="https://schema.org/Offer"><meta itemprop="price" content="'), c("p_retailprice").cast("string"),
        F.lit('"><link itemprop="url" href="/buy/'), c("p_partkey"), F.lit('"></div><div vocab="https://schema.org/" typeof="Brand"><b property="name">'), c("p_brand"), F.lit('</b></div><figure><video src="/v/'), c("p_partkey"),
        F.lit('.mp4">'), F.when(c("p_size") > 25, '<track kind="captions">').otherwise(""), F.lit("</video><figcaption>Size <i>"), c("p_size"), F.lit("</i></figcaption>"),
        F.when(c("p_size") % 2 == 0, '<a href="/transcript">read</a>').otherwise(""), F.lit('</figure><img itemprop="image" src="/i/'), c("p_partkey"), F.lit('.jpg" alt="'), c("p_brand"), F.lit('" width="'), c("p_size") * 20, F.lit('" height="300"></main>'))
    return spread(table(spark, sf_dir, "part")).select("p_partkey", html.alias("html"))


@query("""WITH i AS (SELECT p_partkey, 'microdata' AS format, 1 AS n, 'Product' AS type, NULL AS parent_property, map_from_entries([('category', [p_type]), ('image', ['/i/' || p_partkey || '.jpg']), ('keywords', [p_type]), ('name', [p_name])]) AS m FROM part
UNION ALL SELECT p_partkey, 'microdata', 2, 'Offer', 'offers', map_from_entries([('price', [CAST(p_retailprice AS VARCHAR)]), ('url', ['/buy/' || p_partkey])]) FROM part UNION ALL SELECT p_partkey, 'rdfa', 3, 'Brand', NULL, map_from_entries([('name', [p_brand])]) FROM part)
SELECT p_partkey, format, type, parent_property, array_to_string(list_transform(map_entries(m), lambda e: e.key || '=' || array_to_string(e.value, ';')), '&') AS properties FROM i""")
def product_items(spark, sf_dir):
    items = content.structured_items(content.with_dom(product_pages(spark, sf_dir), "item", "typed", "vocab"), "p_partkey")
    shown = F.transform(F.filter(F.map_entries("properties"), lambda e: e["key"] != "offers"), lambda e: F.concat_ws("=", e["key"], F.array_join(e["value"], ";")))
    return items.select("p_partkey", "format", F.array_join("types", " ").alias("type"), "parent_property", F.array_join(F.array_sort(shown), "&").alias("properties"))


@query("""SELECT p_partkey, kind, src, caption, captions, transcript, role FROM (SELECT p_partkey, p_size, unnest([{'kind': 'img', 'src': '/logo.png', 'caption': '', 'captions': false, 'transcript': false, 'role': 'logo'},
{'kind': 'video', 'src': '/v/' || p_partkey || '.mp4', 'caption': 'Size ' || p_size, 'captions': p_size > 25, 'transcript': p_size % 2 = 0, 'role': 'video'},
{'kind': 'img', 'src': '/i/' || p_partkey || '.jpg', 'caption': '', 'captions': false, 'transcript': false, 'role': CASE WHEN p_size * 20 >= 300 THEN 'hero' ELSE 'content' END}], recursive := true) FROM part)""")
def product_media(spark, sf_dir):
    return content.media(content.with_dom(product_pages(spark, sf_dir), "figure", "bar"), "p_partkey").select("p_partkey", "kind", "src", "caption", "captions", "transcript", "role")


@query("""WITH t AS (SELECT conv_id, turn, list_filter(string_split(lower(text), ' '), lambda x: x <> '')[1:6] AS w FROM conversations), p AS (SELECT a.conv_id, a.turn, a.w AS x, b.w AS y FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
s AS (SELECT conv_id, turn, x, y, unnest(range(0, 1 << len(x))) AS m FROM p)
SELECT conv_id, turn, CAST(max(bit_count(m)) AS INTEGER) AS in_order FROM s WHERE list_reduce([chr(1) || array_to_string(y, chr(1)) || chr(1)] || list_filter(x, lambda v, i: (m >> (i - 1)) & 1 = 1),
lambda a, v: CASE WHEN instr(a, chr(1) || v || chr(1)) > 0 THEN substring(a, instr(a, chr(1) || v || chr(1)) + 1 + length(v)) ELSE '' END) <> '' GROUP BY ALL""")
def turn_alignment(spark, sf_dir):
    """Longest common subsequence of the first six words of each turn and the next; the SQL tries every choice of words."""
    opening = F.slice(F.filter(F.split(F.lower("text"), " "), lambda w: w != ""), 1, 6)
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", opening.alias("w"))
    turns = turns.withColumn("next", F.lead("w").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("next is not null")
    return turns.select("conv_id", "turn", content.in_order(F.col("w"), F.col("next")).alias("in_order"))


def typed_pages(spark, sf_dir) -> DataFrame:
    """typed_sources with the DOM tree."""
    return content.with_dom(typed_sources(spark, sf_dir), "bar")


def typed_sources(spark, sf_dir) -> DataFrame:
    """A page for each part, of a type by its key: service, product, article, questions, data set, plain page, and one without a schema."""
    c, k = F.col, F.col("p_partkey")
    one = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    block = (F.when(k % 7 == 0, one('{"@graph":[{"@type":"Service","name":"', c("p_name"), '","areaServed":["', c("p_brand"), '"],"offers":{"price":', c("p_size"), '}},{"@type":"Organization","name":"', c("p_brand"), '"},{"@type":"Offer","serviceType":"', c("p_type"), '"}]}'))
             .when(k % 7 == 1, one('{"@type":["Thing","Product"],"sku":', k, ',"brand":{"name":"', c("p_brand"), '"},"color":"x"}'))
             .when(k % 7 == 2, one('[{"@type":"Person","name":"P"},{"@type":"Article","headline":null,"datePublished":"2024-01-0', c("p_size") % 9 + 1, '"}]'))
             .when(k % 7 == 3, one('{"@type":"FAQPage","mainEntity":[{"@type":"Question","name":"What is ', c("p_name"), '?","acceptedAnswer":{"text":"A ', c("p_type"), '."}},{"@type":"Question","name":"Why?","suggestedAnswer":[{"text":"One"},{"text":"two"}]},{"@type":"Question","name":"No answer"}]}'))
             .when(k % 7 == 4, one('{"@type":"Dataset","license":"', c("p_brand"), '","distribution":[{"size":', c("p_size"), "}]}")).when(k % 7 == 5, one('{"@type":"WebPage","name":"', c("p_name"), '","about":{"k":', c("p_size"), '},"extra":1}')))
    html = one("<html><head><title>T ", k, '</title></head><body><h1>Head <b>', c("p_name"), '</b></h1><p class="post-byline byline">By ', c("p_brand"), "</p><p>What is ", c("p_name"), "? A ", c("p_type"), ".</p><p>Why? One two</p></body></html>")
    return spread(table(spark, sf_dir, "part")).select("p_partkey", "p_size", F.array_compact(F.array(block)).alias("jsonld"), html.alias("html"), F.concat(F.lit("T "), k.cast("string")).alias("title"), F.create_map().cast("map<string, array<string>>").alias("metas"),
                                               one("Head ", c("p_name"), " By ", c("p_brand"), " What is ", c("p_name"), "? A ", c("p_type"), ". Why? One two").alias("text"))


@query("""WITH p AS (SELECT *, p_partkey % 7 AS m FROM part)
SELECT p_partkey, CASE m WHEN 0 THEN 'Service' WHEN 1 THEN 'Product' WHEN 2 THEN 'Article' WHEN 3 THEN 'FAQPage' WHEN 4 THEN 'Dataset' ELSE 'WebPage' END AS detected_type, CAST(CASE m WHEN 1 THEN 0.8 WHEN 6 THEN 0.5 ELSE 1 END AS DOUBLE) AS confidence,
CASE m WHEN 0 THEN 'areaServed=["' || p_brand || '"]|offers=[{"price":' || p_size || '},{"@type":"Offer","serviceType":"' || p_type || '"}]|provider={"@type":"Organization","name":"' || p_brand || '"}|serviceType="' || p_type || '"'
WHEN 1 THEN 'brand={"name":"' || p_brand || '"}|sku=' || p_partkey WHEN 2 THEN 'author="By ' || p_brand || '"|datePublished="2024-01-0' || (p_size % 9 + 1) || '"|headline="Head ' || p_name || '"'
WHEN 4 THEN 'distribution=[{"size":' || p_size || '}]|license="' || p_brand || '"' WHEN 5 THEN 'about={"k":' || p_size || '}|name="' || p_name || '"' ELSE '' END AS properties,
CASE m WHEN 3 THEN 'What is ' || p_name || '?=A ' || p_type || '.|Why?=One two' ELSE '' END AS questions, m = 3 AS questions_shown FROM p""")
def page_type_facts(spark, sf_dir):
    out = page_types.page_types(typed_pages(spark, sf_dir), "p_partkey")
    named = F.transform(F.array_sort(F.map_entries("properties")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return out.select("p_partkey", "detected_type", "confidence", F.array_join(named, "|").alias("properties"), F.array_join(F.transform("questions", lambda q: F.concat_ws("=", q["question"], q["answer"])), "|").alias("questions"), "questions_shown")


SHAPES = {(1, "Product"): "`@type`: ARRAY<STRING>, brand: OBJECT<name: STRING>, color: STRING, sku: BIGINT", (1, "Thing"): "`@type`: ARRAY<STRING>, brand: OBJECT<name: STRING>, color: STRING, sku: BIGINT",
          (4, "Dataset"): "`@type`: STRING, distribution: ARRAY<OBJECT<size: BIGINT>>, license: STRING", (5, "WebPage"): "`@type`: STRING, about: OBJECT<k: BIGINT>, extra: BIGINT, name: STRING",
          (0, "Service"): "`@type`: STRING, areaServed: ARRAY<STRING>, name: STRING, offers: OBJECT<price: BIGINT>", (0, "Organization"): "`@type`: STRING, name: STRING", (0, "Offer"): "`@type`: STRING, serviceType: STRING",
          (2, "Person"): "`@type`: STRING, name: STRING", (2, "Article"): "`@type`: STRING, datePublished: STRING, headline: VOID",
          (3, "FAQPage"): "`@type`: STRING, mainEntity: ARRAY<OBJECT<`@type`: STRING, acceptedAnswer: OBJECT<text: STRING>, name: STRING, suggestedAnswer: ARRAY<OBJECT<text: STRING>>>>"}


@query(" UNION ALL ".join(f"SELECT '{t}' AS type, count(*) AS entities, 'OBJECT<{shape}>' AS shape FROM part WHERE p_partkey % 7 = {m}" for (m, t), shape in SHAPES.items()))
def entity_shapes(spark, sf_dir):
    return page_types.schema_shapes(typed_sources(spark, sf_dir))


@query(rf"""WITH p AS (SELECT page_id, coalesce(html, '') AS h, regexp_extract(coalesce(html, ''), '(?s)<nav>(.*?)</nav>', 1) AS nav FROM pages), c AS (SELECT page_id, len(regexp_extract_all(h, '<(?:p|h1|ul)>')) AS blocks, list_transform(regexp_extract_all(nav, '(?s)<li>(.*?)</li>', 1), lambda x: array_to_string({STRINGS('x')}, '')) AS li,
array_to_string({STRINGS(r"regexp_extract(h, '(?s)<h1>(.*?)</h1>', 1)")}, '') AS h1 FROM p)
SELECT page_id, CAST(blocks AS INTEGER) AS blocks, CAST(floor(blocks * 0.3) AS INTEGER) AS top, CAST(len(li[1:10]) AS INTEGER) AS items, array_to_string(list_transform(li[1:3], lambda x: left(x, 50)), '|') AS shown,
CASE WHEN regexp_matches(lower(h1), '\?$|^(who|what|when|where|why|how|is|are|can|should|will) ') THEN h1 ELSE '' END AS questions FROM c""")
def page_snippets(spark, sf_dir):
    s = content.with_dom(table(spark, sf_dir, "pages"), "frame").select("page_id", content.snippet_signals(F.col("dom")).alias("s"))
    first = F.try_element_at(F.col("s.lists"), F.lit(1))
    return s.select("page_id", "s.blocks", "s.top", first["items"].alias("items"), F.array_join(first["shown"], "|").alias("shown"), F.array_join(F.transform("s.questions", lambda q: q["text"]), "|").alias("questions"))


@query(rf"""WITH t AS (SELECT page_id, regexp_extract(html, '<html lang="([^"]*)"', 1) AS html_lang, array_to_string({STRINGS("html")}, ' ') AS t, len(regexp_extract_all(regexp_replace(html, '(?s)<(script|style)\b.*?</(?:script|style)>', '', 'g'), '<p>')) AS paragraphs FROM pages)
SELECT page_id, html_lang, CAST(length(t) AS INTEGER) AS chars, CAST(length(regexp_replace(t, '[\x00-\x7F]', '', 'g')) AS INTEGER) AS non_ascii, CAST(paragraphs AS INTEGER) AS paragraphs FROM t""")
def page_language_signals(spark, sf_dir):
    s = content.with_dom(table(spark, sf_dir, "pages"), "frame").select("page_id", content.language_signals(F.col("dom")).alias("s"))
    return s.select("page_id", "s.html_lang", "s.chars", "s.non_ascii", "s.paragraphs")


@query("""SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'Service::true,Organization:url:false,Offer::true' WHEN 1 THEN 'Thing::true' WHEN 2 THEN 'Person::true,Article:headline+author:false' WHEN 3 THEN 'FAQPage::true' WHEN 4 THEN 'Dataset::true' WHEN 5 THEN 'WebPage::true' ELSE '' END AS checks FROM part""")
def page_schema_checks(spark, sf_dir):
    checks = page_types.schema_checks(entity_graph(F.col("jsonld")))
    shown = F.transform(checks, lambda c: F.concat_ws(":", c["type"], F.array_join(c["missing"], "+"), c["valid"].cast("string")))
    return typed_sources(spark, sf_dir).select("p_partkey", F.array_join(shown, ",").alias("checks"))


@query("""WITH p AS (SELECT page_id, 25 AS metadata, coalesce(html, '') AS h FROM pages) SELECT page_id, CAST(CASE WHEN regexp_matches(h, '<title>[^<]*[^<\\s]') THEN 25 ELSE 0 END AS DOUBLE) AS metadata, CAST(0 AS DOUBLE) AS structured_data,
CAST(CASE WHEN regexp_matches(h, '<title>[^<]*[^<\\s]') THEN 2.5 ELSE 0 END AS DOUBLE) AS overall FROM p WHERE NOT regexp_matches(h, 'ld\\+json|rel="?canonical|name="?description|hreflang')
UNION ALL SELECT page_id, NULL, NULL, NULL FROM p WHERE regexp_matches(h, 'ld\\+json|rel="?canonical|name="?description|hreflang')""")
def page_record_scores(spark, sf_dir):
    p = page_signals(table(spark, sf_dir, "pages"))
    described = F.try_element_at(F.try_element_at("metas", F.lit("description")), F.lit(1))
    entities = F.size(entity_graph(F.col("jsonld")))
    score = pages.record_scores(F.col("title"), described, F.col("canonical"), F.size("hreflangs"), F.size("jsonld"), entities, entities < 0, entities < 0)
    return p.select("page_id", score.alias("s")).select("page_id", "s.metadata", "s.structured_data", "s.overall")


@query("""WITH c AS (SELECT conv_id, turn, lower(trim(text)) AS t, list_filter(string_split_regex(lower(trim(text)), '\\s+'), lambda x: x <> '') AS w FROM conversations)
SELECT conv_id, turn, CASE WHEN length(t) BETWEEN 3 AND 40 AND len(w) <= 5 AND NOT contains(t, ' - ') AND NOT contains(t, ' | ') AND NOT regexp_matches(t, '\\.(com|net|org)$') THEN t END AS keyword FROM c""")
def heading_keywords(spark, sf_dir):
    """Turns as headings: those that look like a keyword."""
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", pages.chosen_keyword(none, none, none, F.col("text")).alias("keyword"))
