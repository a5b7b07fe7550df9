"""Queries of keyword records, ranks, keyed updates and score arithmetic.  API answers are made of the table part, in Spark and in SQL alike."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitegauge.functions import scores, text, urls
from sitegauge.operators import graph, keywords, tables
from sitegauge.registry import query
from sitegauge.sources.tables import resolve_columns, table

R2 = "CAST(floor(({0}) * 100 + 0.5) / 100 AS DOUBLE)".format


def keyword_answers(spark, sf_dir):
    """A response for each brand, an item for each part; items have one of three layouts, tasks of size 7 have failed."""
    c = F.col
    info = F.struct((c("p_size") * 10).cast("long").alias("search_volume"), (c("p_size") / 100).alias("competition"), (c("p_retailprice") / 1000).alias("cpc"))
    k = c("p_partkey") % 3
    name = F.concat(F.when(c("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(c("p_name")), F.lit(" "), c("p_type"))
    item = F.to_json(F.struct(F.when(k != 1, name).alias("keyword"), F.when(k == 0, info["search_volume"]).alias("search_volume"), F.when(k == 0, info["competition"]).alias("competition"), F.when(k == 0, info["cpc"]).alias("cpc"),
                              F.when(k == 2, info).alias("keyword_info"), F.when(k == 1, F.struct(name.alias("keyword"), info.alias("keyword_info"))).alias("keyword_data")))
    rows = table(spark, sf_dir, "part").select("p_brand", "p_size", F.struct("p_partkey", item.alias("j")).alias("i"))
    tasks = rows.groupBy("p_brand", "p_size").agg(F.array_join(F.array_sort(F.collect_list("i"))["j"], ",").alias("items"))
    task = F.concat(F.lit('{"status_code": '), F.when(c("p_size") == 7, "40000").otherwise("20000"), F.lit(', "result": [{"items": ['), c("items"), F.lit("]}]}"))
    return tasks.groupBy("p_brand").agg(F.concat(F.lit('{"tasks": ['), F.array_join(F.array_sort(F.collect_list(F.struct("p_size", task.alias("t"))))["t"], ","), F.lit("]}")).alias("body"))


KEYWORDS = """k AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END || ' ' || p_type AS keyword, CAST(p_size * 10 AS BIGINT) AS search_volume, p_size / 100 AS competition, p_retailprice / 1000 AS cpc, p_brand, p_size, p_partkey FROM part WHERE p_size <> 7),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(keyword) ORDER BY p_brand, p_size, p_partkey) AS n FROM k) WHERE n = 1)"""


@query(f"""WITH {KEYWORDS} SELECT keyword, search_volume, {R2('competition')} AS competition, {R2('cpc')} AS cpc, CASE WHEN regexp_matches(lower(keyword), 'buy|price|cost|cheap|best|review|deal|discount') THEN 'commercial'
WHEN regexp_matches(lower(keyword), 'login|website|official|contact|near me') THEN 'navigational' ELSE 'informational' END AS intent FROM f""")
def keyword_records(spark, sf_dir):
    answers = keyword_answers(spark, sf_dir)
    # items of one response are numbered over its tasks, which stand by size and within them by part
    out = keywords.keyword_records(answers, order="p_brand")
    return out.select("keyword", "search_volume", scores.round2(F.col("competition")).alias("competition"), scores.round2(F.col("cpc")).alias("cpc"), "intent")


@query(f"WITH {KEYWORDS} SELECT keyword, search_volume FROM (SELECT *, row_number() OVER (PARTITION BY lower(keyword) ORDER BY search_volume DESC, keyword DESC) AS m FROM k) WHERE m = 1 ORDER BY search_volume DESC, keyword LIMIT 5")
def keyword_top(spark, sf_dir):
    c = F.col
    name = F.concat(F.when(c("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(c("p_name")), F.lit(" "), c("p_type"))
    return keywords.top_keywords(table(spark, sf_dir, "part").filter("p_size <> 7").select(name.alias("keyword"), (c("p_size") * 10).cast("long").alias("search_volume")))


@query(f"""WITH r AS (SELECT 'k' || (l_partkey % 200) AS keyword, l_linenumber AS position, 's' || (l_suppkey % 25) || '.example' AS domain FROM lineitem), g AS (SELECT keyword, min(position) FILTER (domain = 's3.example' OR contains(domain, 's3.example') OR contains('s3.example', domain)) AS rank FROM r GROUP BY 1)
SELECT keyword, rank, CASE WHEN rank IS NULL THEN 'Not Found' ELSE 'Found' END AS status, (SELECT {R2('coalesce(avg(rank), 0)')} FROM g) AS average_rank FROM g""")
def keyword_ranks(spark, sf_dir):
    results = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("k"), (F.col("l_partkey") % 200).cast("string")).alias("keyword"), F.col("l_linenumber").alias("position"),
                                                      F.concat(F.lit("https://www.s"), (F.col("l_suppkey") % 25).cast("string"), F.lit(".example/p")).alias("url"))
    ranks = keywords.rank_of(results, "s3.example")
    return ranks.join(F.broadcast(keywords.average_rank(ranks).select(scores.round2(F.col("average_rank")).alias("average_rank")))).select("keyword", "rank", "status", "average_rank")


@query("""SELECT o_orderkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'B' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN c_mktsegment = 'BUILDING' THEN 0.0 ELSE o_totalprice END AS o_totalprice FROM orders JOIN customer ON c_custkey = o_custkey
UNION ALL SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)""")
def member_updates(spark, sf_dir):
    members = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return tables.update_members(table(spark, sf_dir, "orders"), members, "o_custkey", o_orderstatus=F.lit("B"), o_totalprice=F.lit(0.0)).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("""SELECT o_custkey, o_orderkey, o_orderstatus FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') UNION ALL SELECT o_custkey, o_orderkey, 'new' FROM orders WHERE o_orderpriority = '1-URGENT'""")
def replaced_keys(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    fresh = orders.filter("o_orderpriority = '1-URGENT'").select("o_custkey", "o_orderkey", F.lit("new").alias("o_orderstatus"))
    return tables.replace_by_key(orders.select("o_custkey", "o_orderkey", "o_orderstatus"), fresh, ["o_custkey"])


@query(f"""SELECT p_partkey, CAST(greatest(0, 100 - 15 * (p_size % 5) - 8 * (p_partkey % 4) - 3 * (p_partkey % 7)) AS BIGINT) AS legacy_score, {R2('greatest(0, least(100, p_size * 3.0 - 20))')} AS clamped, CASE WHEN p_size % 4 = 0 THEN 'high' WHEN p_size % 4 = 1 THEN 'medium' ELSE 'low' END AS severity FROM part""")
def score_arithmetic(spark, sf_dir):
    c = F.col
    name = F.when(c("p_size") % 4 == 0, " Critical").when(c("p_size") % 4 == 1, "WARN").when(c("p_size") % 4 == 2, None).otherwise("odd")
    return table(spark, sf_dir, "part").select("p_partkey", scores.legacy_page_score(c("p_size") % 5, c("p_partkey") % 4, c("p_partkey") % 7).cast("long").alias("legacy_score"), scores.round2(scores.clamp(c("p_size") * 3.0 - 20)).alias("clamped"), scores.severity(name).alias("severity"))


WORDS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')"
SYL = "CASE WHEN length(w) <= 3 THEN 1 ELSE greatest(1, len(regexp_extract_all(w, '[aeiouy]+')) - CASE WHEN ends_with(w, 'e') THEN 1 ELSE 0 END) END"


@query(f"""WITH t AS (SELECT conv_id, turn, {WORDS} AS ws, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[.!?]+'), lambda s: trim(s) <> '')) AS ns FROM conversations), u AS (SELECT *, list_sum(list_transform(ws, lambda w: {SYL})) AS sy FROM t WHERE len(ws) > 0 AND ns > 0)
SELECT conv_id, turn, CAST(sy AS INTEGER) AS syllables, {R2('206.835 - 1.015 * (len(ws) / ns) - 84.6 * (sy / len(ws))')} AS flesch FROM u""")
def flesch_scores(spark, sf_dir):
    ws = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]+"), F.lit(0))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", ws.alias("ws"), F.size(text.sentences(F.col("text"))).alias("ns")).filter("size(ws) > 0 and ns > 0")
    rows = rows.withColumn("syllables", F.aggregate("ws", F.lit(0), lambda n, w: n + text.syllables(w).cast("int")))
    return rows.select("conv_id", "turn", "syllables", scores.round2(text.flesch(F.size("ws"), F.col("ns"), F.col("syllables"))).alias("flesch"))


@query(f"""WITH t AS (SELECT DISTINCT p_name || CASE p_partkey % 3 WHEN 0 THEN ': get the best deal, save now' WHEN 1 THEN ' and more' ELSE '' END || repeat(' wide', p_size % 40) AS d FROM part)
SELECT d, CAST(greatest(0, least(100, 50 + CASE WHEN regexp_matches(lower(d), '{text.POWER_WORDS}') THEN 25 ELSE 0 END + CASE WHEN regexp_matches(lower(d), '{text.CALL_WORDS}') THEN 25 ELSE 0 END + CASE WHEN length(d) BETWEEN 150 AND 160 THEN 10 WHEN length(d) < 120 THEN -10 WHEN length(d) > 160 THEN -5 ELSE 0 END)) AS INTEGER) AS ctr,
CASE WHEN regexp_matches(lower(d), 'deal') THEN 'transactional' ELSE 'informational' END AS intent FROM t""")
def description_scores(spark, sf_dir):
    c = F.col
    d = F.concat("p_name", F.when(c("p_partkey") % 3 == 0, ": get the best deal, save now").when(c("p_partkey") % 3 == 1, " and more").otherwise(""), F.expr("repeat(' wide', p_size % 40)"))
    return table(spark, sf_dir, "part").select(d.alias("d")).distinct().select("d", text.ctr_score(c("d")).cast("int").alias("ctr"), text.intent(c("d")).alias("intent"))


@query(f"""WITH a AS (SELECT p_partkey, p_name AS x, p_name || ' ' || p_type AS y FROM part), s AS (SELECT p_partkey, list_distinct(string_split(lower(x), ' ')) AS a, list_distinct(string_split(lower(y), ' ')) AS b FROM a)
SELECT p_partkey, {R2('len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))')} AS similarity FROM s""")
def name_similarity(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", scores.round2(text.jaccard(F.col("p_name"), F.concat_ws(" ", "p_name", "p_type"))).alias("similarity"))


@query(r"""SELECT l_orderkey, l_linenumber, CASE l_partkey % 4 WHEN 0 THEN 'internal' WHEN 1 THEN 'youtube' WHEN 2 THEN 'twitter' ELSE 'external' END AS class, l_partkey % 5 = 0 AS homepage FROM lineitem""")
def link_classes(spark, sf_dir):
    k = F.col("l_partkey") % 4
    h = F.when(k == 0, "shop.site.example").when(k == 1, "www.youtube.com").when(k == 2, "x.com").otherwise("other.example.org")
    url = F.concat(F.lit("https://"), h, F.when(F.col("l_partkey") % 5 == 0, "/").otherwise("/p/q"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", urls.link_class(url, F.lit("site.example")).alias("class"), urls.is_homepage(url).alias("homepage"))


@query(r"""WITH l AS (SELECT DISTINCT user_id AS a, (user_id * 7 + 3) % 60 AS b FROM events UNION SELECT DISTINCT user_id, (user_id + 1) % 60 FROM events WHERE user_id % 4 = 0),
d AS (WITH RECURSIVE r AS (SELECT 0 AS k, 0 AS depth UNION SELECT b, depth + 1 FROM r JOIN l ON l.a = r.k WHERE depth < 40) SELECT k, min(depth) AS depth FROM r GROUP BY 1)
SELECT CAST(k AS VARCHAR) AS key, CAST(depth AS INTEGER) AS click_depth FROM d WHERE k IN (SELECT a FROM l UNION SELECT b FROM l)""")
def click_depth_levels(spark, sf_dir):
    from sitegauge.sources.scratch import saved, shared_folder

    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("u")).distinct()
    s = lambda c: c.cast("string")
    links = saved(e.select(s(F.col("u")).alias("src"), s((F.col("u") * 7 + 3) % 60).alias("dst")).unionByName(e.filter("u % 4 = 0").select(s(F.col("u")).alias("src"), s((F.col("u") + 1) % 60).alias("dst"))).distinct())
    nodes = links.select(F.col("src").alias("key")).union(links.select("dst")).distinct()
    return graph.click_depths(nodes, links, nodes.filter("key = '0'"), shared_folder(spark))


@query("SELECT o_custkey AS project_id, count(*) AS n, max(o_totalprice) AS most FROM orders GROUP BY 1")
def resolved_names(spark, sf_dir):
    """Columns found under any of the names that a key may be stored by."""
    stored = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "seo_project_id")
    rows = resolve_columns(stored, project_id=("projectId", "project_id", "seo_project_id"))
    return rows.groupBy("project_id").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("most"))
