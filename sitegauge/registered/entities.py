"""Queries of the entity audits.  Their JSON-LD is made of the tables nation and supplier: a page for each nation, an entity for each supplier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegauge.functions.scores import round2
from sitegauge.operators import entity_audit as audit
from sitegauge.operators import schema_repair
from sitegauge.registry import query
from sitegauge.sources.tables import table

ROOT = "https://shop.example/"
R2 = "CAST(floor(({0}) * 100 + 0.5) / 100 AS DOUBLE)".format


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """-> url, jsonld."""
    k = F.col("s_suppkey")
    some = lambda condition, value: F.when(condition, value)
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey", F.when(F.col("n_nationkey") == 0, ROOT).otherwise(F.concat(F.lit(ROOT + "n"), F.col("n_nationkey").cast("string"))).alias("url"))
    page = F.to_json(F.struct(F.lit("WebPage").alias("@type"), some(F.col("n_regionkey") != 1, F.col("url")).alias("@id"), F.col("n_name").alias("name"), F.col("url")))
    own = F.when(k % 4 == 0, F.concat(F.lit(ROOT + "#s"), (k % 8).cast("string"))).when(k % 4 == 1, F.concat(F.lit("http://other.example/#s"), k.cast("string"))).when(k % 4 == 2, F.concat(F.lit("#s"), k.cast("string")))
    name = F.when(k % 11 == 0, None).when(k % 10 == 0, "Acme Group").when(k % 10 == 5, "acme group").otherwise(F.col("s_name"))
    refers = lambda to: F.struct(F.lit(to).alias("@id")) if isinstance(to, str) else F.struct(to.alias("@id"))
    entity = F.to_json(F.struct(
        F.when(k % 3 == 0, "LocalBusiness").otherwise("Organization").alias("@type"), own.alias("@id"), name.alias("name"), some(k % 2 == 0, F.concat(F.lit(ROOT + "s"), k.cast("string"))).alias("url"),
        some(k % 5 == 0, F.lit(ROOT + "logo.png")).alias("logo"), F.struct(F.lit("PostalAddress").alias("@type"), F.when(k % 2 == 1, "US").otherwise("USA").alias("addressCountry")).alias("address"),
        refers(F.col("url")).alias("memberOf"), some(k % 7 == 0, F.array(refers(ROOT + "#s4"))).alias("parentOrganization"), some(k % 13 == 0, refers(F.col("url"))).alias("mainEntityOfPage")))
    rows = nation.join(table(spark, sf_dir, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"), "left").select(
        "url", page.alias("page"), F.when(k.isNotNull(), F.struct(k.alias("k"), entity.alias("e"))).alias("e"))
    graph = F.array_join(F.concat(F.array("page"), F.transform(F.array_sort("list"), lambda x: x["e"])), ",")
    return rows.groupBy("url", "page").agg(F.collect_list("e").alias("list")).select("url", F.array(F.concat(F.lit('{"@context": "https://schema.org", "@graph": ['), graph, F.lit("]}"))).alias("jsonld"))


SQL = f"""n AS (SELECT n_nationkey, n_regionkey, n_name, CASE WHEN n_nationkey = 0 THEN '{ROOT}' ELSE '{ROOT}n' || n_nationkey END AS page_url FROM nation),
e AS (SELECT page_url, 0 AS pos, CASE WHEN n_regionkey <> 1 THEN page_url END AS id, 'WebPage' AS type, n_name AS name, true AS has_url, false AS has_logo, 0 AS k, NULL AS country FROM n
  UNION ALL SELECT page_url, row_number() OVER (PARTITION BY page_url ORDER BY s_suppkey), CASE s_suppkey % 4 WHEN 0 THEN '{ROOT}#s' || (s_suppkey % 8) WHEN 1 THEN 'http://other.example/#s' || s_suppkey WHEN 2 THEN '#s' || s_suppkey END,
  CASE WHEN s_suppkey % 3 = 0 THEN 'LocalBusiness' ELSE 'Organization' END, CASE WHEN s_suppkey % 11 = 0 THEN NULL WHEN s_suppkey % 10 = 0 THEN 'Acme Group' WHEN s_suppkey % 10 = 5 THEN 'acme group' ELSE s_name END,
  s_suppkey % 2 = 0, s_suppkey % 5 = 0, s_suppkey, CASE WHEN s_suppkey % 2 = 1 THEN 'US' ELSE 'USA' END FROM n JOIN supplier ON s_nationkey = n_nationkey)"""


def _entities(spark, sf_dir):
    return audit.entity_table(pages(spark, sf_dir))


@query(f"WITH {SQL} SELECT page_url, type, count(*) AS n FROM e GROUP BY ALL")
def entity_types(spark, sf_dir):
    return audit.type_distribution(_entities(spark, sf_dir), "page_url")


@query(f"""WITH {SQL} SELECT page_url, CAST(pos AS INTEGER) AS pos, id, true AS known_type, CAST(CASE WHEN type = 'Organization' AND name IS NULL THEN 1 ELSE 0 END AS INTEGER) AS n_missing,
CASE WHEN id LIKE 'https://%' THEN 'https' WHEN id LIKE 'http://%' THEN 'http' WHEN id LIKE '#%' THEN 'hash' END AS id_form FROM e""")
def entity_checks(spark, sf_dir):
    return audit.validated(_entities(spark, sf_dir)).select("page_url", "pos", "id", "known_type", F.size("missing").alias("n_missing"), "id_form")


@query(f"""WITH {SQL}, c AS (SELECT page_url, count(*) AS n_ids, count_if(id LIKE '{ROOT}%') AS valid_ids FROM e WHERE id IS NOT NULL GROUP BY 1)
SELECT *, {R2('valid_ids * 100 / n_ids')} AS percent, CASE WHEN valid_ids * 100 / n_ids >= 95 THEN 'A' WHEN valid_ids * 100 / n_ids >= 85 THEN 'B' WHEN valid_ids * 100 / n_ids >= 70 THEN 'C' ELSE 'D' END AS grade FROM c""")
def entity_id_compliance(spark, sf_dir):
    return audit.id_compliance(_entities(spark, sf_dir), F.lit(ROOT)).withColumn("percent", round2(F.col("percent")))


@query(f"""WITH {SQL}, c AS (SELECT page_url, type, (bool_or(name IS NOT NULL))::INT + (bool_or(has_url))::INT + (bool_or(has_logo))::INT AS held FROM e WHERE type = 'Organization' GROUP BY ALL
  UNION ALL SELECT page_url, type, 2 FROM e WHERE type = 'WebPage')
SELECT page_url, type, CAST(held AS BIGINT) AS held, CAST(3 AS BIGINT) AS expected, {R2('held * 100 / 3')} AS percent FROM c""")
def entity_expected_properties(spark, sf_dir):
    return audit.expected_properties(_entities(spark, sf_dir)).withColumn("percent", round2(F.col("percent")))


@query(f"WITH {SQL} SELECT page_url, id, count(*) AS n FROM e WHERE id IS NOT NULL GROUP BY ALL HAVING count(*) > 1")
def entity_duplicate_ids(spark, sf_dir):
    return audit.duplicate_ids(_entities(spark, sf_dir))


RELATED = f"""r AS (SELECT page_url, id AS source, 'memberOf' AS property, page_url AS target, k FROM e WHERE k IS NOT NULL AND pos > 0 AND id IS NOT NULL
  UNION ALL SELECT page_url, id, 'parentOrganization', '{ROOT}#s4', k FROM e WHERE pos > 0 AND k % 7 = 0 AND id IS NOT NULL UNION ALL SELECT page_url, id, 'mainEntityOfPage', page_url, k FROM e WHERE pos > 0 AND k % 13 = 0 AND id IS NOT NULL),
own AS (SELECT page_url, id AS target, min_by(type, pos) AS found FROM e WHERE id IS NOT NULL GROUP BY ALL)"""


@query(f"""WITH {SQL}, {RELATED} SELECT page_url, source, property, target, found AS target_type, CASE WHEN found IS NULL THEN 'external_entity' ELSE 'internal_entity' END AS scope FROM r LEFT JOIN own USING (page_url, target)""")
def entity_relations(spark, sf_dir):
    return audit.relations(_entities(spark, sf_dir))


NAMED = f"""t AS (SELECT page_url, pos, id AS target FROM e WHERE id IS NOT NULL UNION ALL SELECT page_url, pos, page_url FROM e WHERE pos > 0 UNION ALL SELECT page_url, pos, '{ROOT}#s4' FROM e WHERE pos > 0 AND k % 7 = 0)"""


@query(f"WITH {SQL}, {NAMED} SELECT page_url, target, count(DISTINCT pos) AS referenced_by FROM t GROUP BY ALL")
def entity_references(spark, sf_dir):
    return audit.references(_entities(spark, sf_dir))


@query(f"""WITH {SQL}, {NAMED}, o AS (SELECT page_url, pos, id FROM e WHERE id IS NOT NULL),
u AS (SELECT DISTINCT page_url, id, 'unreferenced' AS state FROM o a WHERE NOT EXISTS (SELECT 1 FROM t JOIN o b ON b.page_url = t.page_url AND b.id = t.target AND b.pos <> t.pos WHERE t.page_url = a.page_url AND t.target = a.id))
SELECT page_url, id, state FROM u UNION ALL SELECT page_url, id, 'isolated' FROM o WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.page_url = o.page_url AND t.pos = o.pos AND t.target <> o.id)""")
def entity_connectivity(spark, sf_dir):
    e = _entities(spark, sf_dir)
    return audit.unreferenced(e).withColumn("state", F.lit("unreferenced")).unionByName(audit.isolated(e).withColumn("state", F.lit("isolated")))


@query(f"""WITH {SQL}, m AS (SELECT page_url, min_by(id, pos) AS id, min_by(type, pos) AS type, count(*) AS c FROM (SELECT * FROM e WHERE pos > 0 AND k % 13 = 0) GROUP BY 1)
SELECT e.page_url, CASE WHEN m.c > 0 THEN (SELECT x.id FROM e x WHERE x.page_url = e.page_url AND x.pos = (SELECT min(y.pos) FROM e y WHERE y.page_url = e.page_url AND y.pos > 0 AND y.k % 13 = 0)) ELSE e.id END AS primary_id,
CASE WHEN m.c > 0 THEN m.type ELSE 'WebPage' END AS primary_type, CASE WHEN m.c > 0 THEN 'main_entity_of_page' WHEN e.id IS NOT NULL THEN 'id_is_page' ELSE 'type_order' END AS reason,
CAST(CASE WHEN m.c > 0 THEN 2000 WHEN e.id IS NOT NULL THEN 1500 ELSE 1000 END AS INTEGER) AS priority FROM e LEFT JOIN m USING (page_url) WHERE pos = 0""")
def primary_entities(spark, sf_dir):
    return audit.primary_entity(_entities(spark, sf_dir))


@query(f"""WITH {SQL}, f AS (SELECT page_url, min_by(name, pos) FILTER (type = 'Organization' AND name IS NOT NULL) AS org_name FROM e GROUP BY 1),
c AS (SELECT page_url, count_if(type = 'Organization') AS orgs, count_if(type = 'LocalBusiness' AND name IS NOT NULL AND (org_name IS NULL OR name <> org_name)) AS apart, count_if(id LIKE 'http://%') AS foreign_ids, count_if(length(country) <> 2) AS bad FROM e JOIN f USING (page_url) GROUP BY 1)
SELECT page_url, orgs + apart AS organizations, page_url <> '{ROOT}' AND apart > 0 AS local_on_subpage, orgs + apart = 0 AS no_organization, foreign_ids, bad AS bad_countries, CAST(0 AS BIGINT) AS missing_main FROM c""")
def entity_violations(spark, sf_dir):
    return audit.violations(_entities(spark, sf_dir), ROOT)


@query(f"""WITH {SQL}, v AS (SELECT lower(name) AS plain, count(DISTINCT page_url) AS pages, min(name) AS name, count(DISTINCT name) AS spellings FROM e WHERE type IN ('Organization', 'LocalBusiness') AND name IS NOT NULL GROUP BY 1)
SELECT (SELECT name FROM v ORDER BY pages DESC, plain DESC LIMIT 1) AS name, max(pages) AS pages, CAST(sum(spellings) - 1 AS BIGINT) AS other_spellings FROM v""")
def business_name(spark, sf_dir):
    return audit.majority_name(_entities(spark, sf_dir))


@query(f"""WITH {SQL} SELECT page_url, CASE WHEN page_url = '{ROOT}' THEN 'WebPage' ELSE 'WebPage' END AS primary_type, CAST(count(*) AS INTEGER) AS n_types FROM (SELECT DISTINCT page_url, type FROM e) GROUP BY 1""")
def page_primary_types(spark, sf_dir):
    types = _entities(spark, sf_dir).groupBy("page_url").agg(F.array_distinct(F.flatten(F.collect_list("types"))).alias("t"))
    return types.select("page_url", audit.primary_type(F.col("t"), F.col("page_url")).alias("primary_type"), F.size("t").alias("n_types"))


FIRST = "f AS (SELECT page_url, min_by(struct_pack(name := name, has_url := has_url, has_logo := has_logo, k := k, country := country, type := type), pos) AS r FROM e WHERE pos > 0 GROUP BY 1)"


@query(f"""WITH {SQL}, {FIRST} SELECT page_url, r.name AS name, CASE WHEN r.has_url THEN '{ROOT}s' || r.k END AS url, CASE WHEN r.has_logo THEN '{ROOT}logo.png' END AS logo, r.country AS country, CAST(0 AS INTEGER) AS n_profiles FROM f""")
def organization_facts(spark, sf_dir):
    return audit.organization_signals(_entities(spark, sf_dir)).select("page_url", "name", "url", "logo", "country", "n_profiles")


@query(f"""WITH {SQL}, o AS (SELECT page_url, min_by(struct_pack(n := name, u := has_url, l := has_logo), pos) AS r FROM e WHERE type = 'Organization' GROUP BY 1)
SELECT page_url, 'Organization' AS type, CAST((r.n IS NOT NULL)::INT + r.u::INT + r.l::INT AS INTEGER) AS n_values FROM o UNION ALL SELECT page_url, 'WebPage', CAST(2 AS INTEGER) FROM e WHERE type = 'WebPage'""")
def entity_descriptions(spark, sf_dir):
    return audit.described(_entities(spark, sf_dir)).select("page_url", "type", F.size("values").alias("n_values"))


@query(f"""WITH {SQL}, c AS (SELECT page_url, k, name, has_logo, row_number() OVER (PARTITION BY page_url ORDER BY type DESC, pos) AS ord FROM e WHERE pos > 0 AND (type = 'Organization' OR name IS NOT NULL)),
o AS (SELECT page_url, min_by(name, ord) FILTER (name IS NOT NULL) AS name, bool_or(has_logo) AS logo, bool_or(k % 13 = 0) AS main, count(*) FILTER (k % 7 = 0) AS parents, count(*) AS n FROM c GROUP BY 1),
w AS (SELECT e.page_url, e.id, e.name, (SELECT count(*) FROM e x WHERE x.page_url = e.page_url AND x.pos > 0) AS others FROM e WHERE pos = 0)
SELECT w.page_url AS url, '{{"@context":"https://schema.org","@graph":[' || CASE WHEN others = 0 THEN '' ELSE '{{"@id":"{ROOT}#organization","@type":"Organization"' || CASE WHEN n > 0 THEN ',"address":{{"@type":"PostalAddress","addressCountry":"US"}}' ELSE '' END
|| CASE WHEN logo THEN ',"logo":"{ROOT}logo.png"' ELSE '' END || CASE WHEN main THEN ',"mainEntityOfPage":{{"@id":"' || w.page_url || '"}}' ELSE '' END || CASE WHEN n > 0 THEN ',"memberOf":{{"@id":"' || w.page_url || '"}}' ELSE '' END
|| ',"name":' || coalesce('"' || o.name || '"', 'null') || CASE WHEN parents > 0 THEN ',"parentOrganization":[' || array_to_string(list_transform(range(0, parents), lambda i: '{{"@id":"{ROOT}#s4"}}'), ',') || ']' ELSE '' END || ',"url":"https://shop.example"}},' END
|| '{{' || CASE WHEN id IS NOT NULL THEN '"@id":"' || id || '",' ELSE '' END || '"@type":"WebPage","name":"' || w.name || '"' || CASE WHEN others = 0 THEN ',"provider":{{"@id":"{ROOT}#organization"}}' ELSE '' END || ',"url":"' || w.page_url || '"}}]}}' AS jsonld_mended FROM w LEFT JOIN o USING (page_url)""")
def repaired_schemas(spark, sf_dir):
    return schema_repair.repaired(pages(spark, sf_dir), F.lit(ROOT)).select("url", "jsonld_mended")
