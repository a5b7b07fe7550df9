"""Queries of local presence.  Their pages are made of the table customer: a page for each customer, a site for each nation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegauge.functions.urls import host
from sitegauge.operators import presence
from sitegauge.registry import query
from sitegauge.sources.tables import spread, table

STREETS = ("North Main Street", "N. Main St.", "N Main St", "N Mian Street", "Harbour Avenue", "north main street", "Nort Main  Street")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """-> url, jsonld, metas, headings, title, text."""
    k, nation, some = F.col("c_custkey"), F.col("c_nationkey").cast("string"), F.when
    four = F.lpad((k % 10000).cast("string"), 4, "0")
    street = F.concat((k % 3 + 10).cast("string"), F.lit(" "), F.element_at(F.lit(list(STREETS)), (k % 7 + 1).cast("int")))
    address = F.struct(F.lit("PostalAddress").alias("@type"), street.alias("streetAddress"), F.concat(F.lit("City "), nation).alias("addressLocality"), some(k % 4 != 1, F.concat(F.lit("9000"), (k % 2).cast("string"))).alias("postalCode"))
    plain = F.to_json(F.struct(F.lit("Organization").alias("@type"), some(k % 5 == 0, "Best Agency").when(k % 5 > 1, F.col("c_name")).alias("name"), some(k % 10 == 0, F.concat("c_name", F.lit(" Ltd"))).alias("legalName"), some(k % 6 != 5, address).alias("address"),
                               some(k % 4 != 3, F.concat(F.lit("555-123-"), four)).alias("telephone"), some(k % 2 == 1, F.struct((k % 120).cast("string").alias("latitude"), F.lit("-70.25").alias("longitude"))).alias("geo")))
    site = some(k % 3 == 0, F.to_json(F.struct(F.lit("WebSite").alias("@type"), F.concat(F.lit("Site "), nation).alias("name"))))
    metas = F.map_from_entries(F.array_compact(F.array(some(k % 2 == 0, F.struct(F.lit("og:site_name"), F.array(F.concat(F.lit("Shop "), nation)))))))
    text = some(k % 3 == 0, F.concat(F.lit("Call (555) 123-"), four)).when(k % 3 == 1, "555.000.0000 or 555.000.0001").otherwise("no phone")
    return spread(table(spark, sf_dir, "customer")).select(
        F.concat(F.lit("https://n"), nation, F.lit(".example/c"), k.cast("string")).alias("url"), F.array_compact(F.array(plain, site)).alias("jsonld"), metas.alias("metas"),
        F.array(F.struct(F.lit(1).alias("level"), F.concat(F.lit("Company "), k.cast("string")).alias("text"))).alias("headings"), some(k % 4 == 0, F.col("c_name")).otherwise(F.concat(F.lit("Welcome "), k.cast("string"))).alias("title"), text.alias("text"))


_LIST = "[" + ", ".join(f"'{s}'" for s in STREETS) + "]"
SQL = f"""c AS (SELECT c_custkey AS k, 'n' || c_nationkey || '.example' AS site, c_name, c_nationkey AS nation, lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS four,
  CASE WHEN c_custkey % 6 <> 5 THEN (c_custkey % 3 + 10) || ' ' || {_LIST}[c_custkey % 7 + 1] ELSE '' END AS street, CASE WHEN c_custkey % 4 <> 1 THEN '9000' || (c_custkey % 2) ELSE '' END AS zip FROM customer),
p AS (SELECT *, CASE WHEN k % 5 > 1 THEN c_name WHEN k % 10 = 0 THEN c_name || ' Ltd' WHEN k % 3 = 0 THEN 'Site ' || nation WHEN k % 2 = 0 THEN 'Shop ' || nation ELSE 'Company ' || k END AS name,
  CASE WHEN k % 5 > 1 THEN 'organization' WHEN k % 10 = 0 THEN 'legal_name' WHEN k % 3 = 0 THEN 'website' WHEN k % 2 = 0 THEN 'og:site_name' ELSE 'heading' END AS name_source, CASE WHEN k % 4 = 0 THEN c_name ELSE 'Welcome ' || k END AS title,
  CASE WHEN k % 4 <> 3 THEN '555-123-' || four ELSE '' END AS phone FROM c)"""


@query(f"""WITH {SQL} SELECT 'https://' || site || '/c' || k AS url, name, name_source, name = title AS name_consistent, CASE WHEN street = '' THEN '' ELSE concat_ws(' ', street, 'City ' || nation, nullif(zip, '')) END AS address, phone,
CAST(CASE k % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS INTEGER) AS n_phones, phone <> '' AND k % 3 = 0 AS phone_consistent, CASE WHEN k % 2 = 1 AND k % 120 <= 90 THEN CAST(k % 120 AS DOUBLE) END AS lat, street <> '' AND phone <> '' AS complete FROM p""")
def nap_signals(spark, sf_dir):
    return presence.presence(pages(spark, sf_dir)).select("url", "name", "name_source", "name_consistent", F.col("address.shown").alias("address"), "phone", F.size("phones").alias("n_phones"), "phone_consistent", "lat", "complete")


SETTLED = """f AS (SELECT {by}, form, count(*) AS n, min(shown) AS shown FROM r WHERE form <> '' GROUP BY ALL), h AS (SELECT {by}, arg_min(form, (-n, form)) AS majority FROM f GROUP BY ALL)
SELECT {by}, form, n, shown, majority, CASE WHEN levenshtein(form, majority) <= {within} THEN CAST(levenshtein(form, majority) AS INTEGER) END AS distance, levenshtein(form, majority) <= {within} AS agrees FROM f JOIN h USING ({by})""".format
_SHORT = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in presence.SHORT.items())


@query(f"""WITH {SQL}, r AS (SELECT site, concat_ws(' ', CASE WHEN street = '' THEN '' WHEN zip <> '' THEN zip ELSE 'city ' || nation END, nullif(regexp_extract(street, '[0-9]+'), '')) AS block, street AS shown,
  array_to_string(list_transform(regexp_extract_all(lower(street), '[a-z0-9]+'), lambda w: CASE w {_SHORT} ELSE w END), ' ') AS form FROM p), {SETTLED(by='site, block', within=3)}""")
def address_reconciliation(spark, sf_dir):
    found = presence.presence(pages(spark, sf_dir))
    return presence.reconciled_addresses(found.withColumn("site", host(F.col("url"))), "site")


@query(f"WITH {SQL}, r AS (SELECT site, regexp_replace(lower(name), '[ -]', '', 'g') AS form, name AS shown FROM p), {SETTLED(by='site', within=2)}")
def name_reconciliation(spark, sf_dir):
    found = presence.presence(pages(spark, sf_dir))
    return presence.reconciled_names(found.withColumn("site", host(F.col("url"))), "site")
