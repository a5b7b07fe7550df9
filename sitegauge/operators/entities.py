"""Entities of a page's JSON-LD: one flat graph, references between entities, and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The properties that scores and audits read, and those that refer to other entities.
PROPERTIES = ("name", "url", "logo", "address", "telephone", "phone", "description", "sameAs", "image", "jobTitle", "knowsAbout", "award", "alumniOf", "worksFor", "affiliation",
              "foundingDate", "taxID", "leiCode", "duns", "geo", "areaServed", "dateModified", "datePublished", "citation", "isPartOf", "parentOrganization",
              "openingHoursSpecification", "aggregateRating", "offers")
REFERENCES = ("author", "publisher", "creator", "isPartOf", "mainEntityOfPage", "about", "mentions", "parentOrganization", "subOrganization", "worksFor", "memberOf", "employee", "founder",
              "provider", "brand", "manufacturer", "offers", "itemOffered", "location", "address", "image", "logo")
REQUIRED = {"Organization": ("name", "url"), "LocalBusiness": ("name", "address"), "Person": ("name",), "Article": ("name", "datePublished"), "Product": ("name", "offers"), "Service": ("name",)}
FIELDS = ("@id", "@type", "@context", *PROPERTIES)
_ENTITY = "struct<" + ", ".join(f"`{f}`: string" for f in FIELDS) + ">"
_NODE = "struct<`@graph`: array<string>>"


def tolerant(block: Column) -> Column:
    """Entities unescaped and commas before a closing bracket dropped."""
    plain = F.replace(F.replace(block, F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&"))
    return F.regexp_replace(plain, r",(\s*[}\]])", "$1")


def graph(blocks: Column) -> Column:
    """array<struct> of all entities: of objects, of arrays at top level, and of @graph lists; bad JSON gives none."""
    def nodes(block: Column) -> Column:
        top = F.when(F.trim(block).startswith("["), F.from_json(block, "array<string>")).otherwise(F.array(block))
        return F.flatten(F.transform(top, lambda n: F.coalesce(F.from_json(n, _NODE)["@graph"], F.array(n))))

    texts = F.flatten(F.transform(F.coalesce(blocks, F.array().cast("array<string>")), lambda b: F.coalesce(nodes(tolerant(b)), F.array().cast("array<string>"))))
    return F.filter(F.transform(texts, lambda t: F.from_json(t, _ENTITY)), lambda e: e["@type"].isNotNull() | e["@id"].isNotNull())


def has(value: Column) -> Column:
    return F.coalesce(~value.isin("", "[]", "{}", "null"), F.lit(False))


def entity_rows(pages: DataFrame) -> DataFrame:
    """-> page_url, pos and the entity's fields; a row for each entity."""
    return pages.select(F.col("url").alias("page_url"), F.posexplode(graph(F.col("jsonld"))).alias("pos", "e")).select("page_url", "pos", "e.*")


def reference_edges(pages: DataFrame) -> DataFrame:
    """-> page_url, source, target, property, scope (internal if the target is an entity of the page)."""
    wanted = F.array(*[F.lit(p) for p in REFERENCES])
    texts = pages.select(F.col("url").alias("page_url"), F.explode("jsonld").alias("b")).select("page_url", tolerant(F.col("b")).alias("b"))
    part = F.explode(F.regexp_extract_all("b", F.lit(r'("\w+"\s*:\s*\{\s*"@id"\s*:\s*"[^"]*"\s*\})'), F.lit(1)))
    refs = texts.select("page_url", part.alias("r")).select("page_url", F.regexp_extract("r", r'^"(\w+)"', 1).alias("property"), F.regexp_extract("r", r'"@id"\s*:\s*"([^"]*)"', 1).alias("target"))
    own = entity_rows(pages).select("page_url", F.col("@id").alias("target")).filter("target is not null").distinct().withColumn("_own", F.lit(True))
    return refs.filter(F.array_contains(wanted, F.col("property"))).join(own, ["page_url", "target"], "left").select(
        "page_url", "target", "property", F.when(F.col("_own"), "internal").otherwise("external").alias("scope"))


def orphan_entities(pages: DataFrame) -> DataFrame:
    """Entities with an id that no reference of their page names."""
    return entity_rows(pages).filter("`@id` is not null").select("page_url", F.col("@id").alias("target"), F.col("@type").alias("type")).join(
        reference_edges(pages).select("page_url", "target").distinct(), ["page_url", "target"], "left_anti")


def missing_properties(pages: DataFrame) -> DataFrame:
    """-> page_url, type, missing: entities that lack a required property."""
    cases = F.lit(None).cast("array<string>")
    for kind, names in REQUIRED.items():
        lacking = F.array_compact(F.array(*[F.when(~has(F.col(n)), F.lit(n)) for n in names]))
        cases = F.when(F.col("@type") == kind, lacking).otherwise(cases)
    return entity_rows(pages).select("page_url", F.col("@type").alias("type"), cases.alias("missing")).filter(F.size("missing") > 0)
