"""Repair of a page's entity graph in seven ordered passes, each a Column from graph to graph.

A graph is an array of entities, an entity a map from property to the JSON text
of its value; both come from VARIANT, so values of any shape pass through whole.
The passes: one Organization of all organizations and local businesses; no local
business on a subpage; a reference to the organization where none is stated; ids
under the canonical host; country codes; properties that a type needs; entities
with equal signatures merged.

Merging keeps the first value of a property; two lists are joined, of two objects
the later one's properties count; @type and @id are never taken over.  Objects are
written with their properties in order of name.  A page without entities gets an
empty graph; bad JSON gives no entity.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.functions.scores import let
from sitegauge.functions.urls import is_homepage
from sitegauge.operators.entity_audit import nodes

# Codes of countries as they are written, types that may name their provider, and properties that make up a signature.
COUNTRIES = {"United States": "US", "USA": "US", "U.S.A.": "US", "United Kingdom": "GB", "UK": "GB", "U.K.": "GB", "Canada": "CA", "Australia": "AU"}
PROVIDED = ("Service", "Product", "Article", "WebPage", "AboutPage")
SIGNATURES = {"PostalAddress": ("streetAddress", "addressLocality", "addressRegion", "postalCode", "addressCountry"), "Organization": ("name", "url"),
              "LocalBusiness": ("name", "address.streetAddress", "telephone"), "ContactPoint": ("telephone", "email", "contactType")}
LOCAL_FIRST = ("telephone", "address", "openingHours")
ENTITY = "map<string,string>"
GRAPH = f"array<{ENTITY}>"


def quoted(text: Column) -> Column:
    """The JSON string of a text."""
    return F.substring(F.regexp_replace(F.to_json(F.named_struct(F.lit("v"), text)), r"\}$", ""), 6, 1 << 30)


def plain(value: Column) -> Column:
    """A JSON string's text; other values as their JSON; null for null."""
    return F.when(value.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")).when(value != "null", value)


def entity(text: Column) -> Column:
    """The properties of a JSON object, each with its value's JSON; null if the text is none."""
    return F.transform_values(F.from_json(text, "map<string,variant>"), lambda _, v: F.coalesce(F.to_json(v), F.lit("null")))


def json_object(e: Column) -> Column:
    pairs = F.transform(F.array_sort(F.map_entries(e)), lambda p: F.concat(quoted(p["key"]), F.lit(":"), p["value"]))
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))


def truthy(value: Column) -> Column:
    return F.coalesce(~value.isin('""', "[]", "{}", "null", "false", "0", "0.0"), F.lit(False))


def _entity(**values: Column) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k.replace("at_", "@")), v)]).cast(ENTITY)


def with_property(e: Column, name: str, value: Column) -> Column:
    return F.map_concat(F.map_filter(e, lambda k, _: k != name), F.create_map(F.lit(name), value)).cast(ENTITY)


def is_a(e: Column, *types: str) -> Column:
    """Whether the entity's type is one of these; a list of types is none."""
    return F.coalesce(e["@type"].isin(*[f'"{t}"' for t in types]), F.lit(False))


def merged_value(a: Column, b: Column) -> Column:
    """What a property has after merging b into a; either may be null (no such property)."""
    lists = F.when(a == "[]", b).when(b == "[]", a).otherwise(F.concat(F.regexp_replace(a, r"\]$", ","), F.substring(b, 2, 1 << 30)))
    objects = let(F.struct(entity(a).alias("a"), entity(b).alias("b")), lambda o: json_object(F.map_zip_with(o["a"], o["b"], lambda _, x, y: F.coalesce(y, x))))
    return F.when(a.isNull() | (a == "null"), F.coalesce(b, a)).when(b.isNull(), a).when(a.startswith("[") & b.startswith("["), lists).when(a.startswith("{") & b.startswith("{"), objects).otherwise(a)


def merge(target: Column, source: Column, *excluded: str) -> Column:
    """target with the properties of source merged in."""
    taken = F.map_filter(source, lambda k, _: ~k.isin("@type", "@id", *excluded))
    return F.map_zip_with(target, taken, lambda _, a, b: merged_value(a, b))


def consolidate(graph: Column, root: Column) -> Column:
    """Pass 1: the page's organizations, then its named local businesses, become one Organization at the front."""
    start = _entity(at_type=F.lit('"Organization"'), at_id=quoted(F.concat(root, F.lit("#organization"))), name=F.lit("null"), url=quoted(F.regexp_replace(root, "/+$", "")))

    def local(org: Column, e: Column) -> Column:
        name, own = F.trim(plain(e["name"])), F.trim(plain(org["name"]))
        joined = F.when(F.coalesce((own != "") & (own != name), F.lit(False)), merge(org, e, "name")).otherwise(merge(org, e))
        first = F.map_filter(e, lambda k, v: k.isin(*LOCAL_FIRST) & truthy(v))
        return F.when(F.coalesce(name != "", F.lit(False)), F.map_concat(F.map_filter(joined, lambda k, _: ~F.map_contains_key(first, k)), first)).otherwise(org)

    of = lambda kind: F.filter(graph, lambda e: is_a(e, kind))
    org = F.aggregate(of("LocalBusiness"), F.aggregate(of("Organization"), start, lambda org, e: merge(org, e)), local)
    others = F.filter(graph, lambda e: ~is_a(e, "Organization", "LocalBusiness"))
    return F.when(F.size(others) == F.size(graph), graph).otherwise(F.concat(F.array(org), others))


def without_local(graph: Column, url: Column) -> Column:
    """Pass 2: local businesses stand on the homepage alone."""
    return F.when(is_homepage(url), graph).otherwise(F.filter(graph, lambda e: ~is_a(e, "LocalBusiness")))


def _reference(root: Column, typed: bool = False) -> Column:
    return F.concat(F.lit('{"@id":'), quoted(F.concat(root, F.lit("#organization"))), F.lit(',"@type":"Organization"}' if typed else "}"))


def with_reference(graph: Column, root: Column) -> Column:
    """Pass 3: without an Organization, the first entity that may have a provider names it, unless it has one."""
    first = F.array_min(F.transform(graph, lambda e, k: F.when(is_a(e, *PROVIDED), k)))
    named = F.transform(graph, lambda e, k: F.when((k == first) & ~F.map_contains_key(e, "provider"), with_property(e, "provider", _reference(root))).otherwise(e))
    return F.when(F.exists(graph, lambda e: is_a(e, "Organization")), graph).otherwise(named)


def with_ids(graph: Column, root: Column) -> Column:
    """Pass 4: full ids get the canonical host, the Organization its own id."""
    netloc = lambda u: F.regexp_extract(u, r"://([^/?#]*)", 1)

    def step(e: Column) -> Column:
        id = plain(e["@id"])
        moved = F.when(id.contains("://") & (netloc(id) != "") & (netloc(id) != netloc(root)), F.replace(id, netloc(id), netloc(root))).otherwise(id)
        return F.when(truthy(e["@id"]) & e["@id"].startswith('"'), with_property(e, "@id", quoted(F.when(is_a(e, "Organization"), F.concat(root, F.lit("#organization"))).otherwise(moved)))).otherwise(e)

    return F.transform(graph, step)


def country_code(country: Column) -> Column:
    """The two letters of a stated country; null if it names none.

    Of several words the first that is a known capital form or has two letters counts, else the first word."""
    codes = F.create_map(*[F.lit(x) for kv in COUNTRIES.items() for x in kv])
    words = F.filter(F.split(F.trim(country), r"\s+"), lambda w: w != "")
    two = lambda w: w.rlike(r"^\p{L}{2}$")
    first = lambda ws: F.coalesce(F.try_element_at(F.filter(ws, lambda w: F.map_contains_key(codes, F.upper(w)) | two(w)), F.lit(1)), F.try_element_at(ws, F.lit(1)))
    return let(let(words, first), lambda w: F.coalesce(F.try_element_at(codes, w), F.when(two(w), F.upper(w))))


def with_countries(graph: Column) -> Column:
    """Pass 5: addressCountry becomes a code; what names no country goes."""
    def step(e: Column) -> Column:
        address = entity(F.when(e["address"].startswith("{"), e["address"]))
        stated = plain(address["addressCountry"])
        mended = F.coalesce(F.when(country_code(stated).isNotNull(), with_property(address, "addressCountry", quoted(country_code(stated)))), F.map_filter(address, lambda k, _: k != "addressCountry"))
        return F.when(F.coalesce(truthy(address["addressCountry"]) & address["addressCountry"].startswith('"'), F.lit(False)), with_property(e, "address", json_object(mended))).otherwise(e)

    return F.transform(graph, step)


def with_needed(graph: Column, root: Column) -> Column:
    """Pass 6: properties that about pages, articles and services need."""
    host = F.regexp_extract(root, r"://([^/?#]*)", 1)
    needed = F.create_map(
        F.lit('"AboutPage"'), _entity(description=quoted(F.concat(F.lit("About page for "), host)), mainEntity=_reference(root)), *[x for t in ("Article", "BlogPosting") for x in (
            F.lit(f'"{t}"'), _entity(author=_reference(root, typed=True), publisher=_reference(root, typed=True)))], F.lit('"Service"'), _entity(serviceType=F.lit('"Professional Services"'), provider=_reference(root)))
    lacking = lambda e: F.map_filter(F.coalesce(F.try_element_at(needed, e["@type"]), F.create_map().cast(ENTITY)), lambda k, _: ~F.map_contains_key(e, k))
    return F.transform(graph, lambda e: F.map_concat(e, lacking(e)))


def signature(e: Column) -> Column:
    """What equal entities share: the id, else the type and the properties that tell entities of it apart (all texts for types without a list), in small letters."""
    low = lambda v: F.lower(F.trim(F.coalesce(v, F.lit(""))))
    texts = F.transform(F.array_sort(F.map_entries(F.map_filter(e, lambda k, v: ~k.isin("@type", "@context") & v.startswith('"')))), lambda p: low(plain(p["value"])))
    parts = F
    for kind, names in SIGNATURES.items():
        of = [plain(entity(e[n.split(".")[0]])[n.split(".")[1]]) if "." in n else plain(e[n]) for n in names]
        parts = parts.when(is_a(e, kind), F.array(*[low(v) for v in of]))
    shown = F.filter(F.concat(F.array(low(plain(e["@type"]))), parts.otherwise(texts)), lambda t: t != "")
    return F.when(truthy(e["@id"]), F.concat(F.lit("id:"), plain(e["@id"]))).otherwise(F.array_join(shown, ":"))


def without_copies(graph: Column) -> Column:
    """Pass 7: of entities with one signature the first stays, with the others merged in."""
    start = F.array().cast(f"array<struct<s: string, e: {ENTITY}>>")
    signed = F.transform(graph, lambda e: F.struct(signature(e).alias("s"), e.alias("e")))

    def step(kept: Column, x: Column) -> Column:
        joined = F.transform(kept, lambda k: F.when(k["s"] == x["s"], F.struct(k["s"].alias("s"), merge(k["e"], x["e"]).alias("e"))).otherwise(k))
        return F.when(F.exists(kept, lambda k: k["s"] == x["s"]), joined).otherwise(F.concat(kept, F.array(x)))

    return F.aggregate(signed, start, step, lambda kept: F.transform(kept, lambda k: k["e"]))


def passes(url: Column, root: Column) -> list[tuple[str, Callable[[Column], Column]]]:
    return [("consolidate", lambda g: consolidate(g, root)), ("without_local", lambda g: without_local(g, url)), ("with_reference", lambda g: with_reference(g, root)), ("with_ids", lambda g: with_ids(g, root)),
            ("with_countries", with_countries), ("with_needed", lambda g: with_needed(g, root)), ("without_copies", without_copies)]


def entity_graph(jsonld: Column) -> Column:
    """GRAPH of all entities in a page's blocks, nested graphs opened; bad JSON gives none."""
    return F.filter(F.transform(nodes(jsonld), entity), lambda e: e.isNotNull())


def repaired(pages: DataFrame, root: Column) -> DataFrame:
    """pages (url, jsonld) with graph, the mended entities, and jsonld_mended, the one JSON-LD block of them.  No row moves."""
    out = pages.withColumn("graph", entity_graph(F.col("jsonld")))
    for _, step in passes(F.col("url"), root):
        out = out.withColumn("graph", let(F.col("graph"), step))
    block = F.concat(F.lit('{"@context":"https://schema.org","@graph":['), F.array_join(F.transform("graph", json_object), ","), F.lit("]}"))
    return out.withColumn("jsonld_mended", block)
