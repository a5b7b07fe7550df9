"""Local presence: name, address, phone and place of the business a page stands for, and their reconciliation over a site's pages.

presence is one projection over a page (no row moves).  settled groups the forms
that a site's pages show and measures each against the most frequent of its block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.functions.scores import let
from sitegauge.operators.entities import has
from sitegauge.operators.entity_audit import NO_TEXTS, nodes, type_names

# Words of advertising headlines, words of headings that name no business, and forms of phone numbers.
HEADLINES = ("agency", "services", "solutions", "results", "globe", "worldwide")
NO_NAMES = ("home", "menu", "navigation", "search", "cart", "login")
PHONES = (r"\(\d{3}\)\s*\d{3}[-.\s]?\d{4}", r"\d{3}[-.\s]?\d{3}[-.\s]?\d{4}", r"\+1\s*\d{3}[-.\s]?\d{3}[-.\s]?\d{4}")
# Postal short forms of address words.
SHORT = {"street": "st", "avenue": "ave", "road": "rd", "boulevard": "blvd", "drive": "dr", "lane": "ln", "court": "ct", "place": "pl", "square": "sq", "highway": "hwy",
         "suite": "ste", "apartment": "apt", "floor": "fl", "building": "bldg", "north": "n", "south": "s", "east": "e", "west": "w"}
_ADDRESS = "struct<streetAddress: string, addressLocality: string, addressRegion: string, postalCode: string>"
SIMILAR = 0.7


def name_form(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[ -]", "")


def address_form(address: Column) -> Column:
    """Words in small letters, without punctuation, in their postal short forms; empty for null."""
    short = F.create_map(*[F.lit(x) for pair in SHORT.items() for x in pair])
    words = F.regexp_extract_all(F.lower(F.coalesce(address, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(short, w), w)), " ")


def _named(name: Column) -> Column:
    """The trimmed name; null where it is too short, too long or reads like an advertisement."""
    n, low = F.trim(name), F.lower(name)
    plain = ~F.exists(F.lit(list(HEADLINES)), lambda w: F.contains(low, w))
    return F.when(F.length(n).between(3, 99) & plain, n)


def presence(pages: DataFrame) -> DataFrame:
    """-> url, name, name_source, name_consistent, address (struct<street, city, region, zip, shown>), phone, phones, phone_consistent, lat, lng, complete.

    name: the first usable of an Organization's name and legal name, a WebSite's name, og:site_name, a LocalBusiness's name and the first two H1; then title and
    application name are held against it: consistent where 0.7 of the different names have one form, otherwise the most frequent form gives the name, of equals the first.
    address, phone and place: of each JSON-LD block the first Organization or LocalBusiness, and of the blocks the last that has one.  @type may be a list.
    An address that is no object, and a place that is no pair of numbers on the globe, are empty.  phone_consistent: the text shows the same digits.
    Bad JSON and null columns give empty values.  pages: url, jsonld, metas, headings, title, text."""
    parsed = lambda texts: F.filter(F.transform(texts, lambda n: F.from_json(n, "map<string, string>")), lambda m: m.isNotNull())
    of = lambda graph, *types: F.filter(graph, lambda m: F.arrays_overlap(type_names(m["@type"]), F.lit(list(types))))
    some = lambda value, kind: F.coalesce(value, F.array().cast(kind))
    first = lambda names: F.try_element_at(F.filter(names, lambda n: n.isNotNull()), F.lit(1))
    blocks = F.transform(some(F.col("jsonld"), NO_TEXTS), lambda b: parsed(nodes(F.array(b))))
    base = pages.withColumn("_blocks", blocks)
    base = base.withColumns({"_graph": F.flatten("_blocks"), "_home": F.try_element_at(F.filter(F.transform("_blocks", lambda g: F.try_element_at(of(g, "Organization", "LocalBusiness"), F.lit(1))), lambda m: m.isNotNull()), F.lit(-1))})
    entity = lambda kind, field: first(F.transform(of(F.col("_graph"), kind), lambda m: _named(m[field])))
    meta = lambda k: F.try_element_at(F.try_element_at("metas", F.lit(k)), F.lit(1))
    h1 = F.slice(F.transform(F.filter("headings", lambda h: h["level"] == 1), lambda h: h["text"]), 1, 2)
    titled = first(F.transform(h1, lambda t: F.when(~F.exists(F.lit(list(NO_NAMES)), lambda w: F.contains(F.lower(t), w)), _named(t))))
    chain = {"organization": entity("Organization", "name"), "legal_name": entity("Organization", "legalName"), "website": entity("WebSite", "name"), "og:site_name": _named(meta("og:site_name")),
             "local_business": entity("LocalBusiness", "name"), "heading": titled}
    where = F.from_json(F.col("_home")["address"], _ADDRESS)
    place = F.from_json(F.col("_home")["geo"], "struct<latitude: string, longitude: string>")
    text = F.coalesce(F.col("text"), F.lit(""))
    base = base.withColumns({
        "_pick": F.try_element_at(F.filter(F.array(*[F.struct(F.lit(k).alias("source"), v.alias("name")) for k, v in chain.items()]), lambda x: x["name"].isNotNull()), F.lit(1)),
        "_where": where, "phone": F.trim(F.coalesce(F.col("_home")["telephone"], F.lit(""))), "_place": F.struct(place["latitude"].try_cast("double").alias("lat"), place["longitude"].try_cast("double").alias("lng")),
        "phones": F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in PHONES])),
    })
    shown = lambda t: F.when((F.length(F.trim(t)) > 0) & (F.length(F.trim(t)) < 100), F.trim(t))
    names = F.array_compact(F.array(F.col("_pick")["name"], shown(F.col("title")), shown(meta("application-name"))))

    def agreed(n: Column) -> Column:
        kinds = F.array_distinct(n)
        like = lambda among, x: F.size(F.filter(among, lambda y: name_form(y) == name_form(x)))
        lead = F.try_element_at(n, F.lit(1))
        same = (F.size(n) > 0) & (like(kinds, lead) >= SIMILAR * F.size(kinds))
        most = F.array_max(F.transform(n, lambda x, i: F.struct(like(n, x).alias("n"), (-i).alias("i"), x.alias("x"))))["x"]
        return F.struct(F.when(same, lead).otherwise(most).alias("name"), same.alias("same"))

    digits = lambda x: F.regexp_replace(x, r"\D", "")
    field = lambda n: F.trim(F.coalesce(F.col("_where")[n], F.lit("")))
    parts = [field(n) for n in ("streetAddress", "addressLocality", "addressRegion", "postalCode")]
    full = F.array_join(F.filter(F.array(*parts), lambda p: p != ""), " ")
    globe = F.col("_place.lat").between(-90, 90) & F.col("_place.lng").between(-180, 180)
    out = base.withColumns({"_agreed": let(names, agreed), "address": F.struct(*[p.alias(n) for p, n in zip(parts, ("street", "city", "region", "zip"), strict=True)], full.alias("shown"))})
    return out.select("url", F.col("_agreed.name").alias("name"), F.col("_pick.source").alias("name_source"), F.col("_agreed.same").alias("name_consistent"), "address", "phone", "phones",
                      ((F.col("phone") != "") & F.exists("phones", lambda p: digits(p) == digits(F.col("phone")))).alias("phone_consistent"),
                      F.when(globe, F.col("_place.lat")).alias("lat"), F.when(globe, F.col("_place.lng")).alias("lng"),
                      (has(F.col("_agreed.name")) & (F.col("address.shown") != "") & (F.col("phone") != "")).alias("complete"))


def settled(rows: DataFrame, block: tuple[str, ...], form: str, shown: str, within: int = 3) -> DataFrame:
    """-> block, form, n, shown, majority, distance, agrees: each form of a block against the block's most frequent one (of equals the least).

    distance: letters to change, null beyond `within`, so long forms cost no more than their length times `within`; agrees: there is a distance.  shown: the most common
    writing's least.  Rows are counted by form before they meet, so a block with most rows of the table moves only its different forms; a form meets the majority alone,
    never all others.  Null or empty forms, and null block columns, are no evidence and are left out."""
    known = rows.select(*block, F.col(form).alias("form"), F.col(shown).alias("shown")).filter((F.col("form") != "")).dropna(subset=list(block))
    forms = known.groupBy(*block, "form").agg(F.count("*").alias("n"), F.min("shown").alias("shown"))
    # the heads carry shown as well, so that both sides read the same columns and the forms are counted in one exchange
    heads = forms.groupBy(*block).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("form").alias("majority"), "shown")).alias("h")).select(*block, F.col("h.majority").alias("majority"))
    out = forms.join(heads, list(block)).withColumn("d", F.levenshtein("form", "majority", within))
    return out.select(*block, "form", "n", "shown", "majority", F.when(F.col("d") >= 0, F.col("d")).alias("distance"), (F.col("d") >= 0).alias("agrees"))


def reconciled_addresses(found: DataFrame, site: str, within: int = 3) -> DataFrame:
    """settled over a site's addresses (presence's column address).  A block is a postal code, or a city where there is none, and the first house number."""
    a = F.col("address")
    area = F.coalesce(F.nullif(address_form(a["zip"]), F.lit("")), address_form(a["city"]))
    rows = found.select(F.col(site).alias("site"), F.concat_ws(" ", area, F.nullif(F.regexp_extract(a["street"], r"\d+", 0), F.lit(""))).alias("block"), address_form(a["street"]).alias("form"), a["street"].alias("shown"))
    return settled(rows, ("site", "block"), "form", "shown", within)


def reconciled_names(found: DataFrame, site: str, within: int = 2) -> DataFrame:
    """settled over the names of a site's pages."""
    rows = found.select(F.col(site).alias("site"), name_form(F.col("name")).alias("form"), F.col("name").alias("shown"))
    return settled(rows, ("site",), "form", "shown", within)
