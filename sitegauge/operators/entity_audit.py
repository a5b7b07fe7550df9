"""Audits of a site's JSON-LD entities: ids, types, required properties, references, and the page's primary entity.

entity_table gives one row for each entity; everything else is joins, groups
and Columns over it.  An entity's properties are a map of name to text: a string
as it is, any other value as its JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.functions.urls import host, is_homepage, path, query
from sitegauge.operators.entities import has, tolerant

# Schema types that are known, properties that a type needs, properties that refer to other
# entities, types that stay inside others, and the orders in which a page's main type is chosen.
KNOWN_TYPES = ("Thing|Organization|Corporation|Person|Place|Product|Service|Offer|Event|Article|BlogPosting|NewsArticle|WebPage|WebSite|AboutPage|ContactPage|CollectionPage|ItemPage|"
               "ImageObject|VideoObject|AudioObject|MediaObject|BreadcrumbList|ListItem|ItemList|FAQPage|QAPage|Question|Answer|HowTo|HowToStep|HowToSection|LocalBusiness|FoodEstablishment|"
               "Restaurant|Hotel|MedicalEntity|MedicalCondition|MedicalProcedure|JobPosting|RealEstateListing|Vehicle|TouristAttraction|Dataset|Review|AggregateRating|Rating|PostalAddress|"
               "ContactPoint|GeoCoordinates|OpeningHoursSpecification|CreativeWork|Book|Movie|Recipe|Course|SoftwareApplication").split("|")
NEEDED = {"Product": ("name",), "Service": ("name", "description"), "Article": ("headline",), "BlogPosting": ("headline",), "NewsArticle": ("headline",), "WebPage": ("name",),
          "Organization": ("name",), "Person": ("name",), "Place": ("name",), "Event": ("name", "startDate"), "Offer": ("price",), "Restaurant": ("name",), "Hotel": ("name",),
          "JobPosting": ("title", "description"), "FAQPage": ("mainEntity",), "HowTo": ("name", "step"), "Dataset": ("name",), "ImageObject": ("contentUrl",), "VideoObject": ("contentUrl",),
          "BreadcrumbList": ("itemListElement",), "ListItem": ("position", "name")}
EXPECTED = {"Service": ("name", "description", "provider", "areaServed", "serviceType", "offers", "audience", "availableChannel"),
            "Product": ("name", "description", "brand", "offers", "aggregateRating", "review"), "Article": ("headline", "author", "datePublished", "publisher", "image"),
            "BlogPosting": ("headline", "author", "datePublished", "publisher"), "FAQPage": ("mainEntity",), "Dataset": ("name", "description", "license", "creator"),
            "WebPage": ("name", "description", "url"), "Organization": ("name", "url", "logo")}
RELATIONS = ("provider", "publisher", "brand", "author", "creator", "manufacturer", "mainEntityOfPage", "about", "subjectOf", "isPartOf", "hasPart", "logo", "image", "knows", "worksFor",
             "alumniOf", "parentOrganization", "subOrganization", "memberOf", "affiliation", "primaryImageOfPage", "location")
NESTED = ("PostalAddress", "ContactPoint", "GeoCoordinates", "OpeningHoursSpecification")
PRIMARY = ("WebPage", "AboutPage", "Service", "Product", "Organization")
HOME_TYPES = ("WebPage", "Organization", "Service", "Product", "Article", "BlogPosting", "FAQPage", "HowTo", "Dataset", "AboutPage")
SUBPAGE_TYPES = ("Service", "Product", "Article", "BlogPosting", "FAQPage", "HowTo", "Dataset", "AboutPage", "WebPage")
MAIN_NEEDS = {"AboutPage": ("description", "mainEntity"), "Article": ("author", "publisher"), "BlogPosting": ("author", "publisher"), "Service": ("serviceType", "provider")}

NO_TEXTS = "array<string>"
DEPTH = 3  # levels of @graph inside @graph that are opened


def _opened(texts: Column) -> Column:
    """Each text that is an array or holds @graph is replaced by what is inside."""
    none = F.array().cast(NO_TEXTS)

    def inside(t: Column) -> Column:
        listed = F.when(F.trim(t).startswith("["), F.from_json(t, NO_TEXTS))
        return F.coalesce(listed, F.from_json(t, "struct<`@graph`: array<string>>")["@graph"], F.array(t), none)

    return F.flatten(F.transform(texts, inside))


def nodes(blocks: Column) -> Column:
    """The JSON texts of all entities in a page's blocks, whatever graphs and arrays they lie in; bad JSON gives none."""
    texts = F.transform(F.coalesce(blocks, F.array().cast(NO_TEXTS)), tolerant)
    for _ in range(DEPTH):
        texts = _opened(texts)
    return F.filter(texts, lambda t: F.trim(t).startswith("{"))


def type_names(kind: Column) -> Column:
    """@type as an array, whether it was a name or a list of names."""
    return F.when(kind.startswith("["), F.from_json(kind, NO_TEXTS)).when(has(kind), F.array(kind)).otherwise(F.array().cast(NO_TEXTS))


def entity_table(pages: DataFrame) -> DataFrame:
    """-> page_url, pos, id, types, props, node; a row for each entity with a type or an id.  pages: url, jsonld."""
    rows = pages.select(F.col("url").alias("page_url"), F.posexplode(nodes(F.col("jsonld"))).alias("pos", "node"))
    rows = rows.withColumn("props", F.from_json("node", "map<string, string>")).filter("props is not null")
    return rows.select("page_url", "pos", F.nullif(F.col("props")["@id"], F.lit("")).alias("id"), type_names(F.col("props")["@type"]).alias("types"), "props", "node").filter(
        (F.size("types") > 0) | F.col("id").isNotNull())


def held_properties(props: Column) -> Column:
    """The properties with a value; none if only @type is left."""
    kept = F.map_filter(props, lambda k, v: has(v))
    return F.when(F.size(F.map_filter(kept, lambda k, v: k != "@type")) > 0, kept)


def is_graph_node(types: Column, id: Column) -> Column:
    """Whether an entity stands by itself: it has an id or none of the types that stay inside others."""
    return id.isNotNull() | ~F.arrays_overlap(types, F.lit(list(NESTED)))


def entity_id(id: Column, root: Column) -> Column:
    """An id under the canonical root: fragments and paths join it, full URLs take its scheme and host."""
    origin = F.concat(F.regexp_extract(root, "^([A-Za-z][A-Za-z0-9+.-]*://)", 1), F.regexp_extract(root, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    tail = F.concat(path(id), F.when(query(id) != "", F.concat(F.lit("?"), query(id))).otherwise(""), F.when(F.regexp_extract(id, "#(.*)$", 1) != "", F.regexp_extract(id, "#.*$", 0)).otherwise(""))
    slashed = F.when(root.endswith("/"), root).otherwise(F.concat(root, F.lit("/")))
    folder = F.regexp_replace(path(root), "[^/]*$", "")
    return (F.when(id.startswith("#"), F.concat(slashed, id)).when(id.rlike("^https?://"), F.concat(origin, tail)).when(id.startswith("/"), F.concat(origin, id))
            .otherwise(F.concat(origin, F.when(folder == "", "/").otherwise(folder), id)))


def entity_hash(props: Column) -> Column:
    """16 hex digits of the SHA-256 of the properties in order of their names (values in the order they were written)."""
    pairs = F.transform(F.array_sort(F.map_entries(props)), lambda e: F.concat(e["key"], F.lit("\x1f"), F.coalesce(e["value"], F.lit(""))))
    return F.left(F.sha2(F.array_join(pairs, "\x1e"), 256), F.lit(16))


def referenced_ids(node: Column) -> Column:
    """All @id values in an entity's text, its own included, in order, repeats kept."""
    return F.regexp_extract_all(node, F.lit(r'"@id"\s*:\s*"([^"]+)"'), F.lit(1))


def references(entities: DataFrame) -> DataFrame:
    """-> page_url, target, referenced_by: how many of a page's entities name each id; an entity's own id counts if it is named again."""
    named = entities.select("page_url", "pos", F.explode(F.array_distinct(referenced_ids(F.col("node")))).alias("target"))
    return named.groupBy("page_url", "target").agg(F.count_distinct("pos").alias("referenced_by"))


def unreferenced(entities: DataFrame) -> DataFrame:
    """-> page_url, id: entities whose id no other entity of the page names."""
    own = entities.filter("id is not null").select("page_url", "pos", "id")
    named = entities.select("page_url", F.col("pos").alias("of"), F.explode(referenced_ids(F.col("node"))).alias("id"))
    elsewhere = named.join(own, ["page_url", "id"]).filter("of <> pos").select("page_url", "id").distinct()
    return own.select("page_url", "id").distinct().join(elsewhere, ["page_url", "id"], "left_anti")


def isolated(entities: DataFrame) -> DataFrame:
    """-> page_url, id: entities that name no id but their own."""
    return entities.filter("id is not null").filter(F.size(F.filter(referenced_ids(F.col("node")), lambda r: r != F.col("id"))) == 0).select("page_url", "id")


def duplicate_ids(entities: DataFrame) -> DataFrame:
    return entities.filter("id is not null").groupBy("page_url", "id").agg(F.count("*").alias("n")).filter("n > 1")


def type_distribution(entities: DataFrame, *keep: str) -> DataFrame:
    """-> keep, type, n."""
    return entities.select(*keep, F.explode("types").alias("type")).groupBy(*keep, "type").agg(F.count("*").alias("n"))


def validated(entities: DataFrame) -> DataFrame:
    """Adds known_type, missing (needed properties that are absent) and id_form."""
    lacking = [F.when(F.array_contains("types", t), F.filter(F.lit(list(names)), lambda n: ~F.array_contains(F.map_keys("props"), n))) for t, names in NEEDED.items()]
    form = F.when(F.col("id").isNull(), None).when(F.col("id").startswith("https://"), "https").when(F.col("id").startswith("http://"), "http").when(F.col("id").startswith("#"), "hash").otherwise("relative")
    return entities.withColumns({"known_type": F.arrays_overlap("types", F.lit(list(KNOWN_TYPES))), "missing": F.flatten(F.array_compact(F.array(*lacking))), "id_form": form})


def id_compliance(entities: DataFrame, root: Column) -> DataFrame:
    """-> page_url, n_ids, valid_ids, percent, grade: ids under the root, or of its host, count as valid."""
    plain = F.regexp_replace(root, "#.*$", "")
    ok = F.col("id").startswith("https://") & (F.startswith(F.col("id"), plain) | (host(F.col("id")) == host(root)))
    out = entities.filter("id is not null").groupBy("page_url").agg(F.count("*").alias("n_ids"), F.count_if(ok).alias("valid_ids"))
    percent = F.col("valid_ids") * 100.0 / F.col("n_ids")
    return out.withColumn("percent", percent).withColumn("grade", F.when(percent >= 95, "A").when(percent >= 85, "B").when(percent >= 70, "C").otherwise("D"))


def expected_properties(entities: DataFrame) -> DataFrame:
    """-> page_url, type, held, expected, percent: expected properties that at least one of the page's entities of the type (its first name) holds."""
    rows = entities.select("page_url", F.try_element_at("types", F.lit(1)).alias("type"), "props")
    cases = F.lit(None).cast(NO_TEXTS)
    for kind, names in EXPECTED.items():
        cases = F.when(F.col("type") == kind, F.lit(list(names))).otherwise(cases)
    rows = rows.withColumn("names", cases).filter("names is not null").select("page_url", "type", F.explode("names").alias("name"), "props")
    each = rows.groupBy("page_url", "type", "name").agg(F.bool_or(has(F.col("props")[F.col("name")])).alias("held"))
    out = each.groupBy("page_url", "type").agg(F.count_if("held").alias("held"), F.count("*").alias("expected"))
    return out.withColumn("percent", F.col("held") * 100.0 / F.col("expected"))


def relations(entities: DataFrame) -> DataFrame:
    """-> page_url, source, property, target, target_type, scope; a row for each property value that names an @id.

    scope: internal_entity if the page holds the target, whose type then counts, else external_entity."""
    rows = entities.filter("id is not null").select("page_url", F.col("id").alias("source"), "props")
    pairs = F.filter(F.map_entries("props"), lambda e: F.lit(list(RELATIONS)).isNotNull() & F.array_contains(F.lit(list(RELATIONS)), e["key"]))
    value = rows.select("page_url", "source", F.explode(pairs).alias("e")).select("page_url", "source", F.col("e.key").alias("property"), F.explode(_opened(F.array(F.col("e.value")))).alias("v"))
    target = value.filter(F.trim("v").startswith("{")).select("page_url", "source", "property", F.from_json("v", "struct<`@id`: string, `@type`: string>").alias("t"))
    target = target.select("page_url", "source", "property", F.col("t.@id").alias("target"), F.col("t.@type").alias("stated")).filter("target is not null")
    own = entities.filter("id is not null").groupBy("page_url", F.col("id").alias("target")).agg(F.min_by(F.try_element_at("types", F.lit(1)), "pos").alias("found"), F.lit(True).alias("own"))
    return target.join(own, ["page_url", "target"], "left").select("page_url", "source", "property", "target", F.coalesce("found", "stated").alias("target_type"),
                                                                  F.when(F.col("own"), "internal_entity").otherwise("external_entity").alias("scope"))


def primary_entity(entities: DataFrame) -> DataFrame:
    """-> page_url, primary_id, primary_type, reason, priority: one row for each page with entities.

    An entity whose mainEntityOfPage is the page has 2000, one whose id is the page's URL 1500, one of a
    PRIMARY type 1000 less the type's place; of equals the first counts, and without any the first entity."""
    main = F.coalesce(F.from_json(F.col("props")["mainEntityOfPage"], "struct<`@id`: string>")["@id"], F.col("props")["mainEntityOfPage"])
    first = F.coalesce(F.try_element_at("types", F.lit(1)), F.lit("Unknown"))
    case = F.when(main == F.col("page_url"), F.struct(F.lit(2000).alias("p"), F.lit("main_entity_of_page").alias("r"), first.alias("t")))
    case = case.when((F.col("id") == F.col("page_url")) & F.col("props")["mainEntityOfPage"].isNull(), F.struct(F.lit(1500).alias("p"), F.lit("id_is_page").alias("r"), first.alias("t")))
    for i, kind in enumerate(PRIMARY):
        case = case.when(F.array_contains("types", kind), F.struct(F.lit(1000 - i).alias("p"), F.lit("type_order").alias("r"), F.lit(kind).alias("t")))
    case = case.otherwise(F.struct(F.lit(0).alias("p"), F.lit("first_entity").alias("r"), first.alias("t")))
    best = F.max_by(F.struct("id", case.alias("c")), F.struct(case["p"].alias("p"), (-F.col("pos")).alias("at"))).alias("b")
    return entities.groupBy("page_url").agg(best).select("page_url", F.col("b.id").alias("primary_id"), F.col("b.c.t").alias("primary_type"), F.col("b.c.r").alias("reason"), F.col("b.c.p").alias("priority"))


def primary_type(types: Column, url: Column) -> Column:
    """The first of HOME_TYPES on a homepage, of SUBPAGE_TYPES elsewhere, among the page's types; null if none."""
    first = lambda order: F.try_element_at(F.filter(F.lit(list(order)), lambda t: F.array_contains(types, t)), F.lit(1))
    return F.when(is_homepage(url), first(HOME_TYPES)).otherwise(first(SUBPAGE_TYPES))


def violations(entities: DataFrame, root: str) -> DataFrame:
    """-> page_url and counts: organizations, local_on_subpage, no_organization, foreign_ids, bad_countries, missing_main.

    A local business counts as an organization of its own if its name differs from that of the page's first organization."""
    kind, p = F.try_element_at("types", F.lit(1)), F.col("props")
    domain = host(F.lit(root))
    name = F.trim(p["name"])
    country = F.from_json(p["address"], "struct<addressCountry: string>")["addressCountry"]
    lacking = F.lit(0)
    for t, names in MAIN_NEEDS.items():
        lacking = F.when(kind == t, sum(((~F.array_contains(F.map_keys("props"), n)).cast("int") for n in names), F.lit(0))).otherwise(lacking)
    rows = entities.select("page_url", "pos", kind.alias("kind"), name.alias("name"), "id", country.alias("country"), lacking.alias("lacking"),
                           (F.from_json(p["provider"], "struct<`@id`: string>")["@id"] == f"{root}#organization").alias("refers"))
    is_org = F.col("kind") == "Organization"
    pages = rows.groupBy("page_url").agg(
        F.count_if(is_org).alias("orgs"), F.min_by(F.when(is_org & (F.col("name") != ""), F.col("name")), F.when(is_org & (F.col("name") != ""), F.col("pos"))).alias("org_name"),
        F.collect_list(F.when(F.col("kind") == "LocalBusiness", F.col("name"))).alias("locals"), F.coalesce(F.bool_or("refers"), F.lit(False)).alias("refers"),
        F.count_if(F.col("id").contains("://") & (host(F.col("id")) != domain)).alias("foreign_ids"), F.count_if(F.length("country") != 2).alias("bad_countries"), F.sum("lacking").alias("missing_main"))
    apart = F.size(F.filter("locals", lambda n: (n != "") & (F.col("org_name").isNull() | (n != F.col("org_name"))))).cast("long")
    out = pages.withColumn("apart", apart)
    return out.select("page_url", (F.col("orgs") + F.col("apart")).alias("organizations"), (~is_homepage(F.col("page_url")) & (F.col("apart") > 0)).alias("local_on_subpage"),
                      ((F.col("orgs") + F.col("apart") == 0) & ~F.col("refers")).alias("no_organization"), "foreign_ids", "bad_countries", F.col("missing_main").cast("long").alias("missing_main"))


def majority_name(entities: DataFrame) -> DataFrame:
    """One row: the organization name most of the site's pages state, how many do, and how many other spellings there are."""
    name = F.trim(F.regexp_replace(F.col("props")["name"], r"\s+", " "))
    rows = entities.filter(F.arrays_overlap("types", F.lit(["Organization", "LocalBusiness"])) & (name != "")).select("page_url", name.alias("name"), F.lower(name).alias("plain"))
    votes = rows.groupBy("plain").agg(F.count_distinct("page_url").alias("pages"), F.min("name").alias("name"), F.count_distinct("name").alias("spellings"))
    return votes.agg(F.max_by("name", F.struct("pages", "plain")).alias("name"), F.max("pages").alias("pages"), (F.sum("spellings") - 1).alias("other_spellings"))


def organization_signals(entities: DataFrame) -> DataFrame:
    """-> page_url, name, url, logo, phone, email, street, locality, country, latitude, longitude, n_profiles of each page's first organization.

    A phone may stand in a contact point, coordinates as numbers or as text."""
    kinds = F.lit(["Organization", "LocalBusiness", "Corporation"])
    first = entities.filter(F.arrays_overlap("types", kinds)).groupBy("page_url").agg(F.min_by("props", "pos").alias("p"))
    p = F.col("p")
    address = F.from_json(p["address"], "struct<streetAddress: string, addressLocality: string, addressCountry: string>")
    contact = F.from_json(p["contactPoint"], "struct<telephone: string, email: string>")
    geo = F.from_json(p["geo"], "struct<latitude: string, longitude: string>")
    held = lambda *values: F.coalesce(*[F.when(has(v), v) for v in values])
    profiles = F.when(p["sameAs"].startswith("["), F.size(F.from_json(p["sameAs"], NO_TEXTS))).when(has(p["sameAs"]), 1).otherwise(0)
    return first.select("page_url", held(p["name"]).alias("name"), held(p["url"]).alias("url"), held(p["logo"]).alias("logo"), held(p["telephone"], contact["telephone"]).alias("phone"), held(p["email"], contact["email"]).alias("email"),
                        address["streetAddress"].alias("street"), address["addressLocality"].alias("locality"), address["addressCountry"].alias("country"),
                        geo["latitude"].try_cast("double").alias("latitude"), geo["longitude"].try_cast("double").alias("longitude"), profiles.alias("n_profiles"))


def linked_authors(entities: DataFrame) -> DataFrame:
    """-> page_url, id, author: entities with an author; one that is only an @id has the name of the page's entity of that id."""
    stated = F.from_json(F.col("props")["author"], "struct<`@id`: string, name: string>")
    plain = F.when(~F.col("props")["author"].startswith("{"), F.col("props")["author"])
    rows = entities.filter(has(F.col("props")["author"])).select("page_url", "id", F.coalesce(stated["name"], plain).alias("named"), stated["@id"].alias("author_id"))
    own = entities.filter("id is not null").groupBy("page_url", F.col("id").alias("author_id")).agg(F.min_by(F.col("props")["name"], "pos").alias("found"))
    return rows.join(own, ["page_url", "author_id"], "left").select("page_url", "id", F.coalesce("named", "found").alias("author"))


def deprecated_properties(entities: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """-> page_url, pos, property: the listed properties that entities still use."""
    return entities.select("page_url", "pos", F.explode(F.array_intersect(F.map_keys("props"), F.lit(list(names)))).alias("property"))


def described(entities: DataFrame, kinds: dict[str, tuple[str, ...]] = EXPECTED) -> DataFrame:
    """-> page_url, type, values: what the page's first entity of each kind says under the kind's properties (a map, absent ones left out)."""
    kind = F.try_element_at("types", F.lit(1))
    first = entities.withColumn("type", kind).filter(F.col("type").isin(*kinds)).groupBy("page_url", "type").agg(F.min_by("props", "pos").alias("p"))
    wanted = F.lit(None).cast(NO_TEXTS)
    for name, properties in kinds.items():
        wanted = F.when(F.col("type") == name, F.lit(list(properties))).otherwise(wanted)
    return first.withColumn("names", wanted).select("page_url", "type", F.map_filter("p", lambda k, v: F.array_contains("names", k) & has(v)).alias("values"))
