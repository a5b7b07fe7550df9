"""What a page of each type says about itself, from free-form JSON-LD read as VARIANT, and from the page where the schema is silent.

page_types gives one row for each page, in place: no row moves.  Values keep their
JSON form; a property that neither the schema nor the page states is left out of
the map.  A page without entities is a WebPage without properties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.functions.scores import let
from sitegauge.functions.text import words
from sitegauge.operators.schema_repair import entity, entity_graph, json_object, plain, quoted, truthy
from sitegauge.sources.dom import TEXT, text_of

# The order in which a page's main entity is looked for, types that are told apart in a list, properties of each type, and marks of bylines and question blocks.
PRIORITY = ("WebPage", "Service", "Product", "Article", "Organization")
RECOGNIZED = ("Service", "Product", "Article", "BlogPosting", "NewsArticle", "FAQPage", "Dataset")
STATED = {"Service": ("serviceType", "areaServed", "audience", "availableChannel", "hasOfferCatalog"), "Product": ("brand", "sku", "aggregateRating", "reviewCount"),
          "Article": ("headline", "author", "publisher", "datePublished", "dateModified", "mainEntityOfPage"), "Dataset": ("creator", "distribution", "license", "datePublished", "dateModified"),
          "WebPage": ("name", "description", "about", "mainEntity")}
ARTICLES = ("Article", "BlogPosting", "NewsArticle")
BYLINE = ((".author", "(^| )author( |$)"), (".byline", "(^| )byline( |$)"), ('[class*="author"]', "author"), ('[rel="author"]', None), (".post-author", "(^| )post-author( |$)"))
ASKING = "faq|question|accordion"
CHECKED = 5


def types(e: Column) -> Column:
    """The entity's types as an array."""
    return F.when(e["@type"].startswith("["), F.from_json(e["@type"], "array<string>")).when(truthy(e["@type"]), F.array(plain(e["@type"]))).otherwise(F.array().cast("array<string>"))


def first_of(graph: Column, *names: str) -> Column:
    """The first entity that has one of the types."""
    return F.try_element_at(F.filter(graph, lambda e: F.arrays_overlap(types(e), F.lit(list(names)))), F.lit(1))


def primary(graph: Column) -> Column:
    return F.coalesce(*[first_of(graph, t) for t in PRIORITY], F.try_element_at(graph, F.lit(1)))


def detected_type(e: Column) -> Column:
    listed = F.coalesce(F.try_element_at(F.filter(types(e), lambda t: t.isin(*RECOGNIZED)), F.lit(1)), F.try_element_at(types(e), F.lit(1)))
    return F.coalesce(F.when(e["@type"].startswith("["), listed), F.when(truthy(e["@type"]), plain(e["@type"])), F.lit("WebPage"))


def confidence(e: Column) -> Column:
    """1 for a single type, 0.8 for one of a list, 0.3 for an entity without type, 0.5 without an entity."""
    return F.when(e.isNull(), 0.5).when(e["@type"].startswith("["), F.when(F.array_contains(types(e), detected_type(e)), 0.8).otherwise(0.5)).when(truthy(e["@type"]), 1.0).otherwise(0.3)


def _listed(value: Column) -> Column:
    """A JSON list's members; any other value as the only member; none for null."""
    members = F.transform(F.from_json(value, "array<variant>"), lambda v: F.coalesce(F.to_json(v), F.lit("null")))
    return F.when(value.startswith("["), members).when(truthy(value), F.array(value)).otherwise(F.array().cast("array<string>"))


def offers(graph: Column, e: Column) -> Column:
    """JSON of the main entity's offers and of the page's Offer entities."""
    own = F.transform(F.filter(graph, lambda x: F.array_contains(types(x), "Offer")), json_object)
    return F.concat(_listed(e["offers"]), own)


def _json_list(values: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(values, ","), F.lit("]"))


def schema_questions(graph: Column) -> Column:
    """array<struct<question, answer>> of the first FAQPage: questions with a name and an accepted, else suggested, answer."""
    def answer(q: Column) -> Column:
        texts = lambda v: F.array_join(F.transform(_listed(v), lambda a: F.coalesce(plain(entity(a)["text"]), F.lit(""))), " ")
        return F.when(truthy(q["acceptedAnswer"]), texts(q["acceptedAnswer"])).otherwise(texts(q["suggestedAnswer"]))

    items = F.transform(_listed(first_of(graph, "FAQPage")["mainEntity"]), entity)
    asked = F.filter(items, lambda q: F.coalesce(plain(q["@type"]).isin("Question", "question"), F.lit(False)))
    pairs = F.transform(asked, lambda q: F.struct(F.coalesce(plain(q["name"]), F.lit("")).alias("question"), F.coalesce(answer(q), F.lit("")).alias("answer")))
    return F.coalesce(F.filter(pairs, lambda p: (p["question"] != "") & (p["answer"] != "")), F.array().cast("array<struct<question: string, answer: string>>"))


def shown_questions(dom: Column) -> Column:
    """array<struct<question, answer>>: headings inside elements whose class names questions, each with the text of the elements after it up to the next heading beside it; each heading once."""
    numbered = F.transform(dom, lambda x, k: F.struct(k.alias("k"), x["tag"].alias("tag"), x["parent"].alias("parent"), x["last"].alias("last"), x["chars"].alias("chars"), F.lower(F.array_join(x["classes"], " ")).alias("c")))
    is_head = lambda x: x["tag"].rlike("^h[1-6]$")

    def pairs(all_nodes: Column) -> Column:
        blocks = F.filter(all_nodes, lambda x: x["c"].rlike(ASKING))
        heads = F.filter(all_nodes, lambda x: is_head(x) & (x["chars"] > 0) & F.exists(blocks, lambda b: (x["k"] > b["k"]) & (x["k"] <= b["last"])))
        elements = F.filter(all_nodes, lambda x: ~x["tag"].startswith("#"))

        def pair(h: Column) -> Column:
            beside = F.filter(elements, lambda x: (x["parent"] == h["parent"]) & (x["k"] > h["last"]))
            stop = F.coalesce(F.array_min(F.transform(F.filter(beside, is_head), lambda x: x["k"])), F.lit(1 << 30))
            told = F.filter(beside, lambda x: (x["k"] < stop) & (x["chars"] > 0))
            return F.struct(text_of(dom, h["k"], h["last"], " ").alias("question"), F.array_join(F.transform(told, lambda x: text_of(dom, x["k"], x["last"], " ")), " ").alias("answer"))

        return F.filter(F.transform(heads, pair), lambda p: (p["question"] != "") & (p["answer"] != ""))

    return let(numbered, pairs)


def byline(dom: Column, metas: Column) -> Column:
    """The author that the page shows: its meta tag, else the first element with the marks of a byline, in order of the marks; null if there is none."""
    numbered = F.transform(dom, lambda x, k: F.struct(k.alias("k"), x["last"].alias("last"), F.array_join(x["classes"], " ").alias("c"), F.try_element_at(x["attrs"], F.lit("rel")).alias("rel"), x["tag"].alias("tag")))
    fits = lambda p: lambda x: (x["tag"] != TEXT) & F.coalesce((x["rel"] == "author") if p is None else x["c"].rlike(p), F.lit(False))
    found = lambda ns: F.coalesce(*[F.try_element_at(F.filter(ns, fits(p)), F.lit(1)) for _, p in BYLINE])
    shown = let(let(numbered, found), lambda x: F.when(x.isNotNull(), text_of(dom, x["k"], x["last"], " ")))
    return F.coalesce(F.trim(F.try_element_at(F.try_element_at(metas, F.lit("author")), F.lit(1))), shown)


def page_types(pages: DataFrame, *keys: str) -> DataFrame:
    """-> keys, detected_type, confidence, properties (map of name to JSON), questions, average_answer, questions_shown.

    pages: keys, jsonld, and of features and the DOM tree: title, metas, text, dom.  questions_shown: the first five questions and answers stand in the page's text."""
    out = pages.withColumn("_g", entity_graph(F.col("jsonld"))).withColumn("_e", primary(F.col("_g"))).withColumn("detected_type", detected_type(F.col("_e")))
    g, e, kind = F.col("_g"), F.col("_e"), F.col("detected_type")
    first_h1 = F.try_element_at(F.filter(F.transform(F.col("dom"), lambda x, k: F.when((x["tag"] == "h1"), text_of(F.col("dom"), k, x["last"], " "))), lambda t: t.isNotNull()), F.lit(1))
    text = lambda v: F.when(v.isNotNull(), quoted(v))
    provider = F.when(e["provider"].startswith("{") & truthy(e["provider"]), e["provider"]).when(truthy(e["provider"]), F.concat(F.lit('{"name":'), quoted(plain(e["provider"])), F.lit("}"))).otherwise(
        F.coalesce(json_object(first_of(g, "Organization")), F.lit("{}")))
    service_type = F.try_element_at(F.filter(F.transform(g, lambda x: x["serviceType"]), truthy), F.lit(1))
    listed = offers(g, e)
    derived = {"serviceType": F.when((kind == "Service") & ~truthy(e["serviceType"]), service_type), "provider": F.when(kind == "Service", provider),
               "offers": F.when((kind == "Service") | (kind == "Product") & (F.size(listed) > 0), _json_list(listed)),
               "headline": F.when(kind.isin(*ARTICLES) & ~truthy(e["headline"]), text(F.coalesce(first_h1, F.nullif(F.col("title"), F.lit(""))))),
               "author": F.when(kind.isin(*ARTICLES) & ~truthy(e["author"]), text(byline(F.col("dom"), F.col("metas"))))}
    wanted = F.lit(None).cast("array<string>")
    for name, names in STATED.items():
        wanted = F.when(kind.isin(*ARTICLES) if name == "Article" else kind == name, F.lit(list(names))).otherwise(wanted)
    stated = F.map_filter(e, lambda k, v: F.array_contains(F.col("_w"), k) & (v != "null"))
    more = F.map_filter(F.create_map(*[x for k, v in derived.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())
    both = F.map_zip_with(F.coalesce(stated, F.create_map().cast("map<string,string>")), more, lambda _, a, b: F.coalesce(b, a))
    out = out.withColumn("_w", wanted).withColumn("properties", F.when(e.isNotNull(), both).otherwise(F.create_map().cast("map<string,string>")))
    asked = let(schema_questions(g), lambda s: F.when(F.size(s) > 0, s).otherwise(shown_questions(F.col("dom"))))
    out = out.withColumn("questions", F.when(kind == "FAQPage", asked).otherwise(F.array().cast("array<struct<question: string, answer: string>>")))
    q, page = F.col("questions"), F.lower("text")
    flat = lambda t: F.lower(F.trim(F.regexp_replace(t, r"(?U)\s+", " ")))
    n_words = F.aggregate(q, F.lit(0), lambda n, p: n + F.size(words(p["answer"])))
    return out.select(*keys, "detected_type", confidence(e).alias("confidence"), "properties", "questions", F.when(F.size(q) > 0, F.floor(n_words / F.size(q))).otherwise(0).cast("int").alias("average_answer"),
                      ((F.size(q) > 0) & F.forall(F.slice(q, 1, CHECKED), lambda p: F.contains(page, flat(p["question"])) & F.contains(page, flat(p["answer"])))).alias("questions_shown"))


CHECKS = {"BreadcrumbList": ("itemListElement",), "Article": ("headline", "author", "datePublished"), "NewsArticle": ("headline", "author", "datePublished"), "BlogPosting": ("headline", "author", "datePublished"), "FAQPage": ("mainEntity",),
          "HowTo": ("step",), "Organization": ("name", "url"), "LocalBusiness": ("name", "address", "description")}
COUNTED = {"BreadcrumbList": "itemListElement", "FAQPage": "mainEntity", "HowTo": "step"}
RETIRED = ("DataFeed", "DataCatalog", "Residence", "CivicStructure")


def schema_checks(graph: Column) -> Column:
    """array<struct<type, valid, missing, retired, members>> of a page's entities: required properties of eight types that are absent or empty, types that are no longer used, and how many
    members a trail, question page or instruction lists; an entity of several types is judged by the first."""
    def check(e: Column) -> Column:
        kind = F.coalesce(F.try_element_at(types(e), F.lit(1)), F.lit("Unknown"))
        missing, members = F.array().cast("array<string>"), F.lit(None).cast("int")
        for name, needed in CHECKS.items():
            missing = F.when(kind == name, F.array_compact(F.array(*[F.when(~truthy(e[n]), F.lit(n)) for n in needed]))).otherwise(missing)
        for name, listed in COUNTED.items():
            members = F.when(kind == name, F.when(e[listed].startswith("["), F.size(_listed(e[listed]))).otherwise(0)).otherwise(members)
        retired = kind.isin(*RETIRED)
        return let(F.struct(kind.alias("type"), missing.alias("missing"), retired.alias("retired"), members.alias("members")), lambda c: F.struct(
            c["type"].alias("type"), ((F.size(c["missing"]) == 0) & ~c["retired"]).alias("valid"), c["missing"].alias("missing"), c["retired"].alias("retired"), c["members"].alias("members")))

    return F.transform(graph, check)


def schema_shapes(pages: DataFrame) -> DataFrame:
    """-> type, entities, shape: for each entity type of the site, how many entities there are and the merged shape of all of them.

    The shape is the schema of a VARIANT over all entities, merged by partial aggregates, so a property that is a text on one page and an object on another shows as VARIANT."""
    rows = pages.select(F.explode(entity_graph(F.col("jsonld"))).alias("e"))
    rows = rows.select(F.explode(types(F.col("e"))).alias("type"), F.parse_json(json_object(F.col("e"))).alias("v"))
    return rows.groupBy("type").agg(F.count("*").alias("entities"), F.schema_of_variant_agg("v").alias("shape"))
