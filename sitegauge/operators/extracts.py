"""Extracts from a page's HTML and from saved probe answers: sections, breadcrumbs, questions, images, formats, headers, performance.

Columns over the page table of sources.signals; html is the page's source.
Null html gives empty extracts.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from sitegauge.functions.intents import alt_score, image_weight
from sitegauge.functions.scores import let
from sitegauge.functions.text import QUESTION, jaccard, words
from sitegauge.functions.urls import bare_url, host, path
from sitegauge.operators.entities import has
from sitegauge.sources.html import attribute, strip_tags

# headings' words for each kind of section, security headers, performance audits with the factor
# to their unit, opportunities, marks of main content, noise and bylines, and properties that are no longer used.
SECTIONS = {"definition_section": "what is|overview|introduction|about|definition", "use_case_section": "use case|who it's for|ideal for|applications|benefits",
            "step_section": "how it works|steps|process|get started|tutorial|guide", "faq_section": "faq|frequently asked questions|questions|common questions",
            "edge_case_section": "limitations|edge case|exceptions|constraints|caveats"}
SECURITY = {"csp": "content-security-policy", "hsts": "strict-transport-security", "x_frame_options": "x-frame-options", "x_content_type_options": "x-content-type-options", "referrer_policy": "referrer-policy",
            "permissions_policy": "permissions-policy"}
AUDITS = {"fcp": ("first-contentful-paint", 1000), "lcp": ("largest-contentful-paint", 1000), "cls": ("cumulative-layout-shift", 1), "tbt": ("total-blocking-time", 1), "speed_index": ("speed-index", 1000), "tti": ("interactive", 1000)}
OPPORTUNITIES = ("render-blocking-resources", "unused-css-rules", "unused-javascript", "uses-responsive-images", "offscreen-images", "uses-optimized-images", "modern-image-formats", "uses-text-compression", "uses-rel-preconnect",
                 "server-response-time", "redirects", "uses-long-cache-ttl", "total-byte-weight")
NOISE = r"(?is)<(nav|footer|aside|header|form|script|style|noscript|select|button|label|textarea)\b.*?</\1\s*>"
SEMANTIC = "header|nav|main|section|article|aside|footer|figure|figcaption|details|summary|time|mark"
UPDATED = r"(?i)(?:last\s+)?(?:updated|modified|reviewed|published)\s*(?:on|:)?\s*([A-Za-z0-9 ,./-]{6,24}\d)"
DEPRECATED = ("sourceOrganization", "awards", "members", "reviews", "offers_old", "map", "maps")
NO_TEXTS = "array<string>"


def _all(html: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(pattern), F.lit(group))


def main_content(html: Column) -> Column:
    """Text of the first of main, article and body that has over 100 characters without navigation, forms and scripts; '' if none has."""
    part = lambda tag: strip_tags(F.regexp_replace(F.regexp_extract(F.coalesce(html, F.lit("")), rf"(?is)<{tag}\b[^>]*>(.*)</{tag}\s*>", 1), NOISE, " "))
    return F.coalesce(*[let(part(tag), lambda t: F.when(F.length(t) > 100, t)) for tag in ("main", "article", "body")], F.lit(""))


def sections(html: Column) -> Column:
    """array<struct<kind, heading, level, n_words, confidence>>: for each kind the last heading that names it and is followed by 80 words or more.

    A heading has 5 points for each word of the kind, a fifth more at levels 2 and 3, a tenth more at 4; paragraphs count from 80 characters on."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(nav|header|footer|aside|form|style|script|noscript)\b.*?</\1\s*>", " ")
    block = lambda b: F.filter(F.transform(_all(b, r"(?is)<(?:p|div|section|ul|ol|table|blockquote)\b[^>]*>(?:(?!<(?:p|div|section)\b).)*"), strip_tags), lambda t: F.length(t) >= 80)

    def found(piece: Column) -> Column:
        level = F.regexp_extract(piece, r"(?i)^<h([1-4])", 1).cast("int")
        heading = strip_tags(F.regexp_extract(piece, r"(?is)^(<h[1-4]\b[^>]*>.*?</h[1-4]\s*>)", 1))
        n = F.aggregate(block(F.regexp_replace(piece, r"(?is)^<h[1-4]\b[^>]*>.*?</h[1-4]\s*>", "")), F.lit(0), lambda a, t: a + F.size(words(t)))
        points = F.array(*[F.struct((sum((F.when(F.lower(heading).contains(w), 5.0).otherwise(0.0) for w in p.split("|")), F.lit(0.0)) * F.when(level.isin(2, 3), 1.2).when(level == 4, 1.1).otherwise(1.0)).alias("confidence"),
                                    F.lit(-i).alias("at"), F.lit(k).alias("kind")) for i, (k, p) in enumerate(SECTIONS.items())])
        best = F.array_max(points)
        return F.struct(best["kind"].alias("kind"), heading.alias("heading"), level.alias("level"), n.alias("n_words"), best["confidence"].alias("confidence"))

    pieces = _all(bare, r"(?is)<h[1-4]\b[^>]*>.*?(?=<h[1-6]\b|\z)")
    good = F.filter(F.transform(pieces, found), lambda s: (s["confidence"] >= 2) & (s["n_words"] >= 80))
    last = let(good, lambda g: F.filter(g, lambda s, i: ~F.exists(F.slice(g, i + 2, F.greatest(F.size(g), F.lit(1))), lambda t: t["kind"] == s["kind"])))
    return F.array_sort(last, lambda a, b: F.when(a["confidence"] > b["confidence"], -1).when(a["confidence"] < b["confidence"], 1).otherwise(0))


def breadcrumbs(jsonld: Column) -> Column:
    """struct<names, positions, sorted, complete> of the page's first breadcrumb list."""
    item = "array<struct<position: int, name: string, item: string>>"
    lists = F.filter(F.transform(F.flatten(F.transform(F.coalesce(jsonld, F.array().cast(NO_TEXTS)), lambda b: _all(b, r'(?s)"itemListElement"\s*:\s*(\[.*?\])\s*[,}]', 1))), lambda x: F.from_json(x, item)), lambda x: x.isNotNull())
    return let(F.coalesce(F.try_element_at(lists, F.lit(1)), F.array().cast(item)), lambda x: let(F.transform(x, lambda i: i["position"]), lambda p: F.struct(
        F.transform(x, lambda i: i["name"]).alias("names"), p.alias("positions"), (F.array_sort(p) == p).alias("sorted"), ((F.size(x) > 0) & F.forall(x, lambda i: has(i["name"]) & i["position"].isNotNull())).alias("complete"))))


def compare_trails(schema: Column, shown: Column) -> Column:
    """struct<shared, only_schema, only_shown> of two arrays of names."""
    return F.struct(F.array_intersect(schema, shown).alias("shared"), F.array_except(schema, shown).alias("only_schema"), F.array_except(shown, schema).alias("only_shown"))


def schema_questions(jsonld: Column) -> Column:
    """Names of the Question entities."""
    return F.flatten(F.transform(F.coalesce(jsonld, F.array().cast(NO_TEXTS)), lambda b: _all(b, r'(?s)"@type"\s*:\s*"Question"[^{}]*?"name"\s*:\s*"([^"]+)"', 1)))


def heading_questions(headings: Column) -> Column:
    return F.filter(F.transform(headings, lambda h: h["text"]), lambda t: t.rlike(QUESTION) | t.endswith("?"))


def matched_questions(schema: Column, shown: Column, least: float = 0.7) -> Column:
    """struct<exact, similar, only_schema>: questions that both have, those alike by over least of their words, and the rest of the schema's."""
    exact = F.array_intersect(schema, shown)
    rest = let(F.array_except(schema, exact), lambda s: let(F.filter(s, lambda q: F.exists(F.array_except(shown, exact), lambda t: jaccard(q, t) > least)), lambda alike: F.struct(
        exact.alias("exact"), alike.alias("similar"), F.array_except(s, alike).alias("only_schema"))))
    return rest


def image_summary(images: Column) -> Column:
    """struct<n, with_alt_percent, alt_score, with_size_percent, lazy, bytes> of a page's images."""
    def of(i: Column) -> Column:
        n = F.size(i)
        share = lambda f: F.coalesce(F.try_divide(F.size(F.filter(i, f)) * 100.0, n), F.lit(0.0))
        mean = F.coalesce(F.try_divide(F.aggregate(i, F.lit(0), lambda a, x: a + alt_score(x["alt"])), n), F.lit(0.0))
        return F.struct(n.alias("n"), share(lambda x: has(x["alt"])).alias("with_alt_percent"), mean.alias("alt_score"), share(lambda x: (x["width"] != "") & (x["height"] != "")).alias("with_size_percent"),
                        F.size(F.filter(i, lambda x: F.lower(x["loading"]) == "lazy")).alias("lazy"), F.aggregate(i, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(image_weight(x["width"], x["height"])["bytes"], F.lit(0))).alias("bytes"))

    return let(images, of)


def described_images(images: Column, image_urls: Column) -> Column:
    """The page's images that an ImageObject names: one address holds the other."""
    return F.filter(F.transform(images, lambda i: i["src"]), lambda s: (s != "") & F.exists(image_urls, lambda u: (u != "") & (F.contains(u, s) | F.contains(s, u))))


def formats(html: Column, jsonld: Column) -> Column:
    """struct<jsonld, microdata, rdfa, microdata_types>: counts of structured data in each format."""
    return F.struct(F.size(jsonld).alias("jsonld"), F.size(_all(html, r"(?i)<[^>]+\sitemscope\b")).alias("microdata"), F.size(_all(html, r"(?i)<[^>]+\stypeof\s*=")).alias("rdfa"),
                    F.array_distinct(F.transform(_all(html, r"""(?i)\sitemtype\s*=\s*["']([^"']+)["']""", 1), lambda t: F.regexp_extract(t, r"([^/#]+)$", 1))).alias("microdata_types"))


def canonical_state(url: Column, canonical: Column) -> Column:
    """struct<present, matches, same_www, same_slash> of a page and its canonical address."""
    www = lambda u: F.startswith(host(u), F.lit("www."))
    return F.struct((canonical != "").alias("present"), ((canonical != "") & (bare_url(url) == bare_url(canonical))).alias("matches"), (www(url) == www(canonical)).alias("same_www"),
                    (path(url).endswith("/") == path(canonical).endswith("/")).alias("same_slash"))


def author_signals(html: Column) -> Column:
    """struct<elements, links, bios>: elements that name an author, links to authors' pages, and biography blocks."""
    return F.struct(F.size(_all(html, r"""(?i)<[^>]+(?:class|rel|itemprop)\s*=\s*["'][^"']*(?:author|byline)[^"']*["']""")).alias("elements"), F.size(_all(html, r"""(?i)<a\b[^>]*href\s*=\s*["'][^"']*/(?:author|authors|team)/""")).alias("links"),
                    F.size(_all(html, r"""(?i)<[^>]+class\s*=\s*["'][^"']*\bbio""")).alias("bios"))


def updated_dates(html: Column, text: Column) -> Column:
    """Dates of update: time elements' and those that the text names."""
    return F.array_distinct(F.concat(_all(html, r"""(?i)<time\b[^>]*datetime\s*=\s*["']([^"']+)["']""", 1), _all(text, UPDATED, 1)))


def render_blocking(html: Column) -> Column:
    """struct<css, js, many>: style sheets (but for print) and scripts without async or defer in the head; many: over three."""
    head = F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<head\b[^>]*>(.*?)</head\s*>", 1)
    js = F.size(F.filter(_all(head, r"(?i)<script\b[^>]*\ssrc\s*=[^>]*>"), lambda t: ~t.rlike(r"(?i)\s(?:async|defer)\b")))
    css = F.size(F.filter(_all(head, r"(?i)<link\b[^>]*>"), lambda t: F.lower(attribute(t, "rel")).contains("stylesheet") & ~F.lower(attribute(t, "rel")).contains("preload") & (F.lower(attribute(t, "media")) != "print")))
    return let(F.struct(css.alias("css"), js.alias("js")), lambda c: F.struct(c["css"].alias("css"), c["js"].alias("js"), (c["css"] + c["js"] > 3).alias("many")))


def security_headers(headers: Column) -> Column:
    """struct of the six headers and how many there are.  headers: map of name to value, names of any case."""
    low = F.transform_keys(headers, lambda k, v: F.lower(F.trim(k)))
    values = {n: F.try_element_at(low, F.lit(h)) for n, h in SECURITY.items()}
    return F.struct(*[v.alias(n) for n, v in values.items()], sum((F.coalesce(v.isNotNull(), F.lit(False)).cast("int") for v in values.values()), F.lit(0)).alias("detected"))


def semantic_percent(html: Column) -> Column:
    """Elements with a meaning of their own, of all elements."""
    h = F.coalesce(html, F.lit(""))
    return F.coalesce(F.try_divide(F.regexp_count(h, F.lit(rf"(?i)<(?:{SEMANTIC})\b")) * 100.0, F.regexp_count(h, F.lit(r"(?i)<[a-z]"))), F.lit(0.0))


def technical_score(metas: Column, canonical: Column, html: Column, images: Column) -> Column:
    """Points for description, viewport, robots, canonical, charset, main, header, meaning of elements and sizes of images; at most 100."""
    held = lambda k: F.coalesce(F.size(F.try_element_at(metas, F.lit(k))) > 0, F.lit(False))
    h = F.coalesce(html, F.lit(""))
    signs = ((held("description"), 15), (held("viewport"), 10), (held("robots"), 10), (canonical != "", 15), (h.rlike(r"(?i)<meta\b[^>]*charset"), 10), (h.rlike(r"(?i)<main\b"), 15), (h.rlike(r"(?i)<header\b"), 10),
             (semantic_percent(html) > 20, 10), (~F.exists(images, lambda i: (i["width"] == "") | (i["height"] == "")), 5))
    return sum((F.when(s, float(n)).otherwise(0.0) for s, n in signs), F.lit(0.0))


def page_fingerprint(html: Column) -> Column:
    """MD5 of the first 5,000 characters of the body; pages with one are taken for one another's copies."""
    return F.md5(F.left(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<body\b[^>]*>(.*)</body\s*>", 1), F.lit(5000)))


def is_complete(title: Column, text: Column, headings: Column, images: Column) -> Column:
    """Whether at least two of title, text, headings and images are there."""
    missing = (F.coalesce(title, F.lit("")) == "").cast("int") + (F.coalesce(text, F.lit("")) == "").cast("int") + (F.coalesce(F.size(headings), F.lit(0)) <= 0).cast("int") + (F.coalesce(F.size(images), F.lit(0)) <= 0).cast("int")
    return missing < 3


def performance(body: Column) -> Column:
    """struct<score, fcp, lcp, cls, tbt, speed_index, tti, opportunities> of a saved audit answer; seconds but for cls and tbt (ms)."""
    audit = "struct<numericValue: double, score: double>"
    names = sorted({a for a, _ in AUDITS.values()} | set(OPPORTUNITIES))
    schema = "struct<lighthouseResult: struct<categories: struct<performance: struct<score: double>>, audits: struct<" + ", ".join(f"`{n}`: {audit}" for n in names) + ">>>"
    parsed = F.from_json(body, schema)["lighthouseResult"]
    low = F.array_compact(F.array(*[F.when(parsed["audits"][n]["score"] < 1, F.lit(n)) for n in OPPORTUNITIES]))
    return F.struct((parsed["categories"]["performance"]["score"] * 100).alias("score"), *[(parsed["audits"][a]["numericValue"] / unit).alias(n) for n, (a, unit) in AUDITS.items()], low.alias("opportunities"))


def crawl_summary(pages: DataFrame, links: DataFrame) -> DataFrame:
    """One row: pages crawled, failed, their success rate, and links by kind.  pages: scrape_status; links: kind (internal, external, or a platform)."""
    ok = F.col("scrape_status") == "SUCCESS"
    done = pages.agg(F.count_if(ok).alias("successful"), F.count_if(F.col("scrape_status") == "FAILED").alias("failed"))
    found = links.agg(F.count_if(F.col("kind") == "internal").alias("internal_links"), F.count_if(~F.col("kind").isin("internal", "external")).alias("social_links"))
    rate = F.coalesce(F.try_divide(F.col("successful") * 100.0, F.col("successful") + F.col("failed")), F.lit(0.0))
    return done.withColumn("success_percent", rate).join(F.broadcast(found))  # one row each


def unreadable(html: Column) -> Column:
    """Tags that are opened and never closed, of those that must be."""
    opened, closed = F.regexp_count(html, F.lit(r"(?i)<(?:div|p|section|article|table|ul|ol)\b")), F.regexp_count(html, F.lit(r"(?i)</(?:div|p|section|article|table|ul|ol)\b"))
    return F.greatest(opened - closed, F.lit(0))


@F.pandas_udf(DoubleType())
def matching_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """difflib's ratio of two texts; 1 if both have under 50 characters.  No built-in distance equals it."""
    pairs = zip(a.fillna(""), b.fillna(""), strict=True)
    return pd.Series([1.0 if len(x) < 50 and len(y) < 50 else difflib.SequenceMatcher(None, x, y).ratio() for x, y in pairs])
