"""Signals that the rules read beyond sources.html: links with their texts, resources, forms, frames, ratios and keywords.

page_signals adds them to page_features; all are Columns over the page's HTML.
Null html gives empty and zero signals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.functions.scores import let
from sitegauge.functions.text import words
from sitegauge.functions.urls import SKIPPED_LINKS, host, resolve_link
from sitegauge.sources.html import attribute, page_features, strip_tags

# Words that are no keywords, frame sizes that fill a page, and marks of analytics scripts.
STOP_WORDS = ("the a an and or but in on at to for of with by is are was were be been have has had do does did will would could should may might can this that these those i you he she it we they "
              "what which who when where why how all any both each few more most other some such only own same so than too very just now also back even further still yet").split()
FULL_WIDTHS, FULL_HEIGHTS = ("100%", "100vw", "1000px", "1200px", "1920px"), ("100%", "100vh", "800px", "900px", "1080px")
RESOURCES = (("img", "src"), ("script", "src"), ("link", "href"), ("iframe", "src"), ("video", "src"), ("audio", "src"))
ANALYTICS = {"ga4": r"\bG-[A-Z0-9]{6,}\b", "universal_analytics": r"\bUA-\d{4,}-\d+\b", "tag_manager": r"\bGTM-[A-Z0-9]{4,}\b|googletagmanager\.com/gtm", "facebook_pixel": r"fbq\(|connect\.facebook\.net",
             "linkedin_insight": r"snap\.licdn\.com|_linkedin_partner_id", "hotjar": r"static\.hotjar\.com|hjid", "clarity": r"clarity\.ms", "twitter_pixel": r"static\.ads-twitter\.com|twq\(",
             "pinterest_tag": r"pintrk\(|s\.pinimg\.com", "tiktok_pixel": r"analytics\.tiktok\.com|ttq\.", "hubspot": r"js\.hs-scripts\.com", "segment": r"cdn\.segment\.com", "mixpanel": r"cdn\.mxpnl\.com|mixpanel\."}
GENERIC_ANCHORS = "click here|read more|learn more|here|more|link|page|website|site|url|download"
HELPFUL_404 = "not found|page not found|error 404|broken link|moved|home|search"


def _all(html: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(html, F.lit(pattern), F.lit(group))


def _tags(html: Column, name: str) -> Column:
    return _all(html, rf"(?is)<{name}\b[^>]*>")


def anchors(html: Column) -> Column:
    """array<struct<href, text, rel, target, title>> of the page's links, in order."""
    return F.transform(_all(html, r"(?is)<a\b[^>]*>.*?</a\s*>"), lambda a: F.struct(*[attribute(F.regexp_extract(a, r"(?is)^<a\b[^>]*>", 0), n).alias(n) for n in ("href", "rel", "target", "title")], strip_tags(a).alias("text")))


def resources(html: Column) -> Column:
    """array<struct<tag, url>> of what the page loads."""
    def of(tag: str, name: str) -> Column:
        return F.transform(_tags(html, tag), lambda t: F.struct(F.lit(tag).alias("tag"), attribute(t, name).alias("url")))

    return F.filter(F.concat(*[of(tag, name) for tag, name in RESOURCES]), lambda r: r["url"] != "")


def keyword(text: Column) -> Column:
    """struct<keyword, count, total, density>: the most frequent word of three letters or more that is no stop word; of equals the first in the text.

    Texts under 50 characters or ten words have none and density 0."""
    useful = lambda found: F.sort_array(F.filter(F.transform(found, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: ~x["w"].isin(*STOP_WORDS)))
    run = F.struct(F.lit("").alias("w"), F.lit(0).alias("n"), F.lit(0).alias("first"), F.lit("").alias("best"), F.lit(0).alias("most"), F.lit(0).alias("at"))

    def step(a: Column, x: Column) -> Column:
        # words come in order and each word's places ascend: first is where the present word began
        again = a["w"] == x["w"]
        n, first = F.when(again, a["n"] + 1).otherwise(1), F.when(again, a["first"]).otherwise(x["i"])
        wins = (n > a["most"]) | ((n == a["most"]) & (first < a["at"]))
        return F.struct(x["w"].alias("w"), n.alias("n"), first.alias("first"), F.when(wins, x["w"]).otherwise(a["best"]).alias("best"), F.greatest(n, a["most"]).alias("most"), F.when(wins, first).otherwise(a["at"]).alias("at"))

    def judged(c: Column) -> Column:
        enough = (F.length(F.trim(F.coalesce(text, F.lit("")))) >= 50) & (c["total"] >= 10) & (c["top"]["most"] > 0)
        return F.struct(F.when(enough, c["top"]["best"]).alias("keyword"), F.when(enough, c["top"]["most"]).otherwise(0).alias("count"), c["total"].alias("total"), F.when(enough, c["top"]["most"] * 100.0 / c["total"]).otherwise(0.0).alias("density"))

    def of(low: Column) -> Column:
        found = F.regexp_extract_all(low, F.lit(r"\b[a-z]{3,}\b"), F.lit(0))
        return F.struct(F.regexp_count(low, F.lit(r"\b[a-z]+\b")).alias("total"), F.aggregate(useful(found), run, step).alias("top"))

    return let(let(F.lower(F.coalesce(text, F.lit(""))), of), judged)


def hreflangs(html: Column) -> Column:
    """array<struct<lang, url>> of the alternates, in order."""
    links = F.filter(_tags(html, "link"), lambda t: (F.lower(attribute(t, "rel")) == "alternate") & (attribute(t, "hreflang") != ""))
    return F.transform(links, lambda t: F.struct(F.lower(attribute(t, "hreflang")).alias("lang"), attribute(t, "href").alias("url")))


def analytics(html: Column) -> Column:
    """Names of the analytics and pixel scripts that the page's source shows."""
    return F.array_compact(F.array(*[F.when(html.rlike(p), F.lit(n)) for n, p in ANALYTICS.items()]))


def needs_script(html: Column, text: Column, title: Column) -> Column:
    """Whether a page is likely to be drawn by script: under 100 words, an application's root element, a shop's marks, or a title and hardly any text."""
    return (F.size(words(text)) < 100) | html.rlike(r"""(?i)id\s*=\s*["'](root|__next|app|vue-app)["']""") | F.contains(F.lower(html), F.lit("shopify")) | ((title != "") & (F.length(text) <= 200))


def page_guard(html: Column, most_bytes: int = 5_000_000, most_nodes: int = 15_000) -> Column:
    """Why a page is not analysed: not_html, too_large or too_many_nodes; null if it is."""
    low = F.lower(F.coalesce(html, F.lit("")))
    return F.when(~(F.contains(low, F.lit("<!doctype")) | F.contains(low, F.lit("<html"))), "not_html").when(F.octet_length("html" if html is None else html) > most_bytes, "too_large").when(
        F.regexp_count(low, F.lit(r"<[a-z]")) > most_nodes, "too_many_nodes")


def page_signals(pages: DataFrame) -> DataFrame:
    """page_features and: anchors, resources, primary_keyword and the signals of operators.rules that the HTML itself shows."""
    source = F.coalesce(F.col("html"), F.lit(""))
    visible = F.regexp_replace(F.regexp_replace(source, r"(?is)<(style|noscript|template|script)\b.*?</\1\s*>", " "), r"(?s)<!--.*?-->", " ")
    marked = page_features(pages.withColumns({"_v": visible, "_html": source, "_src": F.col("html")}).withColumn("html", F.col("_src")).drop("_src"))
    v, h = F.col("_v"), F.col("_html")
    n = lambda tag: F.size(_tags(v, tag))
    marked = marked.withColumns({
        "anchors": anchors(v), "resources": resources(F.regexp_replace(h, r"(?s)<!--.*?-->", " ")), "_keyword": keyword(F.col("text")), "hreflangs": hreflangs(v), "analytics": analytics(h),
        "doctype": F.lower(F.trim(F.regexp_extract(h, r"(?i)^\s*<!doctype\s+([^>]*)>", 1))), "html_bytes": F.octet_length(h), "text_bytes": F.octet_length("text"),
        "paragraphs": F.filter(F.transform(_all(v, r"(?is)<p\b[^>]*>(.*?)</p\s*>", 1), strip_tags), lambda p: p != ""),
        "n_tables": n("table"), "n_lists": n("ul") + n("ol"), "n_list_items": n("li"), "forms": n("form"), "inputs": F.size(F.filter(_tags(v, "(?:input|select|textarea)"), lambda t: ~F.lower(attribute(t, "type")).isin("hidden", "submit", "button"))),
        "has_nav": (n("nav") > 0), "has_header": (n("header") > 0), "has_footer": (n("footer") > 0), "has_main": (n("main") > 0), "viewport": F.map_contains_key("metas", "viewport"),
    })
    own = lambda a: host(resolve_link(F.col("url"), a["href"])) == host(F.col("url"))
    real = F.filter("anchors", lambda a: (a["href"] != "") & ~a["href"].rlike(SKIPPED_LINKS))
    generic = lambda a: (F.length(a["text"]) < 3) | F.lower(a["text"]).rlike(GENERIC_ANCHORS)
    texts = F.filter(F.transform(real, lambda a: F.lower(a["text"])), lambda t: t != "")
    frames = _tags(v, "iframe")
    helps = (n("nav") + n("header") + n("form") > 0) | F.lower("text").rlike(HELPFUL_404)
    return marked.withColumns({
        "html_ratio": F.when(F.col("html_bytes") > 0, F.col("text_bytes") * 100.0 / F.col("html_bytes")), "keyword_density": F.col("_keyword.density"), "primary_keyword": F.col("_keyword.keyword"),
        "mixed_count": F.when(F.col("url").startswith("https://"), F.size(F.filter("resources", lambda r: r["url"].startswith("http://")))).otherwise(0),
        "iframe_wrapped": F.exists(frames, lambda t: F.lower(attribute(t, "width")).isin(*FULL_WIDTHS) & F.lower(attribute(t, "height")).isin(*FULL_HEIGHTS)),
        "nofollow_internal": F.size(F.filter(real, lambda a: own(a) & F.lower(a["rel"]).contains("nofollow"))),
        "generic_anchor_ratio": F.coalesce(F.try_divide(F.size(F.filter(real, generic)) * 100.0, F.size(real)), F.lit(0.0)),
        "anchor_diversity_issue": (F.size(texts) >= 5) & (F.size(F.array_distinct(texts)) * 2 < F.size(texts)),
        "has_custom_404": helps,
    }).withColumn("mixed_content", F.col("mixed_count") > 0).drop("_v", "_html", "_keyword")
