"""Rules that emit issues: a catalog of conditions, evaluated as Columns in one projection.

A page table from sources.html or sources.signals is widened by
with_rule_columns: signals that a crawl may not have (status codes, probes,
accessibility findings) become null columns, and a null signal fires no rule.
Cross-page signals (inbound links, click depth, copies) are ordinary columns,
joined on by plans.page_analysis.  A rule gives an issue for each of its cases
that holds, or one for each item (link, image, entity, violation) it finds.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.functions.intents import alt_score, dates, eeat_page_type, has_dated_note, is_human_author, schema_fits
from sitegauge.functions.text import CALL_WORDS, POWER_WORDS, ctr_score, word_count
from sitegauge.functions.urls import host, is_homepage, page_type, resolve_link
from sitegauge.operators.entities import has
from sitegauge.operators.entity_audit import nodes, type_names

# Signals that come from other tables, and their types.
SIGNALS = {
    "broken_links_count": "int", "is_404": "boolean", "has_custom_404": "boolean", "status_code": "int", "timed_out": "boolean", "mixed_content": "boolean",
    "html_ratio": "double", "keyword_density": "double", "iframe_wrapped": "boolean", "redirected_links": "int", "nofollow_internal": "int", "inbound_links": "long",
    "click_depth": "int", "redirect_chain": "int", "redirect_loop": "boolean", "copies": "long", "primary_keyword": "string", "generic_anchor_ratio": "double",
    "anchor_diversity_issue": "boolean", "broken_images": "int", "heavy_images": "int", "robots_blocked": "boolean", "blocked_resources": "int", "lang_checked": "string",
    "forms": "int", "inputs": "int", "focus_trap": "boolean", "unreachable_elements": "int", "missing_focus_outline": "int", "small_click_targets": "int",
    "axe_violations": "array<struct<id: string, impact: string, description: string>>", "microdata_types": "array<string>", "visible_author": "boolean", "rich_anchor_ratio": "double",
    "anchors": "array<struct<href: string, rel: string, target: string, title: string, text: string>>", "link_states": "array<struct<url: string, status: int>>",
    "image_states": "array<struct<src: string, status: int, bytes: bigint>>", "has_nav": "boolean", "html": "string",
}
# Words and patterns by which the rules tell pages, authors and evidence apart.
SOCIAL_SITES = "facebook.com|twitter.com|linkedin.com|instagram.com|youtube.com|pinterest.com"
BYLINE = "author|by |written by|posted by|published by"
BIO_WORDS = "about the author|author bio|biography|about author|author profile|experience|credentials|background|expertise|qualification"
BIO_TEXT = r"author.*\d+\s+years?\s+experience|background.*in.*|expertise.*includes?|specialized.*in|worked.*with|certified.*in"
RATED_WORDS = "what agencies say|testimonials|customer reviews|client testimonials|what our clients say|reviews|ratings|star|★|testimonial|satisfied clients|rating|review|score|stars|⭐|5/5|—|jennifer|mike|sarah|david|emily"
AUTHOR_IMAGE, QUOTE_IMAGE = "author|avatar|profile|bio|headshot", "testimonial|jennifer|mike|sarah|david|emily|client"
EXPERIENCE = ("we tested|our study|we found|our research|we analyzed|case study|test results|our data|we measured|experiment|we conducted|our team|in our testing|based on our|our results|our analysis|"
              "our investigation|we surveyed|we worked with|our clients|we helped|we achieved").split("|")
MEASURED = {r"\d+(?:\.\d+)?%\s+(?:increase|decrease|improvement|reduction|growth)": "%", r"\$?\d+(?:,\d{3})*(?:\.\d+)?\s+(?:revenue|sales|profit|income|savings)": "revenue|sales|profit|income|savings",
            r"\d+(?:,\d{3})*\s+(?:customers|clients|users|leads|conversions)": "customers|clients|users|leads|conversions", r"\d+\s+(?:years?|months?|weeks?)\s+of\s+experience": "experience", r"from\s+\d+\s+to\s+\d+": "from",
            r"\d+x\s+(?:return|roi|growth)": "return|roi|growth"}
STUDIES = {r"case study[:\s]*[^.!?]*[.!?]": "case study", r"client[:\s]*[^.!?]*result[:\s]*[^.!?]*[.!?]": "client", r"project[:\s]*[^.!?]*outcome[:\s]*[^.!?]*[.!?]": "outcome", r"test[:\s]*[^.!?]*result[:\s]*[^.!?]*[.!?]": "result",
           r"experiment[:\s]*[^.!?]*show[:\s]*[^.!?]*[.!?]": "experiment"}
FRESH_WORDS = "updated|published|reviewed|revised|posted|modified"
ABOUT_PARTS = ("team", "story", "founded", "mission", "since", "year")

EMPTY_TEXTS = "array<string>"


def mentions(text: Column, words: str) -> Column:
    """Whether a text holds one of the words (a|b|c), found by plain search; a pattern with more than words is matched as it is."""
    if re.search(r"[\\.\[\](){}*+?^$]", words):
        return text.rlike(words)
    return reduce(or_, [F.contains(text, F.lit(w)) for w in words.split("|")])


def counted(text: Column, pattern: str, need: str) -> Column:
    """Matches of a pattern, looked for only in texts that hold a word of need."""
    return F.when(mentions(text, need), F.regexp_count(text, F.lit(pattern))).otherwise(0)


def firsthand(body: Column, text: Column) -> Column:
    """Points of first-hand evidence in a text: phrases, figures, studies, quoted people, screenshots; null for a null text.  body: the text in small letters."""
    figures = sum((counted(body, p, need) for p, need in MEASURED.items()), F.lit(0))
    studies = sum((counted(body, p, need) for p, need in STUDIES.items()), F.lit(0))
    people = counted(text, r"\b[A-Z][a-z]+\s+[A-Z][a-z]+\s+(?:said|reported|experienced|achieved)", "said|reported|experienced|achieved")
    return F.when(text.isNotNull(), F.size(F.filter(F.lit(EXPERIENCE), lambda w: F.contains(body, w))) * 0.2 + figures * 0.3 + studies * 0.4 + people * 0.5 + F.when(body.contains("screenshot"), 0.3).otherwise(0.0))


def schema_types(blocks: Column) -> Column:
    """The @type names in JSON-LD blocks, single or listed, at any depth."""
    one = lambda b: F.concat(F.regexp_extract_all(b, F.lit(r'"@type"\s*:\s*"([^"]+)"'), F.lit(1)),
                             F.flatten(F.transform(F.regexp_extract_all(b, F.lit(r'"@type"\s*:\s*\[([^\]]*)\]'), F.lit(1)), lambda x: F.regexp_extract_all(x, F.lit('"([^"]+)"'), F.lit(1)))))
    return F.array_distinct(F.flatten(F.transform(F.coalesce(blocks, F.array().cast(EMPTY_TEXTS)), one)))


def with_rule_columns(pages: DataFrame) -> DataFrame:
    """Adds absent signals as nulls, and the columns that rules share."""
    missing = {n: F.lit(None).cast(t) for n, t in SIGNALS.items() if n not in pages.columns}
    level = lambda n: F.filter("headings", lambda h: (h["level"] == n) & (h["text"] != ""))
    first_meta = lambda k: F.coalesce(F.try_element_at(F.try_element_at("metas", F.lit(k)), F.lit(1)), F.lit(""))
    marked = pages.withColumns(missing).withColumns({"body": F.lower(F.coalesce(F.col("text"), F.lit(""))), "h1s": F.transform(level(1), lambda h: h["text"])})
    # a step of its own, so that the many readers of body don't make it again
    return marked.withColumns({
        "description": F.trim(first_meta("description")), "robots": F.lower(first_meta("robots")),
        "types": schema_types(F.col("jsonld")), "graph": F.filter(F.transform(nodes(F.col("jsonld")), lambda n: F.from_json(n, "map<string, string>")), lambda m: m.isNotNull()), "firsthand": firsthand(F.col("body"), F.col("text")),
        "eeat_type": eeat_page_type(F.col("url"), F.col("text"), F.coalesce(F.try_element_at("h1s", F.lit(1)), F.lit(""))), "page_type": page_type(F.col("url"), F.col("text")), "homepage": is_homepage(F.col("url")),
        "jump": F.exists(F.arrays_zip(F.slice("headings", 1, F.greatest(F.size("headings") - 1, F.lit(0))).alias("a"), F.slice("headings", 2, F.greatest(F.size("headings") - 1, F.lit(0))).alias("b")),
                         lambda z: z["b"]["level"] - z["a"]["level"] > 1),
    })


ISSUE = "array<struct<rule_id: string, rule_no: int, category: string, severity: string, issue_message: string, detected_value: string>>"


@dataclass(frozen=True)
class Rule:
    """condition, or cases of (condition, severity, message, detected), or each, an array of detected values (severity may be a function of one)."""

    rule_id: str
    rule_no: int
    category: str
    severity: str | Column
    condition: Column | None
    message: str
    detected: Column | None = None
    not_on: tuple[str, ...] = ()
    cases: tuple[tuple[Column, str | Column, str, Column | None], ...] = ()
    each: Column | None = None
    grade: object = None

    def _issue(self, level, message: str, seen: Column | None) -> Column:
        level = F.lit(level) if isinstance(level, str) else level
        seen = seen if seen is not None else F.lit(None)
        return F.struct(F.lit(self.rule_id).alias("rule_id"), F.lit(self.rule_no).alias("rule_no"), F.lit(self.category).alias("category"),
                        level.alias("severity"), F.lit(message).alias("issue_message"), seen.cast("string").alias("detected_value"))

    def issues(self) -> Column:
        """array<struct>: the rule's issues on a page."""
        none = F.array().cast(ISSUE)
        if self.each is not None:
            out = F.coalesce(F.transform(self.each, lambda d: self._issue(self.grade(d) if self.grade else self.severity, self.message, d["detected"] if self.grade else d)), none)
        else:
            cases = self.cases or ((self.condition, self.severity, self.message, self.detected),)
            out = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), self._issue(level, message, seen)) for c, level, message, seen in cases]))
        return F.when(F.col("page_type").isin(*self.not_on), none).otherwise(out) if self.not_on else out


def _has(*names: str) -> Column:
    return F.arrays_overlap("types", F.array(*[F.lit(n) for n in names]))


def _lacks_metas(*names: str) -> Column:
    return F.size(F.array_except(F.array(*[F.lit(n) for n in names]), F.map_keys("metas"))) > 0


def _axe(pattern: str) -> Column:
    return F.exists("axe_violations", lambda v: F.lower(F.concat_ws(" ", v["id"], v["description"])).rlike(pattern))


def broken_keyword(h1: Column) -> Column:
    """Whether the H1 lacks the primary keyword but has it split over two words, or run together with a capitalised one."""
    key = F.lower("primary_keyword")
    w = F.split(F.trim(h1), r"\s+")
    pair = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.startswith(key, F.lower(x)) & (F.length(x) < F.length(key)) & F.startswith(F.substr(key, F.length(x) + 1), F.lower(F.get(w, i + 1))))
    glued = F.exists(w, lambda x: F.startswith(F.lower(x), key) & F.substr(x, F.length(key) + 1).rlike("[A-Z]"))
    return F.coalesce(~F.contains(F.lower(h1), key) & (F.exists(pair, lambda p: p) | glued), F.lit(False))


def content_rules() -> list[Rule]:
    c, n = F.col, F.length
    title = c("title")
    h1 = F.coalesce(F.try_element_at("h1s", F.lit(1)), F.lit(""))
    metas = lambda k: F.coalesce(F.size(F.try_element_at("metas", F.lit(k))), F.lit(0))
    return [
        Rule("multiple_meta_descriptions", 27, "Content", "medium", metas("description") > 1, "Several meta descriptions", metas("description")),
        Rule("multiple_title_tags", 28, "Content", "high", metas("title") > 1, "Several title tags", metas("title")),
        Rule("title_missing", 29, "Content", "high", F.coalesce(title, F.lit("")) == "", "Title is missing"),
        Rule("meta_description_missing", 30, "Content", "high", c("description") == "", "Meta description is missing"),
        Rule("title_too_short", 31, "Content", "high", n(title).between(1, 29), "Title is under 30 characters", n(title)),
        Rule("title_too_long", 32, "Content", "medium", n(title) > 60, "Title is over 60 characters", n(title)),
        Rule("meta_description_too_short", 33, "Content", "medium", n("description").between(1, 119), "Meta description is under 120 characters", n("description")),
        Rule("meta_description_too_long", 34, "Content", "medium", n("description") > 158, "Meta description is over 158 characters", n("description")),
        Rule("h1_missing", 35, "Content", "high", F.size("h1s") == 0, "No H1 heading"),
        Rule("multiple_h1_tags", 36, "Content", "high", F.size("h1s") > 1, "Several H1 headings", F.size("h1s")),
        Rule("heading_hierarchy_skipped", 37, "Content", "medium", c("jump"), "A heading level is skipped"),
        Rule("thin_content", 38, "Content", "high", c("word_count") < 300, "Under 300 words", c("word_count"), ("contact",)),
        Rule("keyword_not_in_title", 39, "Content", "high", (word_count(h1) > 2) & ~F.contains(F.lower(title), F.lower(h1)), "The H1's words are not in the title", None, ("contact",)),
        Rule("keyword_not_in_h1", 40, "Content", "high", None, "", cases=(
            ((h1 != "") & broken_keyword(h1), "high", "The primary keyword is broken in the H1", c("primary_keyword")),
            ((h1 != "") & ~F.contains(F.lower(h1), F.lower("primary_keyword")) & ~broken_keyword(h1) & ~F.contains(F.lower(h1), F.array_join(F.slice(F.split(F.trim(F.lower(title)), r"\s+"), 1, 3), " ")), "high", "The primary keyword is not in the H1", c("primary_keyword")))),
        Rule("duplicate_content", 41, "Content", "high", c("copies") > 1, "Other pages hold the same content", c("copies")),
        Rule("https_not_enforced", 91, "Crawlability", "high", c("url").startswith("http://"), "Page is not served by https"),
        Rule("canonical_tag_errors", 93, "Crawlability", "high", c("canonical") == "", "Canonical tag is missing"),
        Rule("noindex_on_admin_pages", 95, "Crawlability", "high", F.lower("url").rlike("/admin|/login|/dashboard|/wp-admin|/wp-login") & ~c("robots").contains("noindex"), "An administration page can be indexed"),
    ]


def site_rules() -> list[Rule]:
    c = F.col
    ratio, density, url, body, g = c("html_ratio"), c("keyword_density"), c("url"), c("body"), c("graph")
    images = lambda f: F.transform(F.filter("images", f), lambda i: i["src"])
    faq = mentions(body, "faq|question|answer|frequently asked|what is|how to|why do") | F.exists("headings", lambda h: F.lower(h["text"]).rlike("faq|questions|frequently asked"))
    share = ("og:title", "og:description", "og:image", "og:url")
    card = ("twitter:card", "twitter:title", "twitter:description", "twitter:image")
    blank = F.exists(F.array(*[F.lit(k) for k in share]), lambda k: F.trim(F.coalesce(F.try_element_at(F.try_element_at("metas", k), F.lit(1)), F.lit(""))) == "")
    main = url.endswith("/") | url.endswith("/index.html") | ~F.lower(url).rlike("about|privacy|terms|contact")
    reached = F.concat(body, F.lit(" "), F.lower(F.array_join("links", " ")))
    of = lambda *t: F.filter(g, lambda e: F.arrays_overlap(type_names(e["@type"]), F.lit(list(t))))
    first = lambda *t: F.try_element_at(of(*t), F.lit(1))
    lacks = lambda e, *names: F.array_compact(F.array(*[F.when(~has(e[n]), F.lit(n)) for n in names]))
    count = lambda *checks: sum((F.coalesce(x, F.lit(False)).cast("int") for x in checks), F.lit(0))
    listed = lambda v: F.when(v.startswith("["), F.from_json(v, "array<string>")).when(has(v), F.array(v)).otherwise(F.array().cast(EMPTY_TEXTS))
    org, article, crumbs, product, person = first("Organization", "LocalBusiness"), first("Article", "BlogPosting", "NewsArticle"), first("BreadcrumbList"), first("Product"), first("Person")
    kind = c("eeat_type")
    fits = schema_fits(kind, c("types"))
    # articles: there, of a type that fits the page, with dates and headline, and dated for readers where the page is one to read
    article_fails = ~(article.isNotNull() & fits & (F.size(lacks(article, "datePublished", "dateModified", "headline")) == 0)) | (kind.isin("blog", "general") & ~mentions(body, "published|updated|date:|posted on|last updated"))
    # breadcrumbs: there, seen, with items, with items that are named and linked; three of these (the fifth check) are enough
    crumb = F.from_json(crumbs["itemListElement"], "array<struct<`@type`: string, name: string, item: string>>")
    crumb_checks = count(crumbs.isNotNull(), mentions(body, "breadcrumb|nav"), F.size(crumb) > 0, F.exists(crumb, lambda i: (i["@type"] == "ListItem") & has(i["name"]) & has(i["item"])))
    # profiles of organizations: some, two, two social ones, none of the site itself, and three of these
    profiles = F.filter(F.transform(of("Organization", "LocalBusiness"), lambda e: listed(e["sameAs"])), lambda p: F.size(p) >= 0)
    social = lambda p: F.size(F.filter(p, lambda x: F.lower(x).rlike(SOCIAL_SITES))) >= 2
    own = lambda p: F.exists(p, lambda x: F.contains(F.lower(x), host(url)) & (host(url) != ""))
    poor = lambda p: count(F.size(p) > 0, F.size(p) >= 2, social(p), ~own(p)) < 3
    bad_profiles = F.transform(F.filter(profiles, poor), lambda p: F.concat(F.size(p).cast("string"), F.lit(" profiles")))
    author = F.coalesce(F.nullif(F.try_element_at(F.try_element_at("metas", F.lit("author")), F.lit(1)), F.lit("")), F.from_json(F.try_element_at(F.filter(g, lambda e: has(e["author"])), F.lit(1))["author"], "struct<name: string>")["name"], person["name"])
    seen = F.coalesce("visible_author", F.lit(False)) | mentions(body, BYLINE)
    author_fails = ~(author.isNotNull() & seen & is_human_author(author) & mentions(body, BIO_WORDS) & mentions(body, BIO_TEXT))
    portrait = lambda i: F.concat_ws(" ", F.lower(i["alt"]), F.lower(i["src"]))
    authors = F.filter("images", lambda i: portrait(i).rlike(AUTHOR_IMAGE) & ~portrait(i).rlike(QUOTE_IMAGE))
    quotes = F.filter("images", lambda i: portrait(i).rlike(QUOTE_IMAGE))
    missing = F.filter(F.lit(list(ABOUT_PARTS)), lambda w: ~F.contains(body, w))
    evidence = c("firsthand")
    axe, pixels, alt = c("axe_violations"), F.length("title") * 8, F.coalesce(F.try_divide(F.aggregate("images", F.lit(0), lambda a, i: a + alt_score(i["alt"])), F.size("images")), F.lit(100.0))
    marked = lambda pattern: F.transform(F.filter(axe, lambda v: F.lower(F.concat_ws(" ", v["id"], v["description"])).rlike(pattern)), lambda v: v["id"])
    inside = lambda a: host(resolve_link(url, a["href"])) == host(url)
    nofollow = F.transform(F.filter("anchors", lambda a: inside(a) & F.lower(a["rel"]).contains("nofollow") & ~F.lower(a["href"]).rlike("login|admin|legal|privacy|terms")), lambda a: a["href"])
    forms = (c("forms") > 0) & (c("inputs") > 0)
    helped = F.coalesce("has_custom_404", F.lit(False)) | F.coalesce("has_nav", F.lit(False)) | mentions(body, "home|homepage|back to home")
    desktop, mobile = pixels > 500, pixels > 400
    return [
        Rule("broken_links", 1, "Internal Pages", "high", c("broken_links_count") > 0, "Broken links", c("broken_links_count")),
        Rule("custom_404_page", 2, "Internal Pages", "medium", c("is_404") & ~helped, "No helpful page for missing pages"),
        Rule("4xx_error_pages", 3, "Internal Pages", "medium", c("status_code").between(400, 499) & (c("status_code") != 404), "Client error", c("status_code")),
        Rule("5xx_server_error", 4, "Internal Pages", "high", c("status_code") >= 500, "Server error", c("status_code")),
        Rule("timeout_errors", 5, "Internal Pages", "medium", c("timed_out"), "Page timed out"),
        Rule("mixed_http_https", 6, "Internal Pages", "high", c("mixed_content"), "Insecure resources on a secure page"),
        Rule("non_seo_friendly_urls", 7, "Internal Pages", "medium", url.contains("?"), "URL has parameters"),
        Rule("double_slash_urls", 8, "Internal Pages", "low", F.regexp_replace("url", "^[a-z]+://", "").contains("//"), "URL has a double slash"),
        Rule("low_code_to_html_ratio", 9, "Internal Pages", F.when(ratio < 5, "medium").otherwise("low"), ratio < 10, "Little text for its HTML", ratio),
        Rule("keyword_density", 10, "Internal Pages", F.when(density == 0, "medium").when(density < 0.5, "low").otherwise("medium"), (density < 0.5) | (density > 3), "Keyword density is out of range", density),
        Rule("iframe_wrapping", 11, "Internal Pages", "high", c("iframe_wrapped"), "The page is wrapped in a frame"),
        Rule("long_urls", 12, "Internal Pages", "low", F.length("url") > 115, "URL is over 115 characters", F.length("url")),
        Rule("schema_markup", 13, "Internal Pages", "high", None, "", cases=(
            ((F.size("jsonld") == 0) & (F.size("microdata_types") > 0), "high", "Structured data is not JSON-LD", F.array_join("microdata_types", ", ")), ((F.size("jsonld") == 0) & ~F.coalesce(F.size("microdata_types") > 0, F.lit(False)), "high", "No structured data", None))),
        Rule("faq_schema", 14, "Internal Pages", "medium", faq & ~_has("FAQPage"), "Questions without FAQ markup"),
        Rule("navigation_visibility", 15, "Internal Pages", "medium", None, "", cases=((c("has_nav") & (F.size("links") == 0), "medium", "Navigation without links that can be followed", None), (~F.coalesce("has_nav", F.size("links") > 0), "medium", "No navigation found", None))),
        Rule("links_to_redirecting_urls", 20, "Links", "medium", None, "Link to a redirecting URL", each=F.transform(F.filter("link_states", lambda x: x["status"].isin(301, 302)), lambda x: x["url"])),
        Rule("rel_nofollow_internal", 21, "Links", "high", None, "Internal link marked nofollow", each=nofollow),
        Rule("orphan_pages", 22, "Links", "high", (c("inbound_links") == 0) & ~c("homepage"), "No page links here"),
        Rule("click_depth", 23, "Links", "medium", c("click_depth") > 3, "Over three clicks from the homepage", c("click_depth")),
        Rule("redirect_chains", 24, "Redirects", "medium", c("redirect_chain") > 1, "Redirect chain", c("redirect_chain")),
        Rule("meta_refresh", 25, "Redirects", "high", F.exists(F.coalesce(F.try_element_at("metas", F.lit("refresh")), F.array().cast(EMPTY_TEXTS)), lambda v: F.lower(v).contains("url=")), "Redirect by meta refresh"),
        Rule("redirect_loop", 26, "Redirects", "high", c("redirect_loop"), "Redirect loop"),
        Rule("title_pixel_length", 30, "SEO Enhancements", "medium", None, "", cases=((desktop, "medium", "Title is too wide for desktop results", pixels), (mobile, "medium", "Title is too wide for mobile results", pixels))),
        Rule("meta_description_ctr", 31, "SEO Enhancements", "medium", None, "", cases=(
            ((c("description") != "") & (ctr_score(c("description")) < 60), "medium", "Meta description draws few clicks", ctr_score(c("description"))), ((c("description") != "") & ~F.lower("description").rlike(POWER_WORDS), "medium", "Meta description without power words", None),
            ((c("description") != "") & ~F.lower("description").rlike(CALL_WORDS), "medium", "Meta description without a call to act", None))),
        Rule("image_alt_text_quality", 32, "SEO Enhancements", "medium", None, "", cases=((alt < 70, "medium", "Poor alternative texts", alt), ((alt >= 70) & (alt < 85), "medium", "Alternative texts could be better", alt),
                                                                                          (F.size(F.filter("images", lambda i: (i["alt"] != "") & (alt_score(i["alt"]) < 70))) > 5, "medium", "Many poor alternative texts", None))),
        Rule("anchor_text_optimization", 33, "SEO Enhancements", "medium", None, "", cases=((c("generic_anchor_ratio") > 30, "medium", "Many generic link texts", c("generic_anchor_ratio")), (c("generic_anchor_ratio").between(20.000001, 30), "medium", "Generic link texts", c("generic_anchor_ratio")),
                                                                                            (c("rich_anchor_ratio") < 60, "medium", "Few link texts with keywords", c("rich_anchor_ratio")))),
        Rule("anchor_text_diversity", 34, "SEO Enhancements", "low", c("anchor_diversity_issue"), "Link texts lack variety"),
        Rule("og_tags_missing", 71, "Social Tags", "low", _lacks_metas(*share), "Open Graph tags are missing"),
        Rule("og_tags_incomplete", 72, "Social Tags", "low", blank, "Open Graph tags are empty"),
        Rule("twitter_card_tags_missing", 73, "Social Tags", "low", _lacks_metas(*card), "Card tags are missing"),
        Rule("broken_images", 79, "Images", "medium", None, "Broken image", each=F.transform(F.filter("image_states", lambda i: i["status"] >= 400), lambda i: i["src"])),
        Rule("image_file_size", 80, "Images", "medium", None, "Image over 100 KB", each=F.transform(F.filter("image_states", lambda i: i["bytes"] > 102400), lambda i: i["src"])),
        Rule("images_missing_alt_text", 81, "Images", "high", None, "Image without alternative text", each=images(lambda i: F.coalesce(i["alt"], F.lit("")) == "")),
        Rule("images_not_webp_format", 82, "Images", "medium", None, "Image in an old format", each=images(lambda i: F.lower(i["src"]).rlike(r"\.(jpe?g|png)$"))),
        Rule("images_missing_dimensions", 83, "Images", "medium", None, "Image without dimensions", each=images(lambda i: (i["width"] == "") | (i["height"] == ""))),
        Rule("images_without_lazy_loading", 84, "Images", "medium", None, "Image not loaded lazily", each=images(lambda i, k: (k >= 3) & (F.lower(i["loading"]) != "lazy"))),
        Rule("robots_txt_blocking", 90, "Crawlability", "high", c("robots_blocked"), "Blocked by robots.txt"),
        Rule("redirect_chains_crawlability", 92, "Crawlability", "medium", c("redirect_chain") >= 3, "Long redirect chain", c("redirect_chain")),
        Rule("googlebot_js_rendering_blocked", 94, "Crawlability", "high", c("blocked_resources") > 0, "Scripts or styles are blocked", c("blocked_resources")),
        Rule("organization_schema", 96, "Schema", "high", None, "", cases=((org.isNull(), "high", "No organization markup", None), (org.isNotNull() & (F.size(lacks(org, "name", "url")) > 0), "high", "Organization markup lacks what it needs", F.array_join(lacks(org, "name", "url"), ", ")),
                                                                           (org.isNotNull() & (F.size(lacks(org, "logo", "sameAs", "address")) > 0), "high", "Organization markup is incomplete", F.array_join(lacks(org, "logo", "sameAs", "address"), ", ")))),
        Rule("article_schema", 97, "Schema", "high", article_fails, "Article markup is missing, incomplete or does not fit the page", kind),
        Rule("breadcrumblist_schema", 98, "Schema", "medium", None, "", cases=((crumbs.isNull(), "medium", "No breadcrumb markup", None), (crumbs.isNotNull() & (crumb_checks < 3), "medium", "Breadcrumb markup is incomplete", crumb_checks))),
        Rule("product_schema", 99, "Schema", "medium", None, "", cases=((mentions(body, "price|buy|cart|product|shop") & product.isNull(), "medium", "Product page without product markup", None), (mentions(body, "price|buy|cart|product|shop") & product.isNotNull() & ~has(product["offers"]), "medium", "Product markup without offers", None))),
        Rule("aggregate_rating_schema", 100, "Schema", "high", (mentions(body, RATED_WORDS) | F.exists("headings", lambda h: h["level"] == 4)) & ~F.exists(g, lambda e: (e["@type"] == "AggregateRating") | e["aggregateRating"].isNotNull()), "Ratings without markup"),
        Rule("sameas_array", 101, "Schema", "high", None, "Organization with too few profiles", each=bad_profiles),
        Rule("deprecated_schema_types", 102, "Schema", "high", None, "Deprecated markup type", each=F.filter("types", lambda t: t.isin("Blog", "Recipe"))),
        Rule("duplicate_schema_formats", 103, "Schema", "medium", F.arrays_overlap("types", "microdata_types"), "One type in two formats", F.array_join(F.array_intersect("types", "microdata_types"), ", ")),
        Rule("author_name_bio", 104, "EEAT", "high", author_fails, "No named author with a biography", author, ("contact", "privacy", "terms", "login")),
        Rule("author_photo", 105, "EEAT", "medium", None, "", cases=((mentions(body, BYLINE) & (F.size(authors) == 0) & (F.size(quotes) > 0), "medium", "Author without photo, testimonials with photos", F.size(quotes)), (mentions(body, BYLINE) & (F.size(authors) == 0) & (F.size(quotes) == 0), "medium", "Author without photo", None))),
        Rule("person_schema_linked", 106, "EEAT", "high", None, "", cases=(
            (person.isNotNull() & ~is_human_author(person["name"]), "high", "Person with a name that is no person's", person["name"]), (person.isNotNull() & ~F.exists(of("Person"), lambda e: has(e["worksFor"])), "high", "Person not linked to an organization", person["name"]),
            (person.isNotNull() & ~has(person["sameAs"]) & ~has(person["url"]), "high", "Person without profile", person["name"]), (person.isNotNull() & ~has(person["jobTitle"]) & ~has(person["description"]), "high", "Person without role", person["name"]))),
        Rule("about_page", 107, "EEAT", "high", None, "", cases=((F.lower(url).contains("about") & (c("word_count") < 300), "high", "Short about page", c("word_count")), (F.lower(url).contains("about") & (F.size(missing) > 3), "high", "About page lacks its parts", F.array_join(missing, ", ")))),
        Rule("privacy_terms_pages", 108, "EEAT", "high", None, "", cases=((main & ~reached.contains("privacy"), "high", "No link to a privacy policy", None), (main & ~reached.contains("terms"), "high", "No link to terms of service", None))),
        Rule("firsthand_experience", 109, "EEAT", "high", evidence < 1.0, "Little first-hand evidence", evidence, ("contact", "privacy", "terms", "login")),
        Rule("content_freshness", 110, "EEAT", "medium", ~(mentions(body, FRESH_WORDS) & (F.size(dates(c("text"))) > 0) & has_dated_note(c("text"))), "No date of update"),
        Rule("text_contrast", 112, "Accessibility", "high", F.exists(axe, lambda v: F.lower(v["id"]).contains("color-contrast")), "Text lacks contrast"),
        Rule("form_inputs_labels", 113, "Accessibility", "high", None, "", cases=((forms & (F.size(marked("label|form")) > 0), "high", "Form inputs lack labels", F.array_join(marked("label|form"), ", ")), (forms & ~F.coalesce(F.size(marked("label|form")) > 0, F.lit(False)), "high", "Form inputs need a review", c("inputs")))),
        Rule("keyboard_accessibility", 114, "Accessibility", "high", None, "", cases=((c("focus_trap"), "high", "Keyboard focus is trapped", None), (c("unreachable_elements") > 0, "high", "Elements that no key reaches", c("unreachable_elements")), (c("missing_focus_outline") > 0, "high", "Focus can't be seen", c("missing_focus_outline")))),
        Rule("focus_indicators", 115, "Accessibility", "high", F.lower(F.coalesce("html", "text")).rlike(r"outline\s*:\s*(0|none)"), "Focus outline removed"),
        Rule("page_language", 116, "Accessibility", "high", F.length(F.coalesce("lang_checked", "html_lang", F.lit(""))) < 2, "Page language is missing"),
        Rule("video_captions", 117, "Accessibility", "medium", F.size(marked("video|caption|media|track")) > 0, "Videos lack captions"),
        Rule("tap_target_size", 118, "Accessibility", "medium", c("small_click_targets") > 0, "Small tap targets", c("small_click_targets")),
        Rule("axe_violations", 119, "Accessibility", "high", None, "Accessibility violation", each=F.transform(axe, lambda v: F.struct(v["id"].alias("detected"), v["impact"].alias("impact"))),
             grade=lambda v: F.when(v["impact"].isin("critical", "serious"), "high").when(v["impact"] == "moderate", "medium").otherwise("low")),
    ]


# Rules that the shipped wiring leaves out, and signals that its projection drops before the rules read them.
UNWIRED = ("low_code_to_html_ratio", "meta_description_ctr", "image_alt_text_quality", "images_not_webp_format", "images_missing_dimensions", "images_without_lazy_loading", "about_page", "firsthand_experience",
           "orphan_pages", "click_depth", "duplicate_content", "text_contrast")
DROPPED = ("broken_links_count", "is_404", "has_custom_404", "status_code", "timed_out", "mixed_content", "html_ratio", "iframe_wrapped", "redirect_chain", "redirect_loop", "primary_keyword", "generic_anchor_ratio", "rich_anchor_ratio",
           "anchor_diversity_issue", "robots_blocked", "blocked_resources", "link_states", "image_states", "anchors", "microdata_types", "visible_author", "has_nav", "text", "html")


def shipped(pages: DataFrame) -> DataFrame:
    """The page table as the shipped wiring hands it to the rules: dropped signals are null, the keyword density is 0."""
    return pages.withColumns({n: F.lit(None).cast(pages.schema[n].dataType) for n in DROPPED if n in pages.columns} | {"keyword_density": F.lit(0.0), "word_count": F.lit(None).cast("int")})


def shipped_issues(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Issues under the shipped wiring: its rules and projection, the first issue of each rule on a page, and no low ones (those are recommendations)."""
    rules = [r for r in content_rules() + site_rules() if r.rule_id not in UNWIRED]
    found = judge(shipped(pages), rules, keep)
    kept = F.filter("issues", lambda i: ~i["severity"].isin("low", "info"))
    first = F.filter(kept, lambda i, k: F.array_position(F.transform(kept, lambda j: j["rule_id"]), i["rule_id"]) == k + 1)
    return found.select(*keep, F.explode(first).alias("i")).select(*keep, "i.*")


def check_catalog(rules: list[Rule]) -> list[Rule]:
    ids = [r.rule_id for r in rules]
    again = sorted({i for i in ids if ids.count(i) > 1})
    if again:
        raise ValueError(f"rule ids registered twice: {again}")
    return rules


def judge(pages: DataFrame, rules: list[Rule], keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """-> keep and issues, an array for each page; no row moves."""
    found = F.flatten(F.array(*[r.issues() for r in check_catalog(rules)]))
    return with_rule_columns(pages).select(*keep, found.alias("issues"))


def evaluate(pages: DataFrame, rules: list[Rule], keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """-> keep, rule_id, rule_no, category, severity, issue_message, detected_value; a row for each issue."""
    return judge(pages, rules, keep).select(*keep, F.explode("issues").alias("i")).select(*keep, "i.*")


def coverage(pages: DataFrame, issues: DataFrame, rules: list[Rule]) -> DataFrame:
    """Per category: rules, and page checks failed and passed; exclusions by page type count as passed."""
    spark = pages.sparkSession
    catalog = spark.createDataFrame([(r.rule_id, r.category) for r in rules], "rule_id string, category string").groupBy("category").agg(F.count("*").alias("n_rules"))
    failed = issues.groupBy("category").agg(F.count("*").alias("failed"))
    total = pages.agg(F.count("*").alias("n"))
    return catalog.join(failed, "category", "left").join(F.broadcast(total)).select(
        "category", "n_rules", F.coalesce("failed", F.lit(0)).alias("failed"), (F.col("n_rules") * F.col("n") - F.coalesce("failed", F.lit(0))).alias("passed"))
