"""What the DOM tree of a page shows: main content, headings, structured items, media, breadcrumbs.

Columns over `dom` of with_dom; see sources.dom for its nodes.  A page without
nodes has empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.functions.scores import let
from sitegauge.functions.urls import host
from sitegauge.sources.dom import Mark, numbered, parse_dom, stripped, subtree, text_of

# Selectors of main content in order, what is taken out of it, and words and sizes that classify headings and images.
CONTENT = ("main .entry-content", "main .post-content", "main .content-area", "main .site-content", ".elementor-element.elementor-widget-theme-post-content",
           ".elementor-element.elementor-widget-text-editor", ".elementor-section-wrap", 'div[data-elementor-type="wp-post"]', 'div[data-elementor-type="single-post"]',
           'div[data-elementor-type="page"]', ".elementor-location-single", "main", "article", '[role="main"]', ".content", ".post-content", ".entry-content", ".article-content",
           ".page-content", ".site-main", "#content", "#main", ".main-content", ".hentry", "body")
UNMEASURED = ("script", "style", "nav", "header", "footer", "aside")
REMOVED = ("nav", "header", "footer", "aside", "form", ".nav", ".navigation", ".menu", ".sidebar", ".footer", ".header", ".ads", ".advertisement", "script", "style", "noscript", "iframe",
           ".comments", ".comment", ".disqus", ".cookie", ".banner", ".popup", ".modal", ".overlay", ".social", ".share", ".related-posts", ".author-box", ".post-meta",
           ".elementor-nav-menu", ".elementor-location-header", ".menu-primary", ".menu-secondary", ".mobile-menu")
STRUCTURE = ("nav", "footer", "aside", "header", "form", "input", "select", "textarea", "button", "label")
NOISE_NAMES = "header|footer|nav|menu|sidebar|popup|modal|banner|cookie"
KEPT_SHORT = frozenset(("h1", "h2", "h3", "h4", "h5", "h6", "p", "a"))
LEAST, SHORT, CAP = 100, 30, 5000
QUESTION_WORDS = ("what", "why", "how", "when", "where", "which", "who", "whom", "whose", "can", "do", "does", "is", "are", "should", "would", "could")
NOT_HERO = "logo|icon|favicon"
MENU_WORDS = "menu|navigation|nav|main"

MARKS = {"unmeasured": Mark(UNMEASURED), "removed": Mark(REMOVED), "noise": Mark(STRUCTURE, NOISE_NAMES, (SHORT, KEPT_SHORT)), "item": Mark(("[itemscope]",)), "typed": Mark(("[typeof]",)),
         "vocab": Mark(("[vocab]", "[prefix]")), "figure": Mark(("figure",)), "frame": Mark(("header", "footer")), "bar": Mark(("header", "nav"))}


def with_dom(pages: DataFrame, *marks: str, html: str = "html") -> DataFrame:
    """pages with dom, carrying the marks that this module reads, or only those named (content: the ranks of its selectors)."""
    wanted = marks or (*MARKS, "content")
    return parse_dom(pages, {n: m for n, m in MARKS.items() if n in wanted}, {"content": CONTENT} if "content" in wanted else {}, html)


def _first(values: Column) -> Column:
    return F.try_element_at(values, F.lit(1))


def main_content(dom: Column) -> Column:
    """struct<selector, text>: of the first selector with an element of over 100 characters (without scripts, navigation, headers, footers and asides) the longest, its text
    without noise, 5,000 characters at most (the stored form's limit); else of the body; selector none without one."""
    ranked = F.filter(numbered(dom, "content_rank", "unmeasured_chars", "last"), lambda x: x["content_rank"].isNotNull() & (x["unmeasured_chars"] > LEAST))
    best = F.array_min(F.transform(ranked, lambda x: F.struct(x["content_rank"].alias("rank"), (-x["unmeasured_chars"]).alias("size"), x["k"].alias("k"), x["last"].alias("last"))))
    body = _first(F.transform(F.filter(numbered(dom, "tag", "last"), lambda x: x["tag"] == "body"), lambda x: F.struct(F.lit(len(CONTENT) - 1).alias("rank"), F.lit(0).alias("size"), x["k"].alias("k"), x["last"].alias("last"))))
    return let(F.coalesce(best, body), lambda b: F.struct(F.coalesce(F.try_element_at(F.lit(list(CONTENT)), b["rank"] + 1), F.lit("none")).alias("selector"),
                                                          F.coalesce(F.left(text_of(dom, b["k"], b["last"], " ", "removed"), F.lit(CAP)), F.lit("")).alias("text")))


def clean_content(dom: Column) -> Column:
    """struct<container, chars, text, clean_chars, reduction>: text of main, else article, else the div with most text (over 100 characters), else the body, without structure, noise, form
    controls and elements of under 30 characters other than headings, paragraphs and links."""
    nodes = numbered(dom, "tag", "chars", "last")
    of = lambda tag: F.filter(nodes, lambda x: x["tag"] == tag)
    shown = lambda x: F.struct(x["tag"].alias("tag"), x["chars"].alias("chars"), x["k"].alias("k"), x["last"].alias("last"))
    div = F.array_min(F.transform(F.filter(of("div"), lambda x: x["chars"] > LEAST), lambda x: F.struct((-x["chars"]).alias("size"), x["k"].alias("k"), shown(x).alias("x"))))["x"]
    found = F.coalesce(_shown_first(of("main"), shown), _shown_first(of("article"), shown), div, _shown_first(of("body"), shown))
    text = lambda c: let(F.coalesce(text_of(dom, c["k"], c["last"], " ", "noise"), F.lit("")), lambda t: F.struct(
        F.coalesce(c["tag"], F.lit("none")).alias("container"), F.coalesce(c["chars"], F.lit(0)).alias("chars"), t.alias("text"), _kept_chars(dom, c).alias("clean_chars")))
    return let(let(found, text), lambda r: r.withField("reduction", F.round(1 - r["clean_chars"] / F.greatest(r["chars"], F.lit(1)), 2)))


def _shown_first(nodes: Column, shown) -> Column:
    return _first(F.transform(nodes, shown))


def _kept_chars(dom: Column, c: Column) -> Column:
    kept = F.filter(subtree(dom, c["k"], c["last"]), lambda x: (x["tag"] == "#text") & (x["noise_at"] < c["k"]))
    return F.coalesce(F.aggregate(kept, F.lit(0), lambda n, x: n + x["chars"]), F.lit(0))


def dom_headings(dom: Column) -> Column:
    """array<struct<level, text>> of headings with text, in order; a heading's texts are joined without space."""
    heads = F.filter(numbered(dom, "tag", "last", "chars"), lambda x: x["tag"].rlike("^h[1-6]$") & (x["chars"] > 0))
    return F.transform(heads, lambda x: F.struct(F.substring(x["tag"], 2, 1).cast("int").alias("level"), text_of(dom, x["k"], x["last"]).alias("text")))


HEAD = "struct<level: int, text: string, place: int, parent: int, parent_level: int, skipped: array<int>, first_at: int, all_caps: boolean, sentence_case: boolean, question: boolean>"


def heading_tree(headings: Column) -> Column:
    """array<HEAD>: each heading with the nearest earlier heading of a lower level, found on a stack of open headings, lowest level first.

    skipped: levels left out since the heading before; first_at: the place of an earlier heading with the same text; places from 0."""
    def step(state: Column, h: Column) -> Column:
        # closing all of this level or deeper leaves the chain of open headings
        return let(F.filter(state["stack"], lambda s: s["level"] < h["level"]), lambda stack: let(F.try_element_at(stack, F.lit(-1)), lambda up: F.struct(
            F.concat(stack, F.array(F.struct(h["level"].alias("level"), F.size(state["out"]).alias("place")))).alias("stack"),
            F.concat(state["out"], F.array(_head(h, state["out"], up))).alias("out"))))

    start = F.struct(F.array().cast("array<struct<level: int, place: int>>").alias("stack"), F.array().cast(f"array<{HEAD}>").alias("out"))
    return F.aggregate(headings, start, step, lambda s: s["out"])


def _head(h: Column, out: Column, up: Column) -> Column:
    before, text, rest = F.try_element_at(out, F.lit(-1))["level"], h["text"], F.substring(h["text"], 2, 1 << 30)
    word = F.lower(F.regexp_extract(text, r"(?U)^\s*(\S+)", 1))
    gap = F.when(h["level"] > before + 1, F.sequence(before + 1, h["level"] - 1)).otherwise(F.array().cast("array<int>"))
    first = F.left(text, F.lit(1))
    sentence = F.when(F.length(text) > 1, (first == F.upper(first)) & (first != F.lower(first)) & (rest != F.upper(rest))).otherwise(True)
    return F.struct(h["level"].alias("level"), text.alias("text"), F.size(out).alias("place"), up["place"].alias("parent"), up["level"].alias("parent_level"),
                    F.coalesce(gap, F.array().cast("array<int>")).alias("skipped"), _first(F.filter(out, lambda o: o["text"] == text))["place"].alias("first_at"),
                    ((text == F.upper(text)) & (text != F.lower(text))).alias("all_caps"), sentence.alias("sentence_case"),
                    F.regexp_replace(word, r"^[.,!?;:]+|[.,!?;:]+$", "").isin(*QUESTION_WORDS).alias("question")).cast(HEAD)


def _short_type(kind: Column) -> Column:
    """The last part of a type's address."""
    return F.regexp_extract(kind, r"([^/#]*)/?$", 1)


OWN = "struct<types: array<string>, id: string, parent: struct<item: int, property: string>>"


def structured_items(pages: DataFrame, *keys: str) -> DataFrame:
    """-> keys, format, item, type, id, parent_item, parent_property, properties map<name, array<value>>: one row for each microdata or RDFa item.

    An item is an element with itemscope, or with typeof where it or an element around it names a vocabulary or prefix.  A property belongs to the nearest item
    around its element; the value of a property that is an item itself is that item's number.  pages: keys, dom."""
    d, a = F.col("dom"), lambda x, n: F.try_element_at(x["attrs"], F.lit(n))
    outer = lambda x, mark: F.coalesce(F.try_element_at(d, F.when(x["parent"] >= 0, x["parent"] + 1))[f"{mark}_at"], F.lit(-1))

    def value(x: Column, k: Column) -> Column:
        tag = x["tag"]
        linked = F.when(tag == "meta", a(x, "content")).when(tag.isin("img", "audio", "video", "iframe", "embed", "source", "track"), a(x, "src")).when(tag.isin("a", "area", "link"), a(x, "href"))
        return F.coalesce(linked.when(tag == "object", a(x, "data")).when(tag.isin("data", "meter"), a(x, "value")).when(tag == "time", a(x, "datetime")), a(x, "content"), text_of(d, k, x["last"], " "))

    def rows(kind: str, mark: str, prop: str, is_item, typed: str, id: str) -> Column:
        marked = F.filter(F.transform(d, lambda x, k: F.struct(x.alias("x"), k.alias("k"))), lambda z: F.map_contains_key(z["x"]["attrs"], prop) | is_item(z["x"]))
        build = lambda x, k: F.struct(
            F.lit(kind).alias("format"), k.alias("k"), is_item(x).alias("is_item"), outer(x, mark).alias("owner"), a(x, typed).alias("type"), a(x, id).alias("id"),
            F.filter(F.split(F.coalesce(a(x, prop), F.lit("")), r"\s+"), lambda p: p != "").alias("props"), F.when(a(x, prop).isNotNull(), F.when(is_item(x), k.cast("string")).otherwise(value(x, k))).alias("value"))
        keep = F.filter(F.transform(marked, lambda z: build(z["x"], z["k"])), lambda r: r["is_item"] | (F.size(r["props"]) > 0) & (r["owner"] >= 0))
        return keep

    micro = rows("microdata", "item", "itemprop", lambda x: a(x, "itemscope").isNotNull(), "itemtype", "itemid")
    rdfa = rows("rdfa", "typed", "property", lambda x: a(x, "typeof").isNotNull() & (x["vocab_at"] >= 0), "typeof", "resource")
    found = pages.select(*keys, F.explode(F.concat(micro, rdfa)).alias("r")).select(*keys, "r.*")
    # an element speaks as an item, and of the item around it: both meet in one grouping, so neither side of a join is ever broadcast
    own = F.struct(F.transform(F.filter(F.split(F.coalesce("type", F.lit("")), r"\s+"), lambda t: t != ""), _short_type).alias("types"), "id",
                   F.when((F.size("props") > 0) & (F.col("owner") >= 0), F.struct(F.col("owner").alias("item"), _first(F.col("props")).alias("property"))).alias("parent"))
    said = F.transform("props", lambda p: F.struct(p.alias("name"), F.col("k").alias("k"), F.col("value").alias("value")))
    roles = F.array(F.when(F.col("is_item"), F.struct(F.col("k").alias("item"), own.alias("own"), F.lit(None).cast("array<struct<name: string, k: int, value: string>>").alias("said"))),
                    F.when((F.col("owner") >= 0) & (F.size("props") > 0), F.struct(F.col("owner").alias("item"), F.lit(None).cast(OWN).alias("own"), said.alias("said"))))
    both = found.select(*keys, "format", F.explode(F.array_compact(roles)).alias("r")).select(*keys, "format", "r.*")
    both = both.groupBy(*keys, "format", "item").agg(F.collect_list("own").alias("own"), F.array_sort(F.flatten(F.collect_list("said"))).alias("said"))
    values = lambda n: F.transform(F.filter("said", lambda s: s["name"] == n), lambda s: s["value"])
    maps = F.map_from_entries(F.transform(F.array_distinct(F.transform("said", lambda s: s["name"])), lambda n: F.struct(n, values(n))))
    out = both.withColumn("properties", F.when(F.size("said") > 0, maps)).withColumn("o", F.explode("own"))
    return out.select(*keys, "format", "item", "o.types", "o.id", F.col("o.parent.item").alias("parent_item"), F.col("o.parent.property").alias("parent_property"), "properties")


def microdata_types(dom: Column) -> Column:
    """Names of the types of the page's microdata items, each once."""
    names = lambda x: F.filter(F.split(F.coalesce(F.try_element_at(x["attrs"], F.lit("itemtype")), F.lit("")), r"\s+"), lambda t: t != "")
    return F.array_distinct(F.flatten(F.transform(F.filter(dom, lambda x: F.map_contains_key(x["attrs"], "itemtype")), lambda x: F.transform(names(x), _short_type))))


def dom_formats(dom: Column, jsonld: Column) -> Column:
    """struct<jsonld, microdata, rdfa, mixed, microdata_types>: how many blocks and items of each format; RDFa counts where a vocabulary or prefix is in force, properties in its items too."""
    at = lambda x, n: F.try_element_at(x["attrs"], F.lit(n))
    micro = F.filter(dom, lambda x: at(x, "itemscope").isNotNull())
    typed = F.size(F.filter(dom, lambda x: at(x, "typeof").isNotNull() & (x["vocab_at"] >= 0)))
    within = lambda x: F.coalesce(F.try_element_at(dom, F.when(x["parent"] >= 0, x["parent"] + 1))["typed_at"], F.lit(-1)) >= 0
    props = F.size(F.filter(dom, lambda x: at(x, "property").isNotNull() & (x["vocab_at"] >= 0) & within(x)))
    counts = F.struct(F.size(jsonld).alias("jsonld"), F.size(micro).alias("microdata"), F.when(typed > 0, typed + props).otherwise(0).alias("rdfa"), microdata_types(dom).alias("microdata_types"))
    return let(counts, lambda c: c.withField("mixed", (c["jsonld"] > 0).cast("int") + (c["microdata"] > 0).cast("int") + (c["rdfa"] > 0).cast("int") > 1))


def media(pages: DataFrame, *keys: str) -> DataFrame:
    """-> keys, k, place, kind, src, alt, width, height, caption, captions, transcript, in_bar, role: one row for each image, video, audio and frame.

    caption: text of the figcaption of the nearest figure around it; captions: it holds a track of kind captions; transcript: a link of that figure, or of the page
    where there is no figure, names a transcript.  role of images: logo, decorative, hero (the largest outside header and navigation, of 300 by 200 at least), content.
    pages: keys, url, dom."""
    d, a = F.col("dom"), lambda x, n: F.coalesce(F.try_element_at(x["attrs"], F.lit(n)), F.lit(""))
    size = lambda v: F.coalesce(F.nullif(F.regexp_extract(v, r"^\s*(\d{1,9})\s*(?:px)?\s*$", 1), F.lit("")).cast("int"), F.lit(0))

    def row(x: Column, k: Column) -> Column:
        f = x["figure_at"]
        end = F.try_element_at(d, F.when(f >= 0, f + 1))["last"]
        near = F.when(f >= 0, subtree(d, f, end)).otherwise(d)
        caption = F.when(f >= 0, _first(F.filter(F.transform(d, lambda y, j: F.when((y["tag"] == "figcaption") & (y["figure_at"] == f), text_of(d, j, y["last"], " "))), lambda t: t.isNotNull())))
        source = F.filter(subtree(d, k, x["last"]), lambda y: y["tag"] == "source")
        words = F.exists(F.filter(F.transform(d, lambda y, j: F.struct(y.alias("y"), j.alias("j"))), lambda z: (z["y"]["tag"] == "a") & ((f < 0) | (z["j"] >= f) & (z["j"] <= end))),
                         lambda z: F.lower(a(z["y"], "href")).contains("transcript") | F.lower(text_of(d, z["j"], z["y"]["last"])).contains("transcript"))
        return F.struct(k.alias("k"), x["tag"].alias("kind"), F.coalesce(F.nullif(a(x, "src"), F.lit("")), a(_first(source), "src"), F.lit("")).alias("src"), a(x, "alt").alias("alt"), size(a(x, "width")).alias("width"), size(a(x, "height")).alias("height"),
                        F.coalesce(caption, F.lit("")).alias("caption"), F.exists(subtree(d, k, x["last"]), lambda y: (y["tag"] == "track") & (a(y, "kind") == "captions")).alias("captions"),
                        (x["tag"].isin("video", "audio") & words).alias("transcript"), (x["bar_at"] >= 0).alias("in_bar"), (a(x, "role") == "presentation").alias("presentation"))

    kinds = ("img", "video", "audio", "iframe")
    found = F.transform(F.filter(F.transform(d, lambda x, k: F.struct(x.alias("x"), k.alias("k"))), lambda z: z["x"]["tag"].isin(*kinds)), lambda z: row(z["x"], z["k"]))
    hero = lambda m: (m["kind"] == "img") & ~F.lower(m["src"]).rlike(NOT_HERO) & (m["width"] >= 300) & (m["height"] >= 200) & ~m["in_bar"]
    area = lambda m: m["width"].cast("long") * m["height"]
    largest = F.array_min(F.transform(F.filter("_m", hero), lambda m: F.struct((-area(m)).alias("area"), m["k"].alias("k"))))["k"]  # within the page's own array: no row moves
    rows = pages.select(*keys, found.alias("_m")).select(*keys, largest.alias("hero_k"), "_m").select(*keys, "hero_k", F.posexplode("_m").alias("place", "m")).select(*keys, "hero_k", "place", "m.*")
    named = F.lower(F.concat("src", F.lit(" "), "alt"))
    small = (F.col("alt") == "") & F.col("width").between(1, 49) & F.col("height").between(1, 49)
    role = F.when(F.col("kind") != "img", F.col("kind")).when(F.col("k") == F.col("hero_k"), "hero").when(named.contains("logo"), "logo").when(F.col("presentation") | small, "decorative").otherwise("content")
    return rows.withColumn("role", role).drop("hero_k", "presentation")


def dom_trail(dom: Column) -> Column:
    """struct<way, position, names, links> of the page's breadcrumbs: a nav labelled so with two links or more, else an element with such a class, else a list of two links or more to
    different addresses; the last two only in the first 30 % of elements and outside header and footer; way 0 (nothing), 1, 2 or 3."""
    total = F.size(F.filter(dom, lambda x: ~x["tag"].startswith("#")))
    top = F.floor(total * 0.3)
    at = lambda x, n: F.try_element_at(x["attrs"], F.lit(n))
    free = lambda x: F.coalesce(F.try_element_at(dom, F.when(x["parent"] >= 0, x["parent"] + 1))["frame_at"], F.lit(-1)) < 0
    inside = lambda k, last: F.filter(F.transform(subtree(dom, k, last), lambda y, j: F.struct(y.alias("y"), (j + k).alias("j"))), lambda z: (z["y"]["tag"] == "a") & at(z["y"], "href").isNotNull())
    links = lambda zs: F.transform(zs, lambda z: F.struct(text_of(dom, z["j"], z["y"]["last"]).alias("name"), at(z["y"], "href").alias("link")))

    def first_links(k: Column, last: Column) -> Column:
        items = F.filter(F.transform(subtree(dom, k, last), lambda y, j: F.struct(y.alias("y"), (j + k).alias("j"))), lambda z: z["y"]["tag"] == "li")
        return F.filter(F.transform(items, lambda z: _first(links(inside(z["j"], z["y"]["last"])))), lambda v: v.isNotNull())

    classed = lambda x: F.when(F.lower(F.array_join(x["classes"], " ")).contains("breadcrumb"), 0).when(F.lower(F.array_join(x["classes"], " ")).contains("bread-crumb"), 1)
    early = lambda x: (x["element"] <= top) & free(x)

    def ways(x: Column, k: Column) -> Column:
        way = lambda n, order, found: F.struct(F.lit(n).alias("way"), order.alias("order"), k.alias("k"), x["element"].alias("position"), found.alias("found"))
        one = F.when((x["tag"] == "nav") & F.lower(F.coalesce(at(x, "aria-label"), F.lit(""))).contains("breadcrumb"), way(1, F.lit(0), links(inside(k, x["last"]))))
        two = F.when(classed(x).isNotNull() & early(x), F.when(~F.lower(text_of(dom, k, x["last"], " ")).rlike(MENU_WORDS), way(2, classed(x), links(inside(k, x["last"])))))
        three = F.when(x["tag"].isin("ol", "ul") & early(x), way(3, F.lit(0), first_links(k, x["last"])))
        return F.array_compact(F.array(one, two, three))

    all_ways = F.flatten(F.transform(dom, ways))
    only_first = lambda v: F.filter(v, lambda w: (w["way"] != 1) | (w["k"] == F.array_min(F.transform(F.filter(v, lambda u: u["way"] == 1), lambda u: u["k"]))))
    good = F.filter(let(all_ways, only_first), lambda w: (F.size(w["found"]) >= 2) & ((w["way"] != 3) | (F.size(F.array_distinct(F.transform(w["found"], lambda v: v["link"]))) >= 2)))
    return let(F.array_min(good), lambda w: F.struct(F.coalesce(w["way"], F.lit(0)).alias("way"), w["position"].alias("position"), F.coalesce(F.transform(w["found"], lambda v: v["name"]), F.array().cast("array<string>")).alias("names"),
                                                   F.coalesce(F.transform(w["found"], lambda v: v["link"]), F.array().cast("array<string>")).alias("links")))


def in_order(schema: Column, shown: Column) -> Column:
    """Length of the longest common subsequence of two trails, names compared without case and outer space: one fold of table rows over the schema's names."""
    plain = lambda v: F.transform(F.coalesce(v, F.array().cast("array<string>")), lambda t: F.lower(stripped(t)))
    zeros = lambda s: F.transform(F.concat(F.array(F.lit("")), s), lambda _: F.lit(0))

    def table_row(row: Column, name: Column, s: Column) -> Column:
        return F.aggregate(s, F.array(F.lit(0)), lambda acc, t: F.concat(acc, F.array(let(F.size(acc), lambda j: F.when(t == name, F.element_at(row, j) + 1).otherwise(F.greatest(F.element_at(row, j + 1), F.element_at(acc, j)))))))

    return let(plain(shown), lambda s: F.element_at(F.aggregate(plain(schema), zeros(s), lambda row, name: table_row(row, name, s)), -1))


BLOCKS = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "table", "dl")
ASKED = ("who", "what", "when", "where", "why", "how", "is", "are", "can", "should", "will")
ITEMS, ROWS, PREVIEW, PREVIEWED = 10, 5, 3, 50


def snippet_signals(dom: Column) -> Column:
    """struct<blocks, top, lists, tables, definitions, questions>: what may become a search snippet.

    blocks: headings, paragraphs, lists and tables; top: 30 % of them, rounded down.  lists and tables: those whose number among lists (tables) is top at most, with up to 10 items (5 rows)
    counted.  definitions: headings of level 2 whose next paragraph or div beside them is a paragraph of 20 to 200 characters.  questions: headings that ask."""
    nodes = numbered(dom, "tag", "parent", "last", "chars")
    of = lambda *tags: F.filter(nodes, lambda x: x["tag"].isin(*tags))
    inside = lambda x, *tags: F.filter(nodes, lambda y: (y["k"] > x["k"]) & (y["k"] <= x["last"]) & y["tag"].isin(*tags))
    words_of = lambda y: text_of(dom, y["k"], y["last"])
    count = F.size(of(*BLOCKS))
    top = F.floor(count * 0.3).cast("int")
    early = lambda found: F.slice(found, F.lit(1), top + 1)
    lists = F.transform(early(of("ul", "ol")), lambda x, i: let(F.slice(inside(x, "li"), 1, ITEMS), lambda li: F.struct(
        x["tag"].alias("kind"), i.alias("place"), F.size(li).alias("items"), F.transform(F.slice(li, 1, PREVIEW), lambda y: F.left(words_of(y), F.lit(PREVIEWED))).alias("shown"))))
    tables = F.transform(early(of("table")), lambda x, i: F.struct(i.alias("place"), F.least(F.lit(ROWS), F.size(inside(x, "tr"))).alias("rows"), (F.size(inside(x, "th")) > 0).alias("headers")))
    beside = lambda h: F.try_element_at(F.filter(nodes, lambda y: (y["parent"] == h["parent"]) & (y["k"] > h["last"]) & y["tag"].isin("p", "div")), F.lit(1))
    defined = F.transform(of("h2"), lambda h: let(beside(h), lambda p: F.when((p["tag"] == "p") & p["chars"].between(20, 200), F.struct(words_of(h).alias("heading"), words_of(p).alias("definition")))))
    asks = lambda t: t.endswith("?") | t.rlike(f"^({'|'.join(ASKED)}) ")
    heads = F.transform(of("h1", "h2", "h3", "h4", "h5", "h6"), lambda h: F.struct(h["tag"].alias("level"), words_of(h).alias("text")))
    return F.struct(count.alias("blocks"), top.alias("top"), lists.alias("lists"), tables.alias("tables"), F.array_compact(defined).alias("definitions"), F.filter(heads, lambda h: asks(F.lower(h["text"]))).alias("questions"))


def language_signals(dom: Column) -> Column:
    """struct<html_lang, langs, chars, non_ascii, non_ascii_percent, paragraphs>: languages that the page states, and characters of its text (texts joined by a space) outside ASCII."""
    lang = lambda x: F.try_element_at(x["attrs"], F.lit("lang"))
    whole = F.array_join(F.transform(F.filter(dom, lambda x: (x["tag"] == "#text") & (x["chars"] > 0)), lambda x: stripped(x["text"])), " ")
    return let(whole, lambda t: let(F.struct(F.length(t).alias("n"), F.length(F.regexp_replace(t, r"[\x00-\x7F]", "")).alias("odd")), lambda c: F.struct(
        _first(F.transform(F.filter(dom, lambda x: x["tag"] == "html"), lang)).alias("html_lang"), F.transform(F.filter(dom, lambda x: lang(x).isNotNull()), lambda x: F.struct(x["tag"].alias("tag"), lang(x).alias("lang"))).alias("langs"),
        c["n"].alias("chars"), c["odd"].alias("non_ascii"), F.coalesce(F.round(F.try_divide(c["odd"] * 100.0, c["n"]), 2), F.lit(0.0)).alias("non_ascii_percent"), F.size(F.filter(dom, lambda x: x["tag"] == "p")).alias("paragraphs"))))


def branding(dom: Column, metas: Column) -> Column:
    """struct<theme_color, apple_icons array<struct<sizes, href>>>."""
    at = lambda x, n: F.try_element_at(x["attrs"], F.lit(n))
    icons = F.filter(dom, lambda x: (x["tag"] == "link") & F.array_contains(F.split(F.coalesce(at(x, "rel"), F.lit("")), r"\s+"), "apple-touch-icon"))
    return F.struct(F.nullif(F.try_element_at(F.try_element_at(metas, F.lit("theme-color")), F.lit(1)), F.lit("")).alias("theme_color"), F.transform(icons, lambda x: F.struct(at(x, "sizes").alias("sizes"), at(x, "href").alias("href"))).alias("apple_icons"))


def image_hosts(src: Column, page_url: Column) -> Column:
    """The host of an image that lies on neither the page's host nor one under it; null if there is none."""
    h = F.lower(host(src))
    return F.when((h != "") & (h != F.lower(host(page_url))) & ~h.endswith(F.lower(host(page_url))), h)
