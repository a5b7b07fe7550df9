"""Link analysis: kinds, path and domain distributions, anchor quality, sitemaps and robots files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitegauge.functions.urls import host, path, registrable_domain, sitemap_type
from sitegauge.sources.signals import GENERIC_ANCHORS

# Words of citations and of dead links, path segments and file names that are no site content,
# agents that crawl for AI, and rules that shut them out.
CITATION_WORDS, DEAD_WORDS = "source|study|research|report", "404|error|not-found|dead|broken"
BLOCKED_SEGMENTS = ("pxl-template|pxl-templates|elementor_library|elementor-template|fl-builder|divi-template|extra-template|wp-admin|wp-json|wp-includes|wp-content/plugins|draft|revision|trash|"
                    "wp-template|wp-templates|acf-template|template-part|wp-custom-css|sample-post|staging|test|preview|login|register|signup|checkout|cart|account|my-account|user")
JUNK_SITEMAPS = ("pxl-template|elementor_library|elementor-template|fl-builder|fl-template|divi-template|extra-template|-template-sitemap|-builder-sitemap|-templates-sitemap|wp-product-template|"
                 "woo-template|acf-template|/draft-sitemap|/revision-sitemap|/trash-sitemap|/wp-templates|test-sitemap|preview-sitemap|staging-sitemap|-sample-sitemap")
AI_AGENTS = ("GPTBot", "PerplexityBot", "ChatGPTUser", "Google-Extended", "Claude-Web")
LLMS_BOTS = {"GPTBot": "gptbot", "ClaudeBot": "claudebot", "PerplexityBot": "perplexitybot", "GitHubCopilot": "copilot", "Gemini": "gemini"}
SHUT = ("/", "/api/", "/admin/")


def link_kind(url: Column, base: Column) -> Column:
    """fragment, mailto, tel, relative, internal or external; relative links are internal as well.  base: the site's host."""
    h = host(url)
    return (F.when(url.startswith("#"), "fragment").when(url.startswith("mailto:"), "mailto").when(url.startswith("tel:"), "tel").when(h == "", "relative")
            .when(h == base, "internal").otherwise("external"))


def link_rows(pages: DataFrame) -> DataFrame:
    """-> src, url, text, rel, target, kind; a row for each link of each page.  pages: url, anchors (sources.signals)."""
    rows = pages.select(F.col("url").alias("src"), F.explode("anchors").alias("a")).select("src", F.col("a.href").alias("url"), "a.text", "a.rel", "a.target")
    return rows.withColumn("kind", link_kind(F.col("url"), host(F.col("src"))))


def path_pattern(url: Column) -> Column:
    """The first two segments of the path."""
    return F.concat(F.lit("/"), F.array_join(F.slice(F.filter(F.split(path(url), "/"), lambda p: p != ""), 1, 2), "/"))


def path_distribution(links: DataFrame) -> DataFrame:
    """-> src, pattern, n of a page's internal links."""
    return links.filter(F.col("kind").isin("internal", "relative")).groupBy("src", path_pattern(F.col("url")).alias("pattern")).agg(F.count("*").alias("n"))


def external_domains(links: DataFrame) -> DataFrame:
    """-> domain, n, any_nofollow, any_sponsored over all pages."""
    rel = F.lower(F.coalesce("rel", F.lit("")))
    return links.filter("kind = 'external'").groupBy(host(F.col("url")).alias("domain")).agg(
        F.count("*").alias("n"), F.bool_or(rel.contains("nofollow")).alias("any_nofollow"), F.bool_or(rel.contains("sponsored")).alias("any_sponsored"))


def top_domains(links: DataFrame, n: int = 10) -> DataFrame:
    return external_domains(links).orderBy(F.desc("n"), "domain").limit(n)


def link_summary(links: DataFrame) -> DataFrame:
    """-> src and counts of a page's links: total, internal, external, repeated, generic, descriptive_percent, secure, citations, doubtful."""
    c = F.col
    internal, external = c("kind").isin("internal", "relative"), c("kind") == "external"
    text = F.lower(F.trim(F.coalesce("text", F.lit(""))))
    generic = (F.length(text) < 3) | text.rlike(GENERIC_ANCHORS)
    doubtful = text.rlike(DEAD_WORDS) | F.lower("url").rlike(DEAD_WORDS)
    each = links.groupBy("src", "url", internal.alias("internal")).agg(F.count("*").alias("n"), F.count_if(generic).alias("generic"), F.count_if(external).alias("external"), F.count_if(external & c("url").startswith("https://")).alias("secure"),
                                                                      F.count_if(external & text.rlike(CITATION_WORDS)).alias("citations"), F.count_if(external & doubtful).alias("doubtful"))
    total = lambda n: F.sum(n).cast("long").alias(n)
    out = each.groupBy("src").agg(F.sum("n").alias("total"), F.sum(F.when(c("internal"), c("n")).otherwise(0)).alias("internal"), total("external"), F.count_if(c("internal") & (c("n") > 1)).alias("repeated"),
                                  total("generic"), total("secure"), total("citations"), total("doubtful"))
    return out.withColumn("descriptive_percent", (c("total") - c("generic")) * 100.0 / c("total"))


def is_content_url(url: Column) -> Column:
    """No template, builder, system or transaction page."""
    return ~F.lower(url).rlike(f"/(?:{BLOCKED_SEGMENTS})/")


def is_content_sitemap(url: Column) -> Column:
    return ~F.lower(url).rlike(JUNK_SITEMAPS)


def same_site(url: Column, base: Column) -> Column:
    """Whether one host, less www., ends with the other's."""
    a, b = registrable_domain(url), registrable_domain(base)
    return F.endswith(a, b) | F.endswith(b, a)


def robots_sitemaps(robots: Column) -> Column:
    """The URLs of a robots file's sitemap lines."""
    lines = F.filter(F.split(F.coalesce(robots, F.lit("")), r"\r?\n"), lambda x: F.lower(F.trim(x)).startswith("sitemap:"))
    return F.transform(lines, lambda x: F.trim(F.regexp_replace(F.trim(x), "(?i)^sitemap:", "")))


def sitemap_urls(body: Column) -> Column:
    """The <loc> values of a sitemap or sitemap index, entities undone."""
    return F.transform(F.regexp_extract_all(body, F.lit(r"(?is)<loc>\s*(?:<!\[CDATA\[)?\s*(.*?)\s*(?:\]\]>)?\s*</loc>"), F.lit(1)), lambda u: F.replace(u, F.lit("&amp;"), F.lit("&")))


def is_sitemap(body: Column) -> Column:
    """Whether a body is a sitemap: XML marks and no HTML page or challenge."""
    low = F.lower(F.coalesce(body, F.lit("")))
    return low.rlike(r"<(?:urlset|sitemapindex)\b") & ~low.rlike(r"<html\b|cloudflare|attention required")


def expand_sitemaps(roots: DataFrame, files: DataFrame, depth: int = 5) -> DataFrame:
    """-> url, sitemap, kind: pages that the sitemaps list, those named inside others to the given depth.

    roots: sitemap (URLs); files: sitemap, body (what was fetched).  A page in several sitemaps has the kind of
    the least rank (service, blog, main, category, other).  Each level is a join; one that names itself ends."""
    bodies = files.filter(is_sitemap(F.col("body"))).select("sitemap", F.lower("body").contains("<sitemapindex").alias("index"), sitemap_urls(F.col("body")).alias("locs"))
    level = roots.select("sitemap").distinct()
    seen, pages = level, None
    for _ in range(depth):
        held = level.join(bodies, "sitemap")
        found = held.filter("not index").select("sitemap", F.explode("locs").alias("url"))
        pages = found if pages is None else pages.unionByName(found)
        level = held.filter("index").select(F.explode("locs").alias("sitemap")).filter(is_content_sitemap(F.col("sitemap"))).distinct().join(seen, "sitemap", "left_anti")
        seen = seen.unionByName(level)
    kind = sitemap_type(F.col("sitemap"))
    rank = F.array_position(F.lit(["service", "blog", "main", "category", "other"]), kind)
    best = F.min(F.struct(rank.alias("rank"), "sitemap", kind.alias("kind"))).alias("b")
    return pages.filter(is_content_url(F.col("url"))).groupBy("url").agg(best).select("url", F.col("b.sitemap").alias("sitemap"), F.col("b.kind").alias("kind"))


def robots_rules(files: DataFrame) -> DataFrame:
    """-> host, line, agent, directive, value: a robots file's rules, each under the last agent above it.  files: host, robots."""
    lines = files.select("host", F.posexplode(F.split("robots", r"\r?\n")).alias("line", "t")).select("host", "line", F.trim(F.regexp_replace("t", "#.*$", "")).alias("t"))
    rows = lines.select("host", "line", F.lower(F.trim(F.regexp_extract("t", r"^([A-Za-z-]+)\s*:", 1))).alias("directive"), F.trim(F.regexp_extract("t", r"^[A-Za-z-]+\s*:(.*)$", 1)).alias("value")).filter("directive <> ''")
    w = Window.partitionBy("host").orderBy("line")
    agent = F.last(F.when(F.col("directive") == "user-agent", F.col("value")), ignorenulls=True).over(w)
    return rows.withColumn("agent", F.coalesce(agent, F.lit("*"))).filter("directive <> 'user-agent'").select("host", "line", "agent", "directive", "value")


def blocked_agents(rules: DataFrame) -> DataFrame:
    """-> host, agents: the AI crawlers that a robots file shuts out by name."""
    hit = rules.filter((F.col("directive") == "disallow") & F.col("value").isin(*SHUT) & F.col("agent").isin(*AI_AGENTS))
    return hit.groupBy("host").agg(F.array_sort(F.collect_set("agent")).alias("agents"))


def llms_rules(body: Column) -> Column:
    """struct<allows, disallows, bots>: whether an llms.txt has such lines, and the crawlers it names."""
    low = F.lower(F.coalesce(body, F.lit("")))
    return F.struct(low.rlike(r"\ballow\b").alias("allows"), low.rlike(r"\bdisallow\b").alias("disallows"),
                    F.array_compact(F.array(*[F.when(low.contains(p), F.lit(n)) for n, p in LLMS_BOTS.items()])).alias("bots"))


def select_pages(links: DataFrame, limit: int = 25, first: tuple[str, ...] = ("main", "service")) -> DataFrame:
    """-> url, type: pages of the first types by type and name, then others (a null type first), each URL once."""
    rank = F.when(F.col("type").isin(*first), 0).otherwise(1)
    best = links.filter("url <> ''").groupBy("url").agg(F.min(F.struct(rank.alias("r"), F.col("type").isNotNull().alias("named"), "type")).alias("b"))
    return best.orderBy("b.r", "b.named", "b.type", "url").limit(limit).select("url", F.col("b.type").alias("type"))


def with_sitemap(links: DataFrame, sitemap_pages: DataFrame) -> DataFrame:
    """Links and sitemap pages as one list of URLs, each once: source html, sitemap or both."""
    both = links.select("url", F.lit(True).alias("h"), F.lit(False).alias("s")).unionByName(sitemap_pages.select("url", F.lit(False).alias("h"), F.lit(True).alias("s")))
    out = both.groupBy("url").agg(F.bool_or("h").alias("h"), F.bool_or("s").alias("s"))
    return out.select("url", F.when(F.col("h") & F.col("s"), "both").when(F.col("h"), "html").otherwise("sitemap").alias("source"))
