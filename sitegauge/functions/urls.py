"""URL functions as Columns.  A null URL gives null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tracking parameter marks, social hosts and URL patterns.
TRACKING = "utm_|fbclid|gclid|msclkid|campaign|source|medium"
SOCIAL = {"facebook.com": "facebook", "instagram.com": "instagram", "linkedin.com": "linkedin", "twitter.com": "twitter", "x.com": "twitter",
          "youtube.com": "youtube", "pinterest.com": "pinterest", "tiktok.com": "tiktok"}
URL_TYPES = (("main", "/pages/|/services/|/service/|/about|/contact"), ("collection", "/collections/"), ("product", "/products/"), ("blog", "/blogs/"))
SITEMAP_TYPES = (("service", "service"), ("blog", "blog|post"), ("main", "page|standard"), ("category", "category"))
PAGE_TYPES = (("contact", "/contact|/support|/help"), ("blog", "/blog|/article|/post"), ("service", "/service|/solution"), ("about", "/about|/team"))
PAGE_TYPES_BY_TEXT = (("contact", "contact form|email us|get in touch|contact us"), ("blog", "blog post|article|published"))
SKIPPED_LINKS = r"^(#|mailto:|tel:|javascript:|ftp:|file:)"


def host(url: Column) -> Column:
    """Lower-cased authority with its port; '' without one."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def registrable_domain(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def trimmed_path(url: Column) -> Column:
    bare = F.regexp_replace(path(url), "/+$", "")
    return F.when(bare == "", "/").otherwise(bare)


def normalize_url(url: Column) -> Column:
    """https, host in lower case, no tracking or valueless parameters, no closing slash or fragment."""
    plain = F.coalesce(F.try_url_decode(F.regexp_replace(url, r"\+", "%2B")), url)
    kept = F.filter(F.split(query(plain), "&"), lambda p: p.contains("=") & ~F.lower(F.regexp_extract(p, "^([^=]*)=", 1)).rlike(TRACKING))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.concat(F.lit("https://"), host(plain), trimmed_path(plain), tail)


def lookup_key(url: Column) -> Column:
    """Scheme and host in lower case, no closing slash; the query stays."""
    q = query(url)
    return F.concat(F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*://)", 1)), host(url), F.regexp_replace(path(url), "/+$", ""),
                    F.when(q == "", "").otherwise(F.concat(F.lit("?"), q)))


def selection_key(url: Column) -> Column:
    return F.regexp_replace(F.trim(F.lower(url)), "/+$", "")


def _first_match(text: Column, table, default: str) -> Column:
    out = F
    for name, pattern in table:
        out = out.when(text.rlike(pattern), name)
    return out.otherwise(default)


def url_type(url: Column) -> Column:
    return _first_match(F.lower(F.coalesce(url, F.lit(""))), URL_TYPES, "other")


def sitemap_type(url: Column) -> Column:
    return _first_match(F.lower(F.coalesce(url, F.lit(""))), SITEMAP_TYPES, "other")


def page_type(url: Column, text: Column) -> Column:
    by_text = _first_match(F.lower(F.coalesce(text, F.lit(""))), PAGE_TYPES_BY_TEXT, "general")
    by_url = _first_match(F.lower(F.coalesce(url, F.lit(""))), PAGE_TYPES, "")
    return F.when(by_url == "", by_text).otherwise(by_url)


def link_class(url: Column, base: Column) -> Column:
    """internal, the social platform's name, or external."""
    h = host(url)
    out = F.when(h.endswith(base), "internal")
    for domain, platform in SOCIAL.items():
        out = out.when(h.endswith(domain), platform)
    return out.otherwise("external")


def is_homepage(url: Column) -> Column:
    return F.regexp_replace(path(url), "/+$", "") == ""


def without_dots(path: Column) -> Column:
    """A path with its . and .. steps taken; .. above the root is dropped."""
    steps = F.split(F.regexp_replace(path, "^/", ""), "/")
    none = F.array().cast("array<string>")
    folded = F.aggregate(steps, none, lambda a, s: F.when(s == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).when(s == ".", a).otherwise(F.concat(a, F.array(s))))
    tail = F.when(path.rlike(r"/\.\.?$") & (F.size(folded) > 0), "/").otherwise("")
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.concat(F.lit("/"), F.array_join(folded, "/"), tail)).otherwise(path)


def resolve_link(base: Column, href: Column) -> Column:
    """An absolute URL for a link found on a page."""
    scheme = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*:)//", 1)
    root = F.concat(scheme, F.lit("//"), F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    folder = F.regexp_replace(path(base), "[^/]*$", "")
    own, tail = F.regexp_extract(href, "^([^?#]*)", 1), F.regexp_extract(href, "^[^?#]*(.*)$", 1)
    joined = F.when(own.startswith("/"), own).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), own))
    return (F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(scheme, href))
            .when(own == "", F.concat(root, path(base), tail)).otherwise(F.concat(root, without_dots(joined), tail)))


def bare_url(url: Column) -> Column:
    """Lower case, no www., no query or fragment, no closing slash; the scheme stays."""
    low = F.lower(F.trim(url))
    return F.concat(F.regexp_extract(low, "^([a-z][a-z0-9+.-]*://)", 1), registrable_domain(low), F.regexp_replace(path(low), "/+$", ""))


def link_target(base: Column, href: Column) -> Column:
    """A link's absolute URL, decoded, host in lower case, without query and closing slash."""
    plain = F.trim(F.coalesce(F.try_url_decode(F.regexp_replace(href, r"\+", "%2B")), href))
    whole = resolve_link(base, plain)
    return F.concat(F.lower(F.regexp_extract(whole, "^([A-Za-z][A-Za-z0-9+.-]*://)", 1)), host(whole), F.regexp_replace(path(whole), "/+$", ""))


def sitemap_url(url: Column) -> Column:
    """With a scheme (https if there was none), without fragment and closing slash; the query stays."""
    whole = F.when(url.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), url).otherwise(F.concat(F.lit("https://"), url))
    q = query(whole)
    kept = F.concat(F.regexp_extract(whole, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1), path(whole), F.when(q == "", "").otherwise(F.concat(F.lit("?"), q)))
    return F.when(path(whole) == "/", kept).otherwise(F.regexp_replace(kept, "/+$", ""))


def plain_domain(text: Column) -> Column:
    """What a person types as a domain: no scheme, www., path, port or white space, in lower case."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "^[a-z]+://", ""), r"^www\.", ""), "[/?#:].*$", "")
