"""Rules, entities, links and scores on pages made by hand."""

import json

import pytest
from pyspark.sql import functions as F

from sitegauge.functions import intents, readability, urls
from sitegauge.operators import entity_audit, extracts, graph, legacy_rules, links, rules, tables
from sitegauge.plans.page_analysis import UNREAD, full_analysis
from sitegauge.sources.scratch import shared_folder
from sitegauge.sources.signals import page_guard, page_signals

PERSON = {"@type": "Person", "name": "Acme Team"}
ORG = {"@type": ["Organization"], "@id": "https://x.org/#org", "name": "Acme", "url": "https://x.org", "sameAs": ["https://x.org/a", "https://facebook.com/a"]}
RICH = f"""<!DOCTYPE html><html lang="en"><head><title>Garden tools for small gardens</title><meta http-equiv="refresh" content="0; url=/next"><meta name="description" content="Short text">
<link rel="alternate" hreflang="DE" href="/de"><script>gtag('config', 'G-ABCDEF123');</script><script type="application/ld+json">{json.dumps({"@context": "https://schema.org", "@graph": [ORG, {"@graph": [PERSON]}]})}</script></head>
<body><nav><a href="/about">about</a></nav><h1>Garden tools</h1><h3>Which spade?</h3><img src="http://x.org/a.jpg" alt=""><img src="b.webp" alt="A red spade in the garden" width="10" height="20">
<a href="/login" rel="nofollow">log in</a><a href="/shop" rel="nofollow">here</a><form><input type="text"><input type="hidden"></form><iframe width="100%" height="100%" src="/f"></iframe>
<p>Spades and rakes. Spades are written by nobody. Spades dig well, and spades last long when they are kept dry and clean.</p></body></html>"""
PAGES = [(1, "https://x.org/", RICH), (2, "https://x.org/about", "<html><head><title>About</title></head><body><h1>About</h1><p>story</p></body></html>"), (3, "https://x.org/empty", None)]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string")


def test_signals(pages):
    got = {r["page_id"]: r for r in page_signals(pages).collect()}
    one = got[1]
    assert one["mixed_content"] and one["iframe_wrapped"] and one["forms"] == 1 and one["inputs"] == 1 and one["has_nav"] and one["primary_keyword"] == "spades" and one["nofollow_internal"] == 2
    assert [tuple(h) for h in one["hreflangs"]] == [("de", "/de")] and one["analytics"] == ["ga4"] and one["doctype"] == "html" and one["metas"]["refresh"] == ["0; url=/next"]
    assert got[3]["html_bytes"] == 0 and got[3]["anchors"] == [] and not got[3]["iframe_wrapped"]


def test_issues_of_each_kind(spark, pages):
    found = full_analysis(pages, shared_folder(spark)).collect()
    by = {}
    for r in found:
        by.setdefault((r["page_id"], r["rule_id"]), []).append((r["severity"], r["detected_value"]))
    assert by[1, "meta_refresh"] == [("high", None)] and by[1, "mixed_http_https"] and by[1, "iframe_wrapping"]
    assert by[1, "rel_nofollow_internal"] == [("high", "/shop")]
    assert len(by[1, "person_schema_linked"]) == 4 and by[1, "organization_schema"] == [("high", "logo, address")]
    assert (1, "sameas_array") in by and by[1, "images_missing_alt_text"] == [("high", "http://x.org/a.jpg")] and by[1, "images_missing_dimensions"] == [("medium", "http://x.org/a.jpg")]
    assert by[1, "form_inputs_labels"] == [("high", "1")] and len(by[1, "privacy_terms_pages"]) == 2 and len(by[2, "about_page"]) == 2
    assert (1, "orphan_pages") not in by and (3, "orphan_pages") in by and (2, "orphan_pages") not in by


def test_shipped_wiring_drops_signals(pages):
    found = {(r["page_id"], r["rule_id"]): r["severity"] for r in rules.shipped_issues(page_signals(pages)).collect()}
    assert (1, "iframe_wrapping") not in found and (1, "orphan_pages") not in found and "low" not in found.values()
    assert found[1, "keyword_density"] == "medium" and len(found) == rules.shipped_issues(page_signals(pages)).count()


def test_nested_graphs_and_types(spark, pages):
    e = entity_audit.entity_table(page_signals(pages))
    assert {r["id"] for r in e.collect()} == {"https://x.org/#org", None}
    assert {t for r in e.collect() for t in r["types"]} == {"Organization", "Person"}
    ids = spark.createDataFrame([("#a",), ("http://www.x.org/p?q=1#b",), ("/c",), ("d",)], "id string")
    assert [r[0] for r in ids.select(entity_audit.entity_id(F.col("id"), F.lit("https://x.org/s/"))).collect()] == ["https://x.org/s/#a", "https://x.org/p?q=1#b", "https://x.org/c", "https://x.org/s/d"]
    props = spark.sql("select map('@type', 'X', 'a', '', 'b', '[]') as p, map('b', '1', 'a', '2') as q, map('a', '2', 'b', '1') as r")
    row = props.select(entity_audit.held_properties(F.col("p")), entity_audit.entity_hash(F.col("q")) == entity_audit.entity_hash(F.col("r"))).first()
    assert row[0] is None and row[1]


def test_older_rules_are_complete(spark, pages):
    found = legacy_rules.rules()
    assert len(found) == 55 and len({r.rule_id for r in found}) == 55
    scores = {r["page_id"]: r["rule_scores"] for r in legacy_rules.legacy_scores(legacy_rules.legacy_features(page_signals(pages)), "page_id").collect()}
    assert all(0 <= v <= 100 for s in scores.values() for v in s.values())
    assert scores[1]["structured_data_completeness"] == pytest.approx((2 / 5 * 8 + 2 / 3 * 6) / 20 * 100) and scores[3]["entity_richness"] == 0


def test_links_paths_and_dots(spark):
    rows = spark.createDataFrame([("https://a.org/x/y/z.html", h) for h in ("../k", "./k/", "/a/../b", "//c.org/d", "?q=1", "#t", "../../../../e")], "base string, href string")
    assert [r[0] for r in rows.select(urls.resolve_link(F.col("base"), F.col("href"))).collect()] == [
        "https://a.org/x/k", "https://a.org/x/y/k/", "https://a.org/b", "https://c.org/d", "https://a.org/x/y/z.html?q=1", "https://a.org/x/y/z.html#t", "https://a.org/e"]


def test_sitemaps_robots_and_guards(spark):
    body = "<?xml version='1.0'?><urlset><url><loc> https://a.org/p?x=1&amp;y=2 </loc></url></urlset>"
    got = spark.createDataFrame([(body, "Allow: /\nGPTBot and copilot")], "b string, l string").select(links.sitemap_urls(F.col("b")), links.is_sitemap(F.col("b")), links.llms_rules(F.col("l")), page_guard(F.col("b"))).first()
    assert got[0] == ["https://a.org/p?x=1&y=2"] and got[1] and got[2]["allows"] and not got[2]["disallows"] and got[2]["bots"] == ["GPTBot", "GitHubCopilot"] and got[3] == "not_html"
    loop = spark.createDataFrame([("a", "<sitemapindex><loc>a</loc><loc>b</loc></sitemapindex>"), ("b", "<urlset><loc>https://s.org/1</loc></urlset>")], "sitemap string, body string")
    assert [r["url"] for r in links.expand_sitemaps(spark.createDataFrame([("a",)], "sitemap string"), loop).collect()] == ["https://s.org/1"]


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(intents.iso_seconds(F.lit("PT1H2M3S"))) == 3723 and one(intents.iso_seconds(F.lit("P"))) is None
    assert one(intents.video_id(F.lit("https://youtu.be/abcdefghijk"))) == "abcdefghijk"
    assert one(intents.is_human_author(F.lit("Jane Doe"))) and not one(intents.is_human_author(F.lit("Support Team")))
    assert one(intents.same_phone(F.lit("+1 (555) 010-2000"), F.lit("1-555-010-2000")))
    assert one(readability.syllables_of_terms(F.lit("table"))) == 2 and one(readability.syllables_of_terms(F.lit("seo"))) == 1
    assert one(graph.cross_link_strength(F.lit(1), F.lit(5))) == 0 and one(graph.cross_link_strength(F.lit(4), F.lit(3))) == 0.5


def test_keyed_tables(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "k int, v string, at int")
    assert sorted(tuple(r) for r in tables.latest(rows, ["k"], "at").collect()) == [(1, "b", 2), (2, "c", 1)]
    assert tables.check_unique(rows, "k", "at").count() == 3
    with pytest.raises(Exception, match="stored twice"):
        tables.check_unique(rows, "k").collect()
    s = spark.sql("select named_struct('a', 1, 'b', 2) as s union all select null")
    assert sorted((r["s"]["a"], r["s"]["b"]) for r in tables.set_fields(s, "s", a=F.lit(9)).collect() if r["s"]["b"]) == [(9, 2)]
    jobs = spark.createDataFrame([("c", "b"), ("b", "a"), ("a", None)], "job_id string, source_id string")
    assert {tuple(r) for r in tables.job_chain(jobs).collect()} == {("c", "b", "a"), ("b", "a", None), ("a", None, None)}
    shots = spark.createDataFrame([(1, "h1", "u1"), (2, "h1", "u2"), (3, "h3", "u1"), (4, None, "u4")], "at int, h string, u string")
    assert sorted(r["at"] for r in tables.distinct_by_any(shots, "at", "h", "u").collect()) == [1, 4]
    tables.append(rows, f"{tmp_path}/t")
    tables.append(rows, f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 6


def test_extracts(spark):
    long = "word " * 90
    html = f"""<html><head><link rel="stylesheet" href="a.css"><link rel="stylesheet" media="print" href="b.css"><script src="x.js"></script><script async src="y.js"></script></head><body><nav>menu</nav>
<h2>How it works: steps</h2><p>{long}</p><h3>About</h3><p>short</p><div itemscope itemtype="https://schema.org/Product"></div><span class="author-name">Jo</span><time datetime="2024-05-01">May</time></body></html>"""
    crumbs = json.dumps({"@type": "BreadcrumbList", "itemListElement": [{"position": 1, "name": "Home", "item": "/"}, {"position": 3, "name": "A"}, {"position": 2, "name": "B"}]})
    asked = json.dumps({"@type": "FAQPage", "mainEntity": [{"@type": "Question", "name": "What is a spade?"}, {"@type": "Question", "name": "How long do rakes last in the garden?"}]})
    row = spark.createDataFrame([(html, [crumbs, asked], ["What is a spade?", "How long do rakes last in a garden?", "Why?"])], "html string, jsonld array<string>, shown array<string>")
    h, j = F.col("html"), F.col("jsonld")
    got = row.select(extracts.sections(h).alias("s"), extracts.breadcrumbs(j).alias("b"), extracts.matched_questions(extracts.schema_questions(j), F.col("shown")).alias("q"), extracts.render_blocking(h).alias("r"),
                     extracts.formats(h, j).alias("f"), extracts.author_signals(h).alias("a"), extracts.updated_dates(h, F.lit("updated on 3/4/2024")).alias("u"), extracts.main_content(h).alias("m")).first()
    assert [(s["kind"], s["level"], s["n_words"]) for s in got["s"]] == [("step_section", 2, 90)]
    assert got["b"]["names"] == ["Home", "A", "B"] and not got["b"]["sorted"] and got["b"]["complete"]
    assert got["q"]["exact"] == ["What is a spade?"] and got["q"]["similar"] == ["How long do rakes last in the garden?"] and got["q"]["only_schema"] == []
    assert (got["r"]["css"], got["r"]["js"], got["r"]["many"]) == (1, 1, False) and got["f"]["microdata_types"] == ["Product"] and got["a"]["elements"] == 1
    assert got["u"] == ["2024-05-01", "3/4/2024"] and "menu" not in got["m"] and got["m"].startswith("How it works")
    pair = spark.createDataFrame([("a" * 60, "a" * 60), ("x", "y")], "a string, b string").select(extracts.matching_ratio("a", "b").alias("r")).collect()
    assert [r["r"] for r in pair] == [1.0, 1.0]


def test_organizations_and_authors(spark):
    blocks = [json.dumps({"@graph": [{"@type": "LocalBusiness", "@id": "#o", "name": "Acme", "contactPoint": {"telephone": "+1 555"}, "address": {"streetAddress": "1 Road", "addressCountry": "US"}, "geo": {"latitude": "1.5", "longitude": 2},
                                      "sameAs": ["https://a", "https://b"], "map": "m"}, {"@type": "Article", "@id": "#a", "author": {"@id": "#p"}}, {"@type": "Person", "@id": "#p", "name": "Jo Doe"}, {"@type": "Article", "author": "Al"}]}), "{not json"]
    e = entity_audit.entity_table(spark.createDataFrame([("https://x.org/", blocks)], "url string, jsonld array<string>"))
    o = entity_audit.organization_signals(e).first()
    assert (o["name"], o["phone"], o["street"], o["country"], o["latitude"], o["longitude"], o["n_profiles"]) == ("Acme", "+1 555", "1 Road", "US", 1.5, 2.0, 2)
    assert sorted(r["author"] for r in entity_audit.linked_authors(e).collect()) == ["Al", "Jo Doe"]
    assert [r["property"] for r in entity_audit.deprecated_properties(e, extracts.DEPRECATED).collect()] == ["map"]


def test_no_signal_of_the_rules_is_left_out():
    assert not set(UNREAD) & set(rules.SIGNALS)
