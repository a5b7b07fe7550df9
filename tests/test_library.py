"""Rules, scores, URLs, graph, keyed tables, entities and keywords on small fixtures."""

import json
import math

import pytest
from pyspark.sql import functions as F

from sitegauge.functions import scores, text, urls
from sitegauge.operators import ai_rules, entities, graph, keywords, rules, tables
from sitegauge.plans import page_analysis
from sitegauge.sources.html import page_features, parse_pages
from sitegauge.sources.tables import CANDIDATES, resolve_columns

ORG = {"@context": "https://schema.org", "@graph": [{"@type": "Organization", "@id": "https://x.example/#org", "name": "X", "url": "https://x.example/", "sameAs": ["a", "b", "c"]},
                                                   {"@type": ["Person"], "@id": "#p", "name": "Ann Lee", "worksFor": {"@id": "https://x.example/#org"}}]}
HTML = f"""<!DOCTYPE html><html lang="en"><head><title>A good &amp; plain title for the start page</title><meta name="Description" content="short">
<link rel="canonical" href="https://x.example/"><script type="application/ld+json">{json.dumps(ORG)}</script><style>p{{}}</style></head>
<body><h1>One</h1><h3>Skipped</h3><a href="/a">a</a><a href='mailto:x@y.example'>m</a><img src="i.png" alt=""><p>Some <b>text here</body></html>"""


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.fixture()
def page(spark):
    return spark.createDataFrame([(1, "https://x.example/", HTML), (2, "http://x.example/admin", None)], "page_id long, url string, html string")


def test_features_by_patterns_and_by_parser_agree(page):
    a, b = (sorted(map(str, f(page).select("page_id", "title", "html_lang", "canonical", "links", "headings", "images", "jsonld", "text").collect())) for f in (page_features, parse_pages))
    assert a == b


def test_content_rules(page):
    got = {(r["page_id"], r["rule_id"]) for r in page_analysis.page_issues(page).collect()}
    assert {x for i, x in got if i == 1} == {"meta_description_too_short", "heading_hierarchy_skipped", "thin_content"}
    assert {"title_missing", "h1_missing", "https_not_enforced", "canonical_tag_errors", "noindex_on_admin_pages"} <= {x for i, x in got if i == 2}


def test_scores_of_both_plans_agree(page):
    f = page_features(page)
    one_pass = page_analysis.page_scores(page).orderBy("page_id").collect()
    joined = page_analysis.scored_pages(f, rules.evaluate(f, rules.content_rules())).orderBy("page_id").collect()
    assert [r.asDict() for r in one_pass] == [r.asDict() for r in joined]


@pytest.mark.parametrize("high,medium,low,n,want", [(0, 0, 0, 300, 100.0), (1, 0, 0, 300, 100 - 15 * math.log(4)), (10**6, 0, 0, 0, 25.0), (0, 0, 1, 600, 100 - 15 * math.log1p(0.5))])
def test_page_score(spark, high, medium, low, n, want):
    assert one(spark, scores.page_score(*[F.lit(float(x)) for x in (high, medium, low, n)])) == pytest.approx(want)


def test_severity_names(spark):
    assert [one(spark, scores.severity(F.lit(s))) for s in ("Critical", "warn", "info", None)] == ["high", "medium", "low", "low"]


@pytest.mark.parametrize("url,want", [("http://WWW.X.example/a/?utm_source=1&b=2#f", "https://www.x.example/a?b=2"), ("https://x.example", "https://x.example/"), ("https://x.example/p%20q?flag", "https://x.example/p q")])
def test_normalize_url(spark, url, want):
    assert one(spark, urls.normalize_url(F.lit(url))) == want


def test_links_and_text(spark):
    base = F.lit("https://x.example/a/b.html")
    assert [one(spark, urls.resolve_link(base, F.lit(h))) for h in ("c", "/d", "//e.example/f", "http://g.example/")] == ["https://x.example/a/c", "https://x.example/d", "https://e.example/f", "http://g.example/"]
    assert one(spark, text.jaccard(F.lit("a b c"), F.lit("b c D"))) == 0.5
    assert one(spark, text.jaccard(F.lit(None).cast("string"), F.lit(""))) == 0.0


def test_crawl_graph(spark, tmp_path):
    rows = [("https://x.example/", ["/a", "/a", "https://o.example/"]), ("https://x.example/a", ["/b", "/a"]), ("https://x.example/b", ["/"]), ("https://x.example/lost", [])]
    got = {r["url"][18:]: r for r in graph.crawl_graph(spark.createDataFrame(rows, "url string, links array<string>"), f"file://{tmp_path}").collect()}
    assert {k: r["click_depth"] for k, r in got.items()} == {"": 0, "a": 1, "b": 2, "lost": -1}
    by = {r["url"]: r for r in got.values()}
    assert (by["https://x.example/a"]["inbound_links"], by["https://x.example/"]["outbound_links"], by["https://x.example/lost"]["is_orphan"]) == (3, 3, True)


def test_upsert_and_replace(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, created_at int")
    c = spark.createDataFrame([(2, "B", 9), (3, "C", 9)], "k int, v string, created_at int")
    assert sorted(map(tuple, tables.upsert(t, c, ["k"]).collect())) == [(1, "a", 1), (2, "B", 1), (3, "C", 9)]
    assert sorted(map(tuple, tables.replace_by_key(t, c, ["k"]).collect())) == [(1, "a", 1), (2, "B", 9), (3, "C", 9)]
    assert sorted(map(tuple, tables.update_members(t, c, "k", v=F.lit("z")).select("k", "v").collect())) == [(1, "a"), (2, "z")]


def test_entities(page):
    rows = entities.entity_rows(page_features(page)).collect()
    assert [(r["@type"], r["name"]) for r in rows] == [("Organization", "X"), ('["Person"]', "Ann Lee")]
    edges = entities.reference_edges(page_features(page)).collect()
    assert [(r["property"], r["scope"]) for r in edges] == [("worksFor", "internal")]
    assert [r["target"] for r in entities.orphan_entities(page_features(page)).collect()] == ["#p"]


def test_ai_scores(page):
    got = {r["rule_id"]: r["score"] for r in ai_rules.rule_scores(ai_rules.features(page_features(page))).filter("page_id = 1").collect()}
    assert set(got) == set(ai_rules.rules())
    assert got["primary_organization_schema"] == 100.0 and got["sameas_array_links_active"] == 100.0 and got["event_schema"] == 0.0


def test_keywords(spark):
    body = json.dumps({"tasks": [{"status_code": 20000, "result": [{"items": [{"keyword": "Buy shoes", "search_volume": 10}, {"keyword_data": {"keyword": "buy SHOES"}}, {"keyword_data": {"keyword": "how", "keyword_info": {"search_volume": 7}}}]}]},
                                 {"status_code": 40000, "result": [{"items": [{"keyword": "no"}]}]}]})
    got = sorted(map(tuple, keywords.keyword_records(spark.createDataFrame([(body,)], "body string")).select("keyword", "search_volume", "intent").collect()))
    assert got == [("Buy shoes", 10, "commercial"), ("how", 7, "informational")]


def test_catalog_rejects_repeats_and_missing_columns(spark):
    with pytest.raises(ValueError):
        rules.check_catalog(rules.content_rules() * 2)
    with pytest.raises(ValueError):
        resolve_columns(spark.range(1), url=CANDIDATES["url"])


def test_parser_leaves_references_without_semicolon(spark):
    html = '<html lang="en"><title>Cut off &amp</title><body><p>A &copy 1 &amp; B&C &#39;d&#39; &#65 &lt</p><script type="application/ld+json">{"a": "x&y &amp z"}</script><a href="/x?a=1&amp=2">t</a></body></html>'
    page = spark.createDataFrame([(1, "https://a.example/", html)], "page_id long, url string, html string")
    a, b = (f(page).select("title", "text", "links", "jsonld").first() for f in (page_features, parse_pages))
    assert a == b and b["title"] == "Cut off &amp" and b["text"].endswith("A &copy 1 & B&C 'd' &#65 &lt t") and b["jsonld"] == ['{"a": "x&y &amp z"}']
