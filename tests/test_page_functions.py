"""Snippet, language and branding signals, schema checks, and small page functions."""

import json

import pytest
from pyspark.sql import functions as F

from sitegauge.functions import pages
from sitegauge.operators import content, page_types
from sitegauge.operators.schema_repair import entity_graph


def one(spark, value, **columns):
    return spark.createDataFrame([tuple(v for v, _ in columns.values())], ", ".join(f"{k} {t}" for k, (_, t) in columns.items())).select(value.alias("v")).first()["v"]


def test_snippets(spark):
    lists = "".join(f"<ul>{'<li>item ' + '<b>x</b>' * 60 + '</li>'}{'<li>y</li>' * 12}</ul>" for _ in range(3))
    html = f"""<html lang="de"><body><h1>How to dig</h1><h2>Spade</h2><b>no block</b><p>A tool that digs holes in the ground.</p><h2>Rake</h2><div>x</div><p>A tool of teeth that gathers leaves.</p><h2>Hoe</h2><p>Short.</p><h3>Isolated</h3><h3>Really?</h3>
    {lists}<table><tr><th>a</th></tr>{"<tr></tr>" * 7}</table><table><tr><td>b</td></tr></table><p lang="fr">é</p></body></html>"""
    df = content.with_dom(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")).orderBy("page_id")
    s, empty = (r["s"] for r in df.select(content.snippet_signals(F.col("dom")).alias("s")).collect())
    assert (s["blocks"], s["top"]) == (15, 4) and [(x["kind"], x["place"], x["items"]) for x in s["lists"]] == [("ul", k, 10) for k in range(3)]
    assert s["lists"][0]["shown"][0] == "item" + "x" * 46 and s["lists"][0]["shown"][1:] == ["y", "y"]
    assert [(t["rows"], t["headers"]) for t in s["tables"]] == [(5, True), (1, False)]
    assert [tuple(d) for d in s["definitions"]] == [("Spade", "A tool that digs holes in the ground.")] and [q["text"] for q in s["questions"]] == ["How to dig", "Really?"]
    assert empty["blocks"] == 0 and empty["lists"] == empty["tables"] == empty["definitions"] == empty["questions"] == []
    lang, none = (r["s"] for r in df.select(content.language_signals(F.col("dom")).alias("s")).collect())
    assert lang["html_lang"] == "de" and [tuple(x) for x in lang["langs"]] == [("html", "de"), ("p", "fr")] and lang["non_ascii"] == 1 and lang["paragraphs"] == 4 and none["chars"] == 0 and none["non_ascii_percent"] == 0


def test_branding(spark):
    df = content.with_dom(spark.createDataFrame([('<link rel="apple-touch-icon" sizes="60x60" href="/i.png"><link rel="icon" href="/f.ico"><link rel="x apple-touch-icon">',)], "html string")).withColumn("metas", F.create_map(F.lit("theme-color"), F.array(F.lit("#fff"))))
    got = df.select(content.branding(F.col("dom"), F.col("metas")).alias("b")).first()["b"]
    assert got["theme_color"] == "#fff" and [tuple(i) for i in got["apple_icons"]] == [("60x60", "/i.png"), (None, None)]


def test_schema_checks(spark):
    graph = [{"@type": "BreadcrumbList", "itemListElement": [1, 2]}, {"@type": "BreadcrumbList"}, {"@type": "BlogPosting", "headline": "h", "author": ""}, {"@type": "FAQPage", "mainEntity": {"@type": "Question"}}, {"@type": "HowTo", "step": []},
             {"@type": ["LocalBusiness", "X"], "name": "n", "address": "a", "description": "d"}, {"@type": "DataFeed"}, {"@type": "Odd"}, {"name": "none"}]
    got = one(spark, page_types.schema_checks(entity_graph(F.array("j"))), j=(json.dumps(graph), "string"))
    assert [(c["type"], c["valid"], c["missing"], c["members"]) for c in got] == [
        ("BreadcrumbList", True, [], 2), ("BreadcrumbList", False, ["itemListElement"], 0), ("BlogPosting", False, ["author", "datePublished"], None), ("FAQPage", True, [], 0), ("HowTo", False, ["step"], 0), ("LocalBusiness", True, [], None),
        ("DataFeed", False, [], None), ("Odd", True, [], None), ("Unknown", True, [], None)]
    assert [c["retired"] for c in got] == [False] * 6 + [True, False, False]


@pytest.mark.parametrize("given,want", [((" Spade ", "rake", "hoe", "H"), "spade"), (("ab", "Rake", None, None), "rake"), ((None, None, " Hoe , x", "H1 text"), "hoe"), ((None, "", "x", "Best Spades"), "best spades"), ((None, None, None, "Spades | Shop"), None),
                                        ((None, None, None, "a b c d e f"), None), ((None, None, None, "shop.example.com"), None), ((None, None, None, "x" * 41), None), ((None, None, None, "ab"), None), ((None, None, None, None), None)])
def test_keyword_priority(spark, given, want):
    names = ("t", "p", "m", "h")
    assert one(spark, pages.chosen_keyword(*[F.col(n) for n in names]), **{n: (v, "string") for n, v in zip(names, given, strict=True)}, z=(1, "int")) == want


def test_which_pages_count(spark):
    rows = [("SUCCESS", 200, None, True), ("SUCCESS", 299, "index, follow", True), ("SUCCESS", 300, None, False), ("FAILED", 200, None, False), ("SUCCESS", 200, "NoIndex, nofollow", False), (None, 200, None, False), ("SUCCESS", None, None, False)]
    df = spark.createDataFrame(rows, "s string, h int, r string, want boolean")
    assert all(r["got"] == r["want"] for r in df.select(pages.counts_for_score(F.col("s"), F.col("h"), F.col("r")).alias("got"), "want").collect())
    urls = {"https://a.example/x.PDF?y=1": False, "https://a.example/x.html": True, "https://a.example/pdf": True, "https://a.example/a.svg#t": False, None: True}
    df = spark.createDataFrame([(u, w) for u, w in urls.items()], "u string, want boolean")
    assert all(r["got"] == r["want"] for r in df.select(pages.gets_screenshot(F.col("u")).alias("got"), "want").collect())


def test_loose_lengths(spark):
    cases = [([1, 2, 3, 4], 4), ([], 0), (5, 5), (5.9, 5), ("10", 10), (" -3 ", -3), ("abc", 0), (None, 0), ({}, 0), ({"a": 1}, 0), (True, 0), ("1.5", 0), (10**12, 10**12), (10**30, 0)]
    df = spark.createDataFrame([(k, json.dumps(v)) for k, (v, _) in enumerate(cases)], "k int, j string")
    got = [r["v"] for r in df.orderBy("k").select(pages.loose_length(F.col("j")).alias("v")).collect()]
    assert got == [w for _, w in cases] and one(spark, pages.loose_length(F.col("x")), x=(None, "string"), y=(1, "int")) == 0


def test_record_scores(spark):
    all_of = [F.lit("t"), F.lit("d"), F.lit("c"), F.lit(1), F.lit(1), F.lit(2), F.lit(True), F.lit(False)]
    got = one(spark, pages.record_scores(*all_of, answer_engine=F.lit(50.0)), x=(1, "int"))
    assert (got["metadata"], got["structured_data"], got["answer_engine"], got["overall"]) == (100.0, 80.0, 50.0, 31.0)
    with pytest.raises(ValueError):
        pages.record_scores(*all_of, unknown=F.lit(1.0))
