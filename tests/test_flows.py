"""Sitemap files, rule results with errors, the keyed sink, and page types."""

import gzip
import json
import zlib

import pytest
from pyspark.sql import functions as F

from sitegauge.operators import content, page_types, rule_results
from sitegauge.operators.ai_rules import WEIGHTS, features, page_scores
from sitegauge.sources import sitemaps
from sitegauge.sources.html import page_features
from sitegauge.streaming import sink

URLS = lambda *u: "<urlset xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'>" + "".join(f"<url><loc> {x} </loc></url>" for x in u) + "</urlset>"
INDEX = lambda *u: "<?xml version='1.0'?><sitemapindex>" + "".join(f"<sitemap><loc>{x}</loc></sitemap>" for x in u) + "</sitemapindex>"


def walked(spark, tmp_path, files, roots=("top",), **limits):
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    found = sitemaps.sitemap_files(spark, str(tmp_path), F.regexp_extract("path", "([^/]+)$", 1))
    pages, report = sitemaps.walk(spark.createDataFrame([(r,) for r in roots], "sitemap string"), sitemaps.decoded(found, limits.pop("most_bytes", 1000)), **limits)
    return {r["url"]: (r["sitemap"], r["level"]) for r in pages.collect()}, {r["sitemap"]: tuple(r)[1:] for r in report.collect()}


def test_nested_compressed_sitemaps(spark, tmp_path):
    files = {"top": gzip.compress(INDEX("mid", "flat", "flat", "gone", "bad", "cut", "big", "html", "top").encode()), "mid": zlib.compress(INDEX("leaf", "top").encode()), "flat": ("﻿" + URLS("a", "b", "b&amp;c")).encode(),
             "leaf": gzip.compress(URLS("c").encode()) + gzip.compress(b"<!-- second member -->"), "bad": b"\x1f\x8b\x08\x00 not gzip at all", "cut": gzip.compress(URLS("x").encode())[:-12], "big": gzip.compress(URLS(*["y"] * 3000).encode()), "html": b"<html>no</html>"}
    pages, report = walked(spark, tmp_path, files, depth=None, children=None)
    assert pages == {"a": ("flat", 1), "b": ("flat", 1), "b&c": ("flat", 1), "c": ("leaf", 2)}
    assert report == {"top": (0, "index", 0, 8, 0), "mid": (1, "index", 0, 2, 0), "flat": (1, "urls", 3, 0, 0), "gone": (1, "missing", 0, 0, 0), "bad": (1, "bad_compression", 0, 0, 0), "cut": (1, "cut_short", 0, 0, 0),
                      "big": (1, "too_large", 0, 0, 0), "html": (1, "not_a_sitemap", 0, 0, 0), "leaf": (2, "urls", 1, 0, 0)}


def test_limits_of_the_walk_are_reported(spark, tmp_path):
    files = {"top": INDEX(*[f"s{k}" for k in range(5)]).encode(), "s0": INDEX("deep").encode(), "deep": URLS("d").encode()} | {f"s{k}": URLS(f"u{k}").encode() for k in range(1, 5)}
    pages, report = walked(spark, tmp_path, files, depth=2, children=3)
    assert set(pages) == {"u1", "u2"} and report["top"] == (0, "index", 0, 5, 2) and report["deep"] == (2, "below_depth", 0, 0, 0) and "s4" not in report
    assert walked(spark, tmp_path, files, roots=(), depth=2)[0] == {}


def test_results_keep_errors_and_weights(spark):
    c = F.col
    rules = [rule_results.ScoreRule("a", "x", F.try_divide(c("n"), c("d")), 3.0, 10.0, ((c("n") >= 0, "negative"),)), rule_results.ScoreRule("b", "x", c("s").try_cast("double"), 1.0, 5.0), rule_results.ScoreRule("c", "y", F.lit(2.0), 1.0, 4.0)]
    weights = {"x": 75.0, "y": 25.0}
    rule_results.check(rules, weights)
    rows = [(1, 8, 1, "5"), (2, 8, 0, "5"), (3, -1, 1, "NaN"), (4, 99, 1, "word"), (5, None, 1, None)]
    df, counted = rule_results.observed(rule_results.with_results(spark.createDataFrame(rows, "id int, n int, d int, s string"), rules), rules)
    got = {r["id"]: r for r in rule_results.page_totals(df, weights).collect()}
    assert {k: {e["rule_id"]: e["error"] for e in r["errors"]} for k, r in got.items()} == {
        1: {}, 2: {"a": "no score"}, 3: {"a": "negative", "b": "not a number"}, 4: {"a": "score out of range", "b": "no score"}, 5: {"a": "negative", "b": "no score"}}
    assert got[1]["final_score"] == pytest.approx((80 * 3 + 100) / 4 * 0.75 + 50 * 0.25) and got[2]["final_score"] == pytest.approx(100 / 4 * 0.75 + 12.5) and all(r["valid"] for r in got.values())
    stats = rule_results.statistics(rules, weights, counted)
    assert (stats["pages"], stats["bad_pages"], stats["total_rules"]) == (5, 4, 3)
    assert stats["categories"]["x"] == {"rule_count": 2, "total_weight": 4.0, "rules": {"a": {"failed": 4, "mean": 16.0}, "b": {"failed": 3, "mean": 40.0}}}
    for bad in ([rules[0], rules[0]], [rule_results.ScoreRule("d", "z", F.lit(1))], [rule_results.ScoreRule("d", "x", F.lit(1), 0.0)]):
        with pytest.raises(ValueError):
            rule_results.check(bad, weights)
    with pytest.raises(ValueError):
        rule_results.check(rules, {"x": 75.0, "y": 20.0})


def test_validators_find_each_fault(spark):
    good = ("r", "c", 50.0, 1.0, 10.0, None)
    rows = [good, *[(*good[:k], v, *good[k + 1 :]) for k, v in ((0, None), (1, None), (2, 101.0), (2, -1.0), (2, None), (3, 0.0), (4, 0.0))]]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], f"k int, r {rule_results.RESULT}")
    assert [r["v"] for r in df.orderBy("k").select(rule_results.valid_result(F.col("r")).alias("v")).collect()] == [True] + [False] * 7


def test_catalog_scores_equal_those_of_the_plain_rules(spark):
    html = '<html><body><h1>What is a spade?</h1><p>A spade digs. It digs well.</p><script type="application/ld+json">{"@type":"Organization","name":"A","url":"u","@context":"https://schema.org"}</script></body></html>'
    pages = features(page_features(spark.createDataFrame([(1, "https://a.example/", html), (2, "https://a.example/e", None)], "page_id long, url string, html string")))
    rules = rule_results.catalog()
    rule_results.check(rules, WEIGHTS)
    got = {r["page_id"]: r["final_score"] for r in rule_results.page_totals(rule_results.with_results(pages, rules)).select("page_id", "final_score").collect()}
    assert got == pytest.approx({r["page_id"]: r["final_score"] for r in page_scores(pages).collect()})


SINK = "key long, value int, text string"


def stored(spark, out, state):
    df = spark.createDataFrame([], SINK)
    return sorted((r["key"], r["value"], r["batch"], r["reason"]) if r["key"] is not None else (-1, r["value"], r["batch"], r["reason"]) for r in sink.table(spark, df.schema, out, state).collect())


def test_poisoned_batches_keep_their_good_rows(spark, tmp_path):
    out, checks = str(tmp_path / "out"), {"negative": lambda: F.col("value") >= 0}
    batch = lambda *rows: spark.createDataFrame(rows, SINK)
    first = batch((1, 1, "a"), (2, -5, "b"), (None, 1, "c"), (3, None, "d"), (4, 4, "x"), (4, 4, "x"))
    sink.store(first, 0, out, ("key",), checks)
    good = [(1, 1, 0, None), (4, 4, 0, None)]
    assert stored(spark, out, "good") == good
    dead = [(-1, 1, 0, "no_key"), (2, -5, 0, "negative"), (3, None, 0, "negative"), (4, 4, 0, "repeated_key")]
    assert stored(spark, out, "dead") == dead
    sink.store(batch((1, 9, "again"), (5, 5, "new")), 1, out, ("key",), checks)
    for _ in range(2):  # a batch that is run again changes nothing
        sink.store(first, 0, out, ("key",), checks)
        sink.store(batch((1, 9, "again"), (5, 5, "new")), 1, out, ("key",), checks)
        assert stored(spark, out, "good") == sorted([*good, (5, 5, 1, None)]) and stored(spark, out, "dead") == sorted([*dead, (1, 9, 1, "stored_before")])


def test_sink_of_a_stream_and_its_restart(spark, tmp_path):
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    write = lambda *rows: spark.createDataFrame(rows, SINK).coalesce(1).write.mode("append").parquet(source)
    stream = lambda: sink.sink_stream(spark.readStream.schema(SINK).option("maxFilesPerTrigger", 1).parquet(source), out, check, ("key",), {}).awaitTermination()
    write((1, 1, "a"), (None, 0, "b"))
    stream()
    write((1, 2, "again"), (2, 2, "c"))
    stream()
    stream()
    assert [r[:3] for r in stored(spark, out, "good")] == [(1, 1, 0), (2, 2, 1)] and [r[3] for r in stored(spark, out, "dead")] == ["no_key", "stored_before"]


def typed(spark, *pages):
    rows = [(k, f"https://a.example/{k}", html, [json.dumps(b) if not isinstance(b, str) else b for b in blocks]) for k, (html, blocks) in enumerate(pages)]
    df = page_features(content.with_dom(spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string"))).drop("jsonld")
    blocks = spark.createDataFrame([(r[0], r[3]) for r in rows], "page_id long, jsonld array<string>")
    return {r["page_id"]: r for r in page_types.page_types(df.join(blocks, "page_id"), "page_id").collect()}


def test_page_types_of_schema_and_page(spark):
    faq = "<body><div class='faq-list'><h3>Why <b>dig</b>?</h3><p>To plant.</p><ul><li>Or not.</li></ul><h3>Alone?</h3></div><section class=question><h2>How?</h2>text<p>So.</p></section></body>"
    got = typed(spark, ("<title> T </title><body><p rel=author>Jo</p></body>", [{"@type": "BlogPosting", "headline": ""}]), ("<h1>H</h1>", [{"@type": "Article", "author": {"name": "A"}, "publisher": None}]),
                ("<meta name=author content=' Al '><h1>x</h1>", [[{"@type": "NewsArticle"}]]), (faq, [{"@type": "FAQPage"}]), ("", [{"@type": "Service", "provider": "Me", "offers": [1, {"a": 2}]}]), ("", []), ("", ["{bad"]),
                ("", [{"name": "no type"}]), ("", [{"@type": ["Odd", "Dataset"], "license": "L"}, {"@type": "Product"}]), ("<p>Q one? Ans one.</p>", [{"@type": "FAQPage", "mainEntity": {"@type": "Question", "name": "Q one?", "acceptedAnswer": {"text": "Ans  one."}}}]), ("<p>Q one?</p>", [{"@type": "FAQPage", "mainEntity": [{"@type": "Question", "name": "Q one?", "acceptedAnswer": {"text": "not there"}}]}]))
    assert got[0]["properties"] == {"headline": '"T"', "author": '"Jo"'} and got[0]["detected_type"] == "BlogPosting"
    assert got[1]["properties"] == {"headline": '"H"', "author": '{"name":"A"}'} and got[2]["properties"]["author"] == '"Al"'
    assert [tuple(q) for q in got[3]["questions"]] == [("Why dig ?", "To plant. Or not."), ("How?", "So.")] and got[3]["average_answer"] == 2
    assert got[4]["properties"] == {"provider": '{"name":"Me"}', "offers": '[1,{"a":2}]'}
    assert [(got[k]["detected_type"], got[k]["confidence"], got[k]["properties"]) for k in (5, 6, 7)] == [("WebPage", 0.5, {}), ("WebPage", 0.5, {}), ("WebPage", 0.3, {"name": '"no type"'})]
    assert got[8]["detected_type"] == "Product" and got[8]["confidence"] == 1.0 and got[9]["questions_shown"] and got[3]["questions_shown"] and not got[10]["questions_shown"]
