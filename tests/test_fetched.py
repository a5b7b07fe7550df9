"""Fetched answers, robots files and browser findings, and the rules that read them."""

import random

import pytest
from pyspark.sql import functions as F

from sitegauge.operators import fetched
from sitegauge.plans.page_analysis import full_analysis
from sitegauge.sources.scratch import shared_folder

ANSWERS = "url string, at int, status int, timed_out boolean, bytes long, location string"
SITE = "https://a.example"
HTML = """<html><head><script src="/js/app.js"></script><link rel="stylesheet" href="/css/x.css"><script src="https://cdn.example/js/app.js"></script></head><body><p>text</p><a href="/gone">gone</a><a href="/gone">again</a><a href="moved">m</a><a href="#x">x</a>
<a href="/late">late</a><a href="/unknown">u</a><img src="/big.jpg" alt="b"><img src="broken.jpg" alt="c"></body></html>"""


@pytest.fixture(scope="module")
def found(spark):
    pages = spark.createDataFrame([(1, SITE + "/p/", HTML), (2, SITE + "/loop", "<p>x</p>"), (3, SITE + "/private/a", None), (4, "https://b.example/q", HTML), (5, None, "<p>no url</p>")], "page_id long, url string, html string")
    answers = [(SITE + "/p", 1, 200, False, 5, None), (SITE + "/p/", 2, 503, False, 5, None), (SITE + "/gone", 1, 404, False, 0, None), (SITE + "/p/moved", 1, 301, False, 0, "/p"), (SITE + "/late", 1, None, True, None, None), (None, 1, 200, False, 0, None),
               (SITE + "/big.jpg", 1, 200, False, 300_000, None), (SITE + "/p/broken.jpg", 1, 410, False, 10, None), (SITE + "/loop", 1, 302, False, 0, "/loop2"), (SITE + "/loop2", 1, 302, False, 0, "/loop"), (SITE + "/private/a", 1, 404, False, 0, None)]
    robots = [("a.example", "User-agent: *\nDisallow: /\n\nUser-agent: Googlebot\nDisallow: /private\nAllow: /private/ok\nDisallow: /*.css$ # style\nDisallow: /js/\nAllow: /js/open"), ("b.example", "User-agent: *\nDisallow: /q?\nDisallow:")]
    findings = [(SITE + "/p", 1, True, 3), (SITE + "/p", 2, False, 4)]
    rows = full_analysis(pages, shared_folder(spark), spark.createDataFrame(answers, ANSWERS), spark.createDataFrame(robots, "host string, robots string"),
                         spark.createDataFrame(findings, "url string, at int, focus_trap boolean, small_click_targets int")).collect()
    by = {}
    for r in rows:
        by.setdefault((r["page_id"], r["rule_id"]), []).append(r["detected_value"])
    return {k: sorted(v, key=str) for k, v in by.items()}


def test_answers_reach_the_rules(found):
    assert found[1, "broken_links"] == ["3"] and found[1, "5xx_server_error"] == ["503"] and found[1, "links_to_redirecting_urls"] == [SITE + "/p/moved"]
    assert found[1, "broken_images"] == ["broken.jpg"] and found[1, "image_file_size"] == ["/big.jpg"] and (1, "timeout_errors") not in found
    assert (2, "redirect_loop") in found and (2, "redirect_chains") not in found and (3, "custom_404_page") in found and (3, "4xx_error_pages") not in found
    assert not {k for k in found if k[0] in (4, 5) and k[1] in ("broken_links", "5xx_server_error", "redirect_loop", "broken_images")}


def test_robots_and_findings_reach_the_rules(found):
    assert {k[0] for k in found if k[1] == "robots_txt_blocking"} == {3} and found[1, "googlebot_js_rendering_blocked"] == ["2"] and (4, "googlebot_js_rendering_blocked") not in found
    assert found[1, "tap_target_size"] == ["4"] and (1, "keyboard_accessibility") not in found and (2, "tap_target_size") not in found


def test_redirects_against_following_each(spark):
    rng = random.Random(5)
    nodes = [f"https://r.example/{k}" for k in range(120)]
    to = {n: rng.choice([*nodes, None, None]) for n in nodes} | {f"https://r.example/{k}": f"https://r.example/{k + 1}" for k in range(60, 100)} | {nodes[100]: None}
    df = spark.createDataFrame([(n, 1, 301 if t else 200, False, 0, t) for n, t in to.items()], ANSWERS)
    got = {r["key"]: (r["hops"], r["end"], r["loop"]) for r in fetched.redirect_ends(fetched.answers(df)).collect()}
    want = {}
    for n in (n for n, t in to.items() if t):
        at, path = n, []
        while to.get(at) and at not in path:
            path.append(at)
            at = to[at]
        want[n] = (None, None, True) if to.get(at) else (len(path), at, False)
    assert got == want and len([w for w in want.values() if w[2]]) > 3
    none = spark.createDataFrame([(nodes[0], 1, 200, False, 0, None)], ANSWERS)
    assert fetched.redirect_ends(fetched.answers(none)).count() == 0


@pytest.mark.parametrize("path,blocked", [("/", False), ("/private", True), ("/private/ok/x", False), ("/a.css", True), ("/a.css?x=1", False), ("/a(b)", True), ("/ab", False), ("/x?q=1", True)])
def test_robots_patterns(spark, path, blocked):
    rules = [(False, "/private"), (True, "/private/ok"), (False, "/*.css$"), (False, "/a(b)"), (False, "/x?q="), (True, "/x"), (False, "/same"), (True, "/same")]
    array = F.array(*[F.struct(F.lit(a).alias("allow"), fetched._pattern(F.lit(p)).alias("pattern"), F.lit(len(p)).alias("length")) for a, p in rules])
    assert spark.range(1).select(fetched.is_blocked(F.lit(SITE + path), array).alias("b"), fetched.is_blocked(F.lit(SITE + "/same"), array).alias("s")).first()[:] == (blocked, False)
