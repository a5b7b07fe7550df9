"""DOM trees, what operators.content reads from them, and the repair of entity graphs."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sitegauge.operators import content, schema_repair
from sitegauge.plans.page_analysis import full_analysis
from sitegauge.sources.dom import Mark, parse_dom
from sitegauge.sources.scratch import shared_folder

LONG = "Long words of main content repeated. " * 6


def trees(spark, *htmls, **more):
    rows = [(k, "https://a.example/x", h) for k, h in enumerate(htmls)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return parse_dom(df, **more) if more else content.with_dom(df)


def column(df, c):
    return [r["c"] for r in df.orderBy("page_id").select(c.alias("c")).collect()]


def test_tree_numbers(spark):
    html = "<body><p id=a class='x y'>one<br>two<b>three</p>four</i><script>if (a < b) {}</script><!-- no --> five</body>"
    (nodes,) = column(trees(spark, html, marks={"bold": Mark(("b",))}, ranks={"r": ("p b", ".y", "[id]")}), F.col("dom"))
    assert [(n["tag"], n["parent"], n["last"], n["element"]) for n in nodes] == [
        ("body", -1, 10, 0), ("p", 0, 6, 1), ("#text", 1, 2, 2), ("br", 1, 3, 2), ("#text", 1, 4, 3), ("b", 1, 6, 3), ("#text", 5, 6, 4), ("#text", 0, 7, 4), ("script", 0, 9, 4), ("#raw", 8, 9, 5), ("#text", 0, 10, 5)]
    assert nodes[1]["classes"] == ["x", "y"] and nodes[1]["id"] == "a" and nodes[1]["attrs"] == {"id": "a", "class": "x y"}
    assert nodes[0]["chars"] == 3 + 3 + 5 + 4 + 4 and nodes[0]["bold_chars"] == 14 and nodes[5]["bold_chars"] == 0
    assert [n["bold_at"] for n in nodes] == [-1, -1, -1, -1, -1, 5, 5, -1, -1, -1, -1] and [n["r_rank"] for n in nodes[:6]] == [None, 1, None, None, None, 0]


def test_tree_edges(spark):
    df = trees(spark, None, "", "plain", "</p></b>", "<p>" * 3000 + "x", "<div " * 50, "<a href=1 href=2>", "é" * 200_000)
    nodes = column(df, F.col("dom"))
    assert [len(n) for n in nodes[:4]] == [0, 0, 1, 0] and nodes[4][0]["last"] == 3000 and nodes[4][0]["chars"] == 1
    assert nodes[6][0]["attrs"] == {"href": "1"} and nodes[7][0]["chars"] == 200_000
    assert [r["selector"] for r in column(df, content.main_content(F.col("dom")))] == ["none"] * 8


@pytest.mark.parametrize("selector", content.CONTENT)
def test_every_selector_of_main_content(spark, selector):
    """Each selector alone finds its element; of all of them the first in order."""
    steps = selector.split(" ")
    last = steps[-1]
    tag = "div" if last[0] in ".#[" else last.split("[")[0].split(".")[0]
    attrs = " ".join([f'class="{" ".join(c for c in last.split("[")[0].split(".")[1:])}"' if "." in last else "", f'id="{last[1:]}"' if last[0] == "#" else "", last[last.index("[") + 1 : -1] if "[" in last else ""])
    inner = f"<{tag} {attrs}>{LONG}</{tag}>"
    page = f"<html>{inner}</html>" if tag == "body" else f"<body><{steps[0]}>{inner}</{steps[0]}></body>" if len(steps) > 1 else f"<body>{inner}</body>"
    got = column(trees(spark, page), content.main_content(F.col("dom")))[0]
    assert got["selector"] == selector and got["text"] == LONG.strip()


def test_main_content_of_nested_and_noisy_pages(spark):
    two = f"<body><main>{'a ' * 60}</main>between<main><main>{'b ' * 90}</main></main></body>"  # the longest main, its own text alone
    noisy = f"<body><article>{LONG}<nav>go</nav><div class='share'>share</div><form>f</form><p>end</p><script>x</script></article></body>"
    short = f"<body><main>few</main><div class='post-content'>{LONG}</div></body>"
    measured = f"<body><main><aside>{LONG}</aside>few</main><p>{LONG}</p></body>"  # main's own text is short without the aside
    hidden = f"<body><div class='content menu'>{LONG}</div></body>"  # the element that is found is noise itself
    capped = f"<body><main>{'word ' * 3000}</main></body>"
    got = column(trees(spark, two, noisy, short, measured, hidden, capped), content.main_content(F.col("dom")))
    assert got[0]["selector"] == "main" and got[0]["text"] == ("b " * 90).strip()
    assert got[1]["text"] == LONG.strip() + " end" and got[1]["selector"] == "article"
    assert got[2]["selector"] == ".post-content" and got[3]["selector"] == "body" and got[3]["text"] == "few " + LONG.strip()
    assert got[4]["selector"] == ".content" and got[4]["text"] == "" and len(got[5]["text"]) == 5000


def test_clean_content(spark):
    page = f"<body><div id=side>{LONG}</div><div id=big>{LONG}{LONG}<span>tiny</span><p>ok</p><h2>Hi</h2><ul><li><a href='/'>Home</a></li></ul><div class='site-menu'>{LONG}</div><button>press</button></div></body>"
    got = column(trees(spark, page, "<body><main>short</main></body>", None), content.clean_content(F.col("dom")))
    both = (LONG + LONG).strip()
    assert got[0]["container"] == "div" and got[0]["text"] == both + " ok Hi" and got[0]["clean_chars"] == len(both) + 4
    assert got[1]["container"] == "main" and got[1]["text"] == "" and got[1]["reduction"] == 1.0 and got[2]["container"] == "none"


def test_heading_tree_against_a_scan(spark):
    rng = random.Random(3)
    cases = [[(rng.randrange(1, 7), rng.choice(["How to Dig", "ABC", "abc", "What?", "x"])) for _ in range(rng.randrange(12))] for _ in range(60)]
    df = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "page_id long, h array<struct<level: int, text: string>>")
    for heads, tree in zip(cases, column(df, content.heading_tree(F.col("h"))), strict=True):
        for k, (level, text) in enumerate(heads):
            up = next((j for j in range(k - 1, -1, -1) if heads[j][0] < level), None)
            first = next((j for j in range(k) if heads[j][1] == text), None)
            gap = list(range(heads[k - 1][0] + 1, level)) if k else []
            t = tree[k]
            assert (t["place"], t["parent"], t["parent_level"], t["first_at"], t["skipped"]) == (k, up, heads[up][0] if up is not None else None, first, gap)
            assert t["all_caps"] == (text == "ABC") and t["question"] == (text in ("How to Dig", "What?"))
    assert [h["text"] for h in column(trees(spark, "<h2>a <b>b</b></h2><h3> </h3><h1>c</h1>"), content.dom_headings(F.col("dom")))[0]] == ["ab", "c"]


ITEMS = """<body><div itemscope itemtype="https://schema.org/Product" itemid="#p"><span itemprop="name">Pen</span><img itemprop="image photo" src="p.jpg">
<div itemprop="offers" itemscope itemtype="http://schema.org/Offer"><meta itemprop="price" content="3"><a itemprop="url" href="/b">b</a></div><time itemprop="released" datetime="2024">x</time><span itemprop="name">Stift</span></div>
<div vocab="https://schema.org/" typeof="Person"><b property="name">Ann</b></div><div typeof="Lost"><b property="name">Bob</b></div><i itemprop="loose">no item</i></body>"""


def test_items_of_both_formats(spark):
    df = trees(spark, ITEMS, "<p>none</p>")
    got = sorted(content.structured_items(df, "page_id").collect(), key=lambda r: r["item"])
    assert [(r["format"], r["types"], r["id"], r["parent_property"]) for r in got] == [("microdata", ["Product"], "#p", None), ("microdata", ["Offer"], None, "offers"), ("rdfa", ["Person"], None, None)]
    assert got[1]["parent_item"] == got[0]["item"]
    assert got[0]["properties"] == {"name": ["Pen", "Stift"], "image": ["p.jpg"], "photo": ["p.jpg"], "offers": [str(got[1]["item"])], "released": ["2024"]}
    assert got[1]["properties"] == {"price": ["3"], "url": ["/b"]} and got[2]["properties"] == {"name": ["Ann"]}
    formats = column(df, content.dom_formats(F.col("dom"), F.array(F.lit("{}"))))
    assert [(f["jsonld"], f["microdata"], f["rdfa"], f["mixed"], f["microdata_types"]) for f in formats] == [(1, 2, 2, True, ["Product", "Offer"]), (1, 0, 0, False, [])]


def test_microdata_reaches_the_rules(spark):
    block = '<script type="application/ld+json">{"@context": "https://schema.org", "@type": "Product", "name": "Pen"}</script>'
    pages = spark.createDataFrame([(1, "https://a.example/p", "<html>" + block + ITEMS + "</html>"), (2, "https://a.example/q", ITEMS), (3, "https://a.example/r", "<p>none</p>")], "page_id long, url string, html string")
    found = {(r["page_id"], r["rule_id"]): (r["severity"], r["detected_value"]) for r in full_analysis(pages, shared_folder(spark)).collect()}
    assert found[1, "duplicate_schema_formats"] == ("medium", "Product")
    assert found[2, "schema_markup"] == ("high", "Product, Offer") and found[3, "schema_markup"] == ("high", None) and (1, "schema_markup") not in found


def test_media(spark):
    html = """<body><header><img src="/big.jpg" width="900" height="900"></header><figure><img src="/a.jpg" width="400px" height="300" alt="A"><figure><video><source src="v.mp4"><track kind="captions"></video><figcaption>Inner <b>cap</b></figcaption></figure>
<figcaption>Outer</figcaption></figure><img src="/s.gif" width=1 height=1><img src="/x.png" role="presentation" alt="x"><img alt="Our Logo" src="/l.png"><audio src="s.mp3"></audio><img src="/b.jpg" width=300 height=400><a href="/t">Transcript</a></body>"""
    got = {r["src"]: r for r in content.media(trees(spark, html, "<p>no media</p>", None), "page_id").collect()}
    assert {s: r["role"] for s, r in got.items()} == {"/big.jpg": "content", "/a.jpg": "hero", "v.mp4": "video", "/s.gif": "decorative", "/x.png": "decorative", "/l.png": "logo", "s.mp3": "audio", "/b.jpg": "content"}
    assert got["v.mp4"]["caption"] == "Inner cap" and got["/a.jpg"]["caption"] == "Outer" and got["/b.jpg"]["caption"] == "" and got["/big.jpg"]["in_bar"]
    assert got["v.mp4"]["captions"] and not got["v.mp4"]["transcript"] and got["s.mp3"]["transcript"]


def test_trails(spark):
    body = "<p>x</p>" * 30
    pages = ["<body><nav aria-label='Breadcrumb'><a href='/'>Home</a><a href='/s'> Shop </a></nav></body>", f"<body><div class='breadcrumbs'><a href='/'>Home</a> <a href='/s'>Shop</a></div>{body}</body>",
             f"<body><header><ul><li><a href='/q'>q</a></li><li><a href='/r'>r</a></li></ul></header><ul><li><a href='/'>Home</a></li><li><a href='/s'>Shop</a><a href='/n'>no</a></li></ul>{body}</body>",
             f"<body>{body}<div class='breadcrumb'><a href='/'>Home</a><a href='/s'>Shop</a></div></body>", f"<body><ul><li><a href='/'>Home</a></li><li><a href='/'>Shop</a></li></ul>{body}</body>",
             f"<body><div class='breadcrumb'><a href='/'>Main menu</a><a href='/s'>Shop</a></div>{body}</body>"]
    got = column(trees(spark, *pages), content.dom_trail(F.col("dom")))
    assert [t["way"] for t in got] == [1, 2, 3, 0, 0, 0] and all(t["names"] == ["Home", "Shop"] and t["links"] == ["/", "/s"] for t in got[:3])


def test_order_of_trails_against_a_table(spark):
    rng = random.Random(8)
    pairs = [([rng.choice("abcd") for _ in range(rng.randrange(7))], [rng.choice("ABcd") for _ in range(rng.randrange(7))]) for _ in range(150)] + [(None, ["a"]), ([" Home "], ["home"])]

    def lcs(x, y):
        row = [0] * (len(y) + 1)
        for a in x:
            below = [0]
            for j, b in enumerate(y):
                below.append(row[j] + 1 if a == b else max(row[j + 1], below[j]))
            row = below
        return row[-1]

    df = spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(pairs)], "page_id long, x array<string>, y array<string>")
    assert column(df, content.in_order(F.col("x"), F.col("y"))) == [lcs([s.lower().strip() for s in x or []], [s.lower().strip() for s in y]) for x, y in pairs]


ROOT = "https://x.example"


def run_pass(spark, entities, name, url=ROOT + "/p"):
    df = spark.createDataFrame([(url, [json.dumps(entities)])], "url string, jsonld array<string>")
    step = dict(schema_repair.passes(F.col("url"), F.lit(ROOT)))[name]
    graph = df.select(step(schema_repair.entity_graph(F.col("jsonld"))).alias("g")).first()["g"]
    return [{k: json.loads(v) for k, v in e.items()} for e in graph]


def test_consolidation(spark):
    org = {"@type": "Organization", "@id": "#o", "name": "Acme", "sameAs": ["a"], "founder": {"name": "F"}, "count": 3}
    same = {"@type": "LocalBusiness", "name": " Acme ", "telephone": "5", "sameAs": ["b"], "founder": {"born": 1}, "count": 4}
    other = {"@type": "LocalBusiness", "name": "Other", "email": "e", "url": "u", "address": {"addressCountry": "US"}}
    article = {"@type": "Article", "headline": 'say "q" é'}
    got = run_pass(spark, [article, org, same, other, {"@type": "LocalBusiness", "telephone": "9"}], "consolidate")
    assert got == [{"@type": "Organization", "@id": ROOT + "#organization", "name": "Acme", "url": ROOT, "sameAs": ["a", "b"], "founder": {"name": "F", "born": 1}, "count": 3, "telephone": "5", "email": "e",
                    "address": {"addressCountry": "US"}}, article]
    assert run_pass(spark, [article], "consolidate") == [article] and run_pass(spark, [], "consolidate") == []


def test_the_other_passes(spark):
    local, web, product = {"@type": "LocalBusiness", "name": "L"}, {"@type": "WebPage", "name": "W"}, {"@type": "Product", "name": "P"}
    assert run_pass(spark, [local, web], "without_local") == [web] and run_pass(spark, [local, web], "without_local", ROOT + "/") == [local, web]
    assert run_pass(spark, [local, web, product], "with_reference") == [local, web | {"provider": {"@id": ROOT + "#organization"}}, product]
    assert run_pass(spark, [{"@type": "Organization"}, web], "with_reference") == [{"@type": "Organization"}, web] and run_pass(spark, [web | {"provider": "me"}, product], "with_reference") == [web | {"provider": "me"}, product]
    ids = [{"@id": "http://www.x.example/a"}, {"@id": "#b"}, {"@id": ""}, {"@type": "Organization", "@id": "http://y.example/#o"}]
    assert [e["@id"] for e in run_pass(spark, ids, "with_ids")] == ["http://x.example/a", "#b", "", ROOT + "#organization"]
    countries = {"USA": "US", " uk ": "UK", "United States": None, "NY 10007": "NY", "Canada": "CA", "de": "DE", "Germany": None, "": ""}
    got = run_pass(spark, [{"@type": "Place", "address": {"addressCountry": c, "x": 1}} for c in countries], "with_countries")
    assert [e["address"].get("addressCountry") for e in got] == list(countries.values()) and all(e["address"]["x"] == 1 for e in got)
    about, service, post = run_pass(spark, [{"@type": "AboutPage", "description": "d"}, {"@type": "Service", "provider": 1}, {"@type": "BlogPosting"}], "with_needed")
    assert about["description"] == "d" and about["mainEntity"] == {"@id": ROOT + "#organization"} and service == {"@type": "Service", "provider": 1, "serviceType": "Professional Services"}
    assert post["author"] == post["publisher"] == {"@type": "Organization", "@id": ROOT + "#organization"}


def test_copies_are_merged(spark):
    one = {"@type": "PostalAddress", "streetAddress": "1 Road", "addressLocality": "X", "tags": [1]}
    again = {"@type": "PostalAddress", "streetAddress": "1 ROAD ", "addressLocality": "x", "tags": [2], "floor": 2}
    named = [{"@id": "#a", "name": "A"}, {"@id": "#a", "name": "B", "k": None}, {"@type": ["T", "U"], "name": "n"}, {"@type": ["T", "U"], "name": " N "}, {"@type": "ContactPoint", "email": "e"}, {"@type": "ContactPoint", "email": "f"}]
    got = run_pass(spark, [one, *named, again], "without_copies")
    assert got == [one | {"tags": [1, 2], "floor": 2}, {"@id": "#a", "name": "A", "k": None}, named[2], named[4], named[5]]


def test_repair_of_pages(spark):
    rows = [(ROOT + "/p", ['{"@type": "WebPage", "name": "W"}', "{bad"]), (ROOT + "/e", []), (ROOT + "/n", None)]
    got = {r["url"]: r["jsonld_mended"] for r in schema_repair.repaired(spark.createDataFrame(rows, "url string, jsonld array<string>"), F.lit(ROOT)).collect()}
    assert json.loads(got[ROOT + "/p"])["@graph"] == [{"@type": "WebPage", "name": "W", "provider": {"@id": ROOT + "#organization"}}]
    assert json.loads(got[ROOT + "/e"]) == json.loads(got[ROOT + "/n"]) == {"@context": "https://schema.org", "@graph": []}


def test_references_without_a_semicolon_stay_as_the_sql_leaves_them(spark):
    words = " ".join(f"w{k}" for k in range(40))
    html = f'<html lang="a&ltb"><title>cut token = &quot</title><body><article><p>{words} &quot x &lt y &amp z &#60 &quot;q&quot; &amp;</p><p>R&D &co</article></body></html>'
    text = f'{words} &quot x &lt y & z &#60 "q" & R&D &co'
    p = content.with_dom(spark.createDataFrame([(1, html)], "page_id long, html string"))
    r = p.select(content.clean_content(F.col("dom")).alias("c"), content.main_content(F.col("dom")).alias("m"), content.language_signals(F.col("dom")).alias("s")).first()
    assert r["c"]["text"] == r["m"]["text"] == text
    assert (r["s"]["html_lang"], r["s"]["chars"]) == ("a&ltb", len("cut token = &quot " + text))
