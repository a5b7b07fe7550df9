from pyspark.sql import functions as F

from sitegauge.operators import presence

SCHEMA = "url string, jsonld array<string>, metas map<string, array<string>>, headings array<struct<level: int, text: string>>, title string, text string"


def _found(spark, **page):
    row = {"url": "https://a.example/", "jsonld": [], "metas": {}, "headings": [], "title": "", "text": ""} | page
    return presence.presence(spark.createDataFrame([tuple(row[n] for n in ("url", "jsonld", "metas", "headings", "title", "text"))], SCHEMA)).first()


def test_last_block_decides_and_lists_of_types_count(spark):
    one = '{"@type": "Organization", "name": "First Shop", "telephone": "555-123-4567", "address": {"streetAddress": "1 A St"}}'
    two = '{"@graph": [{"@type": ["LocalBusiness", "Store"], "name": "Second", "telephone": "5551234567", "address": {"streetAddress": "2 B St", "postalCode": "90001"}, "geo": {"latitude": 12.5, "longitude": "-70"}}]}'
    r = _found(spark, jsonld=[one, two, "not json", '{"@type": "Thing"}'], text="Call (555) 123-4567.", title="first-shop")
    assert (r.name, r.name_source, r.name_consistent) == ("First Shop", "organization", True)
    assert (r.address.shown, r.phone, r.phones, r.phone_consistent, r.lat, r.lng, r.complete) == ("2 B St 90001", "5551234567", ["(555) 123-4567"], True, 12.5, -70.0, True)


def test_name_chain_passes_over_headlines_and_menus(spark):
    bad = '{"@type": "Organization", "name": "Digital Agency", "legalName": "Results Worldwide"}'
    assert _found(spark, jsonld=[bad], metas={"og:site_name": [" Corner "]}).name == "Corner"
    r = _found(spark, jsonld=[bad], headings=[(2, "Bakery"), (1, "Main menu"), (1, "Corner Bakery"), (1, "Third")])
    assert (r.name, r.name_source) == ("Corner Bakery", "heading")
    assert _found(spark, headings=[(1, "home"), (1, "ab"), (1, "Third")]).name is None
    r = _found(spark, metas={"og:site_name": ["Corner"], "application-name": ["Plum Tree"]}, title="Plum-Tree")
    assert (r.name, r.name_consistent) == ("Plum-Tree", False)


def test_null_and_odd_values_give_empty_presence(spark):
    r = _found(spark, jsonld=None, metas=None, headings=None, title=None, text=None)
    assert (r.name, r.address.shown, r.phone, r.phones, r.phone_consistent, r.lat, r.complete) == (None, "", "", [], False, None, False)
    r = _found(spark, jsonld=['{"@type": "Organization", "address": "1 A St", "geo": {"latitude": "north", "longitude": 500}}'], title="T" * 150_000)
    assert (r.name, r.address.shown, r.lat, r.lng) == (None, "", None, None)


def _levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i, *[0] * len(b)]
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1]


def test_settled_equals_brute_force(spark):
    streets = ["12 north main st", "12 n. Main Street", "12 N Mian St", "12 Harbour Avenue", "", None, "12 n main st", "x" * 50_000, "12 north main st"]
    rows = [("a" if i % 4 else None, "b", s) for i in range(12) for s in streets] + [("c", "b", "éé"), ("c", "b", "ee")]
    df = spark.createDataFrame(rows, "site string, block string, street string").withColumn("form", presence.address_form(F.col("street")))
    got = {(r.site, r.form): (r.n, r.majority, r.distance, r.agrees) for r in presence.settled(df, ("site", "block"), "form", "street").collect()}
    forms = {}
    for r in df.collect():
        if r.site and r.form:
            forms.setdefault(r.site, {}).setdefault(r.form, 0)
            forms[r.site][r.form] += 1
    want = {}
    for site, counts in forms.items():
        head = min(counts, key=lambda f: (-counts[f], f))
        for f, n in counts.items():
            d = _levenshtein(f, head) if abs(len(f) - len(head)) <= 3 else 99
            want[site, f] = (n, head, d if d <= 3 else None, d <= 3)
    assert got == want
    assert got["a", "12 n main st"][1] == "12 n main st" and got["a", "12 n mian st"][2:] == (2, True)
    assert presence.settled(df.limit(0), ("site",), "form", "street").count() == 0
