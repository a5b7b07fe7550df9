"""Held-out accuracy, recall on planted cases, and brute-force versions of what SQL can't express."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitegauge.llm import queries
from sitegauge.llm.decontaminate import find_leaks
from sitegauge.llm.licenses import TEMPLATES, scan_licenses
from sitegauge.llm.line_quality import LineField
from sitegauge.llm.mixing import TARGETS, mix_to_targets
from sitegauge.llm.quality import isotonic
from sitegauge.llm.secrets import _with_features, default_findings, fit_forest

SMALL, LARGE = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def held_out(spark, query, label, top):
    y = spark.read.parquet(f"{top}/labels.parquet").groupBy("doc_id").agg(F.max(label).alias("y")).filter("y is not null")
    rows = query(spark, top).filter("held_out").join(y, "doc_id").select("score", "predicted", "y").collect()
    return np.array([r["score"] for r in rows]), np.array([r["predicted"] for r in rows]), np.array([r["y"] for r in rows])


def area(score, y):
    pos, neg = score[y == 1], score[y == 0]
    return ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))


def test_quality_on_rows_it_never_saw(spark):
    score, predicted, y = held_out(spark, queries.op6_quality_classifier, "quality", SMALL)
    assert len(y) > 50 and area(score, y) > 0.97 and (predicted == y).mean() > 0.95


def test_toxicity_on_rows_it_never_saw(spark):
    score, predicted, y = held_out(spark, queries.op8_toxicity, "toxic", LARGE)
    print("toxicity: held out", len(y), "toxic", y.sum(), "area", area(score, y), "found", predicted[y == 1].mean(), "false alarms", predicted[y == 0].mean())
    assert area(score, y) > 0.95 and predicted[y == 1].mean() > 0.85 and predicted[y == 0].mean() < 0.03


def test_isotonic_against_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(20):
        score, y = rng.normal(size=9), rng.integers(0, 2, 9).astype(float)
        at, value = isotonic(score, y)
        assert (np.diff(value) >= 0).all() and (np.diff(at) > 0).all()
        ordered = y[np.argsort(score)]
        best = [max(min(ordered[i : j + 1].mean() for j in range(k, 9)) for i in range(k + 1)) for k in range(9)]  # the max-min form of the fit
        assert len(at) == len(np.unique(np.round(best, 9)))


def test_viterbi_against_enumeration():
    rng = np.random.default_rng(4)
    for n in (1, 2, 5, 9):
        field = LineField(rng.normal(size=3), rng.normal(size=(2, 2)))
        x = rng.normal(size=(n, 3))

        def score(path, field=field, x=x):
            return sum(e * s for e, s in zip(x @ field.emit, path, strict=True)) + sum(field.step[a, b] for a, b in itertools.pairwise(path))

        best = max(itertools.product((0, 1), repeat=n), key=score)
        assert field.decode(x, np.array([0, n])).tolist() == list(best)


def test_shares_meet_their_targets(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = queries.op1_mixing(spark, SMALL)
    names = sorted(TARGETS)
    got = out.agg(F.sum("n_tokens").alias("n"), *[F.sum(F.col("n_tokens") * F.col("rate") * F.col(f"p_{n}")).alias(n) for n in names], F.min("rate").alias("least"), F.count("*").alias("rows")).first()
    assert got["rows"] == docs.count() and got["least"] >= 0
    for n in names:
        assert abs(got[n] / got["n"] - TARGETS[n]) < 1e-3
    known = docs.select("doc_id", F.lit("en").alias("domain"))
    with pytest.warns(UserWarning):
        mix_to_targets(docs, known, {"en": 0.5, "none": 0.5})


def test_rates_against_brute_force(spark):
    """Two domains with known posteriors: the rates minimise the same function as plain projected gradient descent does."""
    docs = [(i, " ".join(["der die und"] * (5 + i)) if i % 2 else " ".join(["the of and"] * (5 + i))) for i in range(12)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    known = spark.createDataFrame([(i, "de" if i % 2 else "en") for i in range(12)], "doc_id long, domain string")
    rows = mix_to_targets(frame, known, {"de": 0.9, "en": 0.1}).collect()
    n, p, rate = np.array([r["n_tokens"] for r in rows], float), np.array([[r["p_de"], r["p_en"]] for r in rows]), np.array([r["rate"] for r in rows])
    goal, size = np.array([0.9, 0.1]), n.sum()
    share = (n @ p) / size
    value = lambda r: (((n * r) @ p / size - goal) ** 2 / share).sum()
    r = np.ones(len(n))
    for _ in range(3000):
        r = np.maximum(0, r - 0.5 * (p @ (((n * r) @ p / size - goal) / share)))
    assert value(rate) <= value(r) + 1e-6


def edited(words, every, rng):
    return [f"zz{rng.randrange(10**6)}" if i % every == every // 2 else w for i, w in enumerate(words)] if every else list(words)


def test_license_recall_on_edited_copies(spark):
    """Texts with no word or one in 40 changed are found; with one in 12 changed under 0.8 of the shingles are left, so they are not."""
    rng = random.Random(9)
    say = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    long = {k: v for k, v in TEMPLATES.items() if len(v.split()) >= 60}
    docs, expected = [], {}
    for every in (0, 40, 12):
        for k, v in long.items():
            for _ in range(4):
                expected[len(docs)] = (k, every)
                docs.append((len(docs), f"{say(30)} {' '.join(edited(v.split(), every, rng))} {say(rng.randrange(5, 40))}"))
    docs += [(10_000 + i, say(400)) for i in range(40)]
    found = {(r["doc_id"], r["license"]) for r in scan_licenses(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    recall = lambda every: np.mean([(i, k) in found for i, (k, e) in expected.items() if e == every])
    print("licenses found:", {e: recall(e) for e in (0, 40, 12)})
    assert recall(0) == 1 and recall(40) >= 0.9 and recall(12) == 0
    assert not [f for f in found if f[0] >= 10_000]


def test_license_versions_are_told_apart(spark):
    texts = ["licensed under the GNU General Public License, version 3", "it is licensed under the GNU General Public License, version 2 only", "Licensed under CC BY-SA 4.0", None, ""]
    got = scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["license"]) for r in got} == {(0, "GPL-3.0 notice"), (1, "GPL-2.0 notice"), (2, "CC-BY-SA-4.0 notice")}


def test_forest_on_findings_it_never_saw(spark):
    rows = default_findings(spark, 6000).withColumn("part", F.pmod(F.xxhash64("before", "candidate"), F.lit(2)))
    model = fit_forest(rows.filter("part = 0"))
    judged = model.transform(_with_features(rows.filter("part = 1"))).select("label", "_class").collect()
    y, got = np.array([r["label"] for r in judged]), np.array([r["_class"] for r in judged])
    print("forest: secrets found", got[y == 1].mean(), "others kept", 1 - got[y == 0].mean())
    assert got[y == 1].mean() > 0.95 and got[y == 0].mean() < 0.05


def common(a, b, weight):
    best = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + (weight[x] if x == y else 0))
    return best[-1][-1]


def test_paraphrases_and_clean_documents(spark):
    """Copies with one word in six replaced before the answer are found; documents that share only single words are not."""
    rng = random.Random(5)
    vocabulary = [f"{a}{b}{c}{d}" for a in "bdfgklmnprst" for b in "aeiou" for c in "lmnrst" for d in ("", *"aeiou")]
    say = lambda n: [vocabulary[rng.randrange(len(vocabulary))] for _ in range(n)]
    items = [(i, " ".join(say(18 + i % 40))) for i in range(300)]
    docs = []
    for i, t in items[::3]:
        w = t.split()
        changed = [f"qq{rng.randrange(10**6)}" if k % 6 == 3 and k < len(w) * 2 // 3 else x for k, x in enumerate(w)]
        docs.append((i, " ".join(say(60) + changed + say(60))))
    docs += [(10_000 + i, " ".join(say(300))) for i in range(100)]
    out = find_leaks(spark.createDataFrame(docs, "doc_id long, text string").repartition(8), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {r["doc_id"] for r in out if r["doc_id"] == r["item_id"]}
    print("paraphrases found:", len(found), "of", len(docs) - 100)
    assert len(found) >= 0.9 * (len(docs) - 100) and not [r for r in out if r["doc_id"] >= 10_000]


def test_matches_against_brute_force(spark):
    """Every window of the three widths against every passage, without any filter."""
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(120)]
    say = lambda n: [vocabulary[min(int(rng.paretovariate(0.7)) - 1, rng.randrange(120))] for _ in range(n)]
    items = [(i, " ".join(say(rng.choice((4, 9, 14, 22, 40))))) for i in range(12)]
    docs = []
    for i in range(24):
        w = items[i % 12][1].split()
        for _ in range(i % 5):
            w[rng.randrange(len(w))] = vocabulary[rng.randrange(120)]
        docs.append((i, " ".join(say(25) + w + say(25))))
    df = {v: sum(v in d.split() for _, d in docs) for v in vocabulary}
    weight = {v: float(np.log(1 + len(docs) / max(df[v], 1))) for v in vocabulary}
    want = set()
    for i, text in docs:
        w = text.split()
        for j, item in items:
            p = item.split()
            total = sum(weight[x] for x in p)
            answer = p[-(-2 * len(p) // 3) :]
            width, step = next((b, c) for a, b, c in ((16, 24, 4), (32, 48, 8), (64, 96, 16)) if len(p) <= a)
            for s in sorted({max(min(k * step, len(w) - width), 0) for k in range(max(-(-(len(w) - width) // step), 0) + 1)}):
                part = w[s : s + width]
                share = common(part, p, weight) / total
                sure = share >= (0.999 if len(p) < 8 else 0.85)
                if not sure and share >= 0.6 and len(p) >= 8:
                    sure = common(part, answer, weight) >= 0.6 * sum(weight[x] for x in answer)
                if sure:
                    want.add((i, j))
    out = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in out.collect()} == want and len(want) >= 12
