"""The numbered queries on small tables with nulls, empty texts, copies and clashing columns."""

import random
import re

import pytest

import corpus_pipeline
from sitegauge.llm import queries
from sitegauge.llm.decontaminate import find_leaks
from sitegauge.llm.ngram_join import ngram_join
from sitegauge.llm.token_counts import load_vocabulary, token_counts

RNG = random.Random(5)
say = lambda n: " ".join(RNG.choice("alpha beta gamma delta omega sigma kappa theta".split()) + str(RNG.randrange(60)) for _ in range(n))
BASE = say(120)
ITEM = say(30)
TEXTS = [None, "", " \n\t ", "word", BASE, BASE, BASE.replace(BASE.split()[60], "other", 1), BASE.upper(), say(40) + " " + ITEM.upper() + " " + say(40), say(50),
         "Licensed under the MIT License " + say(20), 'password = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b" ' + say(20), "line one here\nline one here\nshort", say(3000)]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, h string, key long, label int, score string"
LABELS = "doc_id long, quality int, toxic int"


def rows():
    out = [(i, t, "en" if i % 2 else "de", "s", len(t or ""), "x", 1, 2, "y") for i, t in enumerate(TEXTS)]
    return out + [out[4], (None, BASE, "en", "s", 1, "x", 1, 2, "y")]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("t")
    labels = [(i, i % 2, (i // 2) % 2) for i in range(len(TEXTS))] + [(3, None, None), (None, 1, 1)]
    for name, docs, known in (("full", rows(), labels), ("empty", [], [])):
        spark.createDataFrame(docs, DOCS).write.parquet(f"{top}/{name}/documents.parquet")
        spark.createDataFrame(known, LABELS).write.parquet(f"{top}/{name}/labels.parquet")
        spark.createDataFrame([(c, c % 2, "user", t) for c, t in enumerate(TEXTS)] if docs else [], "conv_id long, turn int, role string, text string").write.parquet(f"{top}/{name}/conversations.parquet")
        spark.createDataFrame([(7, ITEM), (8, None), (9, "")] if docs else [], "item_id long, text string").write.parquet(f"{top}/{name}/benchmark.parquet")
    return str(top)


PER_ROW = [n for n in queries.QUERIES if n.split("_")[0] in ("op1", "op2", "op3", "op4", "op5", "op6", "op8", "op12")]


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_and_full_tables(spark, tables, name):
    assert queries.QUERIES[name](spark, f"{tables}/empty").count() == 0
    got = queries.QUERIES[name](spark, f"{tables}/full").collect()
    if name in PER_ROW:
        assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows())


def test_jaccard_against_brute_force(spark, tables):
    got = {r["doc_id"]: r for r in ngram_join(spark.read.parquet(f"{tables}/full/documents.parquet"), 4, 85).collect()}
    sets = {}
    for i, t in enumerate(TEXTS):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set()
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items() if i is not None} == {i: (len(s), root[i]) for i, s in sets.items()}


def test_base_rules_against_brute_force(spark, tables):
    for r in queries.op3_quality_rules(spark, f"{tables}/full").filter("doc_id is not null").collect():
        t = TEXTS[r["doc_id"]] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines, seen, dup = t.split("\n"), set(), 0
        for line in lines:
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        hit = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 8)} if len(grams) < 500 else set()
        failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit), failed)
        assert not (failed and r["kept"])


def test_tokens_against_greedy_longest_match(spark, tables):
    opening, continuing = load_vocabulary("/opt/tokenizers/byte_bpe_50k.json")

    def pieces(word):
        at = n = 0
        while at < len(word):
            vocabulary = continuing if at else opening
            at += next(k for k in range(len(word) - at, 0, -1) if word[at : at + k] in vocabulary)
            n += 1
        return n

    for r in token_counts(spark.read.parquet(f"{tables}/full/documents.parquet")).filter("doc_id is not null").collect():
        words = (TEXTS[r["doc_id"]] or "").encode().split()
        assert (r["n_words"], r["n_tokens"]) == (len(words), sum(map(pieces, words)))


def test_leaks_and_findings(spark, tables):
    docs = spark.read.parquet(f"{tables}/full/documents.parquet")
    leaks = find_leaks(docs, spark.read.parquet(f"{tables}/full/benchmark.parquet")).collect()
    assert [(r["doc_id"], r["item_id"], r["share"]) for r in leaks] == [(8, 7, 1.0)]
    assert {r["doc_id"] for r in queries.op9_license_scan(spark, f"{tables}/full").collect()} == {10}
    assert {r["doc_id"] for r in queries.op10_secret_scan(spark, f"{tables}/full").filter("is_secret").collect()} == {11}


def test_pipeline_stages(spark, tables):
    path = f"{tables}/full"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = corpus_pipeline.near_duplicates(spark, docs, path)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i in [*range(5), *range(8, len(TEXTS))])
    assert sorted(str(r["doc_id"]) for r in corpus_pipeline.decontamination(spark, docs, path).collect()) == sorted(str(r[0]) for r in rows() if r[0] != 8)
    texts = {r["doc_id"]: r["text"] for r in corpus_pipeline.secrets(spark, docs, path).collect()}
    assert {i for i, t in enumerate(TEXTS) if texts[i] != t} == {11} and "9f86d0" not in texts[11]
