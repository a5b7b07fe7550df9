"""Stages and operators on clashing column names, long texts, ties, repeats and empty tables."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sitegauge.llm import queries
from sitegauge.llm.common import shared_folder
from sitegauge.llm.ngram_join import keep_one_of_each

A = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
B = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
CLASH = "doc_id long, text string, lang string, source string, n_chars long, _id string, _h string, _s string, _nos string, _draw string, _key string, id string, h string, count long, rate string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *"abcdefgh", 1, "r") for i, t in rows], CLASH)


@pytest.fixture(scope="module")
def top(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("edges"))
    labels = [(i, i % 2, i % 2) for i in range(6)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "never seen words of a benchmark item here")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


ROWS = [(0, A), (1, B + ' password = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"'), (2, A), (2, A), (None, A), (None, None), (3, ""), (3, B), (4, "word " * 40_000), (5, A + " " + B)]


def test_stages_keep_columns_whatever_their_names(spark, top):
    docs = frame(spark, ROWS)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, top)
        assert out.columns == docs.columns, name
        assert all(r["_id"] == "a" and r["_h"] == "b" and r["_nos"] == "d" for r in out.collect()), name
    mixed = corpus_pipeline.mixing(spark, docs, top)
    assert {"doc_id", "lang", "source", "n_tokens", "rate", "copies"} <= set(mixed.columns) and mixed.filter("copies <= 0").count() == 0


def test_stages_on_empty_tables(spark, top):
    empty = frame(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, top).count() == 0, name


def test_one_of_each_group_stays(spark):
    kept = sorted(((r["doc_id"], r["text"]) for r in keep_one_of_each(frame(spark, ROWS)).select("doc_id", "text").collect()), key=str)
    want = [(0, A), ROWS[1], (3, ""), (3, B), (4, "word " * 40_000), (5, A + " " + B), (None, None)]
    assert kept == sorted(want, key=str)


def test_redaction_reaches_every_copy(spark):
    secret = 'token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b" '
    docs = frame(spark, [(i % 3, secret + A) for i in range(60)] + [(7, A)])
    out = corpus_pipeline.secrets(spark, docs, "").collect()
    assert len(out) == 61 and not any("9f86" in r["text"] for r in out) and all(r["n_chars"] == len(r["text"]) for r in out)


@pytest.mark.parametrize("name", ["op2_ngram_jaccard_join", "op3_quality_rules", "op4_suffix_dedup", "op5_token_counts", "op7_decontamination", "op9_license_scan", "op10_secret_scan"])
def test_a_long_text(spark, top, tmp_path, name):
    long = " ".join(f"w{i * 7919 % 100_003}x{i % 97}" for i in range(250_000))
    spark.createDataFrame([(1, long), (2, A), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{top}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    out = queries.QUERIES[name](spark, str(tmp_path))
    got = out.collect()
    if name in ("op2_ngram_jaccard_join", "op3_quality_rules", "op4_suffix_dedup", "op5_token_counts"):
        assert sorted(r["doc_id"] for r in got) == [1, 2, 3]


def test_a_cluster_must_name_its_folder():
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError):
        shared_folder(session)


def test_ids_are_no_inputs(spark, top):
    """The same texts under other ids, sources and languages score alike."""
    docs = [(i, t) for i, t in enumerate([A, B, A + B, "x", ""])]
    one = spark.createDataFrame(docs, "doc_id long, text string")
    score = lambda d: {r["text"]: r["score"] for r in queries.quality_scores(d, spark.read.parquet(f"{top}/labels.parquet")).join(d, "doc_id").collect()}
    base = score(one)
    assert set(base) == {t for _, t in docs} and all(0 <= v <= 1 for v in base.values())
    assert one.filter(F.col("doc_id") >= 0).count() == 5
