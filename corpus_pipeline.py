"""The corpus pipeline: five stages, each reading what the one before it wrote.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last keep the columns of docs, whatever names those have.  Empty tables give
empty results.  Null and empty texts score like a text without bytes in the
quality stage, are linked with nothing, hold no benchmark item and no secret,
and have no tokens.  Texts are read whole, however long.  Rows that repeat an id
and text become one row in the near-duplicate stage; all other stages judge
every row by itself, so equal texts fare alike.  A null id is a row like others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegauge.llm.common import Scratch, fresh
from sitegauge.llm.decontaminate import keep_clean
from sitegauge.llm.mixing import mix_to_targets
from sitegauge.llm.ngram_join import keep_one_of_each
from sitegauge.llm.quality import keep_quality
from sitegauge.llm.secrets import redact_secrets

TARGETS = {"en": 0.45, "de": 0.2, "fr": 0.2, "es": 0.15}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return keep_quality(docs, _table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word Jaccard similarity of 0.8: that of the smallest id."""
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return keep_clean(docs, _table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark."""
    return redact_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """-> doc_id, lang, source, n_tokens, p_<language>, rate, copies: the documents of the mixture and how often each is taken.

    copies is the rate, rounded up or down by a hash of id and text, so that its
    mean is the rate; documents with no copies are left out.  Of labelled rows
    the language is the domain; without any, every document belongs to all alike."""
    key, draw = fresh(docs, "id", "draw")
    ids = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias(key)).distinct()
    labelled = docs.join(ids, F.col("doc_id") == F.col(key)).select("doc_id", F.col("lang").alias("domain"))
    docs = docs.withColumn(draw, F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) / (1 << 20))
    out = mix_to_targets(docs, labelled, TARGETS, ("lang", "source", draw))
    return out.withColumn("copies", F.floor(F.col("rate") + F.col(draw)).cast("long")).drop(draw).filter("copies > 0")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secrets),
    ("mixing sources to target weights", mixing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table documents, each written and reread but the last."""
    scratch, docs = Scratch(spark), _table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.save(docs, f"stage{k}")
            scratch.drop(f"stage{k - 1}")
    return docs
