"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Statistics of a whole text (docstats.STATISTICS) are standardised and mapped to
FEATURES cosines whose inner products approximate a Gaussian kernel.  Each
partition of the labelled sample sums Z'Z and Z'y; Spark adds the sums, and the
driver solves one FEATURES x FEATURES ridge system.  Pool-adjacent-violators on
the scores of the rows that the ridge fit left out (one in four, by hash of the
id; all rows if those lack a class) gives the calibration, interpolated between blocks.

Fitted on at most SAMPLE labelled rows; every document is scored.  Results: one
row per document row; null and empty texts score like a text without bytes; a
null id counts as not held out.  Without two classes in the sample every score
is 0.5, and a score of exactly 0.5 counts as good.  Equal texts score alike,
however often they stand; texts are read whole, however long.  Other columns of
the input, whatever their names, are ignored, or kept by keep_quality.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_rows, fold, labelled_sample, small_batches
from .docstats import STATISTICS, statistics
from .words import text_buffer

SAMPLE, FEATURES, RIDGE, SEED = 12_000, 192, 1e-3, 20_25


def isotonic(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (score, probability) of the pool-adjacent-violators fit."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum of labels, of weights, of scores
    for s, y in zip(score[order], label[order], strict=True):
        blocks.append([y, 1.0, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            y2, w2, s2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + y2, blocks[-1][1] + w2, blocks[-1][2] + s2]
    return np.array([b[2] / b[1] for b in blocks]), np.array([(b[0] + 0.5) / (b[1] + 1) for b in blocks])


@dataclass
class QualityModel:
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    phase: np.ndarray
    beta: np.ndarray
    knots: tuple[np.ndarray, np.ndarray]

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -6, 6)
        return np.column_stack([np.ones(len(x)), np.cos(z @ self.weights + self.phase) * np.sqrt(2 / len(self.phase))])

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.beta):
            return np.full(len(x), 0.5)
        return np.clip(np.interp(self.features(x) @ self.beta, *self.knots), 0, 1)


def _statistics(batches):
    schema = pa.schema([("label", pa.float64()), ("back", pa.bool_()), ("x", pa.list_(pa.float64()))])
    for batch in batches:
        yield arrow_rows(schema, label=batch.column("label").cast(pa.float64()), back=batch.column("back"), x=list(statistics(*text_buffer(batch.column("text")))))


def _sums(batches, model: QualityModel):
    """One row for each row of the partition's sum of [Z y]'[Z y]."""
    total = None
    for batch in batches:
        x = np.array(batch.column("x").to_pylist()).reshape(-1, len(STATISTICS))
        z = np.column_stack([model.features(x), batch.column("label").to_numpy(zero_copy_only=False)])
        total = z.T @ z if total is None else total + z.T @ z
    if total is not None:
        yield arrow_rows(pa.schema([("i", pa.int32()), ("v", pa.list_(pa.float64()))]), i=np.arange(len(total)), v=list(total))


def fit_quality(docs: DataFrame, labels: DataFrame, train: Column, bound: int = SAMPLE) -> QualityModel:
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    chosen = labelled_sample(docs, labels, "quality", train, bound).withColumn("back", F.pmod(F.xxhash64("doc_id", F.lit("back")), F.lit(4)) == 0)
    sample = scratch.save(chosen.mapInArrow(_statistics, "label double, back boolean, x array<double>"), "sample")
    d = len(STATISTICS)
    got = sample.select(F.posexplode("x").alias("i", "v"), "label").groupBy("i").agg(
        F.avg("v").alias("m"), F.stddev_pop("v").alias("s"), F.avg("label").alias("y")).collect()
    draw = np.random.default_rng(SEED)
    model = QualityModel(np.zeros(d), np.ones(d), draw.normal(size=(d, FEATURES)) * np.sqrt(1 / d), draw.uniform(0, 2 * np.pi, FEATURES), np.zeros(0), (np.zeros(1), np.full(1, 0.5)))
    if not got or not 0 < got[0]["y"] < 1:
        return model
    for r in got:
        model.centre[r["i"]], model.scale[r["i"]] = r["m"], max(r["s"], 1e-3)
    if sample.filter("back").select("label").distinct().count() == 2 and sample.filter("not back").select("label").distinct().count() == 2:
        fitted, held_back = sample.filter("not back"), sample.filter("back")
    else:
        fitted = held_back = sample
    sums = fitted.select("label", "x").mapInArrow(partial(_sums, model=model), "i int, v array<double>").select(
        "i", F.posexplode("v").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "v")))["v"].alias("v")).collect()
    total = np.zeros((FEATURES + 2, FEATURES + 2))
    for r in sums:
        total[r["i"]] = r["v"]
    gram, right = total[:-1, :-1], total[:-1, -1]
    model.beta = np.linalg.solve(gram + RIDGE * gram[0, 0] / FEATURES * np.eye(FEATURES + 1), right)
    own = held_back.select("label", "x").collect()  # at most bound rows of statistics
    scratch.drop("sample")
    model.knots = isotonic(model.features(np.array([r["x"] for r in own])) @ model.beta, np.array([r["label"] for r in own]))
    return model


def _score(batches, model: QualityModel):
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
    for batch in batches:
        yield arrow_rows(schema, doc_id=batch.column("doc_id"), score=model.score(statistics(*text_buffer(batch.column("text")))))


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """-> doc_id, held_out, score, predicted, for every document."""
    model = fit_quality(docs, labels, fold(F.col("_id"), folds) != held)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(partial(_score, model=model), "doc_id long, score double")
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _keep(batches, model: QualityModel, schema: pa.Schema):
    for batch in batches:
        keep = model.score(statistics(*text_buffer(batch.column("text")))) >= 0.5
        yield batch.filter(pa.array(keep))


def keep_quality(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """The documents, all columns, that the classifier doesn't reject."""
    model = fit_quality(docs, labels, fold(F.col("_id"), folds) != held)
    return docs.mapInArrow(partial(_keep, model=model, schema=None), docs.schema)
