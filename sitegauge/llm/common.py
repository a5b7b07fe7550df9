"""Shared pieces of the corpus operators: scratch tables, folds, samples."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import mix


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a local session (tests) gets a folder of its own; a cluster gets an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sitegauge-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until they clash with no column of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        name = f"_{name}"
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


class Scratch:
    """Tables written once and reread, so that a lost executor costs no lineage.

    Tables that a lazy result still reads go when the driver's process ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.names = spark, f"{shared_folder(spark)}/{uuid.uuid4().hex}", set()
        atexit.register(self._end)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        self.names.add(name)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def size(self, name: str) -> int:
        """Bytes of a table's files."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(self.path(name))
            self.names.discard(name)

    def drop_all_but(self, *kept: str) -> None:
        self.drop(*(self.names - set(kept)))

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def _end(self) -> None:
        with contextlib.suppress(Exception):  # the session may have ended before
            self._delete(self.root)


SMALL_BYTES = 8 << 20


def small_side(df: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """A saved table, marked for broadcast if its files hold at most SMALL_BYTES; else shuffled."""
    return F.broadcast(df) if scratch.size(name) <= SMALL_BYTES else df


def small_batches(spark: SparkSession, rows: int = 512, size: str = "4m") -> None:
    """Arrow batches small enough for a Python worker whatever the texts' length.

    Results are lazy, so the session keeps these settings."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, bound: int) -> DataFrame:
    """At most bound labelled training rows (doc_id, text, label), chosen by hash of the id; one row for each id.

    Rows with a null id, text or label are no training rows; of several labels
    for one id the largest counts, of several texts that of the least hash.  The
    ids chosen (bound of them) are broadcast."""
    ids = (
        labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y"))
        .filter(F.col("_id").isNotNull() & F.col("_y").isNotNull())
        .filter(train)
        .groupBy("_id").agg(F.max("_y").alias("_y"))
        .orderBy(F.xxhash64("_id"), "_id").limit(bound)
    )
    rows = docs.filter(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("_id"))
    return rows.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("_y").alias("label"))


def arrow_rows(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


FILTER_BITS = 1 << 23


def slot_bitmap(values: DataFrame) -> np.ndarray:
    """A bitmap of fixed size (1 MB) that marks the hash slot of each value of column v (long)."""

    def slots(batches):
        bits = np.zeros(FILTER_BITS >> 6, np.uint64)
        for batch in batches:
            slot = mix(batch.column("v").drop_null().to_numpy().view(np.uint64)) % np.uint64(FILTER_BITS)
            np.bitwise_or.at(bits, slot >> np.uint64(6), np.uint64(1) << (slot & np.uint64(63)))
        at = np.flatnonzero(bits)
        yield arrow_rows(pa.schema([("word", pa.int64()), ("mask", pa.int64())]), word=at, mask=bits[at].view(np.int64))

    bits = np.zeros(FILTER_BITS >> 6, np.uint64)
    words = values.mapInArrow(slots, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask"))
    for r in words.groupBy(F.shiftright("word", 11)).agg(F.collect_list("word").alias("word"), F.collect_list("mask").alias("mask")).collect():
        bits[np.array(r["word"])] = np.array(r["mask"], np.int64).view(np.uint64)
    return bits


def in_bitmap(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether the bitmap marks each value's slot; true for all values it was made from."""
    slot = mix(values) % np.uint64(FILTER_BITS)
    return ((bits[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1)).astype(bool)


def grows(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: sorted and merged where the keys meet, whatever its size, so that it never passes through the driver."""
    return df.hint("merge")


def components(edges: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    edges: (a, b), longs.  -> (node, root), root the smallest id of the
    component, one row for each node that is not itself the root.  Each step is
    a minimum per node, with partial sums, and a join back; the edges of one
    node, two longs each, meet in one task of that join.  Every edge is kept
    from its larger end a to its smaller end b.  Edges that are stars already
    are the result: no step is taken to see that it changes nothing."""
    e = scratch.save(edges.filter("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{tag}0")
    step = 0
    while not _stars(e):
        low = _ends(e).groupBy("node").agg(F.least("node", F.min("other")).alias("m"))
        # dealt by a once, for the minimum and for the join
        large = e.select(F.col("b").alias("node"), "a").join(grows(low), "node").select("a", F.col("m").alias("b")).repartition("a")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(grows(low), "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()
        step += 1
        e = scratch.save(small, f"{tag}{step}")
        scratch.drop(f"{tag}{step - 1}")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _ends(e: DataFrame) -> DataFrame:
    """(node, other): each edge from both of its ends."""
    end = lambda x, y: F.struct(F.col(x).alias("node"), F.col(y).alias("other"))
    return e.select(F.explode(F.array(end("a", "b"), end("b", "a"))).alias("end")).select("end.*")


def _stars(e: DataFrame) -> bool:
    """Whether every node a, above its b, has one edge and is no other's b."""
    below = F.col("other") < F.col("node")
    nodes = _ends(e).groupBy("node").agg(F.count("*").alias("n"), F.max(below).alias("below"))
    return not nodes.filter("below and n > 1").agg(F.count("*")).first()[0]
