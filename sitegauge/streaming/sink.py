"""A keyed sink for streams: each batch is stored once however often it is run, and rows that can't be stored are kept apart.

store(batch, number) writes out/batch=<number>/state=good and state=dead in one
pass, with the reason in `reason`.  Rows fail alone: one bad row leaves the rest
of its batch in place.  A batch that is run again replaces its own folder and
reads only the batches before it, so a restart repeats and loses nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

Checks = dict[str, Callable[[], Column]]


def reason(checks: Checks) -> Column:
    """The name of the first check that a row fails; null if it passes all."""
    return F.coalesce(*[F.when(~F.coalesce(c(), F.lit(False)), F.lit(name)) for name, c in checks.items()], F.lit(None).cast("string"))


def table(spark: SparkSession, schema: StructType, out: str, state: str = "good", before: int | None = None) -> DataFrame:
    """Stored rows of a state (good or dead), of all batches or of those before a number."""
    full = StructType(list(schema.fields)).add("reason", "string").add("batch", "long").add("state", "string")
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], full)
    found = spark.read.schema(full).option("basePath", out).parquet(out).filter(F.col("state") == state)
    return found if before is None else found.filter(F.col("batch") < before)


def store(batch: DataFrame, number: int, out: str, keys: tuple[str, ...], checks: Checks) -> None:
    """Stores a batch.  A row fails a check, lacks a key (no_key), repeats a key of its batch (repeated_key; the first by the row's hash stays) or has the key of an earlier batch (stored_before).

    The table's keys are joined by hash; with AQE a hot key's rows are split, and each key is one row on the stored side."""
    spark = batch.sparkSession
    rows = batch.withColumn("reason", F.coalesce(F.when(F.greatest(*[F.col(k).isNull().cast("int") for k in keys], F.lit(0)) == 1, "no_key"), reason(checks)))
    stored = table(spark, batch.schema, out, before=number).select(*keys).distinct().withColumn("_stored", F.lit(True))
    rows = rows.join(stored, list(keys), "left").withColumn("reason", F.coalesce("reason", F.when(F.col("_stored"), "stored_before"))).drop("_stored")
    first = F.row_number().over(Window.partitionBy(*keys, F.col("reason").isNull()).orderBy(F.xxhash64(*batch.columns)))
    rows = rows.withColumn("reason", F.when(F.col("reason").isNull() & (first > 1), "repeated_key").otherwise(F.col("reason")))
    rows = rows.withColumn("state", F.when(F.col("reason").isNull(), "good").otherwise("dead"))
    rows.select(*batch.columns, "reason", "state").write.mode("overwrite").partitionBy("state").parquet(f"{out}/batch={number}")


def sink_stream(rows: DataFrame, out: str, checkpoint: str, keys: tuple[str, ...], checks: Checks) -> StreamingQuery:
    """Streams rows into the sink until what is there has been read."""
    return rows.writeStream.foreachBatch(lambda batch, number: store(batch, number, out, keys, checks)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
