"""Tables written once to the folder that driver and executors share, and reread: no lineage, no repeated work."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset a local session gets a folder of its own, a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sitegauge-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def drop(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _drop_at_end(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        drop(spark, path)


def saved(df: DataFrame, folder: str | None = None) -> DataFrame:
    path = f"{folder or shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_drop_at_end, df.sparkSession, path)  # lazy results may read the table as long as the driver lives
    return df.sparkSession.read.schema(df.schema).parquet(path)
