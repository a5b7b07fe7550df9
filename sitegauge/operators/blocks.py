"""Repeated runs of words inside a text, each text on its own, in Arrow batches."""

from __future__ import annotations

import re
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPLIT = re.compile(r"[ \t\n\r\f\x0b]+")  # white space of functions.text.words


def kept_words(text: str | None, size: int) -> list[str]:
    """The words that no run of size words covers which started earlier too; one step for a word."""
    words = [w for w in SPLIT.split(text or "") if w]
    if len(words) < 2 * size:
        return words
    seen: set[str] = set()
    kept, gone_to = [], 0
    for i, word in enumerate(words):
        if i + size <= len(words):
            run = " ".join(words[i : i + size])
            if run in seen:
                gone_to = i + size
            else:
                seen.add(run)
        if i >= gone_to:
            kept.append(word)
    return kept


def _keep(batches, size: int):
    for batch in batches:
        kept = pa.array([" ".join(kept_words(t, size)) for t in batch.column(1).to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), kept], names=[batch.schema.names[0], "kept"])


def without_repeats(df: DataFrame, key: str, text: str, size: int = 20) -> DataFrame:
    """-> key, kept: the text's words less those in a run of size words that started earlier in the same text.

    key names a row.  Texts of fewer than 2 * size words stay whole.  No row moves:
    a text's runs are compared where it is read."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")  # results are lazy, so the session keeps it
    rows = df.select(F.col(key), F.col(text).cast("string").alias("_text"))
    return rows.mapInArrow(partial(_keep, size=size), f"`{key}` {rows.schema[0].dataType.simpleString()}, kept string")
