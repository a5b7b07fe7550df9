"""Sitemap files as they were fetched: plain, gzip or deflate bytes, and indexes that name other files.

sitemap_files reads a folder of them with the binaryFile source, decoded makes
text of bytes, and walk follows indexes from a frontier table level by level.
Each limit is a parameter, and what it leaves out is a row of the report.
"""

from __future__ import annotations

import zlib
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegauge.operators.links import sitemap_urls
from sitegauge.sources.scratch import saved

MOST_BYTES = 50 << 20
PIECE = 1 << 16


def sitemap_files(spark: SparkSession, folder: str, sitemap: Column) -> DataFrame:
    """-> sitemap, content.  sitemap: the file's address, from the columns path and those of the folder's partitions."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder).select(sitemap.alias("sitemap"), "content")


def _unpacked(content: bytes, most: int) -> tuple[str | None, str | None]:
    """(text, error); a stream is read piece by piece, so no more than `most` bytes are ever held."""
    if content[:2] == b"\x1f\x8b" or content[:1] == b"\x78" and content[:2] in (b"\x78\x01", b"\x78\x9c", b"\x78\xda"):
        out, size, rest = [], 0, content
        while rest:
            stream = zlib.decompressobj(47)  # gzip or zlib, by the head
            try:
                while rest and not stream.eof:
                    part = stream.decompress(rest, PIECE)
                    rest = stream.unconsumed_tail if not stream.eof else stream.unused_data
                    size += len(part)
                    if size > most:
                        return None, "too_large"
                    out.append(part)
                    if not part and not rest:
                        break
                tail = stream.flush()
            except zlib.error:
                return None, "bad_compression"
            out.append(tail)
            size += len(tail)
            if not stream.eof:
                return None, "cut_short"
            if size > most:
                return None, "too_large"
        content = b"".join(out)
    if len(content) > most:
        return None, "too_large"
    try:
        return content.decode("utf-8-sig").strip(), None
    except UnicodeDecodeError:
        return None, "not_text"


def _decode(batches, most: int):
    for batch in batches:
        got = [_unpacked(c, most) if c is not None else (None, "not_fetched") for c in batch.column("content").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("sitemap"), pa.array([t for t, _ in got], pa.string()), pa.array([e for _, e in got], pa.string())], names=["sitemap", "body", "error"])


def decoded(files: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """-> sitemap, body, error (bad_compression, cut_short, too_large, not_text, not_fetched; null if the file could be read)."""
    return files.select("sitemap", "content").mapInArrow(partial(_decode, most=most_bytes), "sitemap string, body string, error string")


def _state(body: Column, error: Column) -> Column:
    low = F.lower(F.coalesce(body, F.lit("")))
    return F.when(error.isNotNull(), error).when(low.rlike(r"<(?:\w+:)?sitemapindex\b"), "index").when(low.rlike(r"<(?:\w+:)?urlset\b"), "urls").otherwise("not_a_sitemap")


def walk(roots: DataFrame, files: DataFrame, depth: int | None = 3, children: int | None = 10, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(pages, report) of all sitemaps reached from the roots.

    pages: url, sitemap (the least of those of the least level that list it), level.  report, one row for each sitemap that a root or an index names: sitemap, level, state
    (urls, index, a reason of `decoded`, not_a_sitemap, missing, or below_depth), n_urls, n_children, children_left_out.  An index names each child once; of its children the
    first `children` are followed.  Files that name one another end, as no sitemap is read twice.  None: no limit.  files: sitemap, body, error."""
    known = saved(files.groupBy("sitemap").agg(F.min_by(F.struct("body", "error"), F.coalesce("body", F.lit(""))).alias("f")).select(
        "sitemap", _state(F.col("f.body"), F.col("f.error")).alias("state"), F.array_distinct(F.filter(sitemap_urls(F.coalesce("f.body", F.lit(""))), lambda u: u != "")).alias("locs")), folder)
    level, frontier, seen, walked = 0, saved(roots.select("sitemap").distinct(), folder), None, None
    while True:
        below = depth is not None and level >= depth
        state = F.lit("below_depth") if below else F.coalesce("state", F.lit("missing"))
        here = frontier.join(known, "sitemap", "left").select("sitemap", F.lit(level).alias("level"), state.alias("state"), F.when(F.lit(not below), F.col("locs")).alias("locs"))
        here = saved(here, folder)
        walked = here if walked is None else walked.unionByName(here)
        seen = frontier if seen is None else seen.unionByName(frontier)
        if below:
            break
        followed = F.col("locs") if children is None else F.slice("locs", 1, children)
        frontier = saved(here.filter("state = 'index'").select(F.explode(followed).alias("sitemap")).distinct().join(seen, "sitemap", "left_anti"), folder)
        if frontier.isEmpty():
            break
        level += 1
    n = F.coalesce(F.size("locs"), F.lit(0))
    held = lambda kind: F.when(F.col("state") == kind, F.greatest(n, F.lit(0))).otherwise(0)
    report = walked.select("sitemap", "level", "state", held("urls").alias("n_urls"), held("index").alias("n_children"),
                           (F.lit(0) if children is None else F.greatest(F.lit(0), held("index") - children)).alias("children_left_out"))
    listed = walked.filter("state = 'urls'").select(F.explode("locs").alias("url"), "sitemap", "level")
    pages = listed.groupBy("url").agg(F.min(F.struct("level", "sitemap")).alias("s")).select("url", "s.sitemap", "s.level")
    return pages, report
