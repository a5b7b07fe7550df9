"""Source divergence audit: how far the term shares of each source lie from those of the other sources and of its language.

Terms of a text are its runs of letters A-Z (lower-cased), a-z and non-ASCII
characters.  A language keeps the V terms that at least min_docs of its documents
hold.  Kept terms are dictionary-encoded: the language's terms in UTF-8 order get
the ids 0 to V - 1, and ids are cut into chunks.  A chunk's task holds its sorted
terms, finds each count's id with searchsorted and turns counts into one dense
vector for each source with bincount, so shares and distances of all sources are
array arithmetic, and ties are broken by id.

For a count in a group with N occurrences of kept terms the share is
1 + floor(10^9 * (count + 5) / (N + 5 * V)), in exact integers (counts are under
2^53).  Part `pair`: for each other source of the language the distances of
shares summed over all kept terms; part `term`: kept terms that the source has
and whose share is above the language's, to rank `top`.

Every (lang, source) that occurs is a group, with terms or without.  Null text,
lang and source count as ''.  Each row is one document, so repeated rows count
again and ids are not read.  A language without kept terms has distances of 0; a
language with one source has no pairs; an empty table gives no rows.  Texts are
read whole, in pieces of CUT bytes.  Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, small_batches
from .words import text_buffer

CUT, HELD, EMITTED = 1 << 20, 300_000, 20_000
CELLS, WIDEST = 1 << 20, 1024
TERM = np.full(256, 32, np.uint8)
TERM[65:91] = TERM[97:123] = np.arange(97, 123)
TERM[128:] = np.arange(128, 256)


def _documents(data: bytes):
    """Lists of terms of one text, piece by piece, cut between terms."""
    at = 0
    while len(data) - at > CUT:
        end = data.rfind(b" ", at, at + CUT) + 1
        end = end if end > at else data.find(b" ", at + CUT) + 1 or len(data)
        yield data[at:end].split()
        at = end
    yield data[at:].split()


def _occurrences(batches):
    """(lang, source, term, n, d): occurrences and documents of each term in what this task has read since it last emitted."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("d", pa.int64())])
    held: dict[tuple, tuple[Counter, Counter]] = {}

    def emit():
        for (lang, source), (n, d) in held.items():
            terms = list(n)
            for k in range(0, len(terms), EMITTED):
                part = terms[k : k + EMITTED]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array([source] * len(part)), pa.array(part, pa.binary()).cast(pa.string()),
                                                  pa.array([n[t] for t in part], pa.int64()), pa.array([d[t] for t in part], pa.int64())], schema=schema)
        held.clear()

    for batch in batches:
        data, offsets = text_buffer(batch.column("text"))
        data, offsets = TERM[data].tobytes(), offsets.tolist()
        groups = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)
        for group, lo, hi in zip(groups, offsets[:-1], offsets[1:], strict=True):
            if group not in held:
                held[group] = Counter(), Counter()
            n, d = held[group]
            seen: set[bytes] = set()
            for terms in _documents(data[lo:hi]):
                n.update(terms)
                seen.update(terms)
            d.update(seen)
        if sum(len(n) for n, _ in held.values()) > HELD:
            yield from emit()
    yield from emit()


def term_counts(docs: DataFrame) -> DataFrame:
    """-> lang, source, term, n occurrences, d documents that hold it."""
    small_batches(docs.sparkSession)
    return docs.select("lang", "source", "text").mapInArrow(_occurrences, "lang string, source string, term string, n long, d long").groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("d").alias("d"))


def dictionary(terms: DataFrame, scratch: Scratch) -> DataFrame:
    """terms (lang, term; one row each) with id, the term's place in the language's UTF-8 order from 0.

    Terms are range-partitioned; a term's id is its place in its partition plus the sizes of the partitions before."""
    parts = scratch.save(terms.repartitionByRange("lang", "term").withColumn("part", F.spark_partition_id()), "parts")
    sizes = parts.groupBy("lang", "part").agg(F.count("*").alias("size"))
    before = sizes.select("lang", "part", (F.sum("size").over(Window.partitionBy("lang").orderBy("part")) - F.col("size")).alias("before"))
    placed = parts.withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy("term")))
    return placed.join(before, ["lang", "part"]).select("lang", "term", (F.col("before") + F.col("place") - 1).alias("id"))


def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 * (counts + 5) / total), three digits at a time so that no product passes 2^63."""
    rest, out = counts + 5, np.zeros(np.broadcast(counts, total).shape, np.int64)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digit
    return out + 1


def _chunk(key, side: pa.Table, rows: pa.Table, top: int) -> pa.Table:
    """Distances and terms of one chunk.  side: one row of the chunk's language; rows: counts (term, id, source, n)."""
    lang, about = key[0].as_py(), side.to_pylist()[0]
    sources, v, n_of = about["sources"], about["v"], np.array(about["totals"], np.int64)
    ids = np.unique(rows.column("id").to_numpy())
    kept = rows.column("term").take(pa.array(np.unique(rows.column("id").to_numpy(), return_index=True)[1])) if len(ids) else pa.array([], pa.string())
    at = np.searchsorted(ids, rows.column("id").to_numpy())
    order = pc.index_in(rows.column("source"), pa.array(sources, pa.string())).to_numpy().astype(np.int64)
    counts = np.bincount(order * len(ids) + at, rows.column("n").to_numpy(), len(sources) * len(ids)).astype(np.int64).reshape(len(sources), len(ids))
    of_source = shares(counts, (n_of + 5 * v)[:, None]) if len(ids) else counts
    of_lang = shares(counts.sum(0), np.int64(n_of.sum() + 5 * v)) if len(ids) else counts.sum(0)
    source, part, item, value = [], [], [], []
    for k, name in enumerate(sources):
        others = np.abs(of_source[k + 1 :] - of_source[k]).sum(1).tolist()
        source += [name] * len(others)
        part += ["pair"] * len(others)
        item += sources[k + 1 :]
        value += others
        over = of_source[k] - of_lang
        found = np.flatnonzero((counts[k] > 0) & (over > 0))
        best = found[np.argsort(-over[found], kind="stable")[:top]]  # stable: equal values stay in order of ids
        source += [name] * len(best)
        part += ["term"] * len(best)
        item += kept.take(pa.array(best)).to_pylist()
        value += over[best].tolist()
    return pa.table({"lang": pa.array([lang] * len(source), pa.string()), "source": pa.array(source, pa.string()), "part": pa.array(part, pa.string()),
                     "item": pa.array(item, pa.string()), "value": pa.array(value, pa.int64())})


def divergence(docs: DataFrame, min_docs: int = 30, top: int = 50) -> DataFrame:
    """-> lang, source, part, item, value, rank.

    Tables by (lang, source) hold as many rows as there are groups; the result has one row for each pair of sources of a language,
    so a language's sources fit in the row that its chunks carry.  A chunk has at most WIDEST terms and CELLS counts."""
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = scratch.save(term_counts(docs), "counts")
    groups = docs.select("lang", "source").distinct()
    kept = counts.groupBy("lang", "term").agg(F.sum("d").alias("d")).filter(F.col("d") >= min_docs).select("lang", "term")
    kept = scratch.save(dictionary(kept, scratch), "kept")
    coded = scratch.save(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "id", "n"), "coded")
    scratch.drop("counts", "parts")
    totals = groups.join(coded.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
    sides = totals.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", F.coalesce("total", F.lit(0)).alias("total")))).alias("g"))
    sides = sides.join(kept.groupBy("lang").agg(F.count("*").alias("v")), "lang", "left").select(
        "lang", F.col("g.source").alias("sources"), F.col("g.total").alias("totals"), F.coalesce("v", F.lit(0)).alias("v"))
    width = F.greatest(F.lit(1), F.least(F.lit(WIDEST), F.floor(F.lit(CELLS) / F.size("sources")))).cast("long")
    sides = scratch.save(sides.withColumn("width", width), "sides")
    chunks = sides.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.floor((F.col("v") - 1) / F.col("width"))))))
    coded = coded.join(sides.select("lang", "width"), "lang").withColumn("chunk", F.floor(F.col("id") / F.col("width"))).drop("width")
    found = chunks.groupBy("lang", "chunk").cogroup(coded.groupBy("lang", "chunk")).applyInArrow(
        lambda key, side, rows: _chunk(key, side, rows, top), "lang string, source string, part string, item string, value long")
    found = scratch.save(found, "found")
    once = found.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = once.unionByName(once.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")).withColumn("part", F.lit("pair"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(ranked))
    terms = found.filter("part = 'term'").withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top)
    return pairs.select("lang", "source", "part", "item", "value", "rank").unionByName(terms.select("lang", "source", "part", "item", "value", "rank"))
