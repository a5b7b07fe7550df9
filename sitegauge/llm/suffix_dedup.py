"""Removal of long repeated substrings, by suffix arrays of shards.

A byte goes if a WINDOW-byte string that covers it also starts anywhere else in
the table.  Every window is filed under its anchor, the GRAM-byte string of the
least hash in it (leftmost of ties); equal windows have equal anchors, so:

1. Consecutive windows of one anchor form a region (under 2 * WINDOW bytes).
   Regions of an anchor that occurs once hold no repeat and go no further.
2. Equal regions are counted; all windows of a region found twice repeat.
   A window holds the HALF bytes after its anchor or those before it, so that
   equal windows of different regions have equal halves: different regions
   without a half in common with another one of their anchor go no further.
3. Different regions of one anchor are joined to one string, a lane, and lanes
   are dealt to shards by the anchor's hash.  A shard sorts the suffixes of all
   its lanes side by side by induced sorting: classify suffixes, sort the
   leftmost-smaller substrings, name them, recurse on the names, induce L and
   S suffixes in one scan each.  Permuted common prefixes (from the irreducible
   ones) of WINDOW bytes or more mark repeats.
4. Anchors with more than HOT different regions would make a lane too long for
   one task: blocks of their windows are counted by hash with partial sums
   instead, and cut finer where they repeat in part.

Results: one row per document row: doc_id, n_bytes, spans (byte ranges removed,
ascending, apart) and kept (binary, as a cut may split a character).  Null
texts count as empty; texts shorter than WINDOW lose nothing; repeated rows
count as copies.  Other columns of the input are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_rows, small_batches
from .words import mix, text_buffer

WINDOW, GRAM, HOT = 400, 32, 32
HALF = (WINDOW - GRAM) // 2
PIECE, SHARD_BYTES, SHARDS_OF_TASK = 1 << 19, 1 << 20, 4  # fixed values, so a task's time doesn't grow with the table
_M = np.uint64(0x9E3779B97F4A7C15)
_POS = np.uint64((1 << 22) - 1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all GRAM-byte strings, by doubling."""
    h, size, factor = data.astype(np.uint64) + np.uint64(1), 1, int(_M)
    while size < GRAM:
        h = h[:-size] * np.uint64(factor) + h[size:]
        factor, size = factor * factor & (1 << 64) - 1, 2 * size
    return mix(h)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of width values, from block-wise running minima."""
    n = len(x)
    blocks = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = x
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def regions(data: np.ndarray, offsets: np.ndarray):
    """(text, start, windows, anchor key, content hash, after, before) of each region.

    after, before: hashes of the anchor with the HALF bytes after it, and with those and one more before it; 0 where the region lacks them."""
    up = np.full(PIECE + WINDOW, _M)
    up[0] = 1
    up = np.cumprod(up)
    down = np.full(PIECE + WINDOW, np.uint64(pow(int(_M), -1, 1 << 64)))
    down[0] = 1
    down = np.cumprod(down)
    out = []
    for lo in range(0, max(len(data) - WINDOW + 1, 0), PIECE):
        hi = min(lo + PIECE, len(data) - WINDOW + 1)
        g = gram_hashes(data[lo : hi + WINDOW - 1])
        low = sliding_min((g & ~_POS) | np.arange(len(g), dtype=np.uint64), WINDOW - GRAM + 1)
        anchor = (low & _POS).astype(np.int64)
        text = np.searchsorted(offsets, np.arange(lo, hi), "right") - 1
        valid = np.arange(lo, hi) + WINDOW <= offsets[text + 1]
        new = np.ones(hi - lo, bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | ~valid[:-1]
        a = np.flatnonzero(new & valid)
        if not len(a):
            continue
        cut = np.flatnonzero(new | ~valid)
        stop = np.append(cut, hi - lo)[np.searchsorted(cut, a, "right")]
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(g + _M) * up[: len(g)])])
        of = lambda x, y: mix((total[y - GRAM + 1] - total[x]) * down[x])  # noqa: E731, B023
        content = mix((total[stop + WINDOW - GRAM] - total[a]) * down[a] + (stop - a).astype(np.uint64))
        t, at = text[a], anchor[a]
        after, before = np.zeros(len(a), np.uint64), np.zeros(len(a), np.uint64)
        has = stop - 1 >= at - HALF
        after[has] = of(at[has], at[has] + GRAM + HALF) | np.uint64(1)
        has = a < at - HALF
        before[has] = of(at[has] - HALF - 1, at[has] + GRAM) | np.uint64(1)
        out.append((t, a + lo - offsets[t], stop - a, g[at], content, after, before))
    if not out:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 4
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


OCCURRENCE = "h binary, doc_id long, start int, windows int, key long, content long, after int, before int"


def _occurrences(batches):
    schema = pa.schema([("h", pa.binary()), ("doc_id", pa.int64()), ("start", pa.int32()), ("windows", pa.int32()), ("key", pa.int64()), ("content", pa.int64()), ("after", pa.int32()), ("before", pa.int32())])
    for batch in batches:
        text, start, windows, key, content, *halves = regions(*text_buffer(batch.column("text")))
        own = pa.array(text)
        yield pa.RecordBatch.from_arrays([batch.column("h").take(own), batch.column("doc_id").take(own), pa.array(start.astype(np.int32)),
                                          pa.array(windows.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(content.view(np.int64)),
                                          *[pa.array(x.astype(np.uint32).view(np.int32)) for x in halves]], schema=schema)


def _cut_out(batches):
    """The bytes of each listed region."""
    schema = pa.schema([("key", pa.int64()), ("content", pa.int64()), ("n", pa.int64()), ("body", pa.binary())])
    for batch in batches:
        for text, wanted in zip(batch.column("text"), batch.column("wanted"), strict=True):
            data, rows = text.as_py().encode(), wanted.as_py()
            yield arrow_rows(schema, key=[r["key"] for r in rows], content=[r["content"] for r in rows], n=[r["n"] for r in rows],
                             body=[data[r["start"] : r["start"] + r["windows"] + WINDOW - 1] for r in rows])


def suffix_array(text: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sorted suffixes of every lane [start, start + size), lane after lane, by induced sorting.

    text: ranks from 0 without gaps; a lane's are above those of lanes before it,
    and its last, least and unique one ends it.  All lanes take a scan's step at
    once; as they share no rank, their writes never meet."""
    n, ranks, top = len(text), int(text[-1 if len(text) == 1 else slice(None)].max()) + 1, int(size.max())
    order = np.argsort(-size, kind="stable")
    base, live = start[order], np.append(np.cumsum(np.bincount(size)[::-1])[::-1], 0)
    step = np.ones(n, np.int64)
    step[:-1] = np.sign(text[1:] - text[:-1])
    nearest = np.minimum.accumulate(np.where(step != 0, np.arange(n), n - 1)[::-1])[::-1]
    smaller = step[nearest] > 0
    first = np.zeros(n, bool)
    first[start] = True
    leftmost = np.zeros(n, bool)
    leftmost[1:] = smaller[1:] & ~smaller[:-1]
    leftmost[start + size - 1] = True
    marks = np.flatnonzero(leftmost)
    count = np.bincount(text, minlength=ranks)
    ends = np.cumsum(count)
    before, kind = np.roll(text, 1), np.roll(smaller, 1)
    to_larger, to_smaller = np.append(np.where(first | kind, ranks, before), ranks), np.append(np.where(first | ~kind, ranks, before), ranks)

    def induce(seeds: np.ndarray) -> np.ndarray:
        sa = np.full(n + top + 2, -1, np.int64)
        c = text[seeds]
        own = np.bincount(c, minlength=ranks)
        sa[ends[c] - own[c] + np.arange(len(c)) - (np.cumsum(own) - own)[c]] = seeds
        for at, way, to, steps in ((np.append(ends - count, n), 1, to_larger, range(top)), (np.append(ends - 1, n + top), -1, to_smaller, range(top - 1, -1, -1))):
            for i in steps:
                s = sa[base[: live[i + 1]] + i]
                c = to[s]
                p = at[c]
                sa[p] = s - 1
                at[c] = p + way
        return sa[:n]

    rough = induce(marks[np.argsort(text[marks], kind="stable")])
    ordered = rough[leftmost[rough]]
    length = np.zeros(n, np.int64)
    length[marks[:-1]] = marks[1:] - marks[:-1] + 1
    length[start + size - 1] = 1
    x, y = ordered[:-1], ordered[1:]
    same = (length[x] == length[y]) & (text[x] == text[y])
    at = np.flatnonzero(same)
    if len(at):
        long = length[x[at]]
        head = np.cumsum(long) - long
        inner = np.arange(long.sum()) - np.repeat(head, long)
        same[at] = np.logical_and.reduceat(text[np.repeat(x[at], long) + inner] == text[np.repeat(y[at], long) + inner], head)
    if same.any():
        name = np.zeros(n, np.int64)
        name[ordered] = np.concatenate([[0], np.cumsum(~same)])
        upto = np.concatenate([[0], np.cumsum(leftmost)])
        inside = upto[start + size] - upto[start]
        ordered = marks[suffix_array(name[marks], np.cumsum(inside) - inside, inside)]
    return induce(ordered)


def common_prefixes(data: np.ndarray, sa: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each position, the bytes its suffix shares with the one sorted before it in its lane."""
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    before[sa[start]] = -1
    first = np.zeros(n, bool)
    first[start] = True
    has = before >= 0
    reducible = has.copy()
    reducible[1:] &= (data[:-1] == data[np.maximum(before[1:] - 1, 0)]) & ~first[1:] & ~first[before[1:]] & has[:-1]
    reducible[0] = False
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)[:n].copy().view(np.uint64).ravel()
    common = np.zeros(n, np.int64)
    at = np.flatnonzero(has & ~reducible)
    while len(at):
        a, b = at + common[at], before[at] + common[at]
        inside = (a < n) & (b < n)
        at, a, b = at[inside], a[inside], b[inside]
        differ = words[a] ^ words[b]
        common[at] += np.where(differ == 0, 8, np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)) // 8).astype(np.int64)
        at = at[differ == 0]
    source = np.maximum.accumulate(np.where(reducible, 0, np.arange(n)))
    return np.where(has, common[source] - (np.arange(n) - source), 0)


def _runs(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flag.astype(np.int8), [0]])))
    return edge[::2], edge[1::2]


FOUND = "key long, content long, lo array<int>, hi array<int>"
FOUND_ARROW = pa.schema([("key", pa.int64()), ("content", pa.int64()), ("lo", pa.list_(pa.int32())), ("hi", pa.list_(pa.int32()))])


def repeated_windows(bodies: list[bytes], keys: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each region, the ranges of windows that another region of its key holds too.

    keys ascend.  0xFF and 0xFE, which UTF-8 text lacks, end a region and a lane."""
    last = np.append(keys[1:] != keys[:-1], True)
    size = np.array([len(b) for b in bodies]) + 1 + last
    stop = np.cumsum(size)
    data = np.frombuffer(b"".join(b + (b"\xff\xfe" if e else b"\xff") for b, e in zip(bodies, last, strict=True)), np.uint8)
    lane_end = stop[last]
    lane_start = np.concatenate([[0], lane_end[:-1]])
    lane = np.repeat(np.arange(len(lane_end)), lane_end - lane_start)
    code = lane * 256 + (data + np.uint8(2))
    text = (np.cumsum(np.bincount(code) > 0) - 1)[code]
    sa = suffix_array(text, lane_start, lane_end - lane_start)
    common = common_prefixes(data, sa, lane_start)
    flag = np.zeros(len(data), bool)
    hit = np.flatnonzero(common[sa] >= WINDOW)
    flag[sa[hit]] = flag[sa[hit - 1]] = True
    return [_runs(flag[e - s : e - s + len(b) - WINDOW + 1]) for b, s, e in zip(bodies, size, stop, strict=True)]


def _shard(table: pa.Table) -> pa.Table:
    table = table.sort_by("key").combine_chunks()
    keys = table["key"].to_numpy()
    found = repeated_windows([b.as_py() for b in table["body"]], keys)
    return pa.table([table["key"], table["content"], [a.astype(np.int32) for a, _ in found], [b.astype(np.int32) for _, b in found]], schema=FOUND_ARROW)


BLOCKS = "key long, content long, block int, lo int, hi int, core long, hull long"


def _blocks(batches, width: int):
    """The listed windows of crowded anchors' regions in blocks of width, aligned to the anchor.

    core hashes what all windows of the whole block share, hull what the block's own windows cover."""
    schema = pa.schema([("key", pa.int64()), ("content", pa.int64()), ("block", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32()), ("core", pa.int64()), ("hull", pa.int64())])
    up = np.full(2 * WINDOW, _M)
    up[0] = 1
    up = np.cumprod(up)
    down = np.full(2 * WINDOW, np.uint64(pow(int(_M), -1, 1 << 64)))
    down[0] = 1
    down = np.cumprod(down)
    span = WINDOW - GRAM
    for batch in batches:
        for key, content, body, part in zip(*(batch.column(c).to_pylist() for c in ("key", "content", "body", "part")), strict=True):
            g = gram_hashes(np.frombuffer(body, np.uint8))
            total = np.concatenate([[np.uint64(0)], np.cumsum(mix(g + _M) * up[: len(g)])])
            of = lambda x, y: mix((total[y - GRAM + 1] - total[x]) * down[x] + (y - x).astype(np.uint64)).view(np.int64)  # noqa: E731, B023
            last = len(body) - WINDOW
            anchor = last + int(np.argmax(g[last:] == np.int64(key).view(np.uint64)))
            s = np.concatenate([np.arange(p["lo"], p["hi"]) for p in part])
            block = (s - anchor + span) // width
            lo = s[np.concatenate([[True], block[1:] != block[:-1]])]
            hi = s[np.concatenate([block[1:] != block[:-1], [True]])] + 1
            block = np.unique(block)
            first = block * width + anchor - span
            yield arrow_rows(schema, key=np.full(len(lo), key), content=np.full(len(lo), content), block=block.astype(np.int32), lo=lo.astype(np.int32),
                             hi=hi.astype(np.int32), core=of(first + width - 1, first + WINDOW), hull=of(lo, hi + WINDOW - 1))


def crowded_repeats(bodies: DataFrame, scratch: Scratch) -> DataFrame:
    """-> key, content, lo, hi: repeated windows of anchors with more than HOT regions.

    A block whose core is found once holds no repeat; one whose hull is found
    twice is all repeats; one block of each hull is cut finer, down to windows."""
    todo = bodies.withColumn("part", F.array(F.struct(F.lit(0).alias("lo"), (F.length("body") - (WINDOW - 1)).alias("hi"))))
    found = None
    for width in (64, 8, 1):
        rows = scratch.save(todo.mapInArrow(partial(_blocks, width=width), BLOCKS), f"blocks{width}")
        shared = rows.groupBy("key", "block", "core").agg(F.count("*").alias("c")).filter("c > 1").drop("c")
        rows = rows.join(shared, ["key", "block", "core"])
        rows = scratch.save(rows.join(rows.groupBy("key", "hull").agg(F.count("*").alias("n"), F.min("content").alias("first")), ["key", "hull"]), f"shared{width}")
        whole = rows.filter("n > 1").select("key", "content", "lo", "hi")
        found = whole if found is None else found.unionByName(whole)
        todo = bodies.join(rows.filter("content = first").groupBy("key", "content").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("part")), ["key", "content"])
    return found


def _cut(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])
    for batch in batches:
        out = {"n_bytes": [], "spans": [], "kept": []}
        for text, found in zip(batch.column("text"), batch.column("found"), strict=True):
            data, found = (text.as_py() or "").encode(), found.as_py()
            spans = []
            for r in sorted((r["start"], r["end"]) for r in found or ()):
                if spans and r[0] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], r[1])
                else:
                    spans.append(list(r))
            edges = [0, *(e for s in spans for e in s), len(data)]
            out["n_bytes"].append(len(data))
            out["spans"].append([{"start": s, "end": e} for s, e in spans])
            out["kept"].append(b"".join(data[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True)) if spans else data)
        yield arrow_rows(schema, doc_id=batch.column("doc_id"), **out)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """-> doc_id, n_bytes, spans array<struct<start, end>>, kept binary."""
    spark = docs.sparkSession
    small_batches(spark, 512, "4m")
    scratch = Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.unhex(F.md5("text")).alias("h"))
    occ = scratch.save(docs.filter(F.octet_length("text") >= WINDOW).mapInArrow(_occurrences, OCCURRENCE), "occurrences")
    again = scratch.save(occ.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key"), "again")  # saved, so that the join can split a hot key
    occ = scratch.save(occ.join(again, "key"), "repeated")
    scratch.drop("occurrences", "again")
    kinds = scratch.save(occ.groupBy("key", "content").agg(F.count("*").alias("n"), F.min(F.struct("h", "doc_id", "start", "windows")).alias("r"), F.min("after").alias("after"), F.min("before").alias("before")), "kinds")
    half = kinds.select("key", "content", F.posexplode(F.array("after", "before")).alias("side", "half")).filter("half <> 0")
    shared = scratch.save(half.groupBy("key", "side", "half").agg(F.count("*").alias("c")).filter("c > 1").drop("c"), "halves")
    live = scratch.save(half.join(shared, ["key", "side", "half"]).select("key", "content").distinct(), "live")
    crowd = live.groupBy("key").agg(F.count("*").alias("d"))
    mixed = kinds.join(live, ["key", "content"]).select("key", "content", "n", "r")
    wanted = scratch.save(mixed.groupBy(F.col("r.h").alias("h"), F.col("r.doc_id").alias("_id")).agg(F.collect_list(F.struct(
        "key", "content", "n", F.col("r.start").alias("start"), F.col("r.windows").alias("windows"))).alias("wanted")), "wanted")
    bodies = docs.join(wanted, ["h"]).filter(F.col("doc_id").eqNullSafe(F.col("_id"))).select("text", "wanted")
    bodies = bodies.mapInArrow(_cut_out, "key long, content long, n long, body binary").dropDuplicates(["key", "content"])
    bodies = scratch.save(bodies.join(crowd.select("key", "d"), "key"), "bodies")
    size = bodies.agg(F.sum(F.when(F.col("d") <= HOT, F.length("body"))).alias("lanes"), F.max("d").alias("d")).first()
    shards = max(1, -(-(size["lanes"] or 0) // SHARD_BYTES))
    sorted_ = bodies.filter(F.col("d") <= HOT).select("key", "content", "body", F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard")).repartition(
        -(-shards // SHARDS_OF_TASK), "shard").groupBy("shard").applyInArrow(_shard, FOUND)
    found = sorted_.select("key", "content", F.arrays_zip("lo", "hi").alias("part"))
    if (size["d"] or 0) > HOT:
        crowded = crowded_repeats(bodies.filter(F.col("d") > HOT).select("key", "content", "body"), scratch)
        found = found.unionByName(crowded.groupBy("key", "content").agg(F.collect_list(F.struct("lo", "hi")).alias("part")))
    whole = kinds.filter("n > 1").select("key", "content", F.array(F.struct(F.lit(0).alias("lo"), F.col("r.windows").alias("hi"))).alias("part"))
    single = kinds.filter("n = 1").select("key", "content").join(found.filter(F.size("part") > 0), ["key", "content"])
    part = scratch.save(whole.unionByName(single), "parts")
    spans = scratch.save(occ.join(part, ["key", "content"]).select("h", F.explode("part").alias("p"), "start").groupBy("h").agg(F.collect_set(F.struct(
        (F.col("start") + F.col("p.lo")).alias("start"), (F.col("start") + F.col("p.hi") + (WINDOW - 1)).alias("end"))).alias("found")), "spans")
    scratch.drop_all_but("spans")
    return docs.join(spans, ["h"], "left").select("doc_id", "text", "found").mapInArrow(
        _cut, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")
