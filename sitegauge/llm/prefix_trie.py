"""Prefix trie of conversations that continue shared openings.

Conversation c is rebuilt from the first h turns of its base (c - c % 100) and its
own turns after the first h; h is crc32 of its decimal id, modulo 6.  Each distinct
sequence of first d turns (role and text) is a node of depth d.

Family-first merging: conversations are cogrouped by base, so that each task
rebuilds one family of at most 199 conversations and builds its small trie; only
the combined nodes of families are shuffled for the global merge, by the node's
key.  Turns travel as a digest of role and text with the text's length, so texts
leave their partition only as 32 bytes.  What a node sums over its subtree is
found without walking the merged trie level by level: each global node belongs to
the family of its smallest member, families sum the nodes they own along their
own small trie, and the sums of a node are added up over its families.

Result: one row for each node, see `prefix_trie`.  Turns are ordered by turn,
nulls first; turns of one conversation with equal turn follow the digest of role
and text; repeated rows are turns again.  Null role and text count as ''.  Rows
without conv_id belong to no conversation; an empty table has no nodes.  Texts
are read whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

SHARED = 6
FAMILY = 100
TOGETHER = 128 * FAMILY
NODES = "base long, node int, up int, key binary, parent binary, depth int, chars long, n long, first long, ends array<long>"
ROOT = bytes(16)


def _ordered(turns: pa.Table) -> tuple[list, list, list]:
    """conv_id, digest and chars of the turns in order."""
    order = pc.sort_indices(turns, sort_keys=[("conv_id", "ascending"), ("turn", "ascending"), ("digest", "ascending")], null_placement="at_start")
    turns = turns.take(order)
    return turns["conv_id"].to_pylist(), turns["digest"].to_pylist(), turns["chars"].to_pylist()


def shared_turns(conv_id: int) -> int:
    return zlib.crc32(str(conv_id).encode()) % SHARED


def _family(key, heads: pa.Table, own: pa.Table) -> pa.Table:
    """The trie of one family: nodes in order of creation, so parents stand before their children."""
    base = key[0].as_py()
    _, digests, chars = _ordered(heads)
    head = list(zip(digests[:SHARED], chars[:SHARED], strict=True))
    ids, digests, chars = _ordered(own)
    child: dict[tuple[int, bytes], int] = {}
    up, keys, depth, length, n, first, ends = [-1], [ROOT], [0], [0], [0], [None], [[]]
    starts = [k for k in range(len(ids)) if not k or ids[k] != ids[k - 1]]
    for a, z in zip(starts, [*starts[1:], len(ids)], strict=True):
        c = ids[a]
        h = shared_turns(c)
        node, at = 0, [*head[:h], *zip(digests[a + h : z], chars[a + h : z], strict=True)]
        first[0] = c if first[0] is None else first[0]
        n[0] += 1
        for digest, size in at:
            nxt = child.get((node, digest))
            if nxt is None:
                nxt = child[node, digest] = len(up)
                up.append(node)
                keys.append(hashlib.sha256(keys[node] + digest).digest()[:16])
                depth.append(depth[node] + 1)
                length.append(size)
                n.append(0)
                first.append(c)
                ends.append([])
            node = nxt
            n[node] += 1
        ends[node].append(c)
    size = len(up) if ids else 0
    parent = [None, *[keys[u] for u in up[1:]]]
    cut = lambda x, kind: pa.array(x[:size], kind)
    return pa.table({"base": pa.array([base] * size, pa.int64()), "node": pa.array(range(size), pa.int32()), "up": cut(up, pa.int32()), "key": cut(keys, pa.binary()),
                     "parent": cut(parent, pa.binary()), "depth": cut(depth, pa.int32()), "chars": cut(length, pa.int64()), "n": cut(n, pa.int64()),
                     "first": cut(first, pa.int64()), "ends": cut(ends, pa.list_(pa.int64()))})


def family_nodes(conversations: DataFrame) -> DataFrame:
    """Nodes of the small tries of all families, before the global merge."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        F.char_length(text).cast("long").alias("chars"))
    turns = turns.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)
    heads = turns.filter("conv_id = base")
    return heads.groupBy("base").cogroup(turns.groupBy("base")).applyInArrow(_family, NODES)


def _subtrees(key, nodes: pa.Table, owned: pa.Table) -> pa.Table:
    """Sums of what the family owns, over the subtree of each node of the family."""
    order = np.argsort(nodes["node"].to_numpy())
    up = nodes["up"].to_numpy()[order].tolist()
    saved, leaves = [0] * len(up), [0] * len(up)
    for k, s, leaf in zip(owned["node"].to_pylist(), owned["own"].to_pylist(), owned["leaf"].to_pylist(), strict=True):
        saved[k], leaves[k] = s, leaf
    for k in range(len(up) - 1, 0, -1):
        saved[up[k]] += saved[k]
        leaves[up[k]] += leaves[k]
    out = pa.table({"key": nodes["key"].take(pa.array(order)), "saved": pa.array(saved, pa.int64()), "leaves": pa.array(leaves, pa.int64())})
    return out.filter(pa.array((np.array(saved) != 0) | (np.array(leaves) != 0)))


def _digests(batches):
    """SHA-256 of each key's texts joined by commas.  Rows come in order of key and place; a digest is fed piece by piece, whatever the number of pieces."""
    schema = pa.schema([("key", pa.binary()), ("ends_sha256", pa.string())])
    key, digest = None, None
    for batch in batches:
        keys, values = [], []
        for k, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if k != key:
                if digest:
                    keys.append(key)
                    values.append(digest.hexdigest())
                key, digest = k, hashlib.sha256(text.encode())
            else:
                digest.update(b"," + text.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(values, pa.string())], schema=schema)
    if digest:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([digest.hexdigest()], pa.string())], schema=schema)


def end_digests(nodes: DataFrame) -> DataFrame:
    """key, ends_sha256 of the nodes where conversations end.

    Families hold disjoint ranges of ids, so a node's ids ascend over its families.  Ids of neighbouring families are joined to one
    text first, in many tasks; the digest, which has to be fed in order, then reads one row for each TOGETHER ids."""
    ending = nodes.filter(F.size("ends") > 0).select("key", F.floor(F.col("base") / TOGETHER).alias("place"), "base", F.array_join(F.col("ends").cast("array<string>"), ",").alias("text"))
    pieces = ending.groupBy("key", "place").agg(F.sort_array(F.collect_list(F.struct("base", "text"))).alias("t")).select("key", "place", F.array_join(F.col("t.text"), ",").alias("text"))
    return pieces.repartition("key").sortWithinPartitions("key", "place").mapInArrow(_digests, "key binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """-> conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256; one row for each node.

    The merge is a partial sum for each key, so a node that every family has costs one row a task.  The join that looks up the
    parent's conv_id is a plain join of two shuffled tables, whose hot parents Spark splits."""
    scratch = Scratch(conversations.sparkSession)
    nodes = scratch.save(family_nodes(conversations), "families")
    merged = nodes.groupBy("key").agg(F.min(F.struct("first", "base", "node")).alias("owner"), F.sum("n").alias("n_convs"),
                                      F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.max("chars").alias("chars"))
    merged = scratch.save(merged, "merged")
    children = merged.filter("parent is not null").groupBy("parent").agg(F.count("*").alias("n_children"))
    merged = merged.join(children.withColumnRenamed("parent", "key"), "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    merged = scratch.save(merged, "counted")
    scratch.drop("merged")
    owned = merged.select(F.col("owner.base").alias("base"), F.col("owner.node").alias("node"), ((F.col("n_convs") - 1) * F.col("chars")).alias("own"), (F.col("n_children") == 0).cast("long").alias("leaf"))
    sums = nodes.select("base", "node", "up", "key").groupBy("base").cogroup(owned.filter("own > 0 or leaf > 0").groupBy("base")).applyInArrow(_subtrees, "key binary, saved long, leaves long")
    sums = sums.groupBy("key").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))
    parents = merged.select(F.col("key").alias("parent"), F.col("owner.first").alias("parent_conv_id"))
    out = merged.join(sums, "key", "left").join(end_digests(nodes), "key", "left").join(parents, "parent", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(F.col("owner.first").alias("conv_id"), F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", zero("n_leaves"), zero("saved_tokens"),
                      F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
