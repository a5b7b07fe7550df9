"""Byte-pair encoding and decoding with a segment tree over adjacent pair ranks.

A text is cut at special tokens, then into chunks by white space and into pieces
by the vocabulary's pattern.  Each piece starts as its bytes.  The leaves of a
segment tree hold, for each adjacent pair, its merge rank and place; a node holds
the least of its children, so the root is the leftmost pair of lowest rank.  A
merge changes three leaves and the nodes above them, so a piece of n bytes takes
O(n log n) steps, however long it is.  Merging ends when the root holds no pair.

encode: doc_id, ids (array of int), one row for each document row.  Null and
empty texts have no ids; a null doc_id is passed through; repeated rows repeat
results; texts are encoded whole; other columns are ignored, whatever their
names.  decode: adds decoded to the columns of its input; null ids give an empty
text, ids outside the vocabulary give nothing, and bytes that are no UTF-8 give
replacement marks.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, small_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
REMEMBERED = 200_000
LONG = 4096
SHORT_BITS, TOGETHER, NONE = 6, 1 << 14, 1 << 60

# White space, and the code points that newer Unicode tables call letters or numbers but the vocabulary's library does not.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
NEWER = (r"\u0558\u058b\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c\uab6d\U000107bb-\U000107bf\U00010940-\U00010959"
         r"\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686"
         r"\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2"
         r"\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96"
         r"\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe\U0001e6ff"
         r"\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f")
LETTER, NUMBER = rf"[\p{{L}}--[{NEWER}]]", rf"[\p{{N}}--[{NEWER}]]"
CHUNKS = re.compile(rf" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?{LETTER}+| ?{NUMBER}+| ?(?:(?!{LETTER}|{NUMBER})[^{WHITE}])+|[{WHITE}]+", regex.V1)


def load_vocabulary(path: str) -> dict:
    """The vocabulary file as flat arrays (1 MB): merges in rank order as ids (left, right, result), ids of single bytes, bytes of each id, special tokens."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    id_of = spec["model"]["vocab"]
    merges = np.array([(id_of[a], id_of[b], id_of[a + b]) for a, b in spec["model"]["merges"]], np.int32)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    names = {i: t for t, i in (id_of | special).items()}
    raw = [b"" if i not in names else bytes(byte_of[c] for c in names[i]) if all(c in byte_of for c in names[i]) else names[i].encode() for i in range(max(names) + 1)]
    return {"merges": merges.tobytes(), "single": [id_of[c] for c, _ in sorted(byte_of.items(), key=lambda x: x[1])], "special": special,
            "bytes": b"".join(raw), "ends": np.cumsum([len(r) for r in raw]).astype(np.int32).tobytes()}


def merge_pairs(symbols: list[int], pairs: dict[int, tuple[int, int]]) -> list[int]:
    """symbols after all merges, the leftmost pair of lowest rank first.  pairs: (left << 32 | right) -> (rank, result)."""
    n, get = len(symbols), pairs.get
    if n < 2:
        return symbols
    none, half = 1 << 62, 1 << (n - 1).bit_length()
    tree, after, before, symbols = [none] * (2 * half), list(range(1, n + 1)), list(range(-1, n - 1)), list(symbols)
    if n > LONG:  # eight bytes for each number
        tree, after, before, symbols = array("q", tree), array("q", after), array("q", before), array("q", symbols)
    left = symbols[0]
    for i in range(n - 1):
        right = symbols[i + 1]
        if found := get(left << 32 | right):
            tree[half + i] = found[0] << 40 | i
        left = right
    for i in range(half - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    while (least := tree[1]) != none:
        i = least & (1 << 40) - 1
        gone = after[i]
        symbols[i] = merged = get(symbols[i] << 32 | symbols[gone])[1]
        symbols[gone] = -1
        after[i] = to = after[gone]
        tree[half + gone] = none
        if to < n:
            before[to] = i
            found = get(merged << 32 | symbols[to])
            tree[half + i] = found[0] << 40 | i if found else none
        else:
            tree[half + i] = none
        if (prior := before[i]) >= 0:
            found = get(symbols[prior] << 32 | merged)
            tree[half + prior] = found[0] << 40 | prior if found else none
        else:
            prior = i
        p, q, r = half + prior, half + i, half + gone
        while q > 1:  # the three leaves' ways to the root, shared nodes once
            p, q, r = p >> 1, q >> 1, r >> 1
            a, b = tree[2 * q], tree[2 * q + 1]
            tree[q] = a if a < b else b
            if p != q:
                a, b = tree[2 * p], tree[2 * p + 1]
                tree[p] = a if a < b else b
            if r != q:
                a, b = tree[2 * r], tree[2 * r + 1]
                tree[r] = a if a < b else b
    return [s for s in symbols if s >= 0]


class Merges:
    """The merges as a dict for one long piece, and as sorted keys for many short ones."""

    def __init__(self, merges: bytes, single: tuple):
        triples = np.frombuffer(merges, np.int32).reshape(-1, 3).astype(np.int64)
        keys, first = np.unique(triples[:, 0] << 32 | triples[:, 1], return_index=True)
        self.keys, self.ranks, self.result = keys, first, triples[:, 2]
        self.pairs = {k: (r, int(self.result[r])) for k, r in zip(keys.tolist(), first.tolist(), strict=True)}
        self.single = np.array(single, np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge ranks of pairs; NONE where there is no merge."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], NONE)

    def one(self, piece: bytes) -> bytes:
        return np.array(merge_pairs(self.single[list(piece)].tolist(), self.pairs), np.int32).tobytes()

    def many(self, pieces: list[bytes]) -> list[bytes]:
        """ids of each piece as int32 bytes.  Short pieces advance together: row k of the arrays is the segment tree of piece k."""
        out: list[bytes] = [b""] * len(pieces)
        classes: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            classes.setdefault(max(1, (len(piece) - 1).bit_length()), []).append(k)
        for bits, members in classes.items():
            if bits > SHORT_BITS:
                for k in members:
                    out[k] = self.one(pieces[k])
                continue
            for at in range(0, len(members), TOGETHER):
                part = members[at : at + TOGETHER]
                for k, ids in zip(part, self._together([pieces[k] for k in part], bits), strict=True):
                    out[k] = ids
        return out

    def _together(self, pieces: list[bytes], bits: int) -> list[bytes]:
        half, size = 1 << bits, np.array([len(p) for p in pieces])
        filled = np.arange(half) < size[:, None]
        symbol = np.full((len(pieces), half), -1, np.int64)
        symbol[filled] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        tree = np.full((len(pieces), 2 * half), NONE, np.int64)
        leaf = self.rank(symbol[:, :-1], symbol[:, 1:])
        tree[:, half:-1] = np.where(leaf < NONE, leaf << bits | np.arange(half - 1), NONE)
        for level in range(bits - 1, -1, -1):
            tree[:, 1 << level : 2 << level] = np.minimum(tree[:, 2 << level : 4 << level : 2], tree[:, (2 << level) + 1 : 4 << level : 2])
        after = np.tile(np.arange(1, half + 1), (len(pieces), 1))
        before = np.tile(np.arange(-1, half - 1), (len(pieces), 1))
        flat, symbols, nexts, priors = tree.ravel(), symbol.ravel(), after.ravel(), before.ravel()
        rows = np.flatnonzero(tree[:, 1] < NONE)
        while len(rows):
            row, top = rows * half, flat[rows * 2 * half + 1]
            at, merged = top & (half - 1), self.result[top >> bits]
            gone = nexts[row + at]
            symbols[row + at], symbols[row + gone] = merged, -1
            to, prior = nexts[row + gone], priors[row + at]
            nexts[row + at] = to
            inside, led = to < half, prior >= 0
            priors[(row + to)[inside]] = at[inside]
            right = self.rank(merged, np.where(inside, symbols[row + np.minimum(to, half - 1)], -1))
            left = self.rank(np.where(led, symbols[row + np.maximum(prior, 0)], -1), merged)
            prior = np.where(led, prior, at)
            node = rows * 2 * half
            ways = [half + prior, half + at, half + gone]
            flat[node + ways[0]] = np.where(left < NONE, left << bits | prior, NONE)
            flat[node + ways[1]] = np.where(right < NONE, right << bits | at, NONE)
            flat[node + ways[2]] = NONE
            # where nothing stands before, its way is that of the pair itself, whose leaf is written last
            for _ in range(bits):
                ways = [w >> 1 for w in ways]
                for w in ways:
                    under = node + 2 * w
                    flat[node + w] = np.minimum(flat[under], flat[under + 1])
            rows = rows[flat[node + 1] < NONE]
        ids, n = symbol[symbol >= 0].astype(np.int32).tobytes(), (symbol >= 0).sum(1)
        ends = (4 * np.cumsum(n)).tolist()
        return [ids[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


class Remembered:
    """Results in two generations: when the younger is full it becomes the older, so what is used often stays."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def get(self, keys: set[str], make) -> dict[str, bytes]:
        """Results of all keys; make(list of keys) gives those that are not remembered."""
        young, old = self.young, self.old
        out = {k: young[k] for k in keys & young.keys()}
        aged = (keys - out.keys()) & old.keys()
        fresh = list(keys - out.keys() - aged)
        more = {k: old[k] for k in aged} | dict(zip(fresh, make(fresh), strict=True))
        if len(young) + len(more) > self.size:
            self.young, self.old = {}, young
        self.young.update((k, v) for k, v in more.items() if len(k) <= 64)
        return out | more


class Encoder:
    """Texts -> their ids as int32 bytes."""

    def __init__(self, merges: bytes, single: tuple, special: tuple):
        self.merges = Merges(merges, single)
        self.special = {k: np.int32(v).tobytes() for k, v in special}
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if special else None
        self.pieces, self.chunks = Remembered(REMEMBERED), Remembered(REMEMBERED)

    def texts(self, texts: list[str]) -> list[bytes]:
        cut = [self._chunks(t) for t in texts]
        of = self.chunks.get({c for t, _ in cut for c in t if type(c) is str}, self._encode_chunks).__getitem__
        return [b"".join([c if type(c) is bytes else of(c) for c in t] if marked else map(of, t)) for t, marked in cut]

    def _chunks(self, text: str) -> tuple[list, bool]:
        """Chunks of the text between special tokens, and the ids of those as bytes; whether there are any."""
        out, at = [], 0
        for m in self.cut.finditer(text) if self.cut else ():
            out += CHUNKS.findall(text, at, m.start())
            out.append(self.special[m[0]])
            at = m.end()
        return out + CHUNKS.findall(text, at), at > 0

    def _encode_chunks(self, chunks: list[str]) -> list[bytes]:
        cut = [[c] if c.removeprefix(" ").isalpha() else PIECES.findall(c) for c in chunks]
        of = self.pieces.get({p for c in cut for p in c}, lambda fresh: self.merges.many([p.encode() for p in fresh]))
        return [b"".join([of[p] for p in c]) for c in cut]


_encoder = lru_cache(1)(Encoder)  # a worker that is used again keeps its tables


def _encode(batches, merges: bytes, single: tuple, special: tuple):
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
    of = _encoder(merges, single, special)
    for batch in batches:
        texts = of.texts([t or "" for t in batch.column("text").to_pylist()])
        offsets = np.concatenate([[0], np.cumsum([len(t) // 4 for t in texts])]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(texts), np.int32)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], schema=schema)


def encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """The vocabulary is read on the driver (about 1 MB as arrays) and shipped with the tasks."""
    small_batches(docs.sparkSession)
    spec = load_vocabulary(vocabulary)
    run = partial(_encode, merges=spec["merges"], single=tuple(spec["single"]), special=tuple(spec["special"].items()))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def _decode(batches, raw: bytes, ends: bytes, ids: str, decoded: str):
    data, ends = np.frombuffer(raw, np.uint8), np.frombuffer(ends, np.int32).astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    for batch in batches:
        column = batch.column(ids)
        flat = column.flatten()
        values = flat.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        known = (values >= 0) & (values < len(ends))
        values = np.where(known, values, 0)
        size = np.where(known, ends[values] - starts[values], 0)
        shift = np.concatenate([[0], np.cumsum(size)])
        out = data[np.repeat(starts[values] - shift[:-1], size) + np.arange(shift[-1])].tobytes()
        n = np.array([len(x) if x.is_valid else 0 for x in column], np.int64)
        cuts = shift[np.concatenate([[0], np.cumsum(n)])].tolist()
        texts = [out[a:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, decoded])


def decode(df: DataFrame, ids: str = "ids", decoded: str = "decoded", vocabulary: str = VOCABULARY) -> DataFrame:
    """df with the text of each row's ids."""
    if decoded in df.columns:
        raise ValueError(f"there is a column {decoded} already")
    spec = load_vocabulary(vocabulary)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(partial(_decode, raw=spec["bytes"], ends=spec["ends"], ids=ids, decoded=decoded), f"{schema}, `{decoded}` string")
