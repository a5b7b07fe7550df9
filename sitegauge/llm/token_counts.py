"""Token counts by a linear longest-match automaton.

Word pieces are a byte-level vocabulary split in two: pieces that open a word
(stored with the vocabulary's space mark) and pieces that continue one.  Greedy
longest match takes the longest opening piece, then the longest continuing
piece, and so on.  The automaton is the trie of all pieces with, for each node,
a failure link to the node that remains after the leading piece is popped, and
the number of pieces popped on the way, precomputed; so a word's length in
pieces is found in time linear in its bytes without building the pieces.

Results: doc_id, n_words, n_tokens, one row per document row.  Null, empty and
blank texts have 0 of both.  Every byte is a piece, so no word lacks a length.
A null id is passed through; repeated rows repeat results; texts are read whole,
however long.  Other columns of the input are ignored.
"""

from __future__ import annotations

import json
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, small_batches
from .words import text_buffer

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
REMEMBERED = 400_000


def load_vocabulary(path: str) -> tuple[frozenset[bytes], frozenset[bytes]]:
    """(opening, continuing) pieces of a byte-level vocabulary file."""
    with open(path, encoding="utf-8") as f:
        names = json.load(f)["model"]["vocab"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    opening, continuing = set(), set()
    for name in names:
        if any(c not in byte_of for c in name):
            continue
        piece = bytes(byte_of[c] for c in name)
        if piece.strip(b" \t\n\r\x0b\x0c") == piece and piece:
            continuing.add(piece)
        elif piece[:1] == b" " and piece[1:].strip(b" \t\n\r\x0b\x0c") == piece[1:] and len(piece) > 1:
            opening.add(piece[1:])
    single = {bytes([i]) for i in range(256)}
    return frozenset(opening | single), frozenset(continuing | single)


class Automaton:
    """Nodes are (side, bytes) of trie paths; side 0 opens a word, side 1 continues it."""

    def __init__(self, opening: frozenset[bytes], continuing: frozenset[bytes]):
        self.child: list[dict[int, int]] = [{}, {}]
        depth, parent, byte, side, final = [0, 0], [0, 1], [0, 0], [0, 1], [False, False]
        for s, pieces in enumerate((opening, continuing)):
            for piece in pieces:
                node = s
                for b in piece:
                    nxt = self.child[node].get(b)
                    if nxt is None:
                        nxt = len(self.child)
                        self.child[node][b] = nxt
                        self.child.append({})
                        depth.append(depth[node] + 1)
                        parent.append(node)
                        byte.append(b)
                        side.append(s)
                        final.append(False)
                    node = nxt
                final[node] = True
        self.fail, self.popped = [-1] * len(self.child), [0] * len(self.child)
        for node in sorted(range(2, len(self.child)), key=depth.__getitem__):
            if final[node]:
                self.fail[node], self.popped[node] = 1, 1
                continue
            # pop what the parent pops, then walk on with this node's byte
            at, count = self.fail[parent[node]], self.popped[parent[node]]
            b = byte[node]
            while at != -1 and b not in self.child[at]:
                count += self.popped[at]
                at = self.fail[at]
            self.fail[node], self.popped[node] = (-1, 0) if at == -1 else (self.child[at][b], count)

    def length(self, word: bytes) -> int:
        """Pieces of greedy longest match."""
        child, fail, popped = self.child, self.fail, self.popped
        node = count = 0
        for b in word:
            nxt = child[node].get(b)
            while nxt is None:
                count += popped[node]
                node = fail[node]
                nxt = child[node].get(b)
            node = nxt
        while node > 1:
            count += popped[node]
            node = fail[node]
        return count


class Lengths(dict):
    """Word -> pieces, computed on first use and forgotten beyond REMEMBERED words."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.length(word)
        if len(self) >= REMEMBERED:
            self.clear()
        if len(word) <= 64:
            self[word] = n
        return n


@lru_cache(1)
def _lengths(opening: bytes, continuing: bytes) -> Lengths:
    cut = lambda joined: frozenset(joined.split(b" "))
    return Lengths(Automaton(cut(opening) | {b" "}, cut(continuing) | {b" "}))


def _count(batches, opening: bytes, continuing: bytes):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64())])
    of = _lengths(opening, continuing).__getitem__
    for batch in batches:
        data, offsets = text_buffer(batch.column("text"))
        n_words, n_tokens = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
        for i, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            words = data[lo:hi].tobytes().split()
            n_words[i], n_tokens[i] = len(words), sum(map(of, words))
        yield arrow_rows(schema, doc_id=batch.column("doc_id"), n_words=n_words, n_tokens=n_tokens)


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """The vocabulary is read on the driver (under 1 MB) and shipped with the tasks."""
    small_batches(docs.sparkSession)
    opening, continuing = load_vocabulary(vocabulary)
    packed = [b" ".join(sorted(p - {b" "})) for p in (opening, continuing)]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        partial(_count, opening=packed[0], continuing=packed[1]), "doc_id long, n_words long, n_tokens long")
