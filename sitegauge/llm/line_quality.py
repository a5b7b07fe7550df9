"""Quality rules with a linear-chain conditional random field over lines.

Base rules count words, symbols, repeated lines and repeated 8-word windows.
The field labels every line with a word as content or boilerplate from
docstats.LINE_FEATURES; Viterbi decoding gives the best sequence of a text, and
the text is kept if content lines hold at least CONTENT_SHARE of its words and
the base rules pass.

There are no labelled lines, so the field is fitted from document quality: first
all lines of a bad document count as boilerplate, then twice only those that the
field itself marks (its most suspect line at least).  The sample is bounded:
SAMPLE labelled documents by hash of the id, their lines in pieces of PIECE, and
of the pieces PIECES by hash of id and number.  All documents are judged whole.

Results: one row per document row.  Null, empty and blank texts have counts 0,
base_failed true and kept false.  A null id is passed through.  Of two label
sequences that score alike the one that starts with content wins.  Repeated rows
repeat results; texts are read whole.  Other columns of the input are ignored.
Without both label values no line is boilerplate.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, labelled_sample, small_batches
from .docstats import LINE_FEATURES, SYMBOL, Lines, Words, counts, duplicate_lines, line_features, repeated_words
from .words import SPACE, text_buffer

SAMPLE, PIECE, PIECES, CONTENT_SHARE = 1500, 256, 3000, 0.5
MIN_WORDS, WINDOW, MAX_REPEAT = 20, 8, 30


@dataclass
class LineField:
    emit: np.ndarray  # features; score of boilerplate over content
    step: np.ndarray  # 2 x 2 transition scores

    def decode(self, x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Viterbi: 1 for boilerplate, for each line of each [bounds[i], bounds[i + 1])."""
        emitted = (x @ self.emit).tolist()
        (s00, s01), (s10, s11) = self.step.tolist()
        out = np.zeros(len(x), np.int8)
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if lo == hi:
                continue
            a, b, back = 0.0, emitted[lo], []
            for e in emitted[lo + 1 : hi]:
                from_a, from_b = a + s00 >= b + s10, a + s01 >= b + s11
                back.append((0 if from_a else 1, 0 if from_b else 1))
                a, b = (a + s00 if from_a else b + s10), (a + s01 if from_b else b + s11) + e
            state = int(b > a)
            out[hi - 1] = state
            for i in range(hi - 2, lo - 1, -1):
                state = back[i - lo][state]
                out[i] = state
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, bounds: np.ndarray, rounds: int = 150) -> None:
        """Gradient ascent on the conditional likelihood, sequences side by side."""
        length = np.diff(bounds)
        order = np.argsort(-length, kind="stable")
        lo, length = bounds[:-1][order], length[order]
        n, top = int(length.sum()), int(length.max())
        live = [int((length > t).sum()) for t in range(top)]
        pairs = np.zeros((2, 2))
        for t in range(1, top):
            np.add.at(pairs, (y[lo[: live[t]] + t - 1], y[lo[: live[t]] + t]), 1)
        m1 = [np.zeros_like(self.emit), np.zeros((2, 2))]
        m2 = [np.zeros_like(self.emit), np.zeros((2, 2))]
        for k in range(1, rounds + 1):
            e = np.column_stack([np.zeros(len(x)), x @ self.emit])
            forward = [e[lo]]
            for t in range(1, top):
                prev = forward[-1][: live[t]]
                forward.append(np.logaddexp(prev[:, :1] + self.step[0], prev[:, 1:] + self.step[1]) + e[lo[: live[t]] + t])
            back, mean, expect = np.zeros((live[top - 1], 2)), np.zeros(len(x)), np.zeros((2, 2))
            for t in range(top - 1, -1, -1):
                full = np.zeros((live[t], 2))
                if t + 1 < top:
                    nxt = e[lo[: live[t + 1]] + t + 1] + back
                    full[: live[t + 1]] = np.logaddexp(self.step[:, 0] + nxt[:, :1], self.step[:, 1] + nxt[:, 1:])
                    joint = forward[t][: live[t + 1], :, None] + self.step + nxt[:, None, :]
                    joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
                    expect += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(0)
                back = full
                both = forward[t] + back
                mean[lo[: live[t]] + t] = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -50, 50)))
            grads = [((y - mean) @ x) / n - 1e-4 * self.emit, (pairs - expect) / n - 1e-4 * self.step]
            for w, g, a, b in zip((self.emit, self.step), grads, m1, m2, strict=True):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                w += 0.2 * (a / (1 - 0.9**k)) / (np.sqrt(b / (1 - 0.99**k)) + 1e-8)


def _lines(data, offsets):
    w = Words.of(data, offsets, False)
    lines = Lines.of(w)
    has = lines.words > 0
    x = line_features(w, lines)[has]
    n_texts = len(offsets) - 1
    bounds = np.concatenate([[0], np.cumsum(np.bincount(lines.text[has], minlength=n_texts))])
    return w, lines, lines.words[has], x, bounds


def fit_field(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> LineField:
    field = LineField(np.zeros(len(LINE_FEATURES)), np.zeros((2, 2)))
    field.emit[0] = -1.0
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("label", pa.int32()), ("x", pa.binary())])

    def features(batches):
        for batch in batches:
            *_, x, bounds = _lines(*text_buffer(batch.column("text")))
            cuts = [(i, k, x[at : min(at + PIECE, hi)].astype(np.float32)) for i, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) for k, at in enumerate(range(lo, hi, PIECE))]
            row = pa.array([c[0] for c in cuts], pa.int64())
            yield arrow_rows(schema, doc_id=batch.column("doc_id").take(row), piece=[c[1] for c in cuts], label=batch.column("label").take(row), x=[c[2].tobytes() for c in cuts])

    sample = labelled_sample(docs, labels, "quality", F.lit(True), bound).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "label")
    sample = sample.mapInArrow(features, "doc_id long, piece int, label int, x binary").orderBy(F.xxhash64("doc_id", "piece"), "doc_id", "piece").limit(PIECES).collect()
    sample.sort(key=lambda r: (r["doc_id"], r["piece"]))
    if len({r["label"] for r in sample}) < 2:
        return field
    xs = [np.frombuffer(r["x"], np.float32).reshape(-1, len(LINE_FEATURES)).astype(float) for r in sample]
    bounds = np.concatenate([[0], np.cumsum([len(v) for v in xs])])
    doc = np.unique([r["doc_id"] for r in sample], return_inverse=True)[1]
    x, piece = np.concatenate(xs), np.repeat(np.arange(len(xs)), np.diff(bounds))
    bad = np.array([r["label"] == 0 for r in sample])[piece]
    owner = doc[piece]
    y = bad.astype(int)
    for _ in range(3):
        field.fit(x, y, bounds)
        score, y = x @ field.emit, field.decode(x, bounds).astype(int) * bad
        marked = np.bincount(owner, y) > 0
        order = np.lexsort((-score, owner))
        top = order[np.concatenate([[True], owner[order][1:] != owner[order][:-1]])]  # the most suspect line of each document
        y[top[bad[top] & ~marked[owner[top]]]] = 1
    return field


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"


def _judge(batches, field: LineField):
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
                       + [("base_failed", pa.bool_()), ("kept", pa.bool_()), ("content_share", pa.float64())])
    visible = np.array([not SPACE[i] and (i & 0xC0) != 0x80 for i in range(256)])
    for batch in batches:
        data, offsets = text_buffer(batch.column("text"))
        w, lines, words, x, bounds = _lines(data, offsets)
        label = field.decode(x, bounds)
        total = np.concatenate([[0], np.cumsum(words * (label == 0))])
        share = np.diff(total[bounds]) / np.maximum(w.n, 1)
        repeats = repeated_words(w, WINDOW)
        failed = (w.n < MIN_WORDS) | (100 * repeats > MAX_REPEAT * w.n)
        yield arrow_rows(schema, doc_id=batch.column("doc_id"), n_words=w.n, word_chars=counts(visible, data, offsets), n_symbols=counts(SYMBOL, data, offsets),
                         n_dup_lines=duplicate_lines(w, lines), n_repeat_words=repeats, base_failed=failed, kept=~failed & (share >= CONTENT_SHARE), content_share=share)


def line_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """-> the base counts, base_failed, kept and content_share of every document."""
    small_batches(docs.sparkSession)
    field = fit_field(docs, labels)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(partial(_judge, field=field), SCHEMA)
