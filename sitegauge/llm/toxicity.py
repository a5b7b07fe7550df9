"""Toxicity: a bidirectional gated recurrent network with attention pooling.

Words are runs of bytes other than white space and ASCII punctuation, A-Z
lower-cased.  A word's input joins a word part (a hashed embedding and the
log-odds of its occurrence in toxic training texts) and a character part (the
mean of hashed byte-trigram embeddings and the highest log-odds of its opening
characters, 3 to 8 bytes).  Two GRUs read each window of WINDOW
words forwards and backwards, attention pools their states, and a text's score
is that of its highest window; windows overlap by half and cover every word.

Trained in numpy by back-propagation through the highest window of each text.
The sample is bounded: SAMPLE labelled texts by hash of the id, in pieces of
LONGEST characters that keep their text's number, and of the pieces PIECES by
hash of id and place.  Log-odds in training leave the text's own count out.  All
documents are scored whole.

Results: one row per document row.  Null, empty and wordless texts score 0.  A
null id counts as not held out.  Without both labels in the sample every score
is 0.  A score of exactly 0.5 counts as toxic.  Equal texts score alike.  Other
columns of the input are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, fold, labelled_sample, small_batches
from .words import BLANK, LOWER, mix, split_words, text_buffer

SAMPLE, LONGEST, PIECES = 5000, 4000, 8000
WINDOW, HIDDEN, EMBED, WORD_SLOTS, GRAM_SLOTS = 16, 8, 4, 1 << 12, 1 << 11
ROUNDS, STEPS, RATE = 6, 15, 0.02
OPENINGS, RARE = range(3, 9), 4


def windows(n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start word (within its text) and text of every window; steps of half a window."""
    half = WINDOW // 2
    count = np.where(n_words > 0, np.maximum(-(-(n_words - WINDOW) // half), 0) + 1, 0)
    text = np.repeat(np.arange(len(n_words)), count)
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.maximum(np.minimum(nth * half, n_words[text] - WINDOW), 0), text


class Vocabulary:
    """The distinct words of a batch: word slots, trigram slots, and each word's number."""

    def __init__(self, column):
        data, offsets = text_buffer(column)
        self.n_texts = len(offsets) - 1
        data = BLANK[data]
        hashes, starts, ends, self.text = split_words(data, offsets)
        self.hashes, first, self.number = np.unique(hashes, return_index=True, return_inverse=True)
        self.n_words = np.bincount(self.text, minlength=self.n_texts)
        self.slot = (self.hashes % np.uint64(WORD_SLOTS)).astype(np.int64)
        s, size = starts[first], (ends - starts)[first]
        grams = np.maximum(size - 2, 1)
        self.gram_at = np.cumsum(grams) - grams
        owner = np.repeat(np.arange(len(grams)), grams)
        pos = s[owner] + np.arange(grams.sum()) - self.gram_at[owner]
        stop = (s + size)[owner]
        low = LOWER[data] if len(data) else data
        code = np.zeros(len(pos), np.int64)
        for k in range(3):
            at = pos + k
            code = code * 263 + np.where(at < stop, low[np.minimum(at, max(len(low) - 1, 0))], 0)
        self.gram = code % GRAM_SLOTS
        self.gram_word, self.grams = owner, grams
        code, opening = np.zeros(len(s), np.uint64), []
        for k in range(max(OPENINGS)):
            at = np.minimum(s + k, max(len(low) - 1, 0))
            code = mix(code + low[at] + np.uint64(1)) if len(s) else code
            if k + 1 in OPENINGS:
                opening.append(np.where(size > k, code, np.uint64(0)))
        self.opening = np.stack(opening, 1)  # words x lengths; 0 where the word is shorter

    def subset(self, used: np.ndarray) -> Vocabulary:
        """The word and trigram slots of some words only."""
        part = object.__new__(Vocabulary)
        part.hashes, part.slot, part.grams = self.hashes[used], self.slot[used], self.grams[used]
        part.gram_at = np.cumsum(part.grams) - part.grams
        part.gram_word = np.repeat(np.arange(len(used)), part.grams)
        part.gram = self.gram[np.arange(part.grams.sum()) - part.gram_at[part.gram_word] + self.gram_at[used][part.gram_word]]
        return part

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of every window (len(hashes) pads), and its text."""
        start, text = windows(self.n_words)
        first = np.cumsum(self.n_words) - self.n_words
        at = start[:, None] + np.arange(WINDOW)
        inside = at < self.n_words[text][:, None]
        flat = np.minimum(first[text][:, None] + at, max(len(self.number) - 1, 0))
        pad = len(self.hashes)
        return (np.where(inside, self.number[flat], pad) if len(self.number) else np.zeros((0, WINDOW), np.int64)), text


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class ToxicityNet:
    def __init__(self, seed: int = 7):
        draw = np.random.default_rng(seed)
        size = 2 + 2 * EMBED
        normal = lambda *s: (draw.normal(size=s) * 0.3).astype(np.float32)
        self.p = {"word": normal(WORD_SLOTS, EMBED) / 3, "gram": normal(GRAM_SLOTS, EMBED) / 3, "att": normal(2 * HIDDEN), "out": normal(2 * HIDDEN), "bias": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"w{d}": normal(size, 3 * HIDDEN), f"u{d}": normal(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.word_odds = self.opening_odds = (np.zeros(1, np.uint64), np.zeros(1, np.float32))
        self.ready = False

    def log_odds(self, v: Vocabulary) -> np.ndarray:
        """Of each word, and the highest of its openings."""

        def of(table, keys):
            at = np.searchsorted(table[0], keys).clip(max=len(table[0]) - 1)
            return np.where(table[0][at] == keys, table[1][at], np.float32(0))

        return np.stack([of(self.word_odds, v.hashes), of(self.opening_odds, v.opening).max(1)], 1)

    def inputs(self, v: Vocabulary, odds: np.ndarray) -> np.ndarray:
        """One row for each word of the vocabulary, and a zero row for padding."""
        x = np.zeros((len(v.hashes) + 1, 2 + 2 * EMBED), np.float32)
        if len(v.hashes):
            x[:-1, :2] = odds / 3
            x[:-1, 2 : 2 + EMBED] = self.p["word"][v.slot]
            x[:-1, 2 + EMBED :] = np.add.reduceat(self.p["gram"][v.gram], v.gram_at) / v.grams[:, None]
        return x

    def _run(self, gates: np.ndarray, rows: np.ndarray, u: np.ndarray, keep: list | None):
        h = np.zeros((len(rows), HIDDEN), np.float32)
        out = []
        for t in range(rows.shape[1]):
            g, hu = gates[rows[:, t]], h @ u
            zr = _sigmoid(g[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(g[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
            if keep is not None:
                keep.append((h, z, r, n, hu[:, 2 * HIDDEN :]))
            h = n + z * (h - n)
            out.append(h)
        return out

    def forward(self, x: np.ndarray, rows: np.ndarray, keep: dict | None = None) -> np.ndarray:
        states = {}
        for d in "fb":
            steps = [] if keep is not None else None
            run = self._run(x @ self.p[f"w{d}"] + self.p[f"c{d}"], rows if d == "f" else rows[:, ::-1], self.p[f"u{d}"], steps)
            states[d] = np.stack(run if d == "f" else run[::-1], 1)
            if keep is not None:
                keep[d] = steps
        h = np.concatenate([states["f"], states["b"]], 2)
        a = h @ self.p["att"]
        a = np.where(rows == len(x) - 1, np.float32(-1e9), a)
        a = np.exp(a - a.max(1, keepdims=True))
        a /= a.sum(1, keepdims=True)
        pooled = np.einsum("bt,bth->bh", a, h)
        if keep is not None:
            keep |= {"h": h, "a": a, "pooled": pooled}
        return pooled @ self.p["out"] + self.p["bias"][0]

    def gradients(self, v: Vocabulary, x: np.ndarray, rows: np.ndarray, keep: dict, d_logit: np.ndarray) -> dict:
        h, a = keep["h"], keep["a"]
        g = {"out": keep["pooled"].T @ d_logit, "bias": np.array([d_logit.sum()])}
        d_pool = d_logit[:, None] * self.p["out"]
        d_a = np.einsum("bh,bth->bt", d_pool, h)
        d_score = a * (d_a - (a * d_a).sum(1, keepdims=True))
        d_h = a[:, :, None] * d_pool[:, None, :] + d_score[:, :, None] * self.p["att"]
        g["att"] = np.einsum("bt,bth->h", d_score, h)
        d_x = np.zeros_like(x)
        for d, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
            order = range(WINDOW - 1, -1, -1)
            u, w = self.p[f"u{d}"], self.p[f"w{d}"]
            g_gates = np.zeros((len(x), 3 * HIDDEN), np.float32)
            g_u, carry = np.zeros_like(u), np.zeros((len(rows), HIDDEN), np.float32)
            for k in order:
                t = k if d == "f" else WINDOW - 1 - k
                h0, z, r, n, hn = keep[d][k]
                dh = carry + d_h[:, t, part]
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (h0 - n) * z * (1 - z)
                dr = dn * hn * r * (1 - r)
                gate = np.concatenate([dz, dr, dn], 1)
                inner = np.concatenate([dz, dr, dn * r], 1)
                np.add.at(g_gates, rows[:, t], gate)
                g_u += h0.T @ inner
                carry = dh * z + inner @ u.T
            g |= {f"u{d}": g_u, f"c{d}": g_gates.sum(0), f"w{d}": x.T @ g_gates}
            d_x += g_gates @ w.T
        g["word"], g["gram"] = np.zeros_like(self.p["word"]), np.zeros_like(self.p["gram"])
        np.add.at(g["word"], v.slot, d_x[:-1, 2 : 2 + EMBED])
        np.add.at(g["gram"], v.gram, (d_x[:-1, 2 + EMBED :] / v.grams[:, None])[v.gram_word])
        return g

    def fit(self, pieces: list[str], owner: np.ndarray, label: np.ndarray) -> None:
        """pieces of texts, the number of each one's text, and the texts' labels."""
        v = Vocabulary(pa.array(pieces, pa.large_string()))
        label = np.asarray(label, np.float32)
        n_texts, own_text = len(label), np.asarray(owner)
        t, c = max(label.sum(), 1), max((1 - label).sum(), 1)

        def odds(toxic, clean):
            prior = np.log(t / c)
            return np.where(toxic + clean >= RARE, np.log((toxic + 2 * t / (t + c)) / (clean + 2 * c / (t + c))) - prior, 0).astype(np.float32)

        def table(number, n):
            """Toxic and clean texts of each of n keys, from (key, text) pairs."""
            pair = np.unique(number.astype(np.int64) * n_texts + texts)
            toxic = np.bincount(pair // n_texts, weights=label[pair % n_texts], minlength=n)
            return toxic, np.bincount(pair // n_texts, minlength=n) - toxic

        texts = own_text[v.text]
        w = table(v.number, len(v.hashes))
        self.word_odds = self._frequent(v.hashes, odds(*w), w[0] + w[1])
        # words of clean texts leave one clean text out, words of toxic texts one toxic text
        less = lambda x: np.maximum(x - 1, 0)
        x = [np.stack([odds(w[0], less(w[1])), np.zeros(len(v.hashes))], 1), np.stack([odds(less(w[0]), w[1]), np.zeros(len(v.hashes))], 1)]
        keys, values, found = [], [], []
        for k in range(v.opening.shape[1]):
            code, number = np.unique(v.opening[:, k], return_inverse=True)
            o = table(number[v.number], len(code))
            plain, zero = odds(*o), code == 0
            plain[zero] = 0
            part = self._frequent(code[~zero], plain[~zero], (o[0] + o[1])[~zero])
            keys.append(part[0])
            values.append(part[1])
            for side, value in enumerate((odds(o[0], less(o[1])), odds(less(o[0]), o[1]))):
                value[zero] = 0
                x[side][:, 1] = np.maximum(x[side][:, 1], value[number])
        keys, values = np.concatenate(keys), np.concatenate(values)
        order = np.argsort(keys)
        self.opening_odds = keys[order], values[order]
        rows, text = v.rows()
        text = own_text[text]
        pad = len(v.hashes)
        weight = np.where(label == 1, 0.3 / t, 0.7 / c).astype(np.float32) * len(label)
        first = {k: np.zeros_like(w) for k, w in self.p.items()}
        second = {k: np.zeros_like(w) for k, w in self.p.items()}
        step = 0
        for _ in range(ROUNDS):
            top = self._highest([self.inputs(v, odd) for odd in x], label, rows, text)
            used, own = np.unique(rows[top], return_inverse=True)
            used, own, y = used[used < pad], own.reshape(len(top), WINDOW), label[text[top]]
            part = v.subset(used)
            for _ in range(STEPS):
                step += 1
                total = None
                for side in (0, 1):
                    pick = y == side
                    inputs, keep = self.inputs(part, x[side][used]), {}
                    logit = self.forward(inputs, own[pick], keep)
                    d_logit = ((_sigmoid(logit) - side) * weight[text[top][pick]] / len(label)).astype(np.float32)
                    g = self.gradients(part, inputs, own[pick], keep, d_logit)
                    total = g if total is None else {k: total[k] + g[k] for k in g}
                for k, w in self.p.items():
                    gk = total[k] + 1e-4 * w
                    first[k] += 0.1 * (gk - first[k])
                    second[k] += 0.01 * (gk * gk - second[k])
                    w -= (RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        self.ready = True

    @staticmethod
    def _frequent(keys, odds, count):
        """Sorted keys in RARE training texts or more; one key that matches nothing else."""
        keep = count >= RARE
        keys, odds = np.append(keys[keep], np.uint64(0)), np.append(odds[keep], np.float32(0))
        order = np.argsort(keys)
        return keys[order], odds[order]

    def _highest(self, xs, label, rows, text) -> np.ndarray:
        """The highest window of each text that has one."""
        logit = np.empty(len(rows), np.float32)
        for side in (0, 1):
            pick = np.flatnonzero(label[text] == side)
            for lo in range(0, len(pick), 4096):
                part = pick[lo : lo + 4096]
                logit[part] = self.forward(xs[side], rows[part])
        order = np.lexsort((-logit, text))
        return order[np.concatenate([[True], text[order][1:] != text[order][:-1]])] if len(order) else order

    def score(self, column) -> np.ndarray:
        v = Vocabulary(column)
        best = np.full(v.n_texts, -np.inf, np.float32)
        if self.ready and len(v.hashes):
            rows, text = v.rows()
            x = self.inputs(v, self.log_odds(v))
            for lo in range(0, len(rows), 2048):
                np.maximum.at(best, text[lo : lo + 2048], self.forward(x, rows[lo : lo + 2048]))
        return _sigmoid(best.astype(np.float64))


def _score(batches, net: ToxicityNet):
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
    with np.errstate(over="ignore"):
        for batch in batches:
            yield arrow_rows(schema, doc_id=batch.column("doc_id"), score=net.score(batch.column("text")))


def toxicity_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """-> doc_id, held_out, score, predicted, for every document."""
    small_batches(docs.sparkSession, 512, "2m")
    sample = labelled_sample(docs, labels, "toxic", fold(F.col("_id"), folds) != held, SAMPLE)
    at = F.sequence(F.lit(0), F.greatest(F.ceil(F.length("text") / LONGEST) - 1, F.lit(0)).cast("int"))
    pieces = sample.select("doc_id", "label", F.posexplode(F.transform(at, lambda i: F.substr("text", i * LONGEST + 1, F.lit(LONGEST)))).alias("place", "piece"))
    pieces = pieces.orderBy(F.xxhash64("doc_id", "place"), "doc_id", "place").limit(PIECES).collect()
    pieces.sort(key=lambda r: (r["doc_id"], r["place"]))
    label = {r["doc_id"]: r["label"] for r in pieces}
    number = {k: i for i, k in enumerate(label)}
    net = ToxicityNet()
    if len(set(label.values())) == 2:
        net.fit([r["piece"] for r in pieces], np.array([number[r["doc_id"]] for r in pieces]), np.array(list(label.values())))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(partial(_score, net=net), "doc_id long, score double")
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))
