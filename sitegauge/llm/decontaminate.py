"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into passages of at most LONGEST words (runs of bytes
other than white space and ASCII punctuation, A-Z and U+00C0-U+00DE lower-cased):

1. Document frequencies of all passages' words over all documents, from one
   pass, give the weights ln(1 + N / df), N rows.
2. Passages are taken in blocks of about BLOCK, so what a task holds has a fixed
   bound.  Randomised SVD of a block's TF-IDF matrix: passages times a Gaussian
   sketch, the sketch's Gram matrix and its product with the passages summed by
   Spark.
3. Every document is read in overlapping windows, in one of three widths for
   short, middle and long passages, so that some window holds a whole copy.
   A window can only match a passage of which it holds a signature word: of its
   rarest words those that weigh so much that no match does without all of them.
   Windows without any signature word, or whose known words weigh too little,
   are passed over (no match is lost); the rest are mapped to the latent space, and
   passages at cosine COSINE or more are candidates.  So are all of which the
   window's words weigh PARAPHRASE or more: a bound no match stays under, so
   whatever the cosine refuses is found too, however many passages a block has.
4. A candidate matches if the longest common subsequence with the window, by
   weight, is COPY of the passage, or PARAPHRASE of it and as much of its
   answer (column answer if there is one, else the passage's last third).
   A passage of fewer than SHORT words must be there whole.

Results: one row per document id and item that leaked into it (doc_id, item_id,
share, at_word of the best window); clean, null and empty texts give none, nor
do null or wordless items.  Rows that repeat an id are taken together; of windows
with equal shares the first is named.  Texts are read whole, however long.
keep_clean gives the documents, all columns, without those that match; a
document with a null id is judged by its text alone.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_rows, in_bitmap, slot_bitmap, small_batches
from .words import BLANK, fold_case, mix, split_words, text_buffer

LONGEST, BLOCK, SHORT, RANK = 64, 4096, 8, 96
COSINE, COPY, PARAPHRASE = 0.6, 0.85, 0.6
FLUSH = 1 << 18  # pairs that a task of the frequency pass holds
FREQUENT = 128  # words whose weights are a dense table in Overlap
WIDTHS = ((16, 24, 4), (32, 48, 8), (LONGEST, 96, 16))  # longest passage, window, step


def _words(column):
    data, offsets = text_buffer(column)
    hashes, _, _, text = split_words(fold_case(BLANK[data]), offsets)
    return hashes, text, np.bincount(text, minlength=len(offsets) - 1)


PASSAGE = "item_id long, part int, words array<long>, answer array<long>"


def _passages(batches):
    schema = pa.schema([("item_id", pa.int64()), ("part", pa.int32()), ("words", pa.list_(pa.int64())), ("answer", pa.list_(pa.int64()))])
    for batch in batches:
        hashes, _, count = _words(batch.column("text"))
        answers, _, n_answer = _words(batch.column("answer"))
        out = {k: [] for k in schema.names}
        at, answer_at = 0, 0
        for item, n, m in zip(batch.column("item_id").to_pylist(), count.tolist(), n_answer.tolist(), strict=True):
            parts = -(-n // LONGEST)
            for k in range(parts):
                words = hashes[at + k * n // parts : at + (k + 1) * n // parts].view(np.int64)
                out["item_id"].append(item)
                out["part"].append(k)
                out["words"].append(words)
                out["answer"].append(answers[answer_at : answer_at + m].view(np.int64) if m else words[-(-2 * len(words) // 3) :])
            at, answer_at = at + n, answer_at + m
        yield arrow_rows(schema, **out)


class Overlap:
    """Weight of each passage's words that a window holds, which no common subsequence exceeds."""

    def __init__(self, passages: list[np.ndarray], weights: np.ndarray):
        self.n, n_words = len(passages), len(weights)
        pair, tf = np.unique(np.concatenate([p * self.n + i for i, p in enumerate(passages)]), return_counts=True)
        word, passage = pair // self.n, pair % self.n
        value = (tf * weights[word]).astype(np.float32)
        often = np.argsort(-np.bincount(word, minlength=n_words), kind="stable")[:FREQUENT]
        self.column = np.full(n_words, -1)
        self.column[often] = np.arange(len(often))
        self.dense = np.zeros((len(often), self.n), np.float32)
        at = self.column[word]
        self.dense[at[at >= 0], passage[at >= 0]] = value[at >= 0]
        self.passage, self.value = passage[at < 0], value[at < 0]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(word[at < 0], minlength=n_words))])

    def of(self, windows: np.ndarray, unknown: int) -> np.ndarray:
        held = np.sort(windows, 1)
        new = held != unknown
        new[:, 1:] &= held[:, 1:] != held[:, :-1]
        row, at = np.nonzero(new)
        word = held[row, at]
        column = self.column[word]
        flags = np.zeros((len(windows), len(self.dense)), np.float32)
        flags[row[column >= 0], column[column >= 0]] = 1
        row, word = row[column < 0], word[column < 0]
        n = self.first[word + 1] - self.first[word]
        post = np.repeat(self.first[word] - np.cumsum(n) + n, n) + np.arange(n.sum())
        rest = np.bincount(np.repeat(row, n) * self.n + self.passage[post], self.value[post], len(windows) * self.n)
        return flags @ self.dense + rest.reshape(len(windows), self.n)


@dataclass
class Latent:
    """A block of passages and, once filled in, the weights and vectors of its words."""

    item: np.ndarray
    passages: list[np.ndarray]
    answers: list[np.ndarray]
    words: np.ndarray
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    vector: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    @classmethod
    def of(cls, rows) -> Latent:
        rows = sorted(rows, key=lambda r: (r["item_id"], r["part"]))
        grams = [np.array(r["words"], np.int64).view(np.uint64) for r in rows]
        words = np.unique(np.concatenate(grams))
        number = lambda g: np.searchsorted(words, g)
        answers = []
        for r in rows:
            a = np.array(r["answer"] or [], np.int64).view(np.uint64)
            answers.append(number(a[np.isin(a, words)]))
        return cls(np.array([r["item_id"] for r in rows], np.int64), [number(g) for g in grams], answers, words)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Each word's number, or len(words) for an unknown one."""
        at = np.searchsorted(self.words, hashes).clip(max=len(self.words) - 1)
        return np.where(self.words[at] == hashes, at, len(self.words))

    def prepare(self) -> None:
        """Padded tables for search, made where the search runs; an unknown word weighs nothing."""
        n = len(self.words)
        self.weights = np.append(self.weight, 0).astype(np.float32)
        self.scaled = np.vstack([self.vector * self.weight[:, None], np.zeros((1, self.vector.shape[1]))]).astype(np.float32)
        size = np.array([len(p) for p in self.passages])
        self.total = np.array([self.weights[p].sum() for p in self.passages])
        self.need = self.total * np.where(size < SHORT, 0.999, PARAPHRASE * 0.999)  # the least weight that a match shares
        self.padded = np.full((len(size), LONGEST), -1)
        self.asked = np.full((len(size), max([LONGEST, *map(len, self.answers)])), -1)
        for i, (p, a) in enumerate(zip(self.passages, self.answers, strict=True)):
            self.padded[i, : len(p)] = p
            self.asked[i, : len(a)] = a
        point = np.stack([self.scaled[p].sum(0) for p in self.passages])
        self.point = point / np.maximum(np.linalg.norm(point, axis=1, keepdims=True), 1e-9)
        low = 0
        self.classes = []
        for longest, width, step in WIDTHS:
            own = np.flatnonzero((size > low) & (size <= longest))
            if len(own):
                self.classes.append((own, width, step, self.need[own].min(), self.signature(own), Overlap([self.passages[i] for i in own], self.weights)))
            low = longest
        self.size, self.unknown = size, n

    def signature(self, own: np.ndarray) -> np.ndarray:
        """Marks the rarest words of each passage that together weigh more than a match may lack."""
        marked = np.zeros(len(self.weights), bool)
        for i in own:
            word, tf = np.unique(self.passages[i], return_counts=True)
            weight = self.weights[word] * tf
            order = np.argsort(-self.weights[word], kind="stable")
            spare = self.total[i] - self.need[i]
            marked[word[order[: int(np.searchsorted(np.cumsum(weight[order]), spare * 1.001, "right")) + 1]]] = True
        return marked

    def common(self, windows: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Weight of the longest common subsequence of each window with its target, pair by pair."""
        best = np.zeros((len(windows), targets.shape[1] + 1), np.float32)
        for t in range(windows.shape[1]):
            w = windows[:, t]
            match = (targets == w[:, None]) * self.weights[w][:, None]
            step = best.copy()
            step[:, 1:] = np.maximum(best[:, 1:], best[:, :-1] + match)
            best = np.maximum.accumulate(step, 1)
        return best[:, -1]

    def find(self, column):
        """(row, passage, share, word) of every match."""
        hashes, text, count = _words(column)
        number = self.numbers(hashes)
        first = np.cumsum(count) - count
        mass = np.concatenate([[0], np.cumsum(self.weights[number], dtype=np.float64)])
        out = []
        for own, width, step, least, signature, overlap in self.classes:
            marks = np.concatenate([[0], np.cumsum(signature[number])])
            n_windows = np.where(count > 0, np.maximum(-(-(count - width) // step), 0) + 1, 0)
            row = np.repeat(np.arange(len(count)), n_windows)
            nth = np.arange(n_windows.sum()) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
            start = first[row] + np.maximum(np.minimum(nth * step, count[row] - width), 0)
            stop = np.minimum(start + width, first[row] + count[row])
            alive = np.flatnonzero((mass[stop] - mass[start] >= least) & (marks[stop] > marks[start]))
            for lo in range(0, len(alive), 512):
                part = alive[lo : lo + 512]
                at = start[part][:, None] + np.arange(width)
                window = np.where(at < stop[part][:, None], number[np.minimum(at, max(len(number) - 1, 0))], self.unknown)
                point = self.scaled[window].sum(1)
                cosine = point @ self.point[own].T / np.maximum(np.linalg.norm(point, axis=1, keepdims=True), 1e-9)
                w, p = np.nonzero((cosine >= COSINE) | (overlap.of(window, self.unknown) >= self.need[own]))
                for cut in range(0, len(w), 2048):
                    out += self._check(row[part], start[part] - first[row[part]], window, w[cut : cut + 2048], own[p[cut : cut + 2048]])
        return out

    def _check(self, row, word, window, w, p):
        enough = (self.weights[window].sum(1))[w] >= self.need[p]
        w, p = w[enough], p[enough]
        share = self.common(window[w], self.padded[p]) / np.maximum(self.total[p], 1e-9)
        sure = share >= np.where(self.size[p] < SHORT, 0.999, COPY)
        maybe = np.flatnonzero(~sure & (share >= PARAPHRASE) & (self.size[p] >= SHORT))
        if len(maybe):
            whole = np.array([self.weights[self.answers[i]].sum() for i in p[maybe]])
            sure[maybe] = self.common(window[w[maybe]], self.asked[p[maybe]]) >= PARAPHRASE * whole
        return [(int(row[a]), int(b), float(s), int(word[a])) for a, b, s in zip(w[sure], p[sure], share[sure], strict=True)]


def _frequencies(batches, bits: np.ndarray):
    """(word, documents) of the words whose slots the bitmap holds, and (null, rows); partial sums."""
    held, size, rows = [], 0, 0
    schema = pa.schema([("word", pa.int64()), ("n", pa.int64())])

    def summed():
        word, n = np.unique(np.concatenate(held), return_counts=True)
        return arrow_rows(schema, word=word.view(np.int64), n=n)

    for batch in batches:
        hashes, text, _ = _words(batch.column("text"))
        known = in_bitmap(bits, hashes)
        word, number = np.unique(hashes[known], return_inverse=True)
        pair = np.unique(text[known] * np.int64(max(len(word), 1)) + number)
        held.append(word[pair % max(len(word), 1)])
        size, rows = size + len(pair), rows + len(batch)
        if size > FLUSH:
            yield summed()
            held, size = [], 0
    if held:
        yield summed()
    yield arrow_rows(schema, word=[None], n=[rows])


def _sketch(words: np.ndarray) -> np.ndarray:
    """Gaussian numbers that follow from each word's hash."""
    h = mix(words[:, None] + np.arange(1, 2 * RANK + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    u = ((h >> np.uint64(11)).astype(np.float64) + 0.5) / 2**53
    return np.sqrt(-2 * np.log(u[:, :RANK])) * np.cos(2 * np.pi * u[:, RANK:])


def _products(batches, words: np.ndarray, weight: np.ndarray):
    """Of the partition's rows Y = A S: the sums Y'Y (row -1 - i) and Y'A (a column for each word)."""
    gram, cross = np.zeros((RANK, RANK)), {}
    for batch in batches:
        for passage in batch.column("words").to_pylist():
            word, tf = np.unique(np.searchsorted(words, np.array(passage, np.int64).view(np.uint64)), return_counts=True)
            a = tf * weight[word]
            a = a / max(np.linalg.norm(a), 1e-9)
            y = a @ _sketch(words[word])
            gram += np.outer(y, y)
            for j, v in zip(word.tolist(), a, strict=True):
                cross[j] = cross.get(j, 0) + v * y
    keys = [-1 - i for i in range(RANK)] + list(cross)
    yield arrow_rows(pa.schema([("word", pa.int64()), ("v", pa.list_(pa.float64()))]), word=keys, v=[*gram, *cross.values()])


def fit_block(passages: DataFrame, frequency: DataFrame, n_docs: int) -> Latent:
    """Weights and latent vectors of one block of passages (about BLOCK).  frequency: word, n."""
    model = Latent.of(passages.collect())
    df = np.zeros(len(model.words))
    words = passages.select(F.explode("words").alias("word")).distinct()
    for r in words.join(frequency, "word").collect():
        df[np.searchsorted(model.words, np.array(r["word"]).view(np.uint64))] = r["n"]
    model.weight = np.log(1 + max(n_docs, 1) / np.maximum(df, 1))
    rows = passages.repartition(4).mapInArrow(partial(_products, words=model.words, weight=model.weight), "word long, v array<double>").select(
        "word", F.posexplode("v").alias("i", "v")).groupBy("word", "i").agg(F.sum("v").alias("v")).groupBy("word").agg(F.array_sort(F.collect_list(F.struct("i", "v")))["v"].alias("v")).collect()
    gram, cross = np.zeros((RANK, RANK)), np.zeros((len(model.words), RANK))
    for r in rows:
        (gram if r["word"] < 0 else cross)[-1 - r["word"] if r["word"] < 0 else r["word"]] = r["v"]
    # A's projection on the sketch's range is B = gram^-1/2 cross'; its right singular vectors span the latent space
    value, base = np.linalg.eigh(gram)
    use = value > max(value[-1], 1e-12) * 1e-9
    b = cross @ (base[:, use] / np.sqrt(value[use]))
    value, turn = np.linalg.eigh(b.T @ b)
    use = value > max(value[-1], 1e-12) * 1e-9
    model.vector = (b @ (turn[:, use] / np.sqrt(value[use]))).astype(np.float32)
    return model


def _blocks(docs: DataFrame, benchmark: DataFrame):
    """The fitted model of each block of passages."""
    scratch = Scratch(docs.sparkSession)
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit("")
    items = benchmark.filter(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text", F.coalesce(answer, F.lit("")).alias("answer"))
    passages = scratch.save(items.mapInArrow(_passages, PASSAGE).filter("item_id is not null"), "passages")
    blocks = -(-passages.count() // BLOCK)
    if not blocks:
        return
    bits = slot_bitmap(passages.select(F.explode("words").alias("v")))
    counts = scratch.save(docs.select("text").mapInArrow(partial(_frequencies, bits=bits), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "frequencies")
    n_docs = counts.filter("word is null").first()["n"]
    for k in range(blocks):
        yield fit_block(passages.filter(F.pmod(F.xxhash64("item_id", "part"), F.lit(blocks)) == k), counts, n_docs)


def _matches(batches, model: Latent):
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("share", pa.float64()), ("at_word", pa.int64())])
    model.prepare()
    for batch in batches:
        best = {}
        for row, passage, share, at in model.find(batch.column("text")):
            key = row, int(model.item[passage])
            best[key] = max(best.get(key, (0.0, 0)), (share, -at))
        if best:
            ids = batch.column("doc_id").to_pylist()
            yield arrow_rows(schema, doc_id=[ids[r] for r, _ in best], item_id=[i for _, i in best], share=[s for s, _ in best.values()], at_word=[-a for _, a in best.values()])


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """-> doc_id, item_id, share, at_word."""
    spark = docs.sparkSession
    small_batches(spark, 256, "1m")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = spark.createDataFrame([], "doc_id long, item_id long, share double, at_word long")
    for model in _blocks(docs, benchmark):
        out = out.unionByName(docs.mapInArrow(partial(_matches, model=model), "doc_id long, item_id long, share double, at_word long"))
    best = F.max(F.struct("share", (-F.col("at_word")).alias("at"))).alias("b")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", F.round("b.share", 6).alias("share"), (-F.col("b.at")).alias("at_word"))


def _clean(batches, model: Latent):
    model.prepare()
    for batch in batches:
        keep = np.ones(len(batch), bool)
        keep[[m[0] for m in model.find(batch.column("text"))]] = False
        yield batch.filter(pa.array(keep))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, all columns, that hold no benchmark item."""
    small_batches(docs.sparkSession, 256, "1m")
    for model in _blocks(docs, benchmark):
        docs = docs.mapInArrow(partial(_clean, model=model), docs.schema)
    return docs
