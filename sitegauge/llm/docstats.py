"""Per-line and per-document statistics of a batch of texts, vectorised."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .words import SPACE, mix, shingles, span_hashes, split_words


def _flags(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


SYMBOL = _flags(b"#*$%&|<>")
UPPER = _flags(bytes(range(65, 91)))
DIGIT = _flags(b"0123456789")
MARK = _flags(b"!?")
STOP = _flags(b".,;:")
BAR = _flags(b"|")
HIGH = _flags(bytes(range(128, 256)))


def counts(table: np.ndarray, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many bytes of the table lie in each [bounds[i], bounds[i + 1])."""
    total = np.concatenate([[0], np.cumsum(table[data], dtype=np.int64)])
    return np.diff(total[bounds])


@dataclass
class Words:
    data: np.ndarray
    offsets: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    n: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray, lower: bool) -> Words:
        h, s, e, t = split_words(data, offsets, lower)
        return cls(data, offsets, h, s, e, t, np.bincount(t, minlength=len(offsets) - 1))


@dataclass
class Lines:
    bounds: np.ndarray  # n + 1; the newline belongs to its line
    text: np.ndarray
    words: np.ndarray
    of_word: np.ndarray

    @classmethod
    def of(cls, w: Words) -> Lines:
        """The \\n-split lines; lines of no bytes at the end of a text are left out."""
        ends = np.unique(np.concatenate([w.offsets, np.flatnonzero(w.data == 10) + 1]))
        starts = ends[:-1]
        text = np.searchsorted(w.offsets, starts, "right") - 1
        of_word = np.searchsorted(ends, w.starts, "right") - 1
        return cls(ends, text, np.bincount(of_word, minlength=len(starts)) if len(of_word) else np.zeros(len(starts), np.int64), of_word)


def duplicate_lines(w: Words, lines: Lines) -> np.ndarray:
    """Per text, lines with a word that equal an earlier line."""
    ends = lines.bounds[1:].copy()
    ends[(w.data[ends - 1] == 10)] -= 1
    has = np.flatnonzero(lines.words > 0)
    h = span_hashes(w.data, lines.bounds[has], ends[has], False)
    key = mix(h + mix(lines.text[has].astype(np.uint64)))
    _, first = np.unique(key, return_index=True)
    again = np.ones(len(has), bool)
    again[first] = False
    return np.bincount(lines.text[has][again], minlength=len(w.n))


def repeated_words(w: Words, k: int) -> np.ndarray:
    """Per text, words within k-word windows that occur twice or more in it."""
    n = len(w.hashes)
    if n < k:
        return np.zeros(len(w.n), np.int64)
    runs, bounds = shingles(w.hashes, w.text, len(w.n), k)
    made = np.diff(bounds)
    owner = np.repeat(np.arange(len(w.n)), made)
    first = np.concatenate([[0], np.cumsum(w.n)])[:-1]
    pos = np.arange(bounds[-1]) - bounds[owner] + first[owner]
    whole = w.n[owner] >= k
    runs, owner, pos = runs[whole], owner[whole], pos[whole]
    _, inverse, count = np.unique(mix(runs + mix(owner.astype(np.uint64))), return_inverse=True, return_counts=True)
    hit = pos[count[inverse] > 1]
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, hit, 1)
    np.subtract.at(cover, hit + k, 1)
    return np.bincount(w.text[np.cumsum(cover[:-1]) > 0], minlength=len(w.n))


def adjacent(w: Words) -> np.ndarray:
    """Whether each word equals the one before it in its text."""
    same = np.zeros(len(w.hashes), bool)
    same[1:] = (w.hashes[1:] == w.hashes[:-1]) & (w.text[1:] == w.text[:-1])
    return same


LINE_FEATURES = ("one", "symbols", "upper", "digits", "marks", "bars", "repeats", "stops", "log_words", "short")


def line_features(w: Words, lines: Lines) -> np.ndarray:
    size = np.maximum(np.diff(lines.bounds), 1)
    share = [np.minimum(counts(t, w.data, lines.bounds) / size * scale, 1) for t, scale in ((SYMBOL, 10), (UPPER, 1), (DIGIT, 2), (MARK, 10), (BAR, 10))]
    words = np.maximum(lines.words, 1)
    again = np.bincount(lines.of_word, weights=adjacent(w), minlength=len(size)) / words
    stops = counts(STOP, w.data, lines.bounds) / words
    return np.column_stack([np.ones(len(size)), *share, again, np.minimum(stops, 1), np.log1p(lines.words) / 5, lines.words <= 3])


STATISTICS = ("log_bytes", "log_words", "word_size", "symbols", "upper", "digits", "marks", "stops", "bars", "high", "adjacent",
              "distinct", "windows", "line_words", "dup_lines", "worst_symbols", "worst_upper", "worst_repeats")


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of STATISTICS for each text; an empty text gives zeros."""
    w = Words.of(data, offsets, True)
    lines = Lines.of(w)
    n_texts, size, words = len(w.n), np.maximum(np.diff(offsets), 1), np.maximum(w.n, 1)
    share = {name: counts(t, data, offsets) / size for name, t in
             (("symbols", SYMBOL), ("upper", UPPER), ("digits", DIGIT), ("marks", MARK), ("stops", STOP), ("bars", BAR), ("high", HIGH), ("space", SPACE))}
    key = np.unique(mix(w.hashes + mix(w.text.astype(np.uint64))), return_index=True)[1]
    distinct = np.bincount(w.text[key], minlength=n_texts) / words
    again = np.bincount(w.text, weights=adjacent(w), minlength=n_texts) / words
    n_lines = np.maximum(np.bincount(lines.text[lines.words > 0], minlength=n_texts), 1)
    f = line_features(w, lines)
    worst = []
    for column in (1, 2, 6):
        top = np.zeros(n_texts)
        np.maximum.at(top, lines.text, f[:, column] * (lines.words > 2))
        worst.append(top)
    return np.column_stack([
        np.log1p(np.diff(offsets)), np.log1p(w.n), (1 - share["space"]) * size / words / 10, share["symbols"], share["upper"], share["digits"],
        share["marks"], share["stops"], share["bars"], share["high"], again, distinct, repeated_words(w, 8) / words, np.log1p(w.n / n_lines),
        duplicate_lines(w, lines) / n_lines, *worst])
