"""Repeated substrings against brute force."""

import hashlib
import random

import numpy as np
import pytest

from sitegauge.llm import suffix_dedup as sd
from sitegauge.llm.queries import op4_suffix_dedup

WORDS = ["lorem", "ipsum", "dolor", "sit", "ämet", "zz", "ab", "aa"]


def brute(texts):
    seen, out = {}, []
    for t in texts:
        b = (t or "").encode()
        for i in range(len(b) - sd.WINDOW + 1):
            w = b[i : i + sd.WINDOW]
            seen[w] = seen.get(w, 0) + 1
    for t in texts:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, np.int8)
        for i in range(len(b) - sd.WINDOW + 1):
            if seen[b[i : i + sd.WINDOW]] > 1:
                gone[i : i + sd.WINDOW] = 1
        kept = bytes(c for c, g in zip(b, gone, strict=False) if not g)
        runs = int((np.diff(np.concatenate([[0], gone])) == 1).sum())
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def fixture():
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(1000)) for _ in range(n))
    passage, other = say(120), say(90)
    texts = [None, "", "short", "a" * 900, "ab" * 700, passage, passage, say(50) + passage + say(60), other[:399], "x" + other[:500] + say(10), say(30) + other[:450]]
    texts += [say(20) + passage[:520] + say(20) for _ in range(140)]
    near = say(400)
    texts += [near[:i] + "#" + near[i + 1 :] for i in range(100, 2000, 300)]
    return texts


@pytest.mark.parametrize("hot", [200, 2])
def test_matches_brute_force(spark, tmp_path, monkeypatch, hot):
    monkeypatch.setattr(sd, "HOT", hot)
    texts = fixture()
    rows = [(i // 2 if i < 4 else i, t, "x") for i, t in enumerate(texts)] + [(None, texts[7], "x")]
    spark.createDataFrame(rows, "doc_id long, text string, h string").write.parquet(f"{tmp_path}/documents.parquet")
    out = op4_suffix_dedup(spark, str(tmp_path)).collect()
    assert all(r["has_repeats"] == (r["n_removed"] > 0) and r["n_removed"] == sum(int(s.split("-")[1]) - int(s.split("-")[0]) for s in r["spans"].split(",") if s) for r in out)
    got = sorted((tuple(r)[:5] for r in out), key=str)
    want = sorted(((r[0], *b) for r, b in zip(rows, brute([r[1] for r in rows]), strict=True)), key=str)
    assert got == want


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert op4_suffix_dedup(spark, str(tmp_path)).count() == 0


def test_suffix_array_of_lanes():
    rng = np.random.default_rng(1)
    lanes = [np.append(rng.integers(1, 4, rng.integers(0, 60)), 0) for _ in range(30)]
    size = np.array([len(x) for x in lanes])
    start = np.cumsum(size) - size
    code = np.concatenate([x + 10 * i for i, x in enumerate(lanes)])
    text = (np.cumsum(np.bincount(code) > 0) - 1)[code]
    sa = sd.suffix_array(text, start, size)
    for s, n in zip(start, size, strict=True):
        own = text[s : s + n].tolist()
        assert (sa[s : s + n] - s).tolist() == sorted(range(n), key=lambda i: own[i:])


def test_regions_without_a_common_half_are_not_sorted(spark, monkeypatch):
    sizes, save = {}, sd.Scratch.save

    def counted(self, df, name):
        out = save(self, df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(sd.Scratch, "save", counted)
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(10**6)) for _ in range(n))
    shared = say(30)[:180]
    rows = [(i, say(60) + shared + say(60)) for i in range(12)]
    out = sd.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(not r["spans"] for r in out) and sizes["kinds"] > 1 and sizes["bodies"] == 0
