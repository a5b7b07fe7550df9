"""Source divergence, byte pairs and prefix trie against brute force and the tokenizers library."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sitegauge.llm import divergence as audit
from sitegauge.llm import queries
from sitegauge.llm.byte_pairs import VOCABULARY, decode, encode, load_vocabulary, merge_pairs
from sitegauge.llm.prefix_trie import prefix_trie

CLASHING = "doc_id long, text string, lang string, source string, ids string, n string, term string, part int"


def test_byte_pairs_against_the_library(spark):
    rng = random.Random(4)
    bits = ["a", "Ab", " ", "  ", "\n", "'s", "'", "é", "１２", "中文", "<|endoftext|>", "!?", " ", "\x1c", "　", "\t", "🙂"]
    texts = [None, "", " ", "<|endoftext|>", "a<|endoftext|>  b <|endoftext|><|endoftext|>", "<|endoftext", "ab" * 20_000, "x" * 70_000 + " y", "word " * 50_000, "don't we'll 's 't", "same", "same"]
    texts += ["".join(rng.choice([*bits, chr(rng.randrange(0xD7FF)), chr(rng.randrange(0xE000, 0x10FFFF))]) for _ in range(rng.randrange(60))) for _ in range(1500)]
    # every code point after a letter and after a digit
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts += ["A" + "A".join(points[k : k + 600]) + "1" + "1".join(points[k : k + 600]) for k in range(0, len(points), 600)]
    docs = spark.createDataFrame([(None if k == 3 else k, t, "en", "s", "x", "y", "z", 1) for k, t in enumerate(texts)], CLASHING)
    library = Tokenizer.from_file(VOCABULARY)
    library.no_truncation()
    library.no_padding()
    want = {k: library.encode(t or "", add_special_tokens=False).ids for k, t in enumerate(texts)}
    got = decode(encode(docs)).collect()
    assert len(got) == len(texts)
    for r in got:
        k = 3 if r["doc_id"] is None else r["doc_id"]
        assert r["ids"] == want[k], texts[k][:60]
        assert r["decoded"] == library.decode(want[k], skip_special_tokens=False) == (texts[k] or "")


def test_decode_of_any_ids(spark):
    rng = random.Random(2)
    library = Tokenizer.from_file(VOCABULARY)
    rows = [[rng.randrange(50257) for _ in range(rng.randrange(30))] for _ in range(400)]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)] + [(None, None), (-1, [5, 70_000, -3])], "k long, ids array<int>")
    got = {r["k"]: r["decoded"] for r in decode(df).collect()}
    assert got.pop(None) == "" and got.pop(-1) == library.decode([5])
    assert got == {k: library.decode(r, skip_special_tokens=False) for k, r in enumerate(rows)}
    with pytest.raises(ValueError):
        decode(df, decoded="k")


def test_segment_tree_against_a_scan():
    spec = load_vocabulary(VOCABULARY)
    triples = np.frombuffer(spec["merges"], np.int32).reshape(-1, 3).tolist()
    pairs = {a << 32 | b: (rank, c) for rank, (a, b, c) in enumerate(triples)}
    rng = random.Random(1)
    for _ in range(300):
        ids = [spec["single"][b] for b in rng.choice(["the and ing", "aaab", "éèê"]).encode() * rng.randrange(1, 6)]
        rng.shuffle(ids)
        want = list(ids)
        while found := min(((pairs[k][0], i) for i in range(len(want) - 1) if (k := want[i] << 32 | want[i + 1]) in pairs), default=None):
            i = found[1]
            want[i : i + 2] = [pairs[want[i] << 32 | want[i + 1]][1]]
        assert merge_pairs(ids, pairs) == want


def brute_divergence(rows, min_docs, top):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for text, lang, source in rows]
    held, count, out = defaultdict(Counter), defaultdict(Counter), []
    for lang, source, terms in docs:
        held[lang].update(set(terms))
        count[lang, source].update(terms)
    for lang in {d[0] for d in docs}:
        kept = [t for t, n in held[lang].items() if n >= min_docs]
        sources = sorted({s for g, s, _ in docs if g == lang})
        share = lambda c, kept=kept: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[k] for k in kept) + 5 * len(kept)) for t in kept}
        of = {s: share(count[lang, s]) for s in sources}
        q = share(sum((count[lang, s] for s in sources), Counter()))
        for s in sources:
            pair = [(-sum(abs(of[s][t] - of[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            term = [(q[t] - of[s][t], t.encode()) for t in kept if count[lang, s][t] and of[s][t] > q[t]]
            for part, found in (("pair", sorted(pair)), ("term", sorted(term)[:top])):
                out += [(lang, s, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(found)]
    return sorted(out)


def test_divergence_against_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    words = ["Alpha", "beta", "ßtraße", "éa", "Éa", "zz", "\U0001f600", "x" * 300, *[f"w{chr(97 + k)}" for k in range(20)]]
    say = lambda n: "".join(rng.choice(words) + rng.choice([" ", "1", "\n", "_", "\x7f"]) for _ in range(n))
    rows = [(say(rng.randrange(40)), rng.choice(["en", "de", None, ""]), rng.choice(["a", "a", "a", "b", "ç", None])) for _ in range(300)]
    rows += [(None, "fr", "only"), ("", "it", "p"), ("few words", "it", "q"), (None, None, None), ("same text here", "es", "t1"), ("same text here", "es", "t2"), (say(5000), "en", "b")]
    rows += [("hot " * 3, "en", "a")] * 200
    docs = spark.createDataFrame([(k % 5 or None, t, lang, s, "i", "n", "t", 1) for k, (t, lang, s) in enumerate(rows)], CLASHING).repartition(5)
    for widest, cut in ((1024, 1 << 20), (3, 64)):  # chunks of a few terms and texts in pieces give the same
        monkeypatch.setattr(audit, "WIDEST", widest)
        monkeypatch.setattr(audit, "CUT", cut)
        for min_docs, top in ((1, 50), (8, 4)):
            got = audit.divergence(docs, min_docs, top).collect()
            assert sorted(map(tuple, got)) == brute_divergence(rows, min_docs, top)
    assert audit.divergence(docs.limit(0)).count() == 0


def test_shares_are_exact_beyond_64_bits():
    counts, total = np.array([0, 7, 10**13, 8 * 10**15]), np.int64(9 * 10**15 - 7)
    assert audit.shares(counts, total).tolist() == [1 + 10**9 * (int(c) + 5) // int(total) for c in counts]


def brute_trie(rows):
    of = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            of[c].append(((turn is not None, turn or 0, digest), (role, text)))
    turns = {c: [t for _, t in sorted(x)] for c, x in of.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(turns):
        h = zlib.crc32(str(c).encode()) % 6
        path = tuple(turns.get(c - c % 100, [])[:h] + turns[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children = Counter(p[:-1] for p in members if p)
    out = []
    for p, m in members.items():
        under = [x for x in members if x[: len(p)] == p]
        out.append((m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], sum(x not in children for x in under),
                    sum((len(members[x]) - 1) * len(x[-1][1]) for x in under if x), hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()))
    return out


def test_prefix_trie_against_brute_force(spark):
    rng = random.Random(6)
    rows = []
    for c in [*range(0, 60), *range(100, 160), 205, 207, 299, *range(300, 320), 10_000, 25_600, 99_999, 99_901]:
        hot = c % 3 == 0
        for turn in range(rng.randrange(9)):
            text = f"turn {turn} é" if hot else " ".join(rng.choice(["a", "b"]) for _ in range(rng.randrange(3)))
            rows.append((c, turn, rng.choice(["user", "assistant"]) if not hot else "user", text))
    rows += [(400, None, "user", "null turn first"), (400, 0, None, "no role"), (400, 1, "user", None), (401, 5, "user", "x"), (None, 1, "user", "no id"), (402, 0, "u", "tie"), (402, 0, "u", "eit"), (402, 0, "u", "tie")]
    rows += [(500 + k, t, "user", "deep") for k in (0, 1, 7) for t in range(300)] + [(777, 0, "user", "long " * 50_000)]
    rng.shuffle(rows)
    conversations = spark.createDataFrame([(*r, "x", 1, "k") for r in rows], "conv_id long, turn int, role string, text string, base string, n int, key string").repartition(7)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, prefix_trie(conversations).collect()), key=key) == sorted(brute_trie(rows), key=key)
    assert prefix_trie(conversations.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_byte_pairs", "op13_prefix_trie"])
def test_queries_on_the_smallest_tables(spark, name):
    got = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert got.count() > 0 and not {t for _, t in got.dtypes} - {"bigint", "string", "int"}
    if name == "op13_prefix_trie":
        assert got.filter("depth = 0").count() == 1
        assert got.agg(F.sum(F.when(F.col("n_children") == 0, 1))).first()[0] == got.filter("depth = 0").first()["n_leaves"]
