"""Cuts that the reviews found: each test fails where an operator does less than its whole job."""

import random

from pyspark.sql import functions as F

from sitegauge.llm.decontaminate import find_leaks
from sitegauge.llm.mixing import TARGETS, mix_to_targets, quality_domains
from sitegauge.llm.secrets import redact_secrets, scan_secrets


def test_held_out_posteriors(spark):
    """Half of the labelled rows fit the classifier, the other half judge its posteriors."""
    top = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{top}/documents.parquet")
    known = quality_domains(docs, spark.read.parquet(f"{top}/labels.parquet")).filter("domain is not null")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    out = mix_to_targets(docs.join(known.select("doc_id"), "doc_id", "left_semi"), known.filter(half == 0), TARGETS)
    names = sorted(TARGETS)
    best = F.array_position(F.array(*[F.col(f"p_{n}") for n in names]), F.greatest(*[F.col(f"p_{n}") for n in names])).cast("int")
    judged = out.join(known.filter(half == 1), "doc_id").select("domain", (F.element_at(F.array(*map(F.lit, names)), best) == F.col("domain")).cast("int").alias("right"))
    got = judged.agg(F.avg("right").alias("all"), F.avg(F.when(F.col("domain") == "junk", F.col("right"))).alias("junk")).first()
    print("held-out accuracy, recall of junk:", got)
    assert got["all"] > 0.985 and got["junk"] > 0.95


SECRETS = [("API_KEY=", "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b", "\nB=1"), ("https://x.org/a?token=", "9f86d081884c7d659a2feaa0c55ad015", "&page=2"), ("key AKIA", "QWERTYUIOPASDFGH", " here"),
           ("SECRET_KEY=", "abcdEFGHijklMNOPqrst", "\n"), ("password: ", "Tr0ub4dor&3", "\n"), ('"password": "', "Wq7!pz", '"'), ('token = "', "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b", '" ')]
OTHERS = ["password: required for all", "the token is the same: see below", "commit 9f86d081884c7d659a2feaa0c55ad015a3bf4f1b", "TOKEN=${TOKEN}", "nothing at all"]


def test_secrets_of_each_form(spark):
    texts = ["".join(t) for t in SECRETS] + OTHERS
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = [(r["doc_id"], r["candidate"], r["probability"]) for r in scan_secrets(docs).orderBy("doc_id").collect()]
    print(found)
    got = {r["doc_id"]: r["text"] for r in redact_secrets(docs).collect()}
    for i, (before, secret, after) in enumerate(SECRETS):
        assert got[i] == (before.removesuffix("AKIA") + "[SECRET]" + after), (texts[i], got[i])
    assert [got[i] for i in range(len(SECRETS), len(texts))] == OTHERS


def test_whole_copies_among_many_passages(spark):
    """2,000 passages of 1 to 64 words, each copied whole between known words: none is lost."""
    rng = random.Random(3)
    known = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in ("", *"lmnrst")]
    say = lambda n: " ".join(known[min(int(rng.paretovariate(0.6)) - 1, rng.randrange(len(known)))] for _ in range(n))
    items = [(i, say(1 + i % 64)) for i in range(2000)]
    docs = [(i, f"{say(40)} {t} {say(40)}") for i, t in items if i % 4 == 0]
    out = find_leaks(spark.createDataFrame(docs, "doc_id long, text string").repartition(8), spark.createDataFrame(items, "item_id long, text string"))
    found = {r["doc_id"] for r in out.filter("doc_id = item_id").collect()}
    print("copies lost:", len(docs) - len(found), "of", len(docs))
    assert found == {i for i, _ in docs}
