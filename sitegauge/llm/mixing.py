"""Mixing sources to target weights with soft domain membership.  DataFrame functions only.

A classifier (multinomial logistic regression, pyspark.ml on the JVM) fitted on
a labelled table predicts each document's posterior over domains.  Projected
gradient descent then finds rates r >= 0, starting at 1, that minimise
    sum_k (sum_i r_i n_i p_ik / N - target_k)^2 / share_k
for n_i tokens, N tokens in all and share_k the domain's present share.  A step
needs only K + K * K sums over all documents: the domains' tokens, and those of
each pair of domains over documents that still have a rate.  The pairs give the
step's curvature, so its gradient is scaled to where the residual would vanish if
no rate reached 0; a step that the projection made too long is halved.  A rate is
a fold over the K-vectors of the steps so far, so no state but those K numbers a
step leaves the executors.

Results: one row per document row.  Null and empty texts have 0 tokens and a
rate like others of their posterior.  A target for a domain that no document
belongs to can't be met; the others then are, as least squares allow, and a
warning names the distance.  Repeated rows count each.  An empty table gives an
empty result.  Posteriors that tie are used as they are; null ids are passed on.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

SAMPLE, STEPS, HALVINGS, TOLERANCE = 20_000, 20, 6, 1e-4

# Frequent function words of four languages, and characters that tell them and junk apart.
FUNCTION_WORDS = {"en": "the|and|of|to|that|is|was|for|with|are|this|as", "fr": "le|les|des|et|est|une|du|dans|pour|qui|sur|pas",
                  "de": "der|die|das|und|ist|nicht|von|mit|ein|auf|zu|den", "es": "el|los|las|y|que|por|una|con|del|para|se|su"}
PATTERNS = {"symbols": "[#*$%&<>]", "bars": "\\|", "uppers": "[A-Z]", "digits": "[0-9]", "marks": "!", "umlauts": "[äöüß]", "accents": "[éèêçàù]", "tildes": "[ñóíáú]"}
STATISTICS = tuple(FUNCTION_WORDS) + ("twice",) + tuple(PATTERNS)
SPACE = "[\\x20\\x09-\\x0D]+"


def tokens(text: Column) -> Column:
    """Words between white space; a text's leading and trailing white space makes none."""
    parts = F.split(text, SPACE)
    blank = lambda i: (F.element_at(parts, i) == "").cast("int")
    return F.coalesce(F.when(F.size(parts) == 1, 1 - blank(1)).otherwise(F.size(parts) - blank(1) - blank(-1)), F.lit(0)).cast("long")


def domain_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens and shares: of function words and of words like the one before by word, of characters by character."""
    spaced = docs.withColumns({"_words": F.split("text", SPACE), "_letters": F.split(F.lower("text"), "[^\\p{L}]+")})
    of = lambda n, whole: n / F.greatest(whole, F.lit(1))
    one_of = lambda v: lambda w: w.isin(v.split("|"))
    words = {k: of(F.size(F.filter("_letters", one_of(v))), F.col("n_tokens")) for k, v in FUNCTION_WORDS.items()}
    words["twice"] = of(F.size(F.filter("_words", lambda w, i: w == F.get("_words", i - 1))), F.col("n_tokens"))
    chars = {k: of(F.regexp_count("text", F.lit(v)), F.length("text")) * 10 for k, v in PATTERNS.items()}
    out = spaced.withColumn("n_tokens", tokens(F.col("text"))).withColumns({k: F.least(F.coalesce(c, F.lit(0.0)), F.lit(3.0)) for k, c in (words | chars).items()})
    return out.drop("_words", "_letters")


def mix_to_targets(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], extra: tuple[str, ...] = ()) -> DataFrame:
    """-> doc_id, n_tokens, p_<domain>, rate (and extra columns of docs).

    labelled: doc_id, domain; at most SAMPLE of its rows, by hash of the id, fit
    the classifier.  targets: each domain's share of the mixed tokens."""
    spark = docs.sparkSession
    scratch, names = Scratch(spark), sorted(targets)
    stats = scratch.save(domain_statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *extra)).drop("text"), "statistics")
    known = labelled.select(F.col("doc_id").alias("_id"), F.col("domain").alias("_domain")).filter(F.col("_domain").isin(names)).groupBy("_id").agg(F.max("_domain").alias("_domain")).orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE)
    train = stats.join(F.broadcast(known), F.col("doc_id") == F.col("_id")).select(*STATISTICS, (F.array_position(F.lit(names), F.col("_domain")) - 1).cast("double").alias("label"))
    gather = VectorAssembler(inputCols=list(STATISTICS), outputCol="_features")
    seen = [int(r["label"]) for r in train.select("label").distinct().collect()]
    if len(seen) > 1:
        model = LogisticRegression(featuresCol="_features", maxIter=60, regParam=1e-4, probabilityCol="_p", rawPredictionCol="_raw", predictionCol="_class", family="multinomial").fit(gather.transform(train))
        scored = model.transform(gather.transform(stats)).withColumn("_p", vector_to_array("_p"))
        p = [F.col("_p")[k] if k < model.numClasses else F.lit(0.0) for k in range(len(names))]
    else:
        scored, p = stats, [F.lit(1.0 if [k] == seen or not seen else 0.0) / (1 if seen else len(names)) for k in range(len(names))]
    cols = [f"p_{n}" for n in names]
    table = scratch.save(scored.select("doc_id", *extra, "n_tokens", *[c.alias(n) for c, n in zip(p, cols, strict=True)]), "posteriors")
    scratch.drop("statistics")
    first = table.agg(F.sum("n_tokens").alias("n"), *[F.sum(F.col("n_tokens") * F.col(c)).alias(c) for c in cols]).first()
    total = first["n"] or 1
    share = [max((first[c] or 0.0) / total, 1e-9) for c in cols]
    whole = sum(targets.values())
    goal = [targets[n] / whole for n in names]
    steps: list[list[float]] = []

    def rate() -> Column:
        if not steps:
            return F.lit(1.0)
        pull = lambda g: sum((F.col(c) * g[k] for k, c in enumerate(cols)), F.lit(0.0))
        return F.aggregate(F.lit(steps), F.lit(1.0), lambda r, g: F.greatest(F.lit(0.0), r - pull(g)))

    def measured() -> tuple[np.ndarray, np.ndarray]:
        """The domains' shares at the present rates, and those of pairs over documents with a rate."""
        n, size = F.col("n_tokens") / total, len(cols)
        pairs = [F.sum(F.when(F.col("r") > 0, n * F.col(cols[i]) * F.col(cols[j])).otherwise(0.0)).alias(f"c{i}_{j}") for i in range(size) for j in range(i, size)]
        got = table.select("n_tokens", *cols, rate().alias("r")).agg(*[F.sum(n * F.col("r") * F.col(c)).alias(f"s{k}") for k, c in enumerate(cols)], *pairs).first()
        bend = np.array([[got[f"c{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(size)] for i in range(size)])
        return np.array([got[f"s{k}"] or 0.0 for k in range(size)]), bend

    weight, wanted = 1 / np.array(share), np.array(goal)
    loss = lambda sums: float((weight * (sums - wanted) ** 2).sum())
    off = 0.0
    if first["n"]:
        sums, bend = measured()
        for _ in range(STEPS):
            off = float(np.abs(sums - wanted).max())
            if off < TOLERANCE:
                break
            root = np.sqrt(weight)
            step = np.linalg.lstsq(bend * root[:, None], (sums - wanted) * root, rcond=1e-9)[0]
            before = loss(sums)
            for _ in range(HALVINGS):
                steps.append(step.tolist())
                sums, bend = measured()
                if loss(sums) < before:
                    break
                steps.pop()
                step = step / 2
            else:
                break
        off = float(np.abs(sums - wanted).max())
        if off >= TOLERANCE:
            warnings.warn(f"domain shares are {off:.4f} from their targets at most", stacklevel=2)
    return table.select("doc_id", *extra, "n_tokens", *cols, rate().alias("rate"))


def quality_domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled table of the queries: 'junk' for quality 0, else the language."""
    y = labels.select(F.col("doc_id").alias("_id"), F.col("quality").alias("_q")).filter("_q is not null").groupBy("_id").agg(F.min("_q").alias("_q"))
    return docs.select("doc_id", "lang").join(y, F.col("doc_id") == F.col("_id")).select("doc_id", F.when(F.col("_q") == 0, "junk").otherwise(F.col("lang")).alias("domain"))


TARGETS = {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.15, "junk": 0.05}
