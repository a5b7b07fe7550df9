"""Scores of rules with their errors: a rule that can't judge a page scores 0, says why, and keeps its weight.

A ScoreRule is a Column of points with what it needs; nothing of it throws, so a
bad row ends no job: rows whose rules failed are told apart by their `errors`.
Counts for each rule are taken from the very pass that writes the results, by
DataFrame.observe.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from sitegauge.operators import ai_rules

RESULT = "struct<rule_id: string, category: string, score: double, weight: double, max_score: double, error: string>"


@dataclass(frozen=True)
class ScoreRule:
    """points: 0 to max_score.  needs: conditions with the error of a page that lacks them, first that fails counts."""

    rule_id: str
    category: str
    points: Column
    weight: float = 1.0
    max_score: float = 10.0
    needs: tuple[tuple[Column, str], ...] = field(default=())

    def result(self) -> Column:
        """RESULT of this rule; score in percent of max_score.  Points that are null, no number or outside 0 to max_score are errors too."""
        p = self.points.cast("double")
        error = F.coalesce(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(e)) for c, e in self.needs], F.when(p.isNull(), "no score").when(F.isnan(p), "not a number").when((p < 0) | (p > self.max_score), "score out of range"))
        return F.struct(F.lit(self.rule_id).alias("rule_id"), F.lit(self.category).alias("category"), F.when(error.isNull(), p * 100 / self.max_score).otherwise(0.0).alias("score"),
                        F.lit(float(self.weight)).alias("weight"), F.lit(float(self.max_score)).alias("max_score"), error.alias("error"))


def catalog() -> list[ScoreRule]:
    """The score rules of ai_rules; a missing score counts as 0 points there, so those have no errors."""
    return [ScoreRule(name, category, F.least(F.lit(10.0), F.greatest(F.lit(0.0), F.coalesce(points, F.lit(0.0))))) for name, (category, points) in ai_rules.rules().items()]


def check(rules: list[ScoreRule], weights: dict[str, float]) -> None:
    """Raises for a rule named twice, without positive weight or max_score, or of a category without weight; category weights must sum to 100."""
    names = [r.rule_id for r in rules]
    bad = sorted({n for n in names if names.count(n) > 1} | {r.rule_id for r in rules if r.weight <= 0 or r.max_score <= 0 or r.category not in weights})
    if bad:
        raise ValueError(f"rules that can't be used: {bad}")
    if abs(sum(weights.values()) - 100) > 0.001:
        raise ValueError(f"category weights sum to {sum(weights.values())}, not 100")


def with_results(pages: DataFrame, rules: list[ScoreRule]) -> DataFrame:
    """pages with results (array of RESULT) and errors (array of struct<rule_id, error>, empty where all rules could judge)."""
    out = pages.withColumn("results", F.array(*[r.result() for r in rules]).cast(f"array<{RESULT}>"))
    failed = F.filter("results", lambda r: r["error"].isNotNull())
    return out.withColumn("errors", F.transform(failed, lambda r: F.struct(r["rule_id"].alias("rule_id"), r["error"].alias("error"))))


def valid_result(r: Column) -> Column:
    """Whether a result is whole: names, a score of 0 to 100, positive weight and max_score."""
    good = r["rule_id"].isNotNull() & r["category"].isNotNull() & r["score"].between(0, 100) & (r["weight"] > 0) & (r["max_score"] > 0)
    return F.coalesce(good, F.lit(False))


def categories(results: Column, weights: dict[str, float]) -> Column:
    """array<struct<category, score, rule_count, failed>> in order of name; a category's score is the mean of its results by weight, failed ones with 0."""
    def of(name: str) -> Column:
        own = F.filter(results, lambda r: r["category"] == name)
        total = F.aggregate(own, F.lit(0.0), lambda n, r: n + r["weight"])
        score = F.try_divide(F.aggregate(own, F.lit(0.0), lambda n, r: n + r["score"] * r["weight"]), total)
        return F.struct(F.lit(name).alias("category"), F.coalesce(score, F.lit(0.0)).alias("score"), F.size(own).alias("rule_count"), F.size(F.filter(own, lambda r: r["error"].isNotNull())).alias("failed"))

    return F.array(*[of(n) for n in sorted(weights)])


def page_totals(pages: DataFrame, weights: dict[str, float] = ai_rules.WEIGHTS) -> DataFrame:
    """pages with results gets categories, final_score (by category weight) and valid: all results whole, and all scores from 0 to 100."""
    out = pages.withColumn("categories", categories(F.col("results"), weights))
    by_name = F.create_map(*[F.lit(x) for kv in sorted((n, float(w)) for n, w in weights.items()) for x in kv])
    out = out.withColumn("final_score", F.aggregate("categories", F.lit(0.0), lambda n, c: n + c["score"] * F.element_at(by_name, c["category"])) / 100)
    whole = F.forall("results", valid_result) & F.forall("categories", lambda c: c["score"].between(0, 100)) & F.col("final_score").between(0, 100)
    return out.withColumn("valid", F.coalesce(whole, F.lit(False)))


def observed(pages: DataFrame, rules: list[ScoreRule], name: str = "rules") -> tuple[DataFrame, Observation]:
    """pages with results, and what is counted while they are read: pages, bad pages, and of each rule its failures and sum of scores."""
    o = Observation(name)
    at = lambda k, f: F.element_at("results", k + 1)[f]
    each = [c for k in range(len(rules)) for c in (F.count_if(at(k, "error").isNotNull()).alias(f"failed_{k}"), F.sum(at(k, "score")).alias(f"score_{k}"))]
    return pages.observe(o, F.count(F.lit(1)).alias("pages"), F.count_if(F.size("errors") > 0).alias("bad_pages"), *each), o


def statistics(rules: list[ScoreRule], weights: dict[str, float], counted: Observation) -> dict:
    """Rules and weights for each category, and for each rule how many pages it failed on and its mean score; complete once an action has read the observed rows."""
    got = counted.get
    n = got["pages"]
    out: dict = {"total_rules": len(rules), "pages": n, "bad_pages": got["bad_pages"], "category_weights": dict(weights), "categories": {}}
    for k, r in enumerate(rules):
        c = out["categories"].setdefault(r.category, {"rule_count": 0, "total_weight": 0.0, "rules": {}})
        c["rule_count"] += 1
        c["total_weight"] += r.weight
        c["rules"][r.rule_id] = {"failed": got[f"failed_{k}"], "mean": (got[f"score_{k}"] or 0.0) / n if n else 0.0}
    return out
