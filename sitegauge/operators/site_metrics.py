"""Site-level scores: dashboard metrics, damping of inflated pages, and the summary of failed rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.functions.scores import clamp, round2
from sitegauge.operators.ai_rules import REQUIRED, WEIGHTS

# Shares of the category scores in each dashboard metric.
METRICS = {
    "ai_readiness": {"llm_readiness": 0.40, "ai_impact": 0.35, "topical_authority": 0.25},
    "schema_coverage": {"ai_impact": 0.70, "topical_authority": 0.30},
    "faq_optimization": {"aeo_score": 0.80, "voice_intent": 0.20},
    "conversational_score": {"voice_intent": 0.60, "aeo_score": 0.40},
    "ai_snippet_probability": {"aeo_score": 0.40, "ai_impact": 0.35, "llm_readiness": 0.25},
    "ai_citation_rate": {"citation_probability": 0.75, "topical_authority": 0.25},
    "knowledge_graph": {"topical_authority": 0.60, "ai_impact": 0.40},
    "entity_coverage": {"topical_authority": 0.65, "citation_probability": 0.35},
    "llm_indexability": {"llm_readiness": 0.70, "ai_impact": 0.30},
    "structured_data_depth": {"ai_impact": 0.75, "llm_readiness": 0.25},
    "entity_coverage_pct": {"topical_authority": 1.00},
    "geo_score": {"ai_impact": 0.20, "citation_probability": 0.20, "llm_readiness": 0.15, "aeo_score": 0.20, "topical_authority": 0.15, "voice_intent": 0.10},
}


def dashboard(scores: DataFrame, *keep: str) -> DataFrame:
    """-> keep and a column for each metric.  scores has a column for each category; null counts as 0."""
    part = lambda formula: sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in formula.items()), F.lit(0.0))
    return scores.select(*keep, *[round2(clamp(part(f))).alias(m) for m, f in METRICS.items()])


def site_categories(scores: DataFrame) -> DataFrame:
    """One row: the mean of each category over all pages, and the site's score, the mean of the pages'."""
    return scores.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in sorted(WEIGHTS)], F.coalesce(F.avg("final_score"), F.lit(0.0)).alias("site_score"), F.count("*").alias("n_pages"))


def validation_summary(rule_scores: DataFrame) -> DataFrame:
    """One row: rules scored under 70, those among them that are required, the rest, and the rest's percentage."""
    low, required = F.col("score") < 70, F.col("rule_id").isin(*REQUIRED)
    out = rule_scores.agg(F.count_if(low).alias("total_issues"), F.count_if(low & required).alias("valid_issues"), F.count_if(low & ~required).alias("filtered_issues"))
    return out.withColumn("filtered_percent", F.coalesce(F.try_divide(F.col("filtered_issues") * 100.0, F.col("total_issues")), F.lit(0.0)))


def ramp(x: Column, start: float, span: float) -> Column:
    """0 up to start, then rising to 1 over span."""
    return F.when(x > start, F.least((x - start) / span, F.lit(1.0))).otherwise(0.0)


def inflation(pages: DataFrame) -> DataFrame:
    """Adds *_inflation columns (0 to 1): more entities, questions, headings, steps, words or nodes than the content bears.

    Reads n_entities, word_count, questions, qa_pairs, h2, h3, n_paragraphs, step_count, n_nodes and cross_links."""
    c = F.col
    answered = c("qa_pairs") / c("questions")
    headings = c("h2") + c("h3")
    return pages.withColumns({
        "entity_inflation": F.when(c("n_entities") > 0, ramp(c("n_entities") * 1000 / F.greatest(c("word_count"), F.lit(1)), 15, 20)).otherwise(0.0),
        "faq_inflation": F.when((c("questions") > 10) & (answered < 0.3), F.least((c("questions") - 10) / 20 * (1 - answered), F.lit(1.0))).otherwise(0.0),
        "heading_inflation": F.when(c("n_paragraphs") > 0, ramp(headings / c("n_paragraphs"), 0.8, 0.5)).otherwise(0.0),
        "step_inflation": F.when(c("word_count") < 1000, ramp(c("step_count"), 10, 15)).otherwise(0.0),
        "word_inflation": F.when(headings < 10, ramp(c("word_count"), 5000, 10000)).otherwise(0.0),
        "structured_inflation": F.when((c("n_nodes") > 10) & (c("cross_links") < 0.3), F.least((5 - c("cross_links") * 10) / 5, F.lit(1.0))).otherwise(0.0),
    })


def _mean(*signals: Column) -> Column:
    """Of the signals that are not null; 0 if none is."""
    known = F.array_compact(F.array(*[s.cast("double") for s in signals]))
    return F.coalesce(F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, x: a + x), F.size(known)), F.lit(0.0))


def authority(types: Column, uniqueness: Column, n_links: Column, n_words: Column, n_nodes: Column) -> Column:
    """Mean of 4 to 6 signs that a page's entities are meant: different, linked, backed by words and of fitting types."""
    n = F.size(types)
    held = lambda t: F.array_contains(types, t)
    fit = F.when(held("Article") & held("Organization") & held("Person"), 1.0).when(held("Article") & held("Organization"), 0.8).when(held("Organization"), 0.6).otherwise(0.5)
    some = F.when(n > 0, F.lit(1.0))
    return _mean(F.when(n > 0, uniqueness).otherwise(0.5), some * F.size(F.array_distinct(types)) / n, F.when((n > 0) & (n_links > 0), F.least(n_links / n, F.lit(1.0))),
                 F.least(n_words / F.greatest(n, F.lit(1)) / 100, F.lit(1.0)), F.when(n_nodes > 10, F.least(n_nodes / 10, F.lit(1.0))).otherwise(0.5), fit)


def spam_index(types: Column, uniqueness: Column, n_words: Column, questions: Column, qa_pairs: Column, n_headings: Column, n_paragraphs: Column) -> Column:
    """Mean of the spam signs that apply, each at most 5."""
    n = F.size(types)
    five = lambda x: F.least(x, F.lit(5.0))
    most = F.array_max(F.transform(F.array_distinct(types), lambda t: F.size(F.filter(types, lambda x: x == t))))
    return _mean(F.when((n > 0) & (n_words > 0) & (uniqueness > 0), five(n * 1000 / n_words / uniqueness / 10)), F.when((questions > 0) & (qa_pairs > 0), five(questions / (qa_pairs / questions) / 5)),
                 F.when(n_paragraphs > 0, five(n_headings / n_paragraphs * 2)), F.when(n > 0, most / n * 3))


def damped(pages: DataFrame) -> DataFrame:
    """Category scores after damping.  Reads the columns of inflation(), authority, spam, uniqueness, has_organization and low_word_count.

    Inflation lowers topical_authority and ai_impact, less so for pages of high
    authority, which also gain; a spam index over 2.5 lowers all but
    voice_intent; thin pages shrink by a logistic curve of their words."""
    c = F.col
    ease = F.when(c("authority") > 0.85, 0.2).when(c("authority") > 0.75, 0.4).when(c("authority") > 0.65, 0.6).otherwise(1.0)
    boost = F.when(c("authority") > 0.85, 1.2).when(c("authority") > 0.75, 1.1).otherwise(1.0)
    entity = c("entity_inflation") * F.when(c("uniqueness") > 0.8, ease * 0.2).when(c("uniqueness") > 0.7, ease * 0.4).when(c("uniqueness") > 0.5, ease * 0.7).otherwise(1.0)
    nodes = c("structured_inflation") * F.when(c("has_organization") & (c("cross_links") > 0.7), ease * 0.3).when(c("has_organization"), ease * 0.6).otherwise(1.0)
    spam = F.when(c("spam") > 2.5, 1 / (1 + F.exp(c("spam") - 3))).otherwise(1.0)
    thin = F.when(c("low_word_count"), 0.3 + 0.7 / (1 + F.exp(-(c("word_count") - 200) / 100))).otherwise(1.0)
    out = {}
    for name in sorted(WEIGHTS):
        score = c(name) * {"topical_authority": 1 - entity, "ai_impact": 1 - nodes}.get(name, F.lit(1.0))
        score = F.when(boost > 1, F.least(score * boost, F.lit(100.0))).otherwise(score)
        out[name] = score * (F.lit(1.0) if name == "voice_intent" else spam) * thin
    return pages.withColumns(out)
