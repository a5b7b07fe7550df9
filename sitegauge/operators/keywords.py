"""Keyword and search-result records from saved API responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.functions.text import keyword_intent
from sitegauge.functions.urls import registrable_domain

ITEM = "struct<keyword: string, keyword_data: struct<keyword: string, keyword_info: struct<search_volume: bigint, competition: double, cpc: double>>, keyword_info: struct<search_volume: bigint, competition: double, cpc: double>, search_volume: bigint, competition: double, cpc: double>"
RESPONSE = f"struct<tasks: array<struct<status_code: int, result: array<struct<items: array<{ITEM}>>>>>>"


def keyword_records(responses: DataFrame, body: str = "body", order: str | None = None) -> DataFrame:
    """-> keyword, search_volume, competition, cpc, intent: one row for each keyword, whatever its case; the first counts.

    Three layouts of an item are read; tasks that failed give none.  order names the
    column by which responses follow one another (the body itself without one)."""
    tasks = F.filter(F.from_json(F.col(body), RESPONSE)["tasks"], lambda t: t["status_code"] == 20000)
    items = F.flatten(F.flatten(F.transform(tasks, lambda t: F.transform(t["result"], lambda r: F.coalesce(r["items"], F.array().cast(f"array<{ITEM}>"))))))
    rows = responses.select(F.col(order or body).alias("at"), F.posexplode(items).alias("pos", "i"))
    inner, own = F.col("i.keyword_data.keyword_info"), F.col("i.keyword_info")
    pick = lambda n, default: F.coalesce(F.col(f"i.{n}"), own[n], inner[n], default)
    rows = rows.select("at", "pos", F.trim(F.coalesce("i.keyword", "i.keyword_data.keyword")).alias("keyword"), pick("search_volume", F.lit(0)).alias("search_volume"),
                       pick("competition", F.lit(0.0)).alias("competition"), pick("cpc", F.lit(0.0)).alias("cpc")).filter("keyword <> ''")
    first = F.min_by(F.struct("keyword", "search_volume", "competition", "cpc"), F.struct("at", "pos", "keyword")).alias("r")
    rows = rows.groupBy(F.lower("keyword").alias("_low")).agg(first).select("r.*")
    return rows.select("keyword", "search_volume", "competition", "cpc", keyword_intent(F.col("keyword")).alias("intent"))


def top_keywords(records: DataFrame, n: int = 5) -> DataFrame:
    """The n keywords of most searches, each once whatever its case; of equals the first by name."""
    best = records.groupBy(F.lower("keyword").alias("_low")).agg(F.max_by(F.struct("keyword", "search_volume"), F.struct("search_volume", "keyword")).alias("r")).select("r.*")
    return best.orderBy(F.desc("search_volume"), "keyword").limit(n)


def domain_matches(found: Column, target: Column) -> Column:
    return (found == target) | found.contains(target) | target.contains(found)


def rank_of(results: DataFrame, target: str) -> DataFrame:
    """-> keyword, rank (null: not found), status.  results: keyword, position, url."""
    hit = domain_matches(registrable_domain(F.col("url")), F.lit(target))
    return results.groupBy("keyword").agg(F.min(F.when(hit, F.col("position"))).alias("rank")).withColumn("status", F.when(F.col("rank").isNull(), "Not Found").otherwise("Found"))


def average_rank(ranks: DataFrame) -> DataFrame:
    return ranks.agg(F.coalesce(F.avg("rank"), F.lit(0.0)).alias("average_rank"))
