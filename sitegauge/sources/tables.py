"""Reading tables, and columns under any of several names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Names under which a key may be stored.
CANDIDATES = {"project_id": ("projectId", "project_id", "seo_project_id", "projectid"), "url": ("url", "page_url", "pageUrl", "page", "link_url"),
              "severity": ("severity", "level", "priority", "type", "issue_type"), "rule_id": ("rule_id", "issue_code", "code", "rule", "rule_code", "issue_id")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ROWS_OF_TASK = 4096  # fixed value: rows that become a page each, so a task's time doesn't grow with the table


def spread(rows: DataFrame) -> DataFrame:
    """The rows dealt over tasks by their number.  A small file is read by one task, however much is made of each of its rows."""
    n, cores = rows.count(), rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(-(-n // ROWS_OF_TASK), min(cores, -(-n // 64)), 1))


def resolve_columns(df: DataFrame, **wanted: tuple[str, ...]) -> DataFrame:
    """Renames the first present candidate of each wanted column; raises if there is none."""
    for name, candidates in wanted.items():
        found = next((c for c in candidates if c in df.columns), None)
        if found is None:
            raise ValueError(f"no column for {name}: {candidates}")
        df = df.withColumnRenamed(found, name)
    return df
