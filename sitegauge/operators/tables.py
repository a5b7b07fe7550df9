"""Keyed tables: upsert, replace, audits, ordered selection, and joins with fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.functions.urls import lookup_key, selection_key, url_type


def latest(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row for each key: that of the greatest order columns, by max_by, whose partial sums need no sort."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_r.{c}") for c in rest])


def upsert(target: DataFrame, changes: DataFrame, keys: list[str], keep: tuple[str, ...] = ("created_at",)) -> DataFrame:
    """Changes win over the target's rows of the same key; columns in keep stay as first stored."""
    other = [c for c in target.columns if c not in keys]
    t, c = target.withColumn("_t", F.lit(True)).alias("t"), changes.withColumn("_c", F.lit(True)).alias("c")
    pick = lambda n: F.when(F.col("_c") & (F.lit(n not in keep) | F.col("_t").isNull()), F.col(f"c.{n}")).otherwise(F.col(f"t.{n}"))
    return t.join(c, keys, "full").select(*keys, *[pick(n).alias(n) for n in other])


def replace_by_key(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Drops the target's rows of every key that rows have, then adds rows."""
    return target.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows)


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def update_members(df: DataFrame, keys: DataFrame, key: str, **values: Column) -> DataFrame:
    """Sets columns on the rows whose key is in keys."""
    hit = keys.select(F.col(key)).distinct().withColumn("_hit", F.lit(True))
    out = df.join(hit, key, "left")
    return out.withColumns({n: F.when(F.col("_hit"), v).otherwise(F.col(n)) for n, v in values.items()}).drop("_hit")


def select_urls(df: DataFrame, limit: int = 25) -> DataFrame:
    """The first urls by type (main, collection, product, blog, other), then by name."""
    kind = url_type(F.col("url"))
    rank = F.array_position(F.lit(["main", "collection", "product", "blog", "other"]), kind)
    return df.select("url", kind.alias("url_type"), rank.alias("_r"), selection_key(F.col("url")).alias("_k")).orderBy("_r", "_k", "url").limit(limit).select("url", "url_type")


def by_device(performance: DataFrame) -> DataFrame:
    """One row for each page_url, with desktop_ and mobile_ scores."""
    return performance.groupBy("page_url").pivot("device_type", ["desktop", "mobile"]).agg(F.max("performance_score"))


def join_with_fallback(left: DataFrame, right: DataFrame, keys: list[Column], right_key: str, *columns: str) -> DataFrame:
    """Left join on the first key that finds a row."""
    out, names = left, []
    for i, key in enumerate(keys):
        r = right.select(F.col(right_key).alias(f"_k{i}"), *[F.col(c).alias(f"_{c}{i}") for c in columns])
        out = out.join(r, key == F.col(f"_k{i}"), "left")
        names.append(i)
    return out.select(*left.columns, *[F.coalesce(*[F.col(f"_{c}{i}") for i in names]).alias(c) for c in columns])


def with_companions(pages: DataFrame, performance: DataFrame, headless: DataFrame, reports: DataFrame) -> DataFrame:
    """Pages (url, project_id) with desktop_score, mobile_score, the last headless row of their URL, and their project's report.

    performance (page_url, device_type, performance_score) may be stored under the looked-up or the raw URL, in
    this order; headless: url, at and any findings; reports: project_id and any columns, one row for each project."""
    scores = by_device(performance).select("page_url", F.col("desktop").alias("desktop_score"), F.col("mobile").alias("mobile_score"))
    out = join_with_fallback(pages, scores, [lookup_key(F.col("url")), F.col("url")], "page_url", "desktop_score", "mobile_score")
    last = latest(headless.withColumn("_key", lookup_key(F.col("url"))).drop("url"), ["_key"], "at").drop("at")
    return out.withColumn("_key", lookup_key(F.col("url"))).join(last, "_key", "left").drop("_key").join(F.broadcast(reports), "project_id", "left")


def append(df: DataFrame, path: str) -> None:
    """Adds rows to a table of files; a failed write leaves none of them."""
    df.write.mode("append").parquet(path)


def set_fields(df: DataFrame, struct: str, **values: Column) -> DataFrame:
    """Sets fields of a struct column and leaves its others; a null struct becomes one."""
    out = F.coalesce(struct, F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema[struct].dataType.fields]))
    for name, value in values.items():
        out = out.withField(name, value)
    return df.withColumn(struct, out)


def check_unique(df: DataFrame, *keys: str) -> DataFrame:
    """The rows themselves; reading them fails where a key occurs twice."""
    rows = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.first(F.struct(*df.columns)).alias("_r"))
    return rows.select(F.when(F.assert_true(F.col("_n") == 1, F.concat(F.lit("key stored twice: "), F.to_json(F.struct(*keys)))).isNull(), F.col("_r")).alias("_r")).select("_r.*")


def job_chain(jobs: DataFrame) -> DataFrame:
    """-> job_id, scraping_id, discovery_id: each job with the job it was made from, and that one's.  jobs: job_id, source_id."""
    of = jobs.select(F.col("job_id").alias("scraping_id"), F.col("source_id").alias("discovery_id"))
    return jobs.select("job_id", F.col("source_id").alias("scraping_id")).join(of, "scraping_id", "left").select("job_id", "scraping_id", "discovery_id")


def distinct_by_any(df: DataFrame, order: str, *keys: str) -> DataFrame:
    """Rows of which no key was seen on a row before: one step for each key, first by order; null keys never clash."""
    for key in keys:
        first = df.groupBy(key).agg(F.min(order).alias("_first"))
        df = df.join(first.filter(F.col(key).isNotNull()).withColumnRenamed(key, "_k"), F.col(key) == F.col("_k"), "left").filter(F.col("_first").isNull() | (F.col("_first") == F.col(order))).drop("_first", "_k")
    return df


def with_html(pages: DataFrame, limit: int = 25) -> DataFrame:
    """The first pages by URL that have HTML."""
    return pages.filter(F.col("html").isNotNull()).orderBy("url", "page_id").limit(limit)


def first_urls(df: DataFrame, limit: int = 25) -> DataFrame:
    """The first different URLs by name."""
    return df.select("url").filter("url <> ''").distinct().orderBy("url").limit(limit)


def lookup(df: DataFrame, **key) -> DataFrame:
    """The row of a key; the filter reaches the scan."""
    for name, value in key.items():
        df = df.filter(F.col(name) == value)
    return df.limit(1)


def in_order_once(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key, null keys left out."""
    rest = [c for c in df.columns if c != key]
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(key, *[F.col(f"_r.{c}") for c in rest])
