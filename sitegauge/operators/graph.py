"""The link graph of a crawl: edges, inbound and outbound counts, click depth."""

from __future__ import annotations

import uuid
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.functions.urls import SKIPPED_LINKS, host, is_homepage, lookup_key, resolve_link


def edges(pages: DataFrame) -> DataFrame:
    """-> src, dst: a row for each link, resolved; repeats stay.  pages: url, links array<string>."""
    rows = pages.select(F.col("url").alias("src"), F.explode("links").alias("href")).filter(~F.col("href").rlike(SKIPPED_LINKS))
    return rows.select("src", F.regexp_replace(resolve_link(F.col("src"), F.col("href")), "#.*$", "").alias("dst"))


def _saved(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def click_depths(nodes: DataFrame, links: DataFrame, root: DataFrame, folder: str, limit: int | None = None) -> DataFrame:
    """-> key, click_depth: breadth-first levels from root (key); unreachable keys are absent.

    It ends when a level is empty; with a limit, pages beyond so many levels raise an error.

    Each level joins the frontier with the links and leaves out what was seen;
    it is written to folder (shared), so no level depends on a lost executor."""
    run = f"{folder.rstrip('/')}/depth-{uuid.uuid4().hex}"
    links = _saved(links.join(nodes.select(F.col("key").alias("dst")), "dst", "left_semi").filter("src <> dst").select("src", "dst").distinct(), f"{run}/links")
    frontier = seen = _saved(root.select("key", F.lit(0).alias("click_depth")), f"{run}/0")
    for depth in count(1):
        ahead = frontier.join(links, F.col("key") == F.col("src")).select(F.col("dst").alias("key")).distinct().join(seen.select("key"), "key", "left_anti")
        frontier = _saved(ahead.select("key", F.lit(depth).alias("click_depth")), f"{run}/{depth}")
        if not frontier.take(1):
            break
        if limit is not None and depth > limit:
            raise ValueError(f"pages lie more than {limit} clicks from the homepage")
        seen = seen.unionByName(frontier)
        if depth % 32 == 0:
            seen = _saved(seen, f"{run}/seen{depth}")
    return seen


def crawl_graph(pages: DataFrame, folder: str, project: Column | None = None) -> DataFrame:
    """-> url, inbound_links, outbound_links, click_depth (-1: unreachable), is_orphan.

    Pages belong to projects, by default their hosts.  Inbound counts links of
    crawled pages only; each project's homepage is its least key with an empty
    path, and clicks stay inside the project."""
    of = host(F.col("url")) if project is None else project
    nodes = pages.select("url", lookup_key(F.col("url")).alias("key"), of.alias("project"))
    links = edges(pages).select(lookup_key(F.col("src")).alias("src"), lookup_key(F.col("dst")).alias("dst"))
    inbound = links.groupBy(F.col("dst").alias("key")).agg(F.count("*").alias("inbound_links"))
    outbound = links.groupBy(F.col("src").alias("key")).agg(F.count("*").alias("outbound_links"))
    root = nodes.filter(is_homepage(F.col("url"))).groupBy("project").agg(F.min("key").alias("key")).select("key")
    known = nodes.select("key", "project").distinct()
    inside = links.distinct().join(known.select(F.col("key").alias("src"), F.col("project").alias("_a")), "src").join(known.select(F.col("key").alias("dst"), F.col("project").alias("_b")), "dst").filter("_a = _b").select("src", "dst")
    depth = click_depths(nodes.select("key"), inside, root, folder)
    return nodes.join(inbound, "key", "left").join(outbound, "key", "left").join(depth, "key", "left").select(
        "url", F.coalesce("inbound_links", F.lit(0)).alias("inbound_links"), F.coalesce("outbound_links", F.lit(0)).alias("outbound_links"),
        F.coalesce("click_depth", F.lit(-1)).alias("click_depth"), (F.col("inbound_links").isNull() & ~is_homepage(F.col("url"))).alias("is_orphan"))


def graph_summary(graph: DataFrame) -> DataFrame:
    return graph.agg(F.count("*").alias("total_pages"), F.count_if("is_orphan").alias("orphan_pages"), F.max("click_depth").alias("max_depth"), F.count_if(F.col("click_depth") < 0).alias("unreachable_pages"))


def cross_link_strength(n_nodes: Column, n_edges: Column) -> Column:
    """Edges as a share of the pairs of nodes, at most 1; 0 for fewer than two nodes."""
    return F.when(n_nodes > 1, F.least(n_edges * 2.0 / (n_nodes * (n_nodes - 1)), F.lit(1.0))).otherwise(0.0)
