"""Click depths of the link graph."""

import pytest
from pyspark.sql import functions as F

from sitegauge.operators.graph import click_depths


def test_click_depth_has_no_silent_end(spark, tmp_path):
    nodes = spark.range(41).select(F.col("id").cast("string").alias("key"))
    links = spark.range(40).select(F.col("id").cast("string").alias("src"), (F.col("id") + 1).cast("string").alias("dst"))
    root = spark.createDataFrame([("0",)], "key string")
    with pytest.raises(ValueError):
        click_depths(nodes, links, root, str(tmp_path), limit=2)
    got = click_depths(nodes, links, root, str(tmp_path)).collect()
    assert sorted(int(r["key"]) for r in got) == list(range(41)) and all(int(r["key"]) == r["click_depth"] for r in got)
