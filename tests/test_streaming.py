"""Streams: scores of crawled pages batch by batch, and windowed counts with late events."""

import datetime as dt
import time

from sitegauge.plans.page_analysis import page_scores
from sitegauge.streaming.pages import event_counts, score_stream


def test_scores_of_a_stream_equal_those_of_the_table(spark, tmp_path):
    html = "<html><head><title>A title of a page that is long enough</title></head><body><h1>Head</h1><p>text</p></body></html>"
    schema = "page_id long, url string, html string"
    for k in range(2):
        spark.createDataFrame([(10 * k + i, f"https://a.org/{k}/{i}", html if i % 2 else None) for i in range(3)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    score_stream(stream, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.select("batch").distinct().count() == 2
    want = page_scores(spark.read.parquet(f"{tmp_path}/in"))
    assert sorted(got.select("page_id", "page_score").collect()) == sorted(want.select("page_id", "page_score").collect())


def test_late_events_are_left_out(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1, 0, 0) + dt.timedelta(minutes=m)
    schema = "ts timestamp, event_type string, value double"
    for k, rows in enumerate(([(at(5), "a", 1.0), (at(50), "a", 2.0)], [(at(200), "b", 5.0)], [(at(201), "b", 5.0)], [(at(10), "a", 100.0), (at(400), "b", 1.0)], [(at(401), "b", 1.0)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/k={k}")
        time.sleep(1.1)  # files are read in order of their time
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in/*")
    query = event_counts(files).writeStream.format("memory").queryName("counted").outputMode("append").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(str(r["window_start"]), r["event_type"]): (r["n"], r["total"]) for r in spark.table("counted").collect()}
    assert got["2024-01-01 00:00:00", "a"] == (2, 3.0)
