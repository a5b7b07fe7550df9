"""Work is dealt out by the number of rows, and nothing that grows with the table is broadcast."""

from sitegauge import catalog
from sitegauge.registered import content as queries
from sitegauge.sources import tables


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_pages_of_a_small_file_are_made_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(tables, "ROWS_OF_TASK", 20)
    assert queries.product_pages(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 10


def test_items_and_media_join_nothing(spark):
    for name in ("product_items", "product_media"):
        shown = plan(catalog.QUERIES[name](spark, "/root/testdata/sf0.001"))
        assert "Join" not in shown and shown.count("MapInArrow") == 1


def test_items_of_pages_with_one_key(spark):
    from sitegauge.operators import content

    html = '<div itemscope itemtype="https://schema.org/A"><b itemprop="n">1</b></div><i itemscope itemtype="https://schema.org/B"></i><u vocab="v" property="p">x</u>'
    rows = spark.createDataFrame([(1, html), (None, html)], "page_id long, html string")
    got = content.structured_items(content.with_dom(rows), "page_id").collect()
    assert sorted(str((r["page_id"], r["types"], r["properties"])) for r in got) == ["(1, ['A'], {'n': ['1']})", "(1, ['B'], None)", "(None, ['A'], {'n': ['1']})", "(None, ['B'], None)"]


def test_typed_pages_are_dealt_out_and_parsed_only_where_the_tree_is_read(spark, monkeypatch):
    monkeypatch.setattr(tables, "ROWS_OF_TASK", 20)
    assert queries.typed_pages(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 10
    for name in ("page_schema_checks", "entity_shapes"):
        assert "MapInArrow" not in plan(catalog.QUERIES[name](spark, "/root/testdata/sf0.001"))


def test_trees_are_made_of_bounded_parts(spark, monkeypatch):
    import pyarrow as pa

    from sitegauge.sources import dom

    monkeypatch.setattr(dom, "PART", 10)
    batch = pa.RecordBatch.from_pydict({"k": list(range(6)), "html": ["<p>ab", None, "<p>abc", "<p>" + "x" * 30, "", "<b>"]})
    parts = list(dom._parse([batch], "html", {}, {}))
    assert [b.column("k").to_pylist() for b in parts] == [[0, 1], [2], [3], [4, 5]] and [len(x) for b in parts for x in b.column("dom").to_pylist()] == [2, 0, 2, 2, 0, 1]
    assert [b.num_rows for b in dom._parse([batch.slice(0, 0)], "html", {}, {})] == []


def test_intents_put_a_text_into_small_letters_once(spark):
    from pyspark.sql import functions as F

    from sitegauge.functions.intents import intent_shares

    df = spark.createDataFrame([("How to BUY the best Price",), ("",), (None,)], "t string").select(intent_shares(F.col("t")).alias("i"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
    got = [(r["i"]["total"], r["i"]["confidence"], r["i"]["shares"]["commercial"]) for r in df.collect()]
    assert got == [(16.0, "high", 13 * 100 / 16), (0.0, "low", 25.0), (0.0, "low", 25.0)]


def test_customers_and_audits_are_dealt_out(spark, monkeypatch):
    from sitegauge.registered import presence

    monkeypatch.setattr(tables, "ROWS_OF_TASK", 20)
    assert presence.pages(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() > 1
    assert catalog.QUERIES["lighthouse_metrics"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() > 1


def test_repeated_runs_are_found_without_a_shuffle(spark):
    from sitegauge.operators.blocks import without_repeats

    run = " ".join(f"w{i}" for i in range(20))
    rows = [(1, f"{run} x\n{run}\ty"), (2, run), (3, None), (None, "a " * 60), (4, f"{run} {run}"[:-1] + "z")]
    out = without_repeats(spark.createDataFrame(rows, "k int, t string"), "k", "t")
    assert "Exchange" not in plan(out)
    assert {r["k"]: r["kept"] for r in out.collect()} == {1: f"{run} x y", 2: run, 3: "", None: "a", 4: f"{run} {run}"[:-1] + "z"}


def test_documents_are_counted_for_the_top_words_alone(spark, tmp_path):
    rows = [(1, "Word word abc"), (1, "WORD other"), (None, "other2"), (2, "x" * 5 + " other-word")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = catalog.QUERIES["top_words"](spark, str(tmp_path))
    assert "array_intersect" in plan(out)
    assert [tuple(r) for r in out.collect()] == [("word", 4, 2), ("other", 3, 2), ("xxxxx", 1, 1)]
