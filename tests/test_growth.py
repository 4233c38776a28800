"""Figures that grow no faster than the input: tasks, broadcasts and widths of rows."""

from pyspark.sql import functions as F

from catalog_fusion.functions import requests
from catalog_fusion.operators import collapse, encode
from catalog_fusion.plans import rating_model, tree_table
from catalog_fusion.schema import UNIFIED_SCHEMA
from catalog_fusion.sources import records


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_forest_is_no_column_of_the_rows(spark):
    leaf = (None, None, None, None)
    nodes = [(0, 0.5, 0, 1, 2.0, 1, 2, None), (0, 0.5, 1, *leaf, 1.0), (0, 0.5, 2, *leaf, 3.0), (1, 2.0, 0, *leaf, 10.0)]
    nodes += [(2, 1.0, 0, 0, None, 1, 2, None), (2, 1.0, 1, *leaf, 100.0), (2, 1.0, 2, *leaf, 200.0)]
    nodes += [(3, 1.0, 0, 0, float("nan"), 1, 2, None), (3, 1.0, 1, *leaf, 1000.0), (3, 1.0, 2, *leaf, 2000.0)]
    rows = spark.createDataFrame([(1, [0.0, 2.0]), (2, [0.0, 2.5]), (3, [None, None]), (4, None), (5, [float("nan")] * 2)], "id int, x array<double>")
    out = tree_table.score_nodes(rows, spark.createDataFrame(nodes, tree_table.NODE_SCHEMA), F.col("x"), 2)
    want = {1: 1220.5, 2: 1221.5, 3: 2221.5, 4: 2221.5, 5: 1221.5}
    assert {r["id"]: r["prediction"] for r in out.collect()} == want
    assert "__forest" not in plan(out) and "lambda" not in plan(out)
    unknown = spark.createDataFrame([(0, 1.0, 0, *leaf, None)], tree_table.NODE_SCHEMA)
    assert {r["prediction"] for r in tree_table.score_nodes(rows, unknown, F.col("x"), 2).collect()} == {None}


def test_requests_of_one_file_are_dealt_out_by_their_slots(spark, monkeypatch):
    monkeypatch.setattr(requests, "TASK_SLOTS", 100)
    wanted = spark.range(50).coalesce(1).select(F.col("id").alias("request_id"), F.lit("2026-11-01").alias("window_start"), F.lit("2026-11-02").alias("window_end"))
    grid = requests.slot_grid(requests.spread_requests(wanted))
    held = [len(p) for p in grid.rdd.glom().collect()]
    assert sum(held) == 600 and len(held) == 6 and max(held) <= 200
    assert requests.spread_requests(wanted.limit(5)).rdd.getNumPartitions() == 1
    monkeypatch.setattr(rating_model, "_SCORED_ROWS", 10)
    assert rating_model.RatingModel.spread(wanted).rdd.getNumPartitions() == 5


def test_long_keys_are_broadcast_by_their_digest(spark):
    rows = spark.range(300).select(F.concat(F.repeat(F.lit("k"), F.lit(3000)), F.col("id") % 100).alias("k"), (F.col("id") % 7).cast("double").alias("y"))
    encoder = encode.TargetEncoder.fit(rows, ["k"], "y")
    assert encoder.narrow_size == 100 * 97 and encoder.sizes["k"] > 300_000
    tight = encoder.transform(rows, broadcast_bytes=10_000)
    assert "BroadcastHashJoin" in tight._jdf.queryExecution().executedPlan().toString()
    assert "_row" not in plan(tight)
    assert sorted(tight.collect()) == sorted(encoder.transform(rows).collect())


def test_ratings_alone_are_narrow_rows(spark):
    rows = spark.createDataFrame([], UNIFIED_SCHEMA).withColumn("source_rank", F.lit(0))
    child = collapse.collapse_by_id(rows)._jdf.queryExecution().analyzed()
    while child.nodeName() != "Aggregate":
        child = child.children().head()
    names = {child.children().head().output().apply(i).name() for i in range(child.children().head().output().size())}
    assert names == {"imdb_id", "_fields", "rating", "vote_count", "source", "source_rank"}


def test_a_split_that_ends_with_its_batch_reports(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        lines = spark.createDataFrame([("h", 1, 0), ("a", 1, 0), ("b", 1, 9), ("c", 1, 9), ("d", 1, 18)], "value string, __file long, __block long").coalesce(1)
        got = records._records(lines, ",", False).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(r["__block"] for r in got if r["__kind"] == records._SPLIT) == [0, 9, 18]
    assert [r["__text"] for r in got if r["__kind"] == records._WHOLE] == ["a", "b", "c", "d"]
