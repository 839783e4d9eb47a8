import os

from pyspark.sql import functions as F

from spanloom.llm import common
from spanloom.llm.common import join_groups, small_batches, written


def test_groups_join_alike_with_and_without_hot_ones(spark, monkeypatch):
    rows = spark.range(300).select(F.when(F.col("id") < 200, 7).otherwise(F.col("id") % 30).alias("k"), "id")
    groups = rows.where("k <> 5").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))
    want = {tuple(r) for r in rows.join(groups, "k").collect()}
    plain = join_groups(rows, groups, "k", "n", 300)
    monkeypatch.setattr(common, "hot_size", lambda total: 50)
    hot = join_groups(rows, groups, "k", "n", 300)
    assert {tuple(r) for r in plain.collect()} == {tuple(r) for r in hot.collect()} == want and plain.columns == hot.columns
    assert "Union" in hot._jdf.queryExecution().toString() and "Union" not in plain._jdf.queryExecution().toString()


def test_written_tables_keep_rows_and_schema_and_go_when_dropped(spark):
    df = spark.createDataFrame([(1, "a", [1.5])], "a int, b string, c array<double>")
    scratch = []
    got = written(df, "x", scratch)
    assert got.schema == df.schema and got.collect() == df.collect() and len(scratch) == 1
    path = scratch[0].removeprefix("file://")
    common.drop(spark, scratch)
    assert not os.path.exists(path) and scratch == []


def test_small_batches_put_the_setting_back(spark):
    before = spark.conf.get(common._ARROW)
    with small_batches(spark):
        assert int(spark.conf.get(common._ARROW)) == common.ARROW_ROWS
    assert spark.conf.get(common._ARROW) == before
