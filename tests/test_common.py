import os

from pyspark.sql import functions as F

from quire import common


def test_sweep(spark):
    df = common.cut(spark.range(5))
    table = common.stored(df, "numbers")
    assert df.count() == table.count() == 5
    folder = common.shared_dir(spark)
    assert any(n.startswith("quire-numbers") for n in os.listdir(folder))
    assert common.sweep(spark) >= 2
    assert not any(n.startswith("quire-numbers") for n in os.listdir(folder))
    assert common.cut(spark.range(3)).count() == 3  # work goes on after it


def test_lookup_of_frequent_and_missing_keys(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    rows = spark.range(100).select(F.when(F.col("id") < 30, 1).when(F.col("id") < 60, None).otherwise(F.col("id") % 7 + 2).cast("long").alias("k"), "id")
    table = spark.createDataFrame([(1, "a"), (3, "b"), (50, "c")], "k long, v string")
    counts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    for hot in (10, 10_000):
        monkeypatch.setattr(common, "HOT_ROWS", hot)
        for how in ("left", "inner"):
            got = sorted((tuple(r) for r in common.skew_lookup(rows, "k", table, counts=counts, how=how).select("k", "id", "v").collect()), key=str)
            assert got == sorted((tuple(r) for r in rows.join(table, "k", how).select("k", "id", "v").collect()), key=str)
