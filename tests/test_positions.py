"""Exact positions: ties across a cut, heavy keys, and ranks whose buckets are cut a second time."""

import pytest
from pyspark.sql import functions as F

from tarnlake.operators import batches as B
from tarnlake.operators import ranks as R


def test_split_of_two_keys_is_exact(spark):
    df = spark.range(40_000).select("id", (F.col("id") % 2).alias("k"))
    got = B.positional_split(df, [F.col("k")], 0.75)
    assert {r["split"]: r["count"] for r in got.groupBy("split").count().collect()} == {"train": 30_000, "test": 10_000}
    assert got.filter("k = 0 AND split = 'test'").count() == 0
    again = B.positional_split(df.repartition(7), [F.col("k")], 0.75)
    assert got.select("id", "split").exceptAll(again.select("id", "split")).count() == 0


def test_chunks_of_tied_and_of_equal_rows(spark):
    df = spark.range(30_000).select((F.col("id") % 3 == 0).cast("int").alias("k"), F.lit("same").alias("x"))
    got = B.chunk(df, [F.col("k")], 6)
    assert [r["count"] for r in got.groupBy("chunk").count().orderBy("chunk").collect()] == [5000] * 6
    assert got.filter("chunk < 4").agg(F.max("k")).first()[0] == 0 and got.filter("chunk >= 4").agg(F.min("k")).first()[0] == 1


@pytest.mark.parametrize("n", [10_500, 20_000, 29_999])
def test_first_rows_do_not_change_with_the_partitions(spark, n):
    df = spark.range(30_000).select("id", F.lit(1).alias("k"), F.create_map(F.lit("a"), F.col("id")).alias("m"))
    a, b = (B.first_n(x, [F.col("k")], n).select("id") for x in (df, df.repartition(5)))
    assert a.count() == n and a.exceptAll(b).count() == 0


def test_key_of_a_row_among_heavy_ties(spark):
    df = spark.range(60_000).select(F.when(F.col("id") < 59_000, 5).otherwise(F.col("id") % 11).cast("int").alias("k"))
    rows = sorted(r["k"] for r in df.collect())
    at = [1, 300, 600, 30_000, 59_500, 60_000]
    assert [k["k0"] for k in R.nth_keys(df, [F.col("k")], at, direct=50)] == [rows[p - 1] for p in at]


@pytest.mark.parametrize("by", [[], ["g"]])
def test_buckets_are_cut_again(spark, monkeypatch, by):
    monkeypatch.setattr(R, "MAX_BUCKETS", 16)
    seen = []
    plain = R.plain_totals
    monkeypatch.setattr(R, "plain_totals", lambda df, by, *a: seen.append(by) or plain(df, by, *a))
    df = spark.range(20_000).select("id", F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 40).alias("g"), F.xxhash64("id").alias("o"), (F.col("id") % 5).alias("v"))
    got = R.running_totals(df, by, [F.col("o")], {"n": F.lit(1), "total": F.col("v")}, hot_rows=100)
    want = plain(df, by, [F.col("o")], {"n": F.lit(1), "total": F.col("v")})
    assert sorted(got.columns) == sorted(want.columns)
    got = got.select(want.columns)
    assert got.exceptAll(want).count() == 0 and got.count() == 20_000
    assert any("_bucket1" in b for b in seen)
