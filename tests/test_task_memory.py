"""What one task reads and holds stays the same when tables grow."""

import pytest
from pyspark.sql import functions as F

from tarnlake.operators import preference as P
from tarnlake.operators import ranks as R
from tarnlake.plans import REGISTRY
from tarnlake.session import size_bytes

SPLIT = "spark.sql.files.maxPartitionBytes"


def test_queries_bound_the_split_a_task_reads(spark, sf_dir):
    before = spark.conf.get(SPLIT)
    try:
        for given, want in (("128m", 16 << 20), ("134217728b", 16 << 20), ("1g", 16 << 20), ("4k", 4 << 10), ("16MB", 16 << 20)):
            spark.conf.set(SPLIT, given)
            REGISTRY["e31_data_source_counts"].run(spark, sf_dir)
            assert size_bytes(spark.conf.get(SPLIT)) == want
    finally:
        spark.conf.set(SPLIT, before)


def test_pairwise_accuracy_reads_its_rows_once(spark):
    """One check and one reading of the rows; nulls, single rows and equal accuracies count 0.5 as before."""
    import random

    rnd = random.Random(5)
    data = [(rnd.randrange(40), i, float(rnd.randrange(4)), float(rnd.randrange(5))) for i in range(300)]
    data += [(None, 900, 1.0, 0.0), (None, 901, 2.0, 1.0), (50, 902, 1.0, None), (50, 903, 1.0, 2.0), (51, 904, 1.0, 1.0), (51, 905, None, 1.0)]
    data += [(52, 906, 1.0, None), (52, 907, 2.0, 1.0), (52, 908, 3.0, 0.0), (52, 909, 0.0, 3.0)]
    df = spark.createDataFrame(data, "uid long, pos long, s double, a double")
    out = P.pairwise_accuracy(df, ["uid"], "pos", "s", "a")
    want = {}
    for u in {r[0] for r in data}:
        own = [r for r in data if r[0] == u and u is not None and r[3] is not None]
        at = lambda r: (r[2] is not None, r[2] or 0.0, r[1])
        pairs = [(x, y) for x in own for y in own if x[3] < y[3]]
        weight = sum(y[3] - x[3] for x, y in pairs)
        want[u] = sum(y[3] - x[3] for x, y in pairs if at(x) < at(y)) / weight if weight else 0.5
    got = {r.uid: r.accuracy for r in out.collect()}
    assert got.keys() == want.keys() and all(abs(got[u] - want[u]) < 1e-12 for u in want)
    assert out._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1


def test_detached_loss_checks_group_sizes_once(spark, monkeypatch):
    calls = []
    for module in (P, R):
        monkeypatch.setattr(module, "checked_limit", lambda *a, f=R.checked_limit, **k: calls.append(1) or f(*a, **k))
    df = spark.createDataFrame([(1, 1.0, 0.3), (1, 0.0, 0.4), (2, 1.0, 0.1)], "uid long, acc double, q double")
    P.detached_loss(df, ["uid"], "acc", "q", 2.0).first()
    assert len(calls) == 1


def test_pairs_are_marked_in_one_reading(spark, sf_dir):
    """Complete pairs come out of a window over the positions: the rows are not read again and joined."""
    from tarnlake.plans.preference import two

    assert two(spark, sf_dir)._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1


def test_incomplete_pairs_and_rows_without_prompt_are_left_out(spark, tmp_path):
    from tarnlake.plans.advantages import pairs

    rows = [(uid, i + 1, 1, 1, 1.0, 1.0, 0.1, 0.0, "A", "F") for uid, n in ((1, 3), (2, 1), (3, 2), (None, 2)) for i in range(n)]
    names = ["l_linenumber int", "l_partkey long", "l_suppkey long", "l_quantity double", "l_extendedprice double",
             "l_discount double", "l_tax double", "l_returnflag string", "l_linestatus string"]
    spark.createDataFrame(rows, ", ".join(["l_orderkey long", *names])).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = sorted((r.uid, r.pair_no, r.side) for r in pairs(spark, str(tmp_path)).collect())
    assert got == [(1, 0, 0), (1, 0, 1), (3, 0, 0), (3, 0, 1)]


@pytest.mark.parametrize("sent", [10_000, 0])
def test_buckets_of_a_hot_group_go_to_several_tasks(spark, monkeypatch, sent):
    """Rows that a join has dealt by their group alone would all be ranked by one task."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    monkeypatch.setattr(R, "MAX_SENT", sent, raising=False)
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df = spark.range(3000).select((F.col("id") % 2).alias("g"), F.xxhash64("id").alias("k"))
        got = R.row_index(df, [F.col("k")], ["g"], "pos", 100).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for g in (0, 1):
        own = sorted((r for r in got if r.g == g), key=lambda r: r.k)
        assert [r.pos for r in own] == list(range(1500))
        assert len({r.task for r in own}) > 2


def test_bootstrap_rows_are_made_once(spark, sf_dir):
    """u4 counts, cuts, sums and ranks its rows: they come from a stored table, not from the join made again."""
    files = REGISTRY["u4_bootstrap_reduce_functions"].run(spark, sf_dir).inputFiles()
    assert files and not any("lineitem" in f or "orders" in f for f in files)
