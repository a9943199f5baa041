"""Helpers that split hot groups give the same rows as the plain window."""

import random

import pytest
from pyspark.sql import functions as F

from tarnlake.operators import advantages as A
from tarnlake.operators import preference as P
from tarnlake.operators.ranks import gather, row_index, running_totals


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(6000):
        key = 0 if i % 3 == 0 else rnd.randrange(1, 400)
        rows.append((key, i, float(rnd.randrange(50)), float(rnd.randrange(2)), f"s{rnd.randrange(900)}"))
    return spark.createDataFrame(rows, "key long, id long, x double, acc double, name string").cache()


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.mark.parametrize("by", [[], ["key"]])
@pytest.mark.parametrize("order", [["x", "id"], ["name", "id"]])
def test_running_totals_in_buckets(skewed, by, order):
    cols = [F.col(c) for c in order]
    plain = running_totals(skewed, by, cols, {"s": F.col("x")}, hot_rows=10**9)
    split = running_totals(skewed, by, cols, {"s": F.col("x")}, hot_rows=100)
    assert rows(plain, "id", "s") == rows(split, "id", "s")


def test_descending_order_in_buckets(skewed):
    cols = [-F.col("x"), F.col("id")]
    assert rows(row_index(skewed, cols, ["key"], "r", 10**9), "id", "r") == rows(row_index(skewed, cols, ["key"], "r", 64), "id", "r")


def test_index_is_dense(skewed):
    got = [r.r for r in row_index(skewed, [F.col("x"), F.col("id")], name="r", hot_rows=50).select("r").orderBy("r").collect()]
    assert got == list(range(6000))


def test_gather_keeps_a_record_in_one_row(skewed):
    ranked = row_index(skewed, [F.col("id")], ["key"], "pos", hot_rows=100)
    whole = gather(ranked, ["key"], "pos", {"ids": F.col("id")})
    assert whole.count() == whole.select("key").distinct().count()
    assert whole.filter("key = 0").first().ids == [i for i in range(6000) if i % 3 == 0]


@pytest.mark.parametrize("reverse", [True, False])
def test_linear_scan_over_blocks(skewed, reverse):
    seq = row_index(skewed, [F.col("id")], ["key"], "t").select("key", "t", "x", "id")
    long = A.linear_scan(seq, ["key"], "t", F.lit(0.5), F.col("x"), "y", reverse, block=8)
    got = {r.id: r.y for r in long.collect()}
    by_key = {}
    for r in sorted(seq.collect(), key=lambda r: (r.key, r.t)):
        by_key.setdefault(r.key, []).append((r.id, r.x))
    for items in by_key.values():
        carry = 0.0
        for i, x in reversed(items) if reverse else items:
            carry = x + 0.5 * carry
            assert got[i] == pytest.approx(carry, abs=1e-9)


def test_pairwise_accuracy_against_all_pairs(spark):
    rnd = random.Random(3)
    data = [(k, i, float(rnd.randrange(6)), rnd.randrange(7) / 7) for k in range(30) for i in range(rnd.randrange(1, 15))]
    df = spark.createDataFrame(data, "uid long, pos long, s double, a double")
    got = {r.uid: r.accuracy for r in P.pairwise_accuracy(df, ["uid"], "pos", "s", "a").collect()}
    for k in range(30):
        g = [d for d in data if d[0] == k]
        num = den = 0.0
        for i in range(len(g)):
            for j in range(i + 1, len(g)):
                w = g[i][3] - g[j][3]
                den += abs(w)
                num += abs(w) * ((g[i][2] - g[j][2] > 0) == (w > 0))
        if g:
            assert got[k] == pytest.approx(num / den if den else 0.5)


def test_ranks_of_a_whole_table_are_not_made_by_one_task(spark):
    from tarnlake.operators.ranks import row_index

    n = 60_000
    out = row_index(spark.range(n).select((F.col("id") * 7919 % n).alias("id"), F.lit("text").alias("text")), [F.col("id")])
    assert "_bucket0" in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.filter(F.col("id") != F.col("row_no")).count() == 0
    assert out.count() == n


def test_weighted_resample_heavy_row(spark):
    rows_ = [(i, 1000.0 if i == 5 else 1.0) for i in range(500)]
    df = spark.createDataFrame(rows_, "id long, w double")
    out = A.weighted_resample(df, ["id"], "w", A.md5_uniform(F.col("id").cast("string"), "s"))
    assert out.count() == 500
    share = out.filter("id = 5").count() / 500
    assert 0.55 < share < 0.78


def test_weighted_resample_small_weights_after_a_large_one(spark):
    # as doubles the running total stays at 1e16, and a draw near the end met all the small rows
    df = spark.createDataFrame([(i, 1e16 if i == 0 else 1.0) for i in range(200)], "id long, w double")
    out = A.weighted_resample(df, ["id"], "w", F.lit(1 - 2.0**-53))
    assert rows(out, "draw_id") == [(i,) for i in range(200)]


@pytest.mark.parametrize("heavy", [1.0, 4000.0])
@pytest.mark.parametrize("wide", [1, 16])
def test_weighted_resample_in_parts_is_exact(spark, monkeypatch, heavy, wide):
    from bisect import bisect_right
    from fractions import Fraction

    monkeypatch.setattr(A, "PART_ROWS", 60)
    monkeypatch.setattr(A, "WIDE_TASKS", wide)
    rnd = random.Random(5)
    # two key columns, one null key, null weights, weights too small to be drawn
    data = [(None if i == 0 else i // 3, i % 3, heavy if i == 400 else rnd.choice([None, 1e-30, 0.25, 1.0, 3.5])) for i in range(1200)]
    df = spark.createDataFrame(rnd.sample(data, len(data)), "a long, b long, w double").repartition(7)
    u = A.md5_uniform(F.concat_ws("_", "a", "b"), "s")
    us = {(r.a, r.b): r.u for r in df.select("a", "b", u.alias("u")).collect()}
    with_weight = [(a, b, Fraction(w)) for a, b, w in data if w is not None]
    total, upto, ends = sum(w for *_, w in with_weight), Fraction(0), []
    for *_, w in with_weight:
        upto += w
        ends.append(upto / total)
    want = {k: with_weight[bisect_right(ends, Fraction(x))][:2] for k, x in us.items()}
    got = A.weighted_resample(df, ["a", "b"], "w", u)
    assert got.columns == ["draw_a", "draw_b", "a", "b"]
    rows_ = got.collect()
    assert len(rows_) == len(data) and {(r.draw_a, r.draw_b): (r.a, r.b) for r in rows_} == want


def test_weighted_resample_without_weights(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "id long, w double")
    assert A.weighted_resample(df, ["id"], "w", F.lit(0.5)).count() == 0
    assert A.weighted_resample(df.limit(0), ["id"], "w", F.lit(0.5)).count() == 0


def test_weighted_resample_makes_its_rows_once(spark):
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    df = spark.range(3000).withColumn("w", F.lit(1.0)).mapInArrow(seen, "id long, w double")
    assert A.weighted_resample(df, ["id"], "w", A.md5_uniform(F.col("id").cast("string"), "s")).count() == 3000
    assert made.value == 3000


def test_running_totals_when_only_a_hash_of_the_keys_is_hot(spark, monkeypatch):
    from tarnlake.operators import ranks as R

    df = spark.range(600).select((F.col("id") % 30).alias("g"), "id")
    plain = sorted(map(tuple, running_totals(df, ["g"], [F.col("id")], {"s": F.col("id")}, hot_rows=10**9).collect()))
    monkeypatch.setattr(R, "HASHES", 2)
    assert R._may_be_hot(df, ["g"], 50) and not R._may_be_hot(df, ["g"], 600)
    assert sorted(map(tuple, running_totals(df, ["g"], [F.col("id")], {"s": F.col("id")}, hot_rows=50).collect())) == plain


def test_bootstrap_of_large_prompts(spark, monkeypatch):
    from tarnlake.operators import evaluation as E

    rnd = random.Random(1)
    data = [("s", 1, i, rnd.choice("abc"), float(rnd.randrange(10))) for i in range(40)]
    df = spark.createDataFrame(data, "source string, uid long, pos long, vote string, value double")
    small = {r.n: r for r in E.bootstrap(df, "source", "uid", "pos", "vote", "value", draws=400).collect()}
    monkeypatch.setattr(E, "BOOTSTRAP_ROWS", 10)
    large = {r.n: r for r in E.bootstrap(df, "source", "uid", "pos", "vote", "value", draws=400).collect()}
    exact = {r.n: r for r in E.best_worst_at_n(df, "source", "uid", "value").collect()}
    assert small.keys() == large.keys() == exact.keys()
    for n in exact:
        for got in (small, large):
            assert got[n].best_mean == pytest.approx(exact[n].best_mean, abs=0.5)
            assert got[n].worst_mean == pytest.approx(exact[n].worst_mean, abs=0.5)


def test_bootstrap_draws_follow_the_seed(spark):
    import numpy as np

    from tarnlake.operators import evaluation as E

    x, votes = [0.1, 0.7, 0.4, 0.9, 0.2], list("abbca")
    df = spark.createDataFrame([("s", 1, i, votes[i], x[i]) for i in range(5)], "source string, uid long, pos long, vote string, value double")
    got = {r.n: r for r in E.bootstrap(df, "source", "uid", "pos", "vote", "value").collect()}
    for n in (2, 4, 5):
        np.random.seed(42)
        best, maj = [], []
        for _ in range(1000):
            idx = np.random.choice(5, size=n, replace=True)
            best.append(max(x[i] for i in idx))
            picked = [votes[i] for i in idx]
            top = max(picked, key=picked.count)
            maj.append(x[idx[picked.index(top)]])
        assert got[n].best_mean == pytest.approx(np.mean(best)) and got[n].majority_mean == pytest.approx(np.mean(maj))


def test_bootstrap_is_the_same_at_every_size(spark, monkeypatch):
    from tarnlake.operators import evaluation as E

    rnd = random.Random(7)
    data = [("s", u, 3 * i, rnd.choice("abc"), rnd.random()) for u in (1, 2) for i in range(20)]
    df = spark.createDataFrame(data, "source string, uid long, pos long, vote string, value double")
    run = lambda: {r.n: (r.prompts, r.best_mean, r.worst_mean, r.majority_mean) for r in E.bootstrap(df, "source", "uid", "pos", "vote", "value", draws=100).collect()}
    small = run()
    monkeypatch.setattr(E, "BOOTSTRAP_ROWS", 10)
    large = run()
    assert small.keys() == large.keys() and all(large[n] == pytest.approx(small[n]) for n in small)


def test_counted_draws_are_the_same_at_every_size(spark, monkeypatch):
    import hashlib

    from tarnlake.operators import evaluation as E

    rnd = random.Random(8)
    x, votes = [rnd.random() for _ in range(20)], [rnd.choice("abc") for _ in range(20)]
    df = spark.createDataFrame([("s", 1, 2 * i, votes[i], x[i]) for i in range(20)], "source string, uid long, pos long, vote string, value double")
    run = lambda: {r.n: (r.best_mean, r.worst_mean, r.majority_mean) for r in E.bootstrap(df, "source", "uid", "pos", "vote", "value", 100, 7, True).collect()}
    small = run()
    monkeypatch.setattr(E, "BOOTSTRAP_ROWS", 10)
    large = run()
    assert small.keys() == large.keys() == {2, 4, 8, 16, 20}
    for n in small:
        best, worst, maj = [], [], []
        for d in range(100):
            idx = [int(hashlib.md5(f"7_{n}_{d}_{s}".encode()).hexdigest()[:13], 16) % 20 for s in range(n)]
            picked = [votes[i] for i in idx]
            best.append(max(x[i] for i in idx))
            worst.append(min(x[i] for i in idx))
            maj.append(x[idx[picked.index(max(picked, key=picked.count))]])
        want = [sum(v) / 100 for v in (best, worst, maj)]
        assert small[n] == pytest.approx(want) and large[n] == pytest.approx(want)


def test_bootstrap_with_user_functions(spark):
    from tarnlake.operators import evaluation as E

    df = spark.createDataFrame([("g", i, float(i)) for i in range(100)], "k string, pos long, x double")
    got = E.bootstrap_reduce(df, ["k"], "pos", "x", 8, {"mean": lambda a: a.mean(1)}, draws=500).first()
    assert got.mean_mean == pytest.approx(49.5, abs=2.0) and got.mean_std == pytest.approx(28.9 / 8**0.5, rel=0.15)


@pytest.mark.parametrize("hex_first", [True, False])
def test_nth_keys(skewed, hex_first):
    from tarnlake.operators.ranks import nth_keys, shuffled_order

    order = [shuffled_order(F.col("id"), "z"), F.col("id")]
    ranked = [tuple(r) for r in skewed.select(*order).orderBy(*order).collect()]
    at = [1, 2, 1999, 3000, 6000]
    assert [tuple(k) for k in nth_keys(skewed, order, at, direct=50, hex_first=hex_first)] == [ranked[p - 1] for p in at]


def test_nth_keys_with_a_hot_first_column(skewed):
    from tarnlake.operators.ranks import nth_keys

    order = [F.col("key"), F.col("id")]
    ranked = [tuple(r) for r in skewed.select(*order).orderBy(*order).collect()]
    assert [tuple(k) for k in nth_keys(skewed, order, [10, 1500, 2500], direct=20)] == [ranked[p - 1] for p in (10, 1500, 2500)]


@pytest.mark.parametrize("limit", [None, 20])
def test_peers_against_brute_force(spark, skewed, limit, monkeypatch):
    if limit:
        spark.conf.set("spark.tarnlake.hotGroupRows", str(limit))
    try:
        got = {r.id: (r.peer_mean, r.acc_share_at_or_below) for r in P.peer_means(skewed, ["key"], "acc", "x").collect()}
    finally:
        spark.conf.unset("spark.tarnlake.hotGroupRows")
    groups = {}
    for r in skewed.collect():
        groups.setdefault(r.key, []).append(r)
    for rows_ in groups.values():
        for r in rows_[:20]:
            peers = [p.x for p in rows_ if (p.acc < r.acc if r.acc > 0 else p.acc > r.acc)]
            want = sum(peers) / len(peers) if peers else 0.0
            assert got[r.id] == (pytest.approx(want), pytest.approx(sum(p.acc <= r.acc for p in rows_) / len(rows_)))
