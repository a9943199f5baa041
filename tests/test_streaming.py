"""Keyed state of the incremental jobs: many deliveries, repeated rows, session settings."""

from pyspark.sql import functions as F

from tarnlake.streaming import incremental as S

SCHEMA = "uid long, resp_idx long, score double"
BATCHES = 20


def deliver(spark, root, k, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/in")



def test_keys_are_scored_once_over_many_batches(spark, tmp_path):
    root, settings = str(tmp_path), {k: spark.conf.get(k, None) for k in S.KEYED_STATE}
    for k in range(BATCHES):
        # new keys, the keys of the delivery before, one twice and a null key
        deliver(spark, root, k, [(u, 0, 1.0) for u in range(10 * k, 10 * k + 20)] + [(10 * k, 0, 1.0), (None, 0, 1.0)])
    S.score_once(S.arriving(spark, f"{root}/in", SCHEMA, 1), ["uid", "resp_idx"], F.col("score") * 2, f"{root}/out", f"{root}/ckpt")
    done = spark.read.parquet(f"{root}/out")
    assert done.select("batch_id").distinct().count() == BATCHES
    assert done.count() == done.select("uid", "resp_idx").distinct().count() == 10 * BATCHES + 10 + 1
    assert done.filter("score != 2").count() == 0
    # a later run knows the keys without the results: they may be moved away
    deliver(spark, root, BATCHES, [(0, 0, 1.0), (9999, 0, 1.0)])
    S.score_once(S.arriving(spark, f"{root}/in", SCHEMA, 1), ["uid", "resp_idx"], F.col("score"), f"{root}/elsewhere", f"{root}/ckpt")
    assert [r["uid"] for r in spark.read.parquet(f"{root}/elsewhere").collect()] == [9999]
    assert settings == {k: spark.conf.get(k, None) for k in S.KEYED_STATE}


def test_forced_runs_score_again(spark, tmp_path):
    root = str(tmp_path)
    deliver(spark, root, 0, [(1, 0, 1.0), (1, 0, 1.0), (2, 0, 0.0)])
    for force in (False, True):
        S.score_once(S.arriving(spark, f"{root}/in", SCHEMA), ["uid", "resp_idx"], F.col("score"), f"{root}/out", f"{root}/ckpt", force)
    assert spark.read.parquet(f"{root}/out").count() == spark.read.parquet(f"{root}/out_forced").count() == 2


def test_current_rates_hold_one_row_per_prompt(spark, tmp_path):
    root = str(tmp_path)
    for k in range(BATCHES):
        # prompt 0 comes with every delivery, each other one once; a null score is no pass
        deliver(spark, root, k, [(0, k, float(k % 2)), (k + 1, 0, 1.0), (k + 1, 1, None)])
    S.running_pass_rates(S.arriving(spark, f"{root}/in", SCHEMA, 1), "uid", "score", f"{root}/out", f"{root}/ckpt")
    got = {r["uid"]: (r["n_responses"], r["pass_rate"]) for r in S.current_pass_rates(spark, "uid", f"{root}/ckpt").collect()}
    assert got == {0: (BATCHES, 0.5)} | {k + 1: (2, 0.5) for k in range(BATCHES)}
    # a micro-batch writes the prompts that it touched only
    sizes = spark.read.parquet(f"{root}/out").groupBy("batch_id").count().collect()
    assert len(sizes) == BATCHES and {r["count"] for r in sizes} == {2}


KL_STEPS = "run string, at timestamp, value double"
KL_ARGS = ("run", ["at"], "value", 0.2, 50.0, 10000.0, 64)


def test_steps_out_of_order_within_the_delay(spark, tmp_path):
    import datetime
    import random

    root, rnd = str(tmp_path), random.Random(3)
    start = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    data = [(run, start + datetime.timedelta(minutes=m), rnd.random() * 100) for run in ("a", "b", None) for m in range(60)]
    sent = sorted(data, key=lambda r: r[1] + datetime.timedelta(minutes=rnd.random() * 8))
    args = (*KL_ARGS, f"{root}/out")
    for k in range(0, len(sent), 30):
        spark.createDataFrame(sent[k : k + 30], KL_STEPS).coalesce(1).write.mode("append").parquet(f"{root}/in")
        S.kl_coefficients(S.arriving(spark, f"{root}/in", KL_STEPS), *args, f"{root}/ckpt", delay="10 minutes")
    done = spark.read.parquet(f"{root}/out")
    assert done.filter("late").count() == 0
    held = S.pending_kl_coefficients(spark, *args, KL_STEPS)
    assert 0 < held.count() <= 3 * 11
    got = {(r["run"], r["at"].timestamp()): r["kl_coef"] for r in done.unionByName(held, allowMissingColumns=True).collect()}
    assert len(got) == len(data)
    for run in ("a", "b", None):
        coef = 0.2
        for _, at, value in sorted((r for r in data if r[0] == run), key=lambda r: r[1]):
            coef *= 1 + min(max(value / 50 - 1, -0.2), 0.2) * 64 / 10000
            assert abs(got[run, at.timestamp()] - coef) < 1e-9


def test_steps_beyond_the_delay_are_marked(spark, tmp_path):
    import datetime

    root = str(tmp_path)
    minute = lambda m: datetime.datetime(2024, 1, 1, 0, m, tzinfo=datetime.timezone.utc)
    for rows in ([("a", minute(0), 60.0), ("a", minute(30), 60.0)], [("a", minute(31), 60.0)], [("a", minute(5), 60.0), ("a", minute(0), 1.0)]):
        spark.createDataFrame(rows, KL_STEPS).coalesce(1).write.mode("append").parquet(f"{root}/in")
        S.kl_coefficients(S.arriving(spark, f"{root}/in", KL_STEPS), *KL_ARGS, f"{root}/out", f"{root}/ckpt", delay="10 minutes")
    rows = spark.read.parquet(f"{root}/out").collect()
    # minute 5 is behind the clock but before no released step, so it still gets its place; minute 0 comes too late
    assert {(r["at"].minute, r["value"], r["late"]) for r in rows} == {(0, 60.0, False), (5, 60.0, False), (0, 1.0, True)}


def test_kl_deliveries_come_from_one_reading(spark, sf_dir, monkeypatch):
    """A middle that differs each time it is computed may not lose or repeat steps, nor make them late."""
    import time

    from tarnlake.plans import REGISTRY
    from tarnlake.plans import sources as Q

    percentile = F.percentile_approx
    drift = F.udf(lambda x: x + time.time_ns() // 1000 * 3000 % 10**12, "long")
    monkeypatch.setattr(Q.F, "percentile_approx", lambda c, p: percentile(drift(c), p))
    got = REGISTRY["s6_kl_coefficient_state"].run(spark, sf_dir)
    n = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    r = got.agg(F.count("*").alias("n"), F.count("kl_coef").alias("with_coef"), F.countDistinct("event_id").alias("ids")).first()
    assert (r.n, r.with_coef, r.ids) == (n, n, n)


def test_rescore_ranks_responses_once_and_counts_no_state(spark, sf_dir, monkeypatch):
    from tarnlake.plans import REGISTRY
    from tarnlake.plans import sources as Q

    read, counted, key = [], [], "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows"
    monkeypatch.setattr(Q, "arrivals", lambda *a, f=Q.arrivals: read.append(1) or f(*a))
    monkeypatch.setattr(S, "drain", lambda q, f=S.drain: counted.append(spark.conf.get(key)) or f(q))
    got = REGISTRY["s4_idempotent_rescore"].run(spark, sf_dir)
    assert len(read) == 1 and counted == ["false", "false"]
    n = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    assert got.count() == got.select("uid", "resp_idx").distinct().count() == n
