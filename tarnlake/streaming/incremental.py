"""Incremental jobs over arriving response files.

Files are a streaming source and every run takes what is new (``availableNow``), so the checkpoint
replaces markers and skip lists.  Results are written by micro-batch: a batch that is retried after
a lost executor or driver overwrites its own folder and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.functions.policy import clip
from tarnlake.operators.advantages import linear_scan
from tarnlake.operators.pass_rates import passed
from tarnlake.operators.ranks import row_index
from tarnlake.session import durable


def arriving(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


# fixed values: keyed state on the executors' disks, of which a micro-batch sends its changes only to the checkpoint
KEYED_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # rows are not counted in the state: that takes a further look-up for each key written
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


@contextmanager
def keyed_state(spark: SparkSession):
    """Queries started within keep their state in RocksDB; the session's own settings are put back."""
    before = {k: spark.conf.get(k, None) for k in KEYED_STATE}
    try:
        for k, v in KEYED_STATE.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def drain(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def newest_batch(spark: SparkSession, folder: str) -> int:
    """Number of the last micro-batch whose folder was written to its end."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
    names = [f.getPath().getName() for f in hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(hadoop)]
    numbers = sorted((int(n.removeprefix("batch_id=")) for n in names if n.startswith("batch_id=")), reverse=True)
    return next(n for n in numbers if exists(spark, f"{folder}/batch_id={n}/_SUCCESS"))


def append_scored(stream: DataFrame, score: Column, out: str, checkpoint: str) -> None:
    """Score what has arrived since the last run and append it once."""
    scored = stream.withColumn("score", score)
    drain(scored.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
          .outputMode("append").trigger(availableNow=True).start())


def per_batch(stream: DataFrame, work: Callable[[DataFrame, int], DataFrame | None], out: str, checkpoint: str, mode="append") -> None:
    """Run ``work`` on each micro-batch and keep its result in the batch's own folder."""
    def run(df: DataFrame, batch: int) -> None:
        result = work(df, batch)
        if result is not None:
            result.write.mode("overwrite").parquet(f"{out}/batch_id={batch}")

    drain(stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
          .outputMode(mode).trigger(availableNow=True).start())


def running_pass_rates(stream: DataFrame, key: str, score: str, out: str, checkpoint: str) -> None:
    """Pass rate per prompt, updated as responses arrive; only changed prompts are written.

    The counts are keyed state, so a micro-batch reads and writes the prompts that it touches.
    """
    rates = stream.groupBy(key).agg(
        F.count("*").alias("n_responses"), F.sum(passed(F.col(score))).alias("n_passed")
    ).withColumn("pass_rate", F.col("n_passed") / F.col("n_responses"))
    with keyed_state(stream.sparkSession):
        per_batch(rates, lambda df, _: df, out, checkpoint, mode="update")


def current_pass_rates(spark: SparkSession, key: str, checkpoint: str) -> DataFrame:
    """Pass rate of every prompt after the last micro-batch: one row per prompt out of the state, no history."""
    state = spark.read.format("statestore").load(checkpoint)
    n, n_passed = (F.col("value")[c] for c in state.schema["value"].dataType.names)
    return state.select(F.col("key")[key].alias(key), n.alias("n_responses"), n_passed.alias("n_passed"), (n_passed / n).alias("pass_rate"))


def score_once(stream: DataFrame, keys: list[str], score: Column, out: str, checkpoint: str, force: bool = False) -> None:
    """Score responses that have no score yet; repeated deliveries are dropped unless forced.

    The keys seen are keyed state: a micro-batch looks up its own keys and reads no history.  A forced run
    goes over all deliveries again with a checkpoint of its own and writes beside the first results.
    """
    if force:
        work = lambda df, _: df.dropDuplicates(keys).withColumn("score", score)
        return per_batch(stream, work, f"{out}_forced", f"{checkpoint}_forced")
    with keyed_state(stream.sparkSession):
        per_batch(stream.dropDuplicates(keys).withColumn("score", score), lambda df, _: df, out, checkpoint)


def finished(markers: DataFrame, expected: int) -> DataFrame:
    """Per run: ranks that left a marker, and whether all have."""
    n = markers.groupBy("run").agg(F.countDistinct("rank").alias("ranks"))
    return n.withColumn("complete", F.col("ranks") == expected)


def _kl_scan(rows: DataFrame, run: str, order: list[str], kl: str, start: float, target: float, horizon: float, n_steps: int) -> DataFrame:
    """Coefficients of ordered rows that go on from ``_carry`` (null: from ``start``)."""
    placed = row_index(rows, [F.col(c) for c in order], [run], "_t")
    mult = 1 + clip(F.col(kl) / target - 1, -0.2, 0.2) * n_steps / horizon
    scanned = linear_scan(placed, [run], "_t", mult, F.lit(0.0), "_product", reverse=False, start=F.lit(1.0))
    coef = F.coalesce("_carry", F.lit(float(start))) * F.col("_product")
    return scanned.select(run, *order, kl, coef.alias("kl_coef"), F.lit(False).alias("late"))


def kl_coefficients(
    stream: DataFrame, run: str, order: list[str], kl: str, start: float, target: float, horizon: float, n_steps: int,
    out: str, checkpoint: str, delay: str | None = None,
) -> None:
    """Step-wise KL coefficient per run; each micro-batch goes on from the last coefficient of the run.

    The recurrence is a product, so a batch is scanned from 1 and scaled by the carried value.  What is
    carried is one row per run, kept beside the results and rewritten by each micro-batch, so a batch reads
    no history.  With ``delay`` (an interval such as '10 minutes') the first column of ``order`` is event
    time and each run has a reorder buffer: a step is held back until the run's latest event time lies the
    delay after it, so steps that arrive in any order within the delay get the coefficients of the ordered
    run.  A micro-batch reads and rewrites the held steps only; ``pending_kl_coefficients`` gives those of
    the steps still held.  A step that arrives after later ones of its run were given coefficients cannot
    change these: it is written with ``late`` set and without a coefficient.
    """
    spark = stream.sparkSession
    state, buffer = f"{out}_last", f"{out}_held"
    step = F.struct(*order)

    def run_batch(df: DataFrame, batch: int) -> None:
        rows = df.select(run, *order, kl)
        before = f"{state}/batch_id={batch - 1}"
        known = exists(spark, before)
        if known and delay is not None:
            rows = rows.unionByName(spark.read.schema(rows.schema).parquet(f"{buffer}/batch_id={batch - 1}"))
        event = rows.schema[order[0]].dataType
        if known:
            carried = spark.read.parquet(before)
            rows = rows.join(carried, rows[run].eqNullSafe(carried[run]), "left").drop(carried[run])
        else:
            rows = rows.withColumns({
                "_last": F.lit(None).cast(rows.select(step.alias("s")).schema["s"].dataType), "_carry": F.lit(None).cast("double"), "_seen": F.lit(None).cast(event),
            })
        if delay is None:
            ready = F.lit(True)
        else:
            # the buffer is used for the release and for what stays held, so it is stored once
            seen = rows.groupBy(F.col(run).alias("_run")).agg(F.greatest(F.max(order[0]), F.max("_seen")).alias("_now"))
            rows = durable(rows.join(seen, rows[run].eqNullSafe(seen["_run"])).drop("_run"), "reorder")
            ready = F.coalesce(F.col(order[0]) <= F.col("_now") - F.expr(f"INTERVAL {delay}"), F.lit(True))
        late = F.col("_last").isNotNull() & (step <= F.col("_last"))
        done = _kl_scan(rows.filter(~late & ready), run, order, kl, start, target, horizon, n_steps)
        lost = rows.filter(late).select(run, *order, kl, F.lit(None).cast("double").alias("kl_coef"), F.lit(True).alias("late"))
        place = f"{out}/batch_id={batch}"
        done.unionByName(lost).write.mode("overwrite").parquet(place)
        if delay is not None:
            rows.filter(~late & ~ready).select(run, *order, kl).write.mode("overwrite").parquet(f"{buffer}/batch_id={batch}")

        last = spark.read.parquet(place).filter("not late").groupBy(run).agg(
            F.max(step).alias("_last"), F.max_by("kl_coef", step).alias("_carry"), F.lit(None).cast(event).alias("_seen")
        )
        parts = [last]
        if delay is not None:
            nothing = [F.lit(None).cast(last.schema[c].dataType).alias(c) for c in ("_last", "_carry")]
            parts.append(rows.groupBy(run).agg(*nothing, F.max("_now").alias("_seen")))
        if known:
            parts.append(carried)
        now = parts[0]
        for p in parts[1:]:
            now = now.unionByName(p)
        # a run's last step and its coefficient come together, as coefficients may fall
        now.groupBy(run).agg(F.max("_last").alias("_last"), F.max_by("_carry", "_last").alias("_carry"), F.max("_seen").alias("_seen")).write.mode(
            "overwrite").parquet(f"{state}/batch_id={batch}")

    drain(stream.writeStream.foreachBatch(run_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def pending_kl_coefficients(
    spark: SparkSession, run: str, order: list[str], kl: str, start: float, target: float, horizon: float, n_steps: int, out: str, schema: str,
) -> DataFrame:
    """Coefficients of the steps still held, as if nothing else arrived; the state stays as it is.

    ``schema`` names the columns of the stream.  The last micro-batch is read, however many there were.
    """
    newest = newest_batch(spark, f"{out}_last")
    held = spark.read.schema(spark.createDataFrame([], schema).select(run, *order, kl).schema).parquet(f"{out}_held/batch_id={newest}")
    carried = spark.read.parquet(f"{out}_last/batch_id={newest}").select(F.col(run).alias("_run"), "_carry")
    rows = held.join(carried, held[run].eqNullSafe(carried["_run"]), "left").drop("_run")
    return _kl_scan(rows, run, order, kl, start, target, horizon, n_steps)


def append_step_scores(stream: DataFrame, out: str, checkpoint: str) -> None:
    """(step, score) rows appended for later histograms, one folder per step."""
    drain(stream.select("step", "score").writeStream.format("parquet").partitionBy("step").option("path", out)
          .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start())
