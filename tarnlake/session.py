"""Session settings shared by the jobs, tests and bench."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


TASKS = {
    # split a skewed join even when a later step then needs a shuffle of its own
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # rows of numbers take about 20 times their shuffled bytes in a sort or hash table: a task gets 16 MB of them at
    # most, and there are parts enough to deal 32 GB of shuffle that way (small ones are put together again)
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "2048",
}


# a task reads at most so much of a table: rows of numbers take about 25 times their file bytes in a partial aggregate
SPLIT_KEY, SPLIT_BYTES = "spark.sql.files.maxPartitionBytes", 16 << 20


def bound_tasks(spark: SparkSession) -> None:
    """The settings of TASKS hold from now on; splits become smaller, never larger, than the session has them."""
    for key, value in TASKS.items():
        spark.conf.set(key, value)
    if size_bytes(spark.conf.get(SPLIT_KEY)) > SPLIT_BYTES:
        spark.conf.set(SPLIT_KEY, str(SPLIT_BYTES))


def size_bytes(text: str) -> int:
    """Bytes of a size setting such as '128m', '134217728b' or '4k'."""
    number, unit = re.fullmatch(r"(\d+)\s*([bkmgtp]?)b?", text.strip().lower()).groups()
    return int(number) << 10 * "bkmgtp".index(unit or "b")


def build_session(app: str = "tarnlake", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **TASKS,
        "spark.ui.enabled": "false",
        # no call site is sent to the JVM for every column expression; long expressions are built twice as fast
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def int_conf(spark: SparkSession, key: str, default: int) -> int:
    return int(spark.conf.get(key, str(default)))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a local one only where the setting is empty and the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if named:
        if current is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    if current is None:
        require_local(spark.sparkContext.master)
        current = tempfile.mkdtemp(prefix="tarnlake-ckpt-")
        spark.sparkContext.setCheckpointDir(current)
    return current


def require_local(master: str) -> None:
    """On a cluster a local folder would hold a part of the files on each machine."""
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of the session (never a worker-local one on a cluster)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def durable(df: DataFrame, name: str = "step") -> DataFrame:
    """Write an intermediate table once to the shared folder and go on from there.

    Lost executors then cost no recomputation, and later readers get real sizes and pruned columns.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
