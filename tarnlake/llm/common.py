"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.session import scratch_path

# fixed values: white space of the word rule, and the word rule itself
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write a table once to the shared folder and go on from the files; a lost executor then costs nothing.

    Unlike a read with a given schema this lets Spark see file sizes and footers only.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Smaller Arrow batches for jobs that hand whole texts to Python, unless the session set its own."""
    if spark.conf.get(BATCH_ROWS, None) in (None, "10000"):
        spark.conf.set(BATCH_ROWS, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Words of the whole text (null: none)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{SPACE_CLASS}+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_PATTERN)).cast("long")


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from: crc32 of the id as text, modulo 5, is 0 (null id: held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """At most ``max_rows`` labelled documents in hash order of their id, none of them held out.

    The choice is made on the narrow label table; its bounded result is broadcast to the documents.
    A document with several labels counts once, with the largest; of an id with several rows the least is
    taken, so the result has at most ``max_rows`` rows whatever the documents repeat.
    """
    chosen = (
        labels.filter(F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max(label).alias("_label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    rest = [c for c in docs.columns if c != "doc_id"]
    found = docs.join(F.broadcast(chosen.withColumnRenamed("doc_id", "_id")), F.col("doc_id") == F.col("_id"))
    return found.groupBy("doc_id", "_label").agg(F.min(F.struct(*rest)).alias("_row")).select("doc_id", "_row.*", "_label")
