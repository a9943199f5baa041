"""Readers and writers for prompt tables, generation batches, rate maps, dumps and metric files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.session import durable


def read_prompts(spark: SparkSession, *paths: str) -> DataFrame:
    """Prompt tables from several files side by side; a missing chat-template flag means True."""
    return with_template_flag(spark.read.option("mergeSchema", "true").parquet(*paths))


def with_template_flag(df: DataFrame) -> DataFrame:
    flag = F.col("apply_chat_template") if "apply_chat_template" in df.columns else F.lit(None).cast("boolean")
    return df.withColumn("apply_chat_template", F.coalesce(flag, F.lit(True)))


def read_json(spark: SparkSession, path: str, schema: str, whole_file: bool = False) -> DataFrame:
    """JSON lines, or one document (or array) per file; the schema is given, never inferred."""
    return spark.read.schema(schema).json(path, multiLine=whole_file)


def read_documents(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Every file of a folder tree is one JSON document; its path is kept."""
    df = spark.read.schema(schema).option("recursiveFileLookup", "true").json(folder, multiLine=True)
    return df.withColumn("path", F.col("_metadata.file_path"))


def rank_of(path: Column) -> Column:
    """Rank number from a '.../dp3/batch_00001.json' path."""
    return F.regexp_extract(path, r"/dp(\d+)/", 1).cast("int")


def read_shards(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Batches 'dp<rank>/batch_*' with their rank and keys namespaced by batch."""
    df = spark.read.schema(schema).json(f"{root}/dp*/batch_*")
    path = F.col("_metadata.file_path")
    return df.withColumns({
        "rank": rank_of(path), "batch": F.regexp_extract(path, r"/(batch_\d+)", 1),
    }).withColumn("key", F.concat("batch", F.lit("_"), F.col("uid").cast("string")))


def size_suffix(n: int) -> str:
    """200 -> 200, 1500 -> 1.5k, 2000 -> 2k."""
    if n < 1000:
        return str(n)
    return f"{n / 1000:.1f}k" if n % 1000 else f"{n // 1000}k"


def write_sized(df: DataFrame, folder: str, prefix: str) -> tuple[str, int]:
    """Write a table as '<prefix>_<size>' and return its path and row count.

    The name needs the count first, so the rows are stored once and counted where they lie: the input is
    evaluated once and the name is that of the rows written.
    """
    df = durable(df, "sized")
    n = df.count()
    path = f"{folder}/{prefix}_{size_suffix(n)}.parquet"
    df.write.mode("overwrite").parquet(path)
    return path, n


def write_rates(df: DataFrame, path: str) -> None:
    """Rate maps by data set and model."""
    df.write.mode("overwrite").partitionBy("dataset", "model").parquet(path)


def write_tables(df: DataFrame, path: str) -> None:
    """Rows of several tables (``table``, ``split``) in one job, a folder for each table and split."""
    df.write.mode("overwrite").partitionBy("table", "split").parquet(path)


def read_table(spark: SparkSession, path: str, name: str, columns: list[str]) -> DataFrame:
    """One table of ``write_tables`` with its own columns and its split; the other tables' files are not read."""
    return spark.read.parquet(path).filter(F.col("table") == name).select(*columns, "split")


def write_dump(df: DataFrame, path: str) -> None:
    """Rollout dump: JSON lines, one folder per step (a training step, so few per run)."""
    df.write.mode("overwrite").partitionBy("step").json(path)


def write_metrics(row: DataFrame, path: str) -> None:
    """A one-row metric table as one JSON file; any other number of rows is an error."""
    if (n := len(row.take(2))) != 1:
        raise ValueError(f"a metric document has one row, not {'several' if n else 'none'}")
    row.coalesce(1).write.mode("overwrite").json(path)
