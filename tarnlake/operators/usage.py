"""Model call logs: cost, usage rollup and catalogue filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.operators.ranks import with_table_stats

PRICE_SCHEMA = "model string, provider string, tier string, capabilities array<string>, price_in double, price_out double"


def price_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Price per million tokens by model: a dimension written by hand, so small by nature."""
    return spark.createDataFrame(rows, PRICE_SCHEMA)


def call_cost(tok_in: Column, tok_out: Column, price_in: Column, price_out: Column) -> Column:
    return tok_in / 1e6 * price_in + tok_out / 1e6 * price_out


def with_cost(calls: DataFrame, prices: DataFrame) -> DataFrame:
    j = calls.join(F.broadcast(prices), "model")
    return j.withColumn("cost", call_cost(F.col("tok_in"), F.col("tok_out"), F.col("price_in"), F.col("price_out")))


def usage_rollup(costed: DataFrame) -> DataFrame:
    """Calls, tokens, cost and last use by model, with the share of the total and the cost rank.

    The rank runs over one row per model.
    """
    per = costed.groupBy("model").agg(
        F.count("*").alias("calls"), F.sum("tok_in").alias("tokens_in"), F.sum("tok_out").alias("tokens_out"),
        F.sum("cost").alias("cost"), F.max("ts").alias("last_used"),
    )
    return with_table_stats(per, total_cost=F.sum("cost")).orderBy(F.col("cost").desc(), "model")


def catalogue(prices: DataFrame, capability: str | None = None, tier: str | None = None, provider: str | None = None) -> DataFrame:
    cond = F.lit(True)
    if capability:
        cond = cond & F.array_contains("capabilities", capability)
    if tier:
        cond = cond & (F.col("tier") == tier)
    if provider:
        cond = cond & (F.col("provider") == provider)
    return prices.filter(cond)


def used_models(prices: DataFrame, usage: DataFrame) -> DataFrame:
    return prices.join(usage.filter(F.col("calls") > 0).select("model"), "model", "left_semi")
