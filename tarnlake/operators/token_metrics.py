"""Batch metrics over token and response tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.functions.policy import EPS, masked_mean, masked_var
from tarnlake.operators.ranks import with_table_stats


def sequence_scores(df: DataFrame, seq: str, value: Column, name: str = "seq_score") -> DataFrame:
    return df.groupBy(seq).agg(F.sum(value).alias(name))


def spread(col: str | Column, prefix: str) -> list[Column]:
    return [F.avg(col).alias(f"{prefix}_mean"), F.max(col).alias(f"{prefix}_max"), F.min(col).alias(f"{prefix}_min")]


def batch_metrics(
    tokens: DataFrame, seq: str, score: str, reward: str, adv: str, ret: str, value: str, mask: str,
    lengths: dict[str, Column],
) -> DataFrame:
    """One row of sequence, masked-token and length statistics."""
    on = F.col(mask) == 1
    only = lambda c: F.when(on, F.col(c))
    token_part = tokens.agg(
        *spread(only(adv), "advantage"), *spread(only(ret), "return"), *spread(only(value), "value"),
        explained_variance(only(value), only(ret)).alias("explained_variance"),
    )
    per = tokens.groupBy(seq).agg(
        F.sum(score).alias("_score"), F.sum(reward).alias("_reward"), *[c.alias(n) for n, c in lengths.items()]
    )
    seq_part = per.agg(
        *spread("_score", "score"), *spread("_reward", "reward"),
        *[x for n in lengths for x in spread(n, n)],
    )
    longest = per.agg(*[F.max(n).alias(f"_top_{n}") for n in lengths])
    ratio = per.crossJoin(F.broadcast(longest)).agg(
        *[F.avg((F.col(n) == F.col(f"_top_{n}")).cast("double")).alias(f"{n}_clip_ratio") for n in lengths]
    )
    return token_part.crossJoin(F.broadcast(seq_part)).crossJoin(F.broadcast(ratio))


def explained_variance(value: Column, ret: Column) -> Column:
    return 1.0 - F.var_samp(ret - value) / (F.var_samp(ret) + 1e-5)


def source_metrics(df: DataFrame, source: str, length: str, score: str, max_length: int) -> DataFrame:
    return df.groupBy(source).agg(
        *spread(length, "length"), F.avg((F.col(length) == max_length).cast("double")).alias("clip_ratio"),
        *spread(score, "score"), F.stddev_samp(score).alias("score_std"),
    )


# fixed values: stages timed against all tokens; generation counts response tokens only
ALL_TOKEN_STAGES = ["ref", "values", "adv", "update_critic", "update_actor"]


def timing_per_token(timings: DataFrame, stage: str, secs: str, tokens: DataFrame) -> DataFrame:
    """Milliseconds per token by stage; ``tokens`` is one row (response_tokens, all_tokens)."""
    j = timings.crossJoin(F.broadcast(tokens))
    n = F.when(F.col(stage) == "gen", F.col("response_tokens")).otherwise(F.col("all_tokens"))
    return j.select(stage, (F.col(secs) * 1000.0 / n).alias("ms_per_token"))


def throughput(total_tokens: Column, secs: Column, devices: Column | int) -> Column:
    return total_tokens / (secs * devices)


def drift_stats(df: DataFrame, a: Column, b: Column, mask: Column) -> DataFrame:
    diff = F.when(mask == 1, F.abs(F.exp(a) - F.exp(b)))
    return df.agg(F.max(diff).alias("max_drift"), F.avg(diff).alias("mean_drift"), F.stddev_samp(diff).alias("std_drift"))


def loss_modes(df: DataFrame, seq: str, loss: Column, mask: Column, width: int) -> DataFrame:
    """The four ways to average token losses, in one pass over sequences."""
    per = df.groupBy(seq).agg(F.sum(loss * mask).alias("_s"), F.sum(mask).alias("_n"))
    return per.agg(
        (F.sum("_s") / (F.sum("_n") + EPS)).alias("token_mean"),
        F.avg("_s").alias("seq_mean_token_sum"),
        F.avg(F.col("_s") / F.nullif(F.col("_n"), F.lit(0))).alias("seq_mean_token_mean"),
        (F.sum("_s") / width).alias("seq_mean_token_sum_norm"),
    )


def masked_stats(df: DataFrame, x: Column, mask: Column) -> DataFrame:
    mean = F.col("_mean")
    return with_table_stats(df, _mean=masked_mean(x, mask)).agg(
        F.sum(x * mask).alias("masked_sum"), masked_mean(x, mask).alias("masked_mean"),
        masked_var(x, mask, mean, unbiased=False).alias("masked_var_biased"), masked_var(x, mask, mean).alias("masked_var"),
    )


def imbalance(df: DataFrame, slice_no: Column, part: Column, length: str) -> DataFrame:
    """Token sums of contiguous slices against those of balanced parts."""
    plain = df.groupBy(slice_no.alias("s")).agg(F.sum(length).alias("t")).agg(
        F.min("t").alias("plain_min"), F.max("t").alias("plain_max"), F.sum("t").alias("total")
    )
    even = df.groupBy(part.alias("p")).agg(F.sum(length).alias("t")).agg(
        F.min("t").alias("balanced_min"), F.max("t").alias("balanced_max"), F.avg("t").alias("mean")
    )
    return plain.crossJoin(F.broadcast(even)).withColumn("plain_diff", F.col("plain_max") - F.col("plain_min"))


def flops(df: DataFrame, length: str, secs: Column, hidden: int, inner: int, layers: int, heads: int, kv_heads: int, vocab: int):
    """Teraflops per second of a dense decoder: 6 N tokens + 12 sum(len^2) head_dim heads layers."""
    head = hidden // heads
    attention = hidden * (hidden + 2 * kv_heads * head + heads * head)
    params = (hidden * inner * 3 + attention) * layers + vocab * hidden * 2
    tokens, squares = F.sum(F.col(length).cast("double")), F.sum(F.col(length).cast("double") * F.col(length))
    return df.agg(
        ((6.0 * params * tokens + 12.0 * squares * head * heads * layers) / secs / 1e12).alias("tflops"),
        F.sum(length).alias("tokens"),
    )
