"""Preference pairs and peer comparisons within a prompt, without listing all pairs."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.functions.policy import log_sigmoid, preference_loss
from tarnlake.operators.ranks import NO_LIMIT, checked_limit, level_totals, row_index, running_totals


def pair_loss(pairs: DataFrame, beta: float, smoothing: float = 0.0, kind: str = "sigmoid", reference_free: bool = False):
    """Mean loss over rows with chosen_logp, rejected_logp, ref_chosen_logp, ref_rejected_logp."""
    policy = F.col("chosen_logp") - F.col("rejected_logp")
    ref = F.lit(0.0) if reference_free else F.col("ref_chosen_logp") - F.col("ref_rejected_logp")
    return pairs.agg(F.avg(preference_loss(policy - ref, beta, smoothing, kind)).alias("loss"), F.count("*").alias("pairs"))


def two_sides(df: DataFrame, pair: list[str], chosen: Column, cols: dict[str, Column]) -> DataFrame:
    """One row per pair with chosen_* and rejected_* columns (each pair has two rows)."""
    aggs = []
    for side, flag in (("chosen", chosen), ("rejected", ~chosen)):
        aggs += [F.max(F.when(flag, c)).alias(f"{side}_{n}") for n, c in cols.items()]
    return df.groupBy(*pair).agg(*aggs)


def preference_metrics(pairs: DataFrame, score: str) -> DataFrame:
    margin = F.col(f"chosen_{score}") - F.col(f"rejected_{score}")
    return pairs.agg(
        F.avg("chosen_logp").alias("chosen_logp_mean"), F.avg("rejected_logp").alias("rejected_logp_mean"),
        F.avg(margin).alias("score_margin_mean"), F.max(margin).alias("score_margin_max"), F.min(margin).alias("score_margin_min"),
        F.avg("chosen_len").alias("chosen_len_mean"), F.avg("rejected_len").alias("rejected_len_mean"),
        F.avg((margin > 0).cast("double")).alias("strict_win_rate"), F.count("*").alias("pairs"),
    )


def peer_means(df: DataFrame, group: list[str], acc: str, q: str, limit: int | None = None) -> DataFrame:
    """Mean q of peers with lower accuracy (for acc > 0) or higher accuracy (otherwise); 0 if none.

    Totals up to each accuracy level replace the peer join; a row's own level is taken off again.
    ``limit`` is the result of ``checked_limit`` over the groups, where it is known.
    """
    limit = checked_limit(df, group) if limit is None else limit
    j = level_totals(df, group, acc, {"_n": F.lit(1).cast("long"), "_q": F.col(q)}, limit)
    own = level_totals(j, [*group, acc], acc, {"_own_n": F.lit(1).cast("long"), "_own_q": F.col(q)}, limit)
    below_n, below_q = F.col("_n_upto") - F.col("_own_n_all"), F.col("_q_upto") - F.col("_own_q_all")
    above_n, above_q = F.col("_n_all") - F.col("_n_upto"), F.col("_q_all") - F.col("_q_upto")
    n = F.when(F.col(acc) > 0, below_n).otherwise(above_n)
    s = F.when(F.col(acc) > 0, below_q).otherwise(above_q)
    return own.withColumns({
        "peer_mean": F.when(n > 0, s / n).otherwise(0.0),
        "acc_share_at_or_below": F.col("_n_upto") / F.col("_n_all"), "group_size": F.col("_n_all"),
    }).drop(*[f"{c}_{t}" for c in ("_n", "_q", "_own_n", "_own_q") for t in ("upto", "all")])


def share_at_or_below(df: DataFrame, group: list[str], value: str, name: str, limit: int | None = None) -> DataFrame:
    """Share of the group with a value at or below the row's own."""
    j = level_totals(df, group, value, {"_v": F.lit(1).cast("long")}, limit)
    return j.withColumn(name, F.col("_v_upto") / F.col("_v_all")).drop("_v_upto", "_v_all")


def cross_entropy(df: DataFrame, q: Column, acc: Column, beta: float) -> DataFrame:
    """Mean binary cross entropy of sigmoid(beta q) against the accuracy."""
    z = q * beta
    return df.agg(F.avg(-(acc * log_sigmoid(z) + (1 - acc) * log_sigmoid(-z))).alias("ce_loss"))


def detached_loss(df: DataFrame, group: list[str], acc: str, q: str, beta: float) -> DataFrame:
    """Sigmoid loss against the mean of opposing peers: plain mean, and weighted by best-of-n chance."""
    limit = checked_limit(df, group)
    j = peer_means(df.select(*group, acc, q), group, acc, q, limit)
    j = share_at_or_below(j, group, q, "_share_q", limit)
    sign = F.when(F.col(acc) > 0, 1.0).otherwise(-1.0)
    loss = -log_sigmoid((F.col(q) * beta - F.col("peer_mean") * beta) * sign)
    n = F.col("group_size").cast("double")
    w_q = n * F.pow(F.col("_share_q"), n - 1)
    w_acc = n * F.pow(F.col("acc_share_at_or_below"), n - 1)
    return j.agg(
        F.avg(loss).alias("loss_plain"), F.sum(loss * w_q).alias("loss_bon_score"), F.sum(loss * w_acc).alias("loss_bon_acc")
    )


def pairwise_accuracy(df: DataFrame, group: list[str], pos: str, score: str, acc: str) -> DataFrame:
    """Per group: |acc difference| share of response pairs ordered alike by score and accuracy.

    A pair agrees when the one with the higher accuracy comes later in (score, position) order.
    Ranking the accuracy levels and splitting the ranks bit by bit puts every pair with different
    accuracy into exactly one half-split, where running counts over the lower half are enough:
    rows times log2(levels) instead of all pairs.  Groups with equal accuracies give 0.5.
    """
    limit = checked_limit(df, group)
    rows = df.select(*group, pos, score, acc)
    counted = reduce(and_, [F.col(c).isNotNull() for c in [*group, acc]])
    if limit == NO_LIMIT:
        level = Window.partitionBy(*group).orderBy(F.col(acc).asc_nulls_last())
        placed = rows.withColumn("_lv", F.when(counted, (F.dense_rank().over(level) - 1).cast("long")))
        j = placed.withColumn("_top", F.max("_lv").over(Window.partitionBy(*group)))
    else:
        levels = row_index(rows.select(*group, acc).filter(counted).distinct(), [F.col(acc)], group, "_lv", limit)
        tops = levels.groupBy(*group).agg(F.max("_lv").alias("_top"))
        j = rows.join(levels, [*group, acc]).join(tops, group)
    bits = F.when(
        F.col("_lv").isNotNull() & (F.col("_top") > 0),
        F.sequence(F.lit(0), F.floor(F.log2(F.col("_top").cast("double")) + 1e-9).cast("int")),
    )
    # small groups keep a row without a bit where they have no pair, so no table of the groups is joined back
    split = j.withColumn("_bit", (F.explode_outer if limit == NO_LIMIT else F.explode)(bits)).select(
        *group, pos, score, acc, "_bit",
        F.expr("shiftright(_lv, _bit) & 1").cast("long").alias("_high"), F.expr("shiftright(_lv, _bit + 1)").alias("_prefix"),
    )
    low = 1 - F.col("_high")
    run = running_totals(
        split, [*group, "_bit", "_prefix"], [F.col(score), F.col(pos)], {"_n0": low, "_s0": low * F.col(acc)}, limit
    )
    sides = run.groupBy(*group, "_bit", "_prefix").agg(
        F.sum(low).alias("_N0"), F.sum(low * F.col(acc)).alias("_S0"),
        F.sum("_high").alias("_N1"), F.sum(F.col("_high") * F.col(acc)).alias("_S1"),
        F.sum(F.col("_high") * (F.col(acc) * F.col("_n0") - F.col("_s0"))).alias("_upto"),
    )
    out = sides.groupBy(*group).agg(
        F.sum(F.col("_S1") * F.col("_N0") - F.col("_S0") * F.col("_N1")).alias("_all"), F.sum("_upto").alias("_agree")
    )
    if limit != NO_LIMIT:
        out = rows.select(*group).distinct().join(out, group, "left")
    return out.withColumn(
        "accuracy", F.when(F.coalesce("_all", F.lit(0.0)) == 0, 0.5).otherwise(F.col("_agree") / F.col("_all"))
    ).drop("_all", "_agree")


def sign_accuracy(df: DataFrame, score: Column, acc: Column) -> DataFrame:
    return df.agg(F.avg((F.signum(score) == F.signum(acc * 2 - 1)).cast("double")).alias("sign_accuracy"))


def squared_margin_loss(df: DataFrame, seq: str, logp: str, old: str, mask: str, reward: str, eta: float) -> DataFrame:
    """(sum logp - sum old - eta r)^2, averaged over sequences with any masked token."""
    per = df.groupBy(seq).agg(
        F.sum((F.col(logp) - F.col(old)) * F.col(mask)).alias("_d"), F.max(reward).alias("_r"), F.sum(mask).alias("_n")
    ).filter(F.col("_n") > 0)
    return per.agg(F.avg(F.pow(F.col("_d") - eta * F.col("_r"), F.lit(2.0))).alias("loss"), F.count("*").alias("sequences"))


