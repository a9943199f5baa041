"""Group-relative advantages, returns and masks over response and token tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.functions.policy import EPS, clip, masked_mean, masked_var
from tarnlake.functions.text import let
from tarnlake.operators.ranks import MAX_BUCKETS, NO_LIMIT, checked_limit, running_totals, top_rows, with_group_stats, with_table_stats
from tarnlake.session import durable

STD_EPS = 1e-6  # fixed value: added to the group deviation
RUN = 16  # values that a fold appends before it joins them to the block's
PART_ROWS = 200_000  # rows of a part (more above 800 million rows); a task has one part, and twice as many draws at most
WIDE_TASKS = 16  # copies of a row that the task which reads it makes at most
LOW_BITS, LOW_MASK = 24, (1 << 24) - 1  # totals of whole weights are kept as two longs


def group_advantage(df: DataFrame, group: list[str], score: str, divide_by_std: bool = True) -> DataFrame:
    """Score minus group mean, over the sample deviation; a group of one keeps its score."""
    j = with_group_stats(df, group, _n=F.count("*"), _m=F.avg(score), _s=F.stddev_samp(score))
    mean = F.when(F.col("_n") > 1, F.col("_m")).otherwise(0.0)
    adv = F.col(score) - mean
    if divide_by_std:
        adv = adv / (F.when(F.col("_n") > 1, F.col("_s")).otherwise(1.0) + STD_EPS)
    return j.withColumn("advantage", adv).drop("_n", "_m", "_s")


def best_only_advantage(df: DataFrame, group: list[str], pos: str, score: str, strict: bool = True, divide_by_std=True):
    """Only the best response of a group gets (best - second) / deviation; ties go to the first."""
    top = top_rows(df.select(*group, pos, score), group, [F.col(score).desc(), F.col(pos)], 2, "_r")
    two = top.groupBy(*group).agg(
        F.max(F.when(F.col("_r") == 1, F.col(score))).alias("_a"),
        F.max(F.when(F.col("_r") == 2, F.col(score))).alias("_b"),
        F.max(F.when(F.col("_r") == 1, F.col(pos))).alias("_at"),
    )
    stats = df.groupBy(*group).agg(F.stddev_samp(score).alias("_s"))
    j = df.join(two.join(stats, group), group)
    gap = F.col("_a") - F.col("_b")
    if divide_by_std:
        gap = gap / (F.col("_s") + STD_EPS)
    single = F.raise_error(F.lit("a group needs at least two responses")).cast("double") if strict else F.lit(0.0)
    adv = F.when(F.col("_b").isNull(), single).when(F.col(pos) == F.col("_at"), gap).otherwise(0.0)
    return j.withColumn("advantage", adv).drop("_a", "_b", "_at", "_s")


def whiten(df: DataFrame, col: str, mask: Column, name: str = "advantage", shift_mean: bool = True) -> DataFrame:
    """(x - mean) / sqrt(var + eps) over the masked rows of the whole table."""
    j = with_table_stats(df, _mean=masked_mean(F.col(col), mask))
    j = with_table_stats(j, _var=masked_var(F.col(col), mask, F.col("_mean")))
    out = (F.col(col) - F.col("_mean")) / F.sqrt(F.col("_var") + EPS)
    if not shift_mean:
        out = out + F.col("_mean")
    return j.withColumn(name, out).drop("_mean", "_var")


def baseline_whitened(df: DataFrame, group: list[str], score: str, length: str) -> DataFrame:
    """Score minus group mean (0 for one response), whitened over all tokens.

    Every token of a response carries the same value, so the token statistics are length-weighted
    response statistics and no token row is made.
    """
    centred = group_advantage(df, group, score, divide_by_std=False).withColumnRenamed("advantage", "_c")
    return whiten(centred, "_c", F.col(length).cast("double")).drop("_c")


def leave_one_out(df: DataFrame, group: list[str], score: str) -> DataFrame:
    """(score - mean) n/(n-1); a single response is unchanged."""
    j = with_group_stats(df, group, _n=F.count("*"), _m=F.avg(score))
    adv = F.when(F.col("_n") > 1, (F.col(score) - F.col("_m")) * F.col("_n") / (F.col("_n") - 1)).otherwise(F.col(score))
    return j.withColumn("advantage", adv).drop("_n", "_m")


def length_weighted_baseline(df: DataFrame, group: list[str], score: str, length: str) -> DataFrame:
    """Score minus sum(len * score) / sum(len) of its group; 0 for one response."""
    j = with_group_stats(
        df, group, _n=F.count("*"), _b=F.sum(F.col(score) * F.col(length)) / F.sum(length)
    )
    return j.withColumn(
        "advantage", F.col(score) - F.when(F.col("_n") > 1, F.col("_b")).otherwise(0.0)
    ).drop("_n", "_b")


def reward_to_go(df: DataFrame, seq: str, t: str, value: Column, name: str = "returns") -> DataFrame:
    """Sum of this and all later tokens of the sequence."""
    return running_totals(df, [seq], [-F.col(t)], {name: value})


def greedy_baseline_advantage(df: DataFrame, seq: str, t: str, reward: str, mask: str, baseline: str) -> DataFrame:
    out = reward_to_go(df, seq, t, F.col(reward) * F.col(mask))
    return out.withColumn("advantage", F.col("returns") - F.col(baseline) * F.col(mask))


def linear_scan(
    df: DataFrame, seq: list[str], t: str, coef: Column, value: Column, name: str, reverse: bool = True,
    start: Column | None = None, block: int = 256,
) -> DataFrame:
    """x_t = value_t + coef_t * x_next (or x_previous), for sequences of any length.

    ``t`` is the dense position.  Sequences are cut into blocks; a block maps the value entering it
    to the value leaving it by one affine rule, and those rules are again such a recurrence with
    fewer steps.  No array is longer than ``block``.
    """
    start = F.lit(0.0) if start is None else start
    keep = [c for c in df.columns if c not in seq]
    item = F.struct(F.col(t).alias("_t"), coef.alias("_c"), value.alias("_v"), F.struct(*keep).alias("_row"))
    blocks = df.groupBy(*seq, F.floor(F.col(t) / block).cast("long").alias("_b")).agg(
        F.sort_array(F.collect_list(item), asc=not reverse).alias("_items")
    )
    last = df.agg(F.max(t).alias("m")).first()["m"]
    if last is None or last < block:
        entered = blocks.withColumn("_x0", start)
    else:
        rule = F.aggregate(
            "_items", F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b")),
            lambda s, i: F.struct((s["a"] * i["_c"]).alias("a"), (i["_v"] + i["_c"] * s["b"]).alias("b")),
        )
        rules = blocks.select(*seq, "_b", rule.alias("_r")).select(*seq, "_b", "_r.a", "_r.b")
        ends = linear_scan(rules, seq, "_b", F.col("a"), F.col("b"), "_x0", reverse, start, block)
        step = -1 if reverse else 1
        shifted = ends.select(*seq, (F.col("_b") + step).alias("_b"), "_x0")
        entered = blocks.join(shifted, [*seq, "_b"], "left").withColumn("_x0", F.coalesce("_x0", start))
    def extended(items, x0, out):
        """Values along ``items`` appended one by one: only for short runs, as each step copies the array."""
        start_at = F.struct(x0.alias("x"), out.alias("out"))
        return F.aggregate(items, start_at, lambda s, i: let(i["_v"] + i["_c"] * s["x"], lambda x: F.struct(
            x.alias("x"), F.concat(s["out"], F.array(x)).alias("out")
        )))

    nothing = F.array().cast("array<double>")
    runs = F.transform(F.sequence(F.lit(0), F.size("_items") - 1, F.lit(RUN)), lambda i: F.slice("_items", i + 1, F.lit(RUN)))
    folded = F.aggregate(
        runs, F.struct(F.col("_x0").alias("x"), nothing.alias("out")),
        lambda s, run: let(extended(run, s["x"], nothing), lambda r: F.struct(r["x"].alias("x"), F.concat(s["out"], r["out"]).alias("out"))),
        lambda s: s["out"],
    )
    paired = entered.select(*seq, F.explode(F.arrays_zip(F.col("_items._row").alias("r"), folded.alias("x"))).alias("_z"))
    return paired.select(*seq, *[F.col(f"_z.r.{c}").alias(c) for c in keep], F.col("_z.x").alias(name))


def next_value(df: DataFrame, seq: str, t: str, col: str, name: str) -> DataFrame:
    """Value of the following token, 0 past the end: a lead, or a self join when a sequence is hot."""
    if checked_limit(df, [seq]) == NO_LIMIT:
        return df.withColumn(name, F.lead(col, 1, 0).over(Window.partitionBy(seq).orderBy(t)).cast("double"))
    nxt = df.select(seq, (F.col(t) - 1).alias(t), F.col(col).cast("double").alias(name))
    return df.join(nxt, [seq, t], "left").withColumn(name, F.coalesce(name, F.lit(0.0)))


def discounted_returns(df: DataFrame, seq: str, t: str, reward: str, mask: str, gamma: float) -> DataFrame:
    """R_t = r_t + gamma R_{t+1} mask_{t+1}, then whitened over the mask."""
    masked = next_value(df, seq, t, mask, "_next_mask")
    out = linear_scan(masked, [seq], t, gamma * F.col("_next_mask"), F.col(reward), "returns").drop("_next_mask")
    # whitening reads the returns twice: once for the moments, once for the rows
    out = whiten(durable(out, "returns"), "returns", F.col(mask))
    return out.withColumn("advantage", F.col("advantage") * F.col(mask))


def gae(df: DataFrame, seq: str, t: str, reward: str, value: str, mask: str, gamma: float, lam: float) -> DataFrame:
    """Generalised advantage estimation; returns = advantage + value, advantage whitened."""
    nxt = next_value(df, seq, t, value, "_next")
    delta = F.col(reward) + gamma * F.col("_next") - F.col(value)
    out = linear_scan(nxt, [seq], t, F.lit(gamma * lam), delta, "raw").drop("_next")
    out = durable(out.withColumn("returns", F.col("raw") + F.col(value)), "gae")
    return whiten(out, "raw", F.col(mask)).drop("raw")


def multi_source_rloo(
    df: DataFrame, prompt: str, seq: str, t: str, reward: str, mask: str, acc: str, reward_coef: float, acc_coef: float,
) -> DataFrame:
    """Leave-one-out advantage summed over two reward sources.

    The token reward uses its masked mean per sequence; the accuracy sits on the last valid token.
    Prompts with one scored sequence have no leave-one-out baseline and are left out.
    """
    per_seq = df.groupBy(prompt, seq).agg(
        (F.sum(F.col(reward) * F.col(mask)) / F.nullif(F.sum(mask), F.lit(0))).alias("_mean"),
        F.max(acc).alias("_acc"), F.sum(mask).alias("_valid"),
    ).filter(F.col("_valid") > 0)
    groups = per_seq.groupBy(prompt).agg(
        F.count("*").alias("_n"), F.sum("_mean").alias("_sum_r"), F.sum("_acc").alias("_sum_a")
    ).filter(F.col("_n") > 1)
    j = df.join(per_seq.join(groups, prompt).drop(prompt, "_mean"), seq)
    scale = F.col("_n") / (F.col("_n") - 1)
    from_reward = F.when(F.col(mask) == 1, F.col(reward) * scale - F.col("_sum_r") / (F.col("_n") - 1)).otherwise(0.0)
    from_acc = F.when(
        F.col(t) == F.col("_valid") - 1, F.col("_acc") * scale - F.col("_sum_a") / (F.col("_n") - 1)
    ).otherwise(0.0)
    total = (from_reward * reward_coef + from_acc * acc_coef) * F.col(mask)
    out = reward_to_go(j, seq, t, total).drop("_n", "_sum_r", "_sum_a", "_valid", "_acc")
    return whiten(durable(out, "returns"), "returns", F.col(mask))


def soft_mean_baseline(df: DataFrame, reward: str, beta: float) -> DataFrame:
    """reward - (1/beta) ln mean exp(beta r) over the batch, in the overflow-free form."""
    if beta == 0:
        return with_table_stats(df, _m=F.avg(reward)).withColumn("advantage", F.col(reward) - F.col("_m")).drop("_m")
    top = with_table_stats(df, _top=F.max(F.col(reward) * beta))
    j = top.crossJoin(F.broadcast(
        top.agg(F.log(F.avg(F.exp(F.col(reward) * beta - F.col("_top")))).alias("_lme"), F.max("_top").alias("_t"))
    ))
    return j.withColumn("advantage", F.col(reward) - (F.col("_lme") + F.col("_t")) / beta).drop("_top", "_lme", "_t")


def kl_penalised(df: DataFrame, score: str, kl: Column, mask: str, beta: float) -> DataFrame:
    return df.withColumn("kl", kl * F.col(mask)).withColumn("token_reward", F.col(score) - beta * F.col("kl"))


def mean_sequence_kl(df: DataFrame, seq: str, mask: str) -> DataFrame:
    """Masked mean per sequence, then the mean over sequences."""
    per = df.groupBy(seq).agg((F.sum(F.col("kl") * F.col(mask)) / (F.sum(mask) + EPS)).alias("_k"))
    return per.agg(F.avg("_k").alias("mean_kl"), F.count("*").alias("sequences"))


def adaptive_coefficient(
    df: DataFrame, run: str, t: str, kl: str, start: float, target: float, horizon: float, n_steps: int,
) -> DataFrame:
    """Coefficient after each step: v *= 1 + clip(kl / target - 1, +-0.2) n / horizon."""
    mult = 1 + clip(F.col(kl) / target - 1, -0.2, 0.2) * n_steps / horizon
    return linear_scan(df, [run], t, mult, F.lit(0.0), "kl_coef", reverse=False, start=F.lit(float(start)))


def eos_mask(df: DataFrame, seq: str, t: str, is_eos: Column) -> DataFrame:
    """1 up to and including the first end token."""
    out = running_totals(df.withColumn("_e", is_eos.cast("long")), [seq], [F.col(t)], {"_seen": F.col("_e")})
    return out.withColumn("response_mask", (F.col("_seen") - F.col("_e") == 0).cast("int")).drop("_e", "_seen")


def position_ids(df: DataFrame, seq: str, t: str, mask: str) -> DataFrame:
    """max(running mask - 1, 0), and the plain position times the mask."""
    out = running_totals(df, [seq], [F.col(t)], {"_m": F.col(mask).cast("long")})
    return out.withColumns({
        "position_id": F.greatest(F.col("_m") - 1, F.lit(0)),
        "arange_position_id": F.col(t) * F.col(mask),
    }).drop("_m")


def attempt_penalty(df: DataFrame, conv: str, attempt: str, reward: str, penalty: float = -0.05) -> DataFrame:
    """0 when an attempt beats the one before it (the first is compared with 0), else the penalty."""
    prev = df.select(conv, (F.col(attempt) + 1).alias(attempt), F.col(reward).alias("_prev"))
    j = df.join(prev, [conv, attempt], "left")
    better = F.col(reward) > F.coalesce("_prev", F.lit(0.0))
    return j.withColumn("penalty", F.when(better, 0.0).otherwise(penalty)).drop("_prev")


def preference_mask(df: DataFrame, pair: list[str], side: str, score: str) -> DataFrame:
    """In each pair the larger score is chosen, ties to the first side (two rows per window)."""
    w = Window.partitionBy(*pair).orderBy(F.col(score).desc(), F.col(side))
    return df.withColumn("chosen", F.row_number().over(w) == 1)


def resample_weights(score: Column, kind: str, power: float, lo: Column, hi: Column) -> Column:
    if kind == "pow":
        w = F.pow(F.abs(score), F.lit(power))
    elif kind == "max_min":
        w = F.when((score == hi) | (score == lo), 1.0).otherwise(0.0)
    elif kind == "max_random":
        w = F.when(score == hi, 0.4).otherwise(0.1)
    else:
        raise ValueError(f"unknown weighting {kind}")
    return w + 1e-8


def weighted_resample(df: DataFrame, key: list[str], weight: str, uniform: Column) -> DataFrame:
    """As many draws with replacement as rows: inverse of the cumulative weights.

    Rows are dealt to parts by ranges of the key.  A part is also a range of the unit range, so draws go straight
    to the part they fall in, and there a sort puts them behind the row whose interval holds them.  A part that
    many draws fall in, as it has a row with a third of the weight, is dealt to several tasks, each with all its
    rows and a share of its draws.  Weights are added as whole numbers, 10^16 to a power of two above the largest
    one, so neither the order of adding nor the number of rows moves an interval, and an interval begins where
    the one before it ends.
    """
    base = durable(df.select(*key, F.col(weight).alias("_weight"), uniform.alias("_u")), "resample")
    size = base.agg(F.count("*").alias("n"), F.pow(F.lit(2.0), F.floor(F.log2(F.max("_weight"))) + 2).alias("unit")).first()
    part_rows = max(PART_ROWS, size["n"] // MAX_BUCKETS + 1)
    parts = size["n"] // part_rows + 1
    share = (F.col("_weight") / F.lit(size["unit"]).cast("double")).cast("decimal(16,16)")
    whole = (share * F.lit(10**16).cast("decimal(17,0)")).cast("long")
    dealt = base.select(*key, "_weight").repartitionByRange(parts, *key).select(*key, whole.alias("_w"), F.spark_partition_id().alias("_part"))
    dealt = durable(dealt.filter(F.col("_w").isNotNull()), "resample_parts")

    # one row per part: where its range begins and ends, the number of tasks that its draws are dealt to, and the first of them
    high, low = F.shiftright("_w", LOW_BITS), F.col("_w").bitwiseAND(LOW_MASK)
    order, every = Window.orderBy("_part"), Window.partitionBy()
    before = lambda c: F.coalesce(F.sum(c).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = dealt.groupBy("_part").agg(F.sum(high).alias("_high"), F.sum(low).alias("_low")).select(
        "_part", "_high", "_low", before("_high").alias("_base_high"), before("_low").alias("_base_low"),
        _as_double(F.sum("_high").over(every), F.sum("_low").over(every)).alias("_total"),
    )
    ends = ends.withColumns({
        "_a": _as_double(F.col("_base_high"), F.col("_base_low")) / F.col("_total"),
        "_z": _as_double(F.col("_base_high") + F.col("_high"), F.col("_base_low") + F.col("_low")) / F.col("_total"),
    })
    tasks = F.greatest(F.lit(1), F.ceil((F.col("_z") - F.col("_a")) * (size["n"] / (2 * part_rows))))
    ends = ends.filter(F.col("_a") < F.col("_z")).withColumn("_tasks", tasks).withColumn("_first", before("_tasks")).drop("_high", "_low")
    ends = durable(ends, "resample_ends")
    slots = ends.agg(F.sum("_tasks").alias("n")).first()["n"] or 1

    rows = dealt.join(F.broadcast(ends.select("_part", "_tasks", "_first")), "_part")
    wide = F.col("_tasks") > WIDE_TASKS  # many copies of a row: its part's rows are first dealt out
    rows = rows.filter(~wide).unionByName(rows.filter(wide).repartition(*key))
    each = F.explode(F.sequence("_first", F.col("_first") + F.col("_tasks") - 1))
    rows = rows.select("_part", each.alias("_task"), *key, "_w", F.lit(None).cast("double").alias("_u"))

    # a draw looks its part up by a cell of the unit range; a cell has one or two parts, or few draws for its many
    cells = 4 * parts
    cell = lambda x: F.least(F.floor(x * cells), F.lit(cells - 1))
    lookup = ends.select("_part", "_tasks", "_first", "_a", "_z", F.explode(F.sequence(cell(F.col("_a")), cell(F.col("_z")))).alias("_cell"))
    draws = base.select(*key, "_u").withColumn("_cell", cell(F.col("_u"))).join(F.broadcast(lookup), "_cell")
    draws = draws.filter((F.col("_u") >= F.col("_a")) & (F.col("_u") < F.col("_z")))
    task = F.floor((F.col("_u") - F.col("_a")) / (F.col("_z") - F.col("_a")) * F.col("_tasks"))
    draws = draws.select("_part", (F.col("_first") + F.least(task, F.col("_tasks") - 1)).alias("_task"), *key, F.lit(None).cast("long").alias("_w"), "_u")

    # rows by key, then draws by place: two sorted runs, which the second sort only has to merge
    both = rows.unionByName(draws).withColumn("_task", F.col("_task").cast("int")).repartitionById(slots, F.col("_task"))
    here, drawn = Window.partitionBy("_task"), F.col("_u").isNotNull()
    upto = here.orderBy(F.col("_u").asc_nulls_first(), *key).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumns({"_high": F.sum(high).over(upto) - high, "_low": F.sum(low).over(upto) - low})
    both = both.join(F.broadcast(ends.select("_part", "_base_high", "_base_low", "_total")), "_part")
    begin = _as_double(F.col("_base_high") + F.col("_high"), F.col("_base_low") + F.col("_low")) / F.col("_total")
    both = both.select("_part", "_task", *key, F.coalesce("_u", begin).alias("_at"), drawn.alias("_drawn"))
    owner = F.last(F.when(~F.col("_drawn"), F.struct(*key)), ignorenulls=True)
    hit = both.withColumn("_hit", owner.over(here.orderBy("_at", "_drawn", *key).rowsBetween(Window.unboundedPreceding, 0))).filter("_drawn")
    return hit.select(*[F.col(k).alias(f"draw_{k}") for k in key], *[F.col(f"_hit.{k}").alias(k) for k in key])


def _as_double(high: Column, low: Column) -> Column:
    """high * 2^24 + low as a double; it never falls while the whole number grows, and depends on that only."""
    return (high + F.shiftright(low, LOW_BITS)).cast("double") * float(LOW_MASK + 1) + low.bitwiseAND(LOW_MASK)


def md5_uniform(key: Column, seed: str) -> Column:
    """Reproducible number in [0, 1) from the first 52 bits of an md5."""
    return F.conv(F.substring(F.md5(F.concat(key, F.lit(seed))), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def full_batch(df: DataFrame, prompt: str, pos: str, metric: str, size: int, per_prompt: int) -> DataFrame:
    """First ``size`` qualifying prompts in generation order, cut to size * per_prompt responses.

    Fails when fewer prompts qualify.  ``size`` is a training batch, so the ranking is a bounded top-n.
    """
    ok = df.groupBy(prompt).agg(
        F.min(metric).alias("_lo"), F.max(metric).alias("_hi"), F.count("*").alias("_n")
    ).filter((F.col("_lo") != F.col("_hi")) | (F.col("_n") == 1))
    first = ok.orderBy(prompt).limit(size)
    enough = first.agg(F.count("*").alias("_c")).withColumn(
        "_ok", F.when(F.col("_c") < size, F.raise_error(F.lit("not enough qualifying prompts")).cast("boolean")).otherwise(True)
    )
    w = Window.orderBy(prompt).rowsBetween(Window.unboundedPreceding, -1)
    offset = first.withColumn("_start", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    j = df.join(F.broadcast(offset.crossJoin(F.broadcast(enough)).filter("_ok").select(prompt, "_start")), prompt)
    return j.filter(F.col("_start") + F.col(pos) < size * per_prompt).drop("_start")
