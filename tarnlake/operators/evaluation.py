"""Evaluation metrics over scored responses: pass@k, mean/best/worst/majority@N, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.operators.ranks import checked_limit, gather, level_totals, ordered_mean, row_index, top_rows

BOOTSTRAP_ROWS = 4096


def powers_of_two(n: Column, below: bool = False) -> Column:
    """[1, 2, 4, ...] up to n; with ``below`` [2, 4, ...] strictly under n, then n itself."""
    top = F.floor(F.log2(n.cast("double")) + 1e-12).cast("int")
    if not below:
        return F.transform(F.sequence(F.lit(0), top), lambda i: F.pow(F.lit(2.0), i).cast("long"))
    steps = F.transform(F.sequence(F.lit(1), F.greatest(top, F.lit(1))), lambda i: F.pow(F.lit(2.0), i).cast("long"))
    return F.concat(F.filter(steps, lambda x: x < n), F.array(n.cast("long")))


def pass_at_k_of(n: Column, c: Column, k: Column) -> Column:
    """1 - C(n-c, k) / C(n, k) as a product of min(k, c) factors."""
    few, many = F.least(k, c), F.greatest(k, c)
    fail = F.aggregate(
        F.sequence(F.lit(0).cast("long"), F.greatest(few - 1, F.lit(0))),
        F.lit(1.0),
        lambda acc, i: acc * (n - many - i) / (n - i),
    )
    return (
        F.when(k > n, F.raise_error(F.lit("k is larger than the number of responses")).cast("double"))
        .when(n - c < k, 1.0)
        .when(c == 0, 0.0)
        .otherwise(1.0 - fail)
    )


def pass_at_k(df: DataFrame, keys: list[str], score: Column, by: list[str] | None = None) -> DataFrame:
    """Mean pass@k x 100 for every power of two up to each prompt's number of responses.

    Prompts with the same (n, correct) share one value, so it is computed once per pair.
    """
    by = by or []
    per = df.groupBy(*by, *keys).agg(F.count("*").alias("n"), F.count_if(score == 1.0).alias("c"))
    pairs = per.groupBy(*by, "n", "c").agg(F.count("*").alias("prompts"))
    each = pairs.withColumn("k", F.explode(powers_of_two(F.col("n"))))
    valued = each.withColumn("p", pass_at_k_of(F.col("n"), F.col("c"), F.col("k")))
    return valued.groupBy(*by, "k").agg(
        F.sum("prompts").alias("prompts"),
        (F.sum(F.col("p") * F.col("prompts")) / F.sum("prompts") * 100).alias("pass_at_k"),
    )


def pass_at_k_fixed(df: DataFrame, keys: list[str], score: Column, order: Column) -> DataFrame:
    """Compatible variant: the number of responses of the last prompt is used for every prompt."""
    per = df.groupBy(*keys).agg(
        F.count("*").alias("own"), F.count_if(score == 1.0).alias("c"), F.max(order).alias("_o")
    )
    last = per.agg(F.max_by("own", "_o").alias("n"))
    each = per.crossJoin(F.broadcast(last)).withColumn("k", F.explode(powers_of_two(F.col("n"))))
    pairs = each.groupBy("n", F.least("c", "n").alias("c"), "k").agg(F.count("*").alias("prompts"))
    valued = pairs.withColumn("p", pass_at_k_of(F.col("n"), F.col("c"), F.col("k")))
    return valued.groupBy("k").agg(
        F.sum("prompts").alias("prompts"),
        (F.sum(F.col("p") * F.col("prompts")) / F.sum("prompts") * 100).alias("pass_at_k"),
    )


def average_at_k(df: DataFrame, prompt: list[str], source: str, score: Column) -> DataFrame:
    """Mean over prompts of the mean score, x 100, per source and overall."""
    per = df.groupBy(source, *prompt).agg(F.avg(score).alias("_m"))
    return per.rollup(source).agg(
        F.when(F.grouping(source) == 1, "overall").otherwise(F.first(source)).alias("scope"),
        F.count("*").alias("prompts"), (F.avg("_m") * 100).alias("avg_at_k"),
    ).drop(source)


def prompt_level_metrics(df: DataFrame, source: str, prompt: str, variables: list[str]) -> DataFrame:
    """mean@N and std@N of numeric variables per prompt, averaged over prompts by metric name."""
    aggs = [F.count("*").alias("_n")]
    for v in variables:
        aggs += [F.avg(v).alias(f"m_{v}"), F.stddev_pop(v).alias(f"s_{v}")]
    per = df.groupBy(source, prompt).agg(*aggs)
    n = F.col("_n").cast("string")
    entries = []
    for v in variables:
        entries.append(F.struct(F.lit(v).alias("variable"), F.concat(F.lit("mean@"), n).alias("metric"), F.col(f"m_{v}").alias("x")))
        entries.append(F.struct(F.lit(v).alias("variable"), F.concat(F.lit("std@"), n).alias("metric"),
                                F.when(F.col("_n") > 1, F.col(f"s_{v}")).alias("x")))
    long = per.select(source, F.explode(F.array(*entries)).alias("e")).filter(F.col("e.x").isNotNull())
    return long.groupBy(source, F.col("e.variable").alias("variable"), F.col("e.metric").alias("metric")).agg(
        F.avg("e.x").alias("value"), F.count("*").alias("prompts")
    )


def best_worst_at_n(df: DataFrame, source: str, prompt: str, value: str) -> DataFrame:
    """Exact mean and deviation of the best and worst of n draws with replacement.

    With F the share of responses at or below a value, the best of n draws is at most that value
    with probability F^n.  Only distinct values and their counts are ranked.
    """
    limit = checked_limit(df, [source, prompt])
    hist = df.groupBy(source, prompt, value).agg(F.count("*").alias("_c"))
    pivots = df.groupBy(source, prompt).agg(F.avg(value).alias("_pivot"))
    cum = level_totals(hist, [source, prompt], value, {"_t": F.col("_c")}, limit)
    cum = cum.withColumnsRenamed({"_t_upto": "_upto", "_t_all": "_N"}).filter(F.col("_N") > 1)
    joined = cum.join(pivots, [source, prompt]).withColumn("n", F.explode(powers_of_two(F.col("_N"), below=True)))
    hi = F.col("_upto") / F.col("_N")
    lo = (F.col("_upto") - F.col("_c")) / F.col("_N")
    n = F.col("n").cast("double")
    best = F.pow(hi, n) - F.pow(lo, n)
    worst = F.pow(1 - lo, n) - F.pow(1 - hi, n)
    # moments about a value of the prompt, so that large values lose no digits
    x = F.col(value) - F.col("_pivot")
    per = joined.groupBy(source, prompt, "n", "_pivot").agg(
        F.sum(x * best).alias("_bm"), F.sum(x * x * best).alias("_b2"),
        F.sum(x * worst).alias("_wm"), F.sum(x * x * worst).alias("_w2"),
    )
    dev = lambda m, s: F.sqrt(F.greatest(F.col(s) - F.col(m) * F.col(m), F.lit(0.0)))
    return per.groupBy(source, "n").agg(
        F.count("*").alias("prompts"),
        F.avg(F.col("_bm") + F.col("_pivot")).alias("best_mean"), F.avg(dev("_bm", "_b2")).alias("best_std"),
        F.avg(F.col("_wm") + F.col("_pivot")).alias("worst_mean"), F.avg(dev("_wm", "_w2")).alias("worst_std"),
    )


def majority_at_n(df: DataFrame, prompt: list[str], pos: str, vote: str, value: str) -> DataFrame:
    """Value of the first response holding the most common vote; ties go to the vote seen first."""
    votes = df.groupBy(*prompt, vote).agg(
        F.count("*").alias("_c"), F.min(pos).alias("_first"), F.min_by(value, pos).alias("_v")
    )
    return votes.groupBy(*prompt).agg(
        F.sum("_c").alias("n"),
        F.max_by(F.struct(F.col(vote), F.col("_v")), F.struct("_c", -F.col("_first"))).alias("_w"),
    ).select(*prompt, "n", F.col(f"_w.{vote}").alias("majority"), F.col("_w._v").alias("majority_value"))


def drawn_position(seed: int, rows: Column, *place: Column) -> Column:
    """Counter-based draw from [0, rows): an md5 of the seed and of the draw's place, so any task can make any draw."""
    text = F.concat_ws("_", F.lit(str(seed)), *[c.cast("string") for c in place])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") % rows


def _resampler(draws: int, seed: int, counter: bool):
    """Resample prompts with the same number of responses together: they share their draws."""

    def run(batches):
        import hashlib

        import numpy as np
        import pandas as pd

        kept = {}

        def places(n):
            # the numbers of drawn_position before they are cut to the number of responses
            if n in kept:
                return kept[n]
            text = (f"{seed}_{n}_{d}_{s}" for d in range(draws) for s in range(n))
            out = np.fromiter((int(hashlib.md5(t.encode()).hexdigest()[:13], 16) for t in text), np.int64, draws * n).reshape(draws, n)
            if n <= 256:
                kept[n] = out
            return out

        def drawn(total, n):
            if counter:
                return places(n) % total
            return np.random.RandomState(seed).choice(total, size=(draws, n), replace=True)

        def lead(picked):
            # slot of the first response holding the most common vote
            n = picked.shape[-1]
            if n <= 64:
                own = np.zeros(picked.shape, dtype=np.int16)
                for j in range(n):
                    own += picked == picked[..., j : j + 1]
                return own.argmax(-1)
            out = np.empty(picked.shape[:-1], dtype=np.int64)
            for at in np.ndindex(out.shape):
                _, inv, cnt = np.unique(picked[at], return_inverse=True, return_counts=True)
                out[at] = cnt[inv].argmax()
            return out

        for pdf in batches:
            out = []
            for total, same in pdf.groupby(pdf["values"].map(len)):
                sizes = [2**i for i in range(1, 64) if 2**i < total] + [total]
                votes, values = np.stack(same["votes"].to_numpy()), np.stack(same["values"].to_numpy())
                names = same["source"].to_numpy()
                for n in sizes:
                    idx = drawn(total, n)
                    step = max(1, 1_000_000 // (draws * n))
                    for a in range(0, len(same), step):
                        x, v = values[a : a + step][:, idx], votes[a : a + step][:, idx]
                        maj = np.take_along_axis(x, lead(v)[..., None], -1)[..., 0]
                        cols = x.max(-1).mean(-1), x.min(-1).mean(-1), maj.mean(-1)
                        out.append(pd.DataFrame({
                            "source": names[a : a + step], "n": n, "best": cols[0], "worst": cols[1], "majority": cols[2]
                        }))
            if out:
                yield pd.concat(out)

    return run


def _draws(draws: int, seed: int):
    """The draws of ``_resampler`` as rows, a part at a time; one stream for each number of responses and n."""

    def run(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for total, n in zip(pdf["_N"], pdf["n"]):
                rng = np.random.RandomState(seed)
                for draw in range(draws):
                    for a in range(0, n, 1_000_000):
                        at = rng.choice(total, size=min(n - a, 1_000_000), replace=True)
                        yield pd.DataFrame({"_N": total, "n": n, "draw": draw, "slot": np.arange(a, a + len(at)), "_at": at})

    return run


def _counted_draws(sizes: DataFrame, draws: int, seed: int, tasks: int) -> DataFrame:
    """Draws of ``drawn_position`` as rows; they are dealt out in parts of 4,096 slots before they are made."""
    parts = sizes.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    parts = parts.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / 4096))))
    first = F.col("_part") * 4096
    slots = parts.repartition(tasks, "_N", "n", "draw", "_part").withColumn("slot", F.explode(F.sequence(first, F.least(first + 4095, F.col("n") - 1))))
    return slots.withColumn("_at", drawn_position(seed, F.col("_N"), F.col("n"), F.col("draw"), F.col("slot"))).drop("_part")


def bootstrap(
    df: DataFrame, source: str, prompt: str, pos: str, vote: str, value: str, draws: int = 1000, seed: int = 42, counter: bool = False,
) -> DataFrame:
    """Seeded resampling of best, worst and majority, averaged over prompts by n.

    With ``counter`` a draw is a hash of the seed and its place (``drawn_position``), so any task makes
    any part of the draws; otherwise every prompt draws with numpy's legacy generator and the seed, one
    stream for each number of responses.  Prompts with at most BOOTSTRAP_ROWS responses are resampled in
    one Arrow group each; for larger ones the same draws are written out and joined to the responses by
    position, which gives the same figures spread over many tasks.
    """
    sizes = df.groupBy(source, prompt).agg(F.count("*").alias("_N")).filter(F.col("_N") > 1)
    sized = df.join(sizes, [source, prompt])
    small = sized.filter(F.col("_N") <= BOOTSTRAP_ROWS)
    arrays = small.groupBy(source, prompt).agg(
        F.sort_array(F.collect_list(F.struct(pos, F.xxhash64(vote).alias("v"), F.col(value).cast("double").alias("x")))).alias("_s")
    ).select(F.col(source).alias("source"), F.col(prompt).alias("prompt"), F.col("_s.v").alias("votes"), F.col("_s.x").alias("values"))
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)
    per_small = arrays.repartition(tasks, F.xxhash64("prompt")).drop("prompt").mapInPandas(
        _resampler(draws, seed, counter), "source string, n long, best double, worst double, majority double"
    )

    big = sized.filter(F.col("_N") > BOOTSTRAP_ROWS)
    plan = big.select(source, prompt, "_N").distinct()
    sizes_n = plan.select("_N").distinct().withColumn("n", F.explode(powers_of_two(F.col("_N"), below=True))).repartition(tasks, "_N", "n")
    if counter:
        drawn_slots = _counted_draws(sizes_n, draws, seed, tasks)
    else:
        drawn_slots = sizes_n.mapInPandas(_draws(draws, seed), "_N long, n long, draw int, slot long, _at long")
    slots = plan.join(drawn_slots, "_N")
    placed = row_index(big.select(source, prompt, pos, vote, value), [F.col(pos)], [source, prompt], "_at")
    drawn = slots.join(placed.select(source, prompt, "_at", vote, value), [source, prompt, "_at"])
    votes = drawn.groupBy(source, prompt, "n", "draw", vote).agg(
        F.count("*").alias("_c"), F.min("slot").alias("_s"), F.min_by(value, "slot").alias("_v"),
        F.max(value).alias("_hi"), F.min(value).alias("_lo"),
    )
    per_draw = votes.groupBy(source, prompt, "n", "draw").agg(
        F.max("_hi").alias("best"), F.min("_lo").alias("worst"),
        F.max_by("_v", F.struct("_c", -F.col("_s"))).alias("majority"),
    )
    per_big = per_draw.groupBy(F.col(source).alias("source"), prompt, "n").agg(
        F.avg("best").alias("best"), F.avg("worst").alias("worst"), F.avg("majority").alias("majority")
    ).drop(prompt)
    return per_small.unionByName(per_big).groupBy("source", "n").agg(
        F.count("*").alias("prompts"), F.avg("best").alias("best_mean"),
        F.avg("worst").alias("worst_mean"), F.avg("majority").alias("majority_mean"),
    )


def bootstrap_reduce(
    df: DataFrame, keys: list[str], pos: str, value: str, size: int, reducers: dict, draws: int = 1000, seed: int = 42,
) -> DataFrame:
    """Mean and deviation of user reduce functions over resamples of ``size`` values per group.

    A reducer takes an array of shape (draws, size) and returns one number per draw.  Draws are made
    by hashing, joined by position and packed ``size`` at a time, so a group of any length is spread.
    """
    n = df.groupBy(*keys).agg(F.count("*").alias("_N"))
    slots = (
        n.withColumn("_draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
        .withColumn("_slot", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
        .withColumn("_at", drawn_position(seed, F.col("_N"), *[F.col(k) for k in keys], F.col("_draw"), F.col("_slot")))
    )
    drawn = slots.join(df.select(*keys, F.col(pos).alias("_at"), F.col(value).cast("double").alias("_x")), [*keys, "_at"])
    packed = drawn.groupBy(*keys, "_draw").agg(F.transform(F.sort_array(F.collect_list(F.struct("_slot", "_x"))), lambda s: s["_x"]).alias("_xs"))
    names = list(reducers)
    schema = packed.select(*keys).schema.simpleString()[len("struct<"):-1] + "".join(f",{m}:double" for m in names)

    def run(batches):
        import numpy as np

        for pdf in batches:
            out = pdf[keys].copy()
            if len(pdf):
                xs = np.stack(pdf["_xs"].to_numpy())
                for m in names:
                    out[m] = np.asarray(reducers[m](xs), dtype="float64")
                yield out

    each = packed.mapInPandas(run, schema)
    return each.groupBy(*keys).agg(*[f(m).alias(f"{m}_{tag}") for m in names for tag, f in (("mean", F.avg), ("std", F.stddev_pop))])


# fixed values: metric families that may be core
CORE_FAMILIES = ["mean", "maj", "best", "std"]


def route_metrics(metrics: DataFrame, source: str) -> DataFrame:
    """Core section: variable 'acc' (else 'reward'), a core family, at the variable's largest N."""
    n = F.regexp_extract("metric", r"@(\d+)", 1).cast("int")
    per_var = metrics.groupBy(source, "variable").agg(F.max(n).alias("_top"))
    per_src = metrics.groupBy(source).agg(F.max(F.col("variable") == "acc").alias("_has_acc"))
    j = metrics.join(per_var, [source, "variable"]).join(per_src, source)
    core_var = F.when(F.col("_has_acc"), "acc").otherwise("reward")
    family = F.regexp_extract("metric", r"^([a-z]+)", 1)
    is_core = (F.col("variable") == core_var) & family.isin(CORE_FAMILIES) & (
        F.contains(F.col("metric"), F.concat(F.lit("@"), F.col("_top").cast("string")))
    )
    return j.withColumn("section", F.when(is_core, "val-core").otherwise("val-aux")).drop("_top", "_has_acc")


def score_by_dataset(df: DataFrame, source: str, dataset: Column, score: str) -> DataFrame:
    return df.groupBy(source, F.coalesce(dataset, F.lit("unknown")).alias("dataset")).agg(
        F.avg(score).alias("mean_score"), F.count("*").alias("n")
    )


def reduce_by_name(df: DataFrame, metric: str, value: str) -> DataFrame:
    """Metrics named with 'max' keep the maximum, with 'min' the minimum, others the mean."""
    agg = df.groupBy(metric).agg(F.max(value).alias("_hi"), F.min(value).alias("_lo"), F.avg(value).alias("_m"))
    return agg.select(
        metric,
        F.when(F.contains(F.col(metric), F.lit("max")), F.col("_hi"))
        .when(F.contains(F.col(metric), F.lit("min")), F.col("_lo")).otherwise(F.col("_m")).alias("value"),
    )


def difficulty_histogram(df: DataFrame, source: str, prompt: str, score: str, bins: int = 10, order: list[Column] | None = None) -> DataFrame:
    """Equal-width bins of the mean score per prompt, between the observed ends, by source and overall.

    Means that lie on the edge of a bin are moved by the order in which scores are added; ``order`` fixes it.
    """
    if order is None:
        per = df.groupBy(source, prompt).agg(F.avg(score).alias("_m"))
    else:
        per = ordered_mean(df, [source, prompt], score, order, "_m")
    both = per.withColumn("scope", F.explode(F.array(F.col(source), F.lit("overall"))))
    values = both.groupBy("scope", "_m").agg(F.count("*").alias("_c"))
    ends = values.groupBy("scope").agg(F.min("_m").alias("lo"), F.max("_m").alias("hi"))
    j = values.join(ends, "scope")
    width = F.col("hi") - F.col("lo")
    b = F.when(width > 0, F.least(F.floor((F.col("_m") - F.col("lo")) / width * bins), F.lit(bins - 1))).otherwise(0)
    return j.groupBy("scope", b.cast("long").alias("bin"), "lo", "hi").agg(F.sum("_c").alias("n"))


def merge_by_first_message(df: DataFrame, key: str, pos: str, items: str, first_cols: list[str]):
    """Rows with the same first message become one: lists joined in row order, first value of the rest.

    Rows are grouped by a digest of the message, so the message itself is moved once and not per step.
    """
    tagged = df.withColumn("_d", F.sha2(F.col(key), 256))
    ranked = row_index(tagged.select("_d", pos, items), [F.col(pos)], ["_d"], "_r")
    lists = gather(ranked, ["_d"], "_r", {"_l": F.col(items)}).withColumn(items, F.flatten("_l")).drop("_l")
    firsts = tagged.groupBy("_d").agg(*[F.min_by(c, pos).alias(c) for c in (key, *first_cols)])
    return lists.join(firsts, "_d").drop("_d")


def token_stats(df: DataFrame, n: Column) -> DataFrame:
    return df.agg(
        F.min(n).alias("min_tokens"), F.max(n).alias("max_tokens"), F.avg(n).alias("mean_tokens"),
        F.stddev_pop(n).alias("std_tokens"),
    )


def sample_pivot(df: DataFrame, step: str, order: list[Column], n: int, cols: dict[str, Column]) -> DataFrame:
    """One row per step with ``<col>_<i>`` for the first n sampled rows."""
    picked = top_rows(df, [step], order, n, "_i")
    aggs = [
        F.max(F.when(F.col("_i") == i, c)).alias(f"{name}_{i}") for i in range(1, n + 1) for name, c in cols.items()
    ]
    return picked.groupBy(step).agg(*aggs)


def case_scores(df: DataFrame, response: list[str], case_no: str, code: str, first: int = 10) -> DataFrame:
    """Share of passed cases: over all, over the first ones, and all-or-first-share."""
    ok = (F.col(code) == 1).cast("double")
    early = F.col(case_no) < first
    return df.groupBy(*response).agg(
        F.count("*").alias("cases"),
        F.avg(ok).alias("share_all"),
        F.coalesce(F.avg(F.when(early, ok)), F.lit(0.0)).alias("share_first"),
        F.when(F.min(ok) == 1.0, 1.0).otherwise(F.coalesce(F.avg(F.when(early, ok)), F.lit(0.0))).alias("all_or_share"),
    )


def spread_compile_errors(df: DataFrame, response: list[str], case_no: str, code: str) -> DataFrame:
    """Cases after the first compile error (-4) become compile errors too."""
    first = df.filter(F.col(code) == -4).groupBy(*response).agg(F.min(case_no).alias("_first"))
    j = df.join(first, response, "left")
    skipped = (F.col(case_no) > F.col("_first")) & (F.col(code) != -4)
    return j.withColumn(
        "status", F.when(skipped, "compile_error_skipped").otherwise(F.lit("as_run"))
    ).withColumn(code, F.when(skipped, -4).otherwise(F.col(code))).drop("_first")
