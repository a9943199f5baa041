"""Pass rates per prompt, difficulty summaries and the filters built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.operators.batches import cut_at
from tarnlake.operators.ranks import gather, running_totals

# fixed values: class names and bounds of the difficulty report
DIFFICULTY_CLASSES = [
    ("Impossible", 0.0, 0.0),
    ("Very Hard", 0.0, 0.2),
    ("Hard", 0.2, 0.4),
    ("Medium", 0.4, 0.6),
    ("Easy", 0.6, 0.8),
    ("Very Easy", 0.8, 1.0),
    ("Perfect", 1.0, 1.0),
]

# fixed values: lookup order of the row id, bare for joins and prefixed for rate maps
BARE_ID_KEYS = ["idx", "index", "id"]
PREFIXED_ID_KEYS = ["index", "idx", "id"]


def row_key(extra: Column, source: Column | None = None) -> Column:
    """Row id from a string map; with ``source`` the id is ``<source>_<id>``."""
    names = PREFIXED_ID_KEYS if source is not None else BARE_ID_KEYS
    key = F.coalesce(*[F.try_element_at(extra, F.lit(n)) for n in names])
    return F.concat(source, F.lit("_"), key) if source is not None else key


def passed(score: Column, threshold: float = 1.0) -> Column:
    """1.0 when the score reaches the threshold; missing scores (errors, timeouts) count 0."""
    return F.when(score >= threshold, 1.0).otherwise(0.0)


def pass_rate(df: DataFrame, keys: list[str], score: Column, threshold: float = 1.0, name="pass_rate") -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count("*").alias("n_responses"), F.avg(passed(score, threshold)).alias(name)
    )


def merge_scores(df: DataFrame, keys: list[str], pos: str, cols: list[str]) -> DataFrame:
    """Scores put back on their prompt as arrays, in response order.

    ``pos`` is the response index; a sample is one record and stays in one row.
    """
    return gather(df, keys, pos, {f"{c}s": F.col(c) for c in cols})


def require_unique(df: DataFrame, key: list[str]) -> DataFrame:
    """Fail when a key occurs twice, as part of the plan and not as a second pass."""
    marked = df.groupBy(*key).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in df.columns if c not in key])
    bad = F.raise_error(F.concat(F.lit("duplicate id: "), F.concat_ws(",", *[F.col(k).cast("string") for k in key])))
    return marked.filter(F.when(F.col("_n") > 1, bad.cast("boolean")).otherwise(F.lit(True))).drop("_n")


def last_per_key(df: DataFrame, keys: list[str], pos: Column) -> DataFrame:
    """Keep the row with the highest position of each key (later entries overwrite earlier ones)."""
    rest = [c for c in df.columns if c not in keys]
    if len(rest) == 1:
        return df.groupBy(*keys).agg(F.max_by(rest[0], pos).alias(rest[0]))
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), pos).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def drop_ids(low: DataFrame, high: DataFrame, low_cut: float, high_cut: float) -> DataFrame:
    """Ids too hard for the low model or too easy for the high model."""
    return (
        low.filter(F.col("pass_rate") <= low_cut).select("idx")
        .union(high.filter(F.col("pass_rate") >= high_cut).select("idx"))
        .distinct()
    )


def filter_band(df: DataFrame, low: DataFrame, high: DataFrame, low_cut: float, high_cut: float) -> DataFrame:
    """Keep rows inside the band; ids absent from both maps stay, rows without id go."""
    kept = df.filter(F.col("idx").isNotNull())
    return kept.join(drop_ids(low, high, low_cut, high_cut), "idx", "left_anti")


def annotate_rates(df: DataFrame, low: DataFrame, high: DataFrame) -> DataFrame:
    lo = low.select("idx", F.col("pass_rate").alias("low_rate"))
    hi = high.select("idx", F.col("pass_rate").alias("high_rate"))
    return (
        df.join(lo, "idx", "left").join(hi, "idx", "left")
        .withColumn("low_rate", F.coalesce("low_rate", F.lit(0.0)))
        .withColumn("high_rate", F.coalesce("high_rate", F.lit(0.0)))
    )


def difficulty_summary(df: DataFrame, rate: Column, keys: list[str] | None = None) -> DataFrame:
    """Count, mean, median (midpoint) and population deviation.

    The percentile keeps counts by distinct value, the deviation merges centred sums.
    """
    return df.groupBy(*(keys or [])).agg(
        F.count("*").alias("n"), F.avg(rate).alias("mean"), F.percentile(rate, F.lit(0.5)).alias("median"), F.stddev_pop(rate).alias("std")
    )


def in_class(rate: Column, name: str, disjoint: bool) -> Column:
    """Membership in a difficulty class; shared edges count in both neighbours unless disjoint."""
    lo, hi = next((a, b) for n, a, b in DIFFICULTY_CLASSES if n == name)
    if lo == hi:
        return rate == lo
    above = rate > lo if lo == 0.0 or disjoint else rate >= lo
    below = rate < hi if hi == 1.0 else rate <= hi
    return above & below


def difficulty_classes(df: DataFrame, rate: Column, keys: list[str] | None = None, disjoint: bool = False) -> DataFrame:
    """Long table (class, count, percent of all prompts)."""
    keys = keys or []
    agg = df.groupBy(*keys).agg(
        F.count("*").alias("total"),
        *[F.count_if(in_class(rate, n, disjoint)).alias(n) for n, _, _ in DIFFICULTY_CLASSES],
    )
    pairs = F.explode(
        F.array(*[
            F.struct(F.lit(i).alias("class_no"), F.lit(n).alias("class_name"), F.col(n).alias("n"))
            for i, (n, _, _) in enumerate(DIFFICULTY_CLASSES)
        ])
    ).alias("p")
    return agg.select(*keys, "total", pairs).select(
        *keys, "p.class_no", "p.class_name", "p.n",
        (F.lit(100.0) * F.col("p.n") / F.col("total")).alias("percent"),
    )


def rank_slices(df: DataFrame, order: list[Column], ranks: int) -> DataFrame:
    """Contiguous equal slices by position; the last slice takes the remainder."""
    n = df.count()
    per = max(n // ranks, 1)
    return cut_at(df, order, [per * i for i in range(1, ranks)], n).withColumn("rank", F.col("_cut").cast("long")).drop("_cut")


def varied_groups(df: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """Rows of groups whose metric varies, or that have one row only."""
    kept = df.groupBy(*keys).agg(
        F.min(metric).alias("_lo"), F.max(metric).alias("_hi"), F.count("*").alias("_n")
    ).filter((F.col("_lo") != F.col("_hi")) | (F.col("_n") == 1))
    return df.join(kept.select(*keys), keys, "left_semi")


def prefer_groups(
    df: DataFrame, key: str, pos: str, acc: str, length: str, lo: float, hi: float, max_len: int, oversample: float,
) -> DataFrame:
    """Keep floor(rows / oversample) rows: preferred prompts first, then by key and response position.

    A prompt is preferred when its mean accuracy is in the band and its longest response is not cut.
    Only one row per prompt is ranked; a row's place is its prompt's offset plus its own position.
    """
    groups = df.groupBy(key).agg(
        F.avg(acc).alias("_acc"), F.max(length).alias("_len"), F.count("*").alias("_n")
    ).withColumn(
        "_bad", F.when((F.col("_acc") >= lo) & (F.col("_acc") <= hi) & (F.col("_len") < max_len - 1), 0).otherwise(1)
    )
    placed = running_totals(groups, [], [F.col("_bad"), F.col(key)], {"_upto": F.col("_n")})
    total = df.agg(F.floor(F.count("*") / oversample).alias("_target"))
    started = placed.crossJoin(F.broadcast(total)).select(
        key, (F.col("_upto") - F.col("_n")).alias("_start"), "_target"
    ).filter(F.col("_start") < F.col("_target"))
    kept = df.join(started, key).filter(F.col("_start") + F.col(pos) < F.col("_target"))
    return kept.drop("_start", "_target")


def data_source_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("data_source").agg(F.count("*").alias("n"))


def length_flag(df: DataFrame, tokens: Column, limit: int) -> DataFrame:
    return df.withColumn("token_length", tokens).withColumn("too_long", F.col("token_length") > limit)


def mean_rate_by_batch(rates: DataFrame, batch: Column) -> DataFrame:
    return rates.groupBy(batch.alias("batch")).agg(F.avg("pass_rate").alias("batch_rate"), F.count("*").alias("prompts"))


def subset_totals(df: DataFrame, subset: str) -> DataFrame:
    per = df.groupBy(subset).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("total"))
    return per.crossJoin(F.broadcast(total))


def chunk_family(name: Column) -> Column:
    return F.split(name, "_chunk", 2)[0]


def combined_name(df: DataFrame, name: str) -> DataFrame:
    """One chunk family keeps its name, several become 'combined'."""
    return df.agg(
        F.when(F.countDistinct(chunk_family(F.col(name))) == 1, F.min(chunk_family(F.col(name))))
        .otherwise(F.lit("combined")).alias("family"),
        F.countDistinct(name).alias("n_chunks"),
    )
