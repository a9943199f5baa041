"""Ranks, running totals and group statistics that hold when one group is a third of the table.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task.  The helpers here use it
only for groups whose size has been counted and is below ``spark.tarnlake.hotGroupRows``.  Larger
groups (and the whole table, when there is no key) are cut into range buckets on the ordering
columns: each bucket is ranked on its own and shifted by the totals of the buckets before it.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.functions.text import let
from tarnlake.session import durable, int_conf

HOT_KEY = "spark.tarnlake.hotGroupRows"
HOT_ROWS = 500_000
WHOLE_ROWS = 20_000
NO_LIMIT = 1 << 62
MAX_BUCKETS = 4096
MAX_SENT = 10_000
HASHES = 1 << 16
SAMPLES_PER_BUCKET = 16


def with_group_stats(df: DataFrame, keys: list[str], **aggs: Column) -> DataFrame:
    """Add per-group aggregates to every row: partial aggregation, then a join back.

    Only one row per group is shuffled for the statistics, and AQE can split a skewed partition of
    the left side of the join, which it cannot do for a window.
    """
    stats = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])
    return df.join(stats, keys, "left")


def with_table_stats(df: DataFrame, **aggs: Column) -> DataFrame:
    """Add whole-table aggregates to every row (a one-row side, so the broadcast size is fixed)."""
    stats = df.agg(*[c.alias(n) for n, c in aggs.items()])
    return df.crossJoin(F.broadcast(stats))


def top_rows(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank_no") -> DataFrame:
    """First k rows of each group.

    The rank filter is pushed below the shuffle by Spark's window group limit, so each map task
    ships at most k rows of a group; k is therefore a small constant.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)


def _cut_points(df: DataFrame, buckets: int):
    """Some distinct values of the ordering struct, evenly spaced over a bounded random sample of the rows."""
    take = buckets * SAMPLES_PER_BUCKET
    rows = (
        df.select("_key").orderBy(F.rand(7)).limit(take)
        .select(F.to_json(F.array_sort(F.collect_list("_key"))).alias("j")).first()
    )
    keys = json.loads(rows["j"] or "[]")
    step = max(1, len(keys) // buckets)
    picked = keys[step // 2 :: step]
    return [k for i, k in enumerate(picked) if not i or k != picked[i - 1]]


def _bucket_of(cuts: list, dtype: T.DataType) -> Column:
    """2 i for rows between two cut points, 2 i + 1 for rows at one: a key with very many rows has a bucket of its own."""
    if not cuts:
        return F.lit(0)
    width = math.isqrt(len(cuts))
    arr, coarse = (F.from_json(F.lit(json.dumps(c)), T.ArrayType(dtype)) for c in (cuts, cuts[width - 1 :: width]))

    def of(key):
        first = F.size(F.filter(coarse, lambda c: c <= key)) * width
        upto = let(first, lambda n: n + F.size(F.filter(F.slice(arr, n + 1, F.lit(width)), lambda c: c <= key)))
        return let(upto, lambda n: 2 * n - F.coalesce(F.get(arr, n - 1) == key, F.lit(False)).cast("int"))

    return let(F.col("_key"), of)


def _with_bucket(keyed: DataFrame, by: list[str], limit: int, send=lambda side: side) -> DataFrame:
    """Add _bucket to the rows of hot groups (_hot is the group's size, null elsewhere: bucket 0).

    Each hot group has cut points of its own, at most MAX_BUCKETS, from rows that a hash of the key picks.
    They are found in two levels of about sqrt(n).  ``send`` is applied to the table of cut points.
    """
    want = F.least(F.lit(MAX_BUCKETS), F.ceil(F.col("_hot") / limit)).cast("int")
    picked = keyed.filter(F.col("_hot").isNotNull() & (F.pmod(F.xxhash64("_key"), F.lit(1 << 20)) * F.col("_hot") < want.cast("long") * (SAMPLES_PER_BUCKET << 20)))
    cuts = picked.groupBy(*by).agg(F.array_sort(F.collect_set("_key")).alias("_all"), F.first(want).alias("_want"))
    step = F.greatest(F.lit(1), F.floor(F.size("_all") / F.col("_want")).cast("int"))
    cuts = cuts.withColumn("_step", step).withColumn("_cuts", F.filter("_all", lambda _, i: i % F.col("_step") == F.col("_step") - 1))
    cuts = cuts.withColumn("_width", F.greatest(F.lit(1), F.floor(F.sqrt(F.size("_cuts"))).cast("int")))
    cuts = cuts.withColumn("_coarse", F.filter("_cuts", lambda _, i: i % F.col("_width") == F.col("_width") - 1)).select(*by, "_cuts", "_width", "_coarse")
    placed = keyed.join(send(cuts), by, "left") if by else keyed.crossJoin(F.broadcast(cuts))
    first = F.size(F.filter("_coarse", lambda c: c <= F.col("_key"))) * F.col("_width")
    bucket = let(first, lambda n: n + F.size(F.filter(F.slice("_cuts", n + 1, F.col("_width")), lambda c: c <= F.col("_key"))))
    found = F.when(F.col("_hot").isNotNull() & F.col("_cuts").isNotNull(), bucket)
    return placed.withColumn("_bucket", F.coalesce(found, F.lit(0))).drop("_cuts", "_width", "_coarse")


def plain_totals(df: DataFrame, by: list[str], order: list[Column], totals: dict[str, Column]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({n: F.sum(c).over(w) for n, c in totals.items()})


def checked_limit(df: DataFrame, by: list[str], hot_rows: int | None = None) -> int | None:
    """Size check made once for several totals over the same groups (or parts of them).

    NO_LIMIT when no group is hot, so later calls need no check of their own; else the given limit.
    """
    limit = hot_rows if hot_rows is not None else int_conf(df.sparkSession, HOT_KEY, HOT_ROWS)
    any_hot = df.groupBy(*by).count().filter(F.col("count") > limit).limit(1).count()
    return hot_rows if any_hot else NO_LIMIT


def nth_keys(df: DataFrame, order: list[Column], positions: list[int], direct: int = 10_000, hex_first: bool = False) -> list:
    """Ordering struct of the n-th smallest row (1-based) for each position, as Python rows.

    Histogram selection: rows are counted by bucket and only a bucket that holds a position is
    looked at again, so no row is sorted or shuffled.  Buckets lie between sampled cut points, or
    are hash prefixes when the first ordering column is a hex digest.  A bucket larger than
    ``direct`` is cut again, unless it holds a single key.
    """
    keyed = df.select(F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)]).alias("_key"))
    if not positions:
        return []
    if max(positions) <= direct:
        top = keyed.orderBy("_key").limit(max(positions)).select("_key")
        wanted = row_number_small(top).filter(F.col("_rn").isin(positions)).collect()
        at = {r["_rn"]: r["_key"] for r in wanted}
        return [at[p] for p in positions]
    if hex_first:
        bucketed = keyed.withColumn("_bucket", F.substring("_key.k0", 1, 4))
    else:
        bucketed = keyed.withColumn("_bucket", _bucket_of(_cut_points(keyed, 64), keyed.schema["_key"].dataType))
    sizes = bucketed.groupBy("_bucket").agg(F.count("*").alias("n"), F.min("_key").alias("low"), F.max("_key").alias("high")).collect()
    found = {}
    start = 0
    for r in sorted(sizes, key=lambda r: r["_bucket"]):
        inside = [p for p in positions if start < p <= start + r["n"]]
        if inside and r["low"] == r["high"]:
            found.update((p, r["low"]) for p in inside)
        elif inside:
            # a bucket is a range of keys, so a deeper look compares with its ends and does not find buckets again
            low, high = (F.struct(*[F.lit(v).alias(f"k{i}") for i, v in enumerate(r[c])]).cast(keyed.schema["_key"].dataType) for c in ("low", "high"))
            part = keyed.filter((F.col("_key") >= low) & (F.col("_key") <= high)).select(*[F.col(f"_key.k{i}") for i in range(len(order))])
            found.update(zip(inside, nth_keys(part, [F.col(c) for c in part.columns], [p - start for p in inside], direct)))
        start += r["n"]
    return [found[p] for p in positions]


def row_number_small(df: DataFrame) -> DataFrame:
    """Row numbers of a top-n result (bounded by its limit)."""
    return df.withColumn("_rn", F.row_number().over(Window.orderBy("_key")))


def at_or_before(order: list[Column], key) -> Column:
    """Row's ordering struct is at or before the given one."""
    own = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    return own <= F.struct(*[F.lit(v).alias(f"k{i}") for i, v in enumerate(key)])


def _may_be_hot(df: DataFrame, by: list[str], limit: int) -> bool:
    """Some hash of the keys has more rows than the limit; a count per hash and not per group, of which there may be as many as rows."""
    return df.groupBy(F.pmod(F.xxhash64(*by), F.lit(HASHES)).alias("_hash")).count().filter(F.col("count") > limit).limit(1).count() > 0


def running_totals(
    df: DataFrame,
    by: list[str],
    order: list[Column],
    totals: dict[str, Column],
    hot_rows: int | None = None,
) -> DataFrame:
    """Inclusive running sums within each group, in ascending order of ``order``.

    Pass ``-col`` for a descending numeric order.  ``order`` must identify a row within its group.
    """
    spark = df.sparkSession
    limit = hot_rows if hot_rows is not None else int_conf(spark, HOT_KEY, HOT_ROWS)
    if limit >= NO_LIMIT:
        return plain_totals(df, by, order, totals)
    if by and not _may_be_hot(df, by, limit):
        return plain_totals(df, by, order, totals)
    if by:
        hot = df.groupBy(*by).count().filter(F.col("count") > limit)
        size = hot.agg(F.max("count").alias("n"), F.count("*").alias("k"), F.sum("count").alias("rows")).first()
        largest, hot_groups, hot_total = int(size["n"] or 0), int(size["k"]), int(size["rows"] or 0)
    else:
        n = df.count()
        # a table has no key that deals its rows, and they may be long texts: one task takes few of them
        limit = min(limit, WHOLE_ROWS)
        hot, largest, hot_groups, hot_total = None, (n if n > limit else 0), 1, n
    if largest == 0:
        return plain_totals(df, by, order, totals)

    # names carry the depth, as a bucket's rows may be cut again
    depth = sum(c.startswith("_bucket") for c in by)
    parts, bucket = {f"_in_{n}": c for n, c in totals.items()}, f"_bucket{depth}"
    keyed = df.withColumns({"_key": F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)]), **parts})
    if by:
        side = hot.select(*by, F.col("count").alias("_hot"))
        keyed = keyed.join(F.broadcast(side) if hot_groups <= MAX_SENT else side, by, "left")
    else:
        keyed = keyed.withColumn("_hot", F.lit(largest).cast("long"))
    # one cut point and one base per bucket: unless there are very many, they go to the rows, which stay where they are
    few = min(hot_total // limit, hot_groups * MAX_BUCKETS) + hot_groups <= MAX_SENT
    send = F.broadcast if few else (lambda side: side)
    keyed = _with_bucket(keyed, by, limit, send).withColumnRenamed("_bucket", bucket)

    sums = (
        keyed.filter(F.col("_hot").isNotNull()).groupBy(*by, bucket)
        .agg(*[F.sum(p).alias(f"_sum{p}") for p in parts])
    )
    before = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(
        *by, bucket,
        *[F.coalesce(F.sum(f"_sum{p}").over(before), F.lit(0)).alias(f"_base{p}") for p in parts],
    )
    joined = keyed.join(send(bases), [*by, bucket], "left").drop("_key", "_hot")
    # one level is enough up to MAX_BUCKETS buckets; beyond that buckets are groups like any other
    deeper = largest > limit * MAX_BUCKETS
    inside = {f"_in_{n}": F.col(f"_in_{n}") for n in totals}
    within = [*by, bucket]
    if deeper:
        out = running_totals(durable(joined, "buckets"), within, order, inside, limit)
    else:
        # rows dealt by the group alone would do for the window, and one task would take all buckets of a group
        out = plain_totals(joined if few else joined.repartition(*within), within, order, inside)
    out = out.withColumns({n: F.col(f"_in_{n}") + F.coalesce(F.col(f"_base_in_{n}"), F.lit(0)) for n in totals})
    return out.drop(bucket, *parts, *[f"_base{p}" for p in parts])


def level_totals(df: DataFrame, by: list[str], level: str, sums: dict[str, Column], hot_rows: int | None = None) -> DataFrame:
    """Add to each row ``<name>_upto`` (sum over rows of its group at or below its level) and
    ``<name>_all`` (sum over its group).

    Small groups take one window; hot ones are first summed per level and joined back.
    """
    limit = hot_rows if hot_rows == NO_LIMIT else checked_limit(df, by, hot_rows)
    if limit == NO_LIMIT:
        upto = Window.partitionBy(*by).orderBy(level).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        whole = Window.partitionBy(*by)
        return df.withColumns({
            **{f"{n}_upto": F.sum(c).over(upto) for n, c in sums.items()}, **{f"{n}_all": F.sum(c).over(whole) for n, c in sums.items()}
        })
    levels = df.groupBy(*by, level).agg(*[F.sum(c).alias(f"_l{n}") for n, c in sums.items()])
    cum = running_totals(levels, by, [F.col(level)], {f"{n}_upto": F.col(f"_l{n}") for n in sums}, limit)
    total = levels.groupBy(*by).agg(*[F.sum(f"_l{n}").alias(f"{n}_all") for n in sums])
    side = cum.join(total, by).drop(*[f"_l{n}" for n in sums])
    return df.join(side, [*by, level])


def row_index(
    df: DataFrame, order: list[Column], by: list[str] | None = None, name: str = "row_no",
    hot_rows: int | None = None,
) -> DataFrame:
    """Dense 0-based position of each row, overall or within ``by``."""
    out = running_totals(df, by or [], order, {name: F.lit(1).cast("long")}, hot_rows)
    return out.withColumn(name, F.col(name) - 1)


def ordered_mean(df: DataFrame, by: list[str], value: str, order: list[Column], name: str) -> DataFrame:
    """Mean per group, its values added in the given order: the last bits do not depend on partitions.

    Of hot groups the buckets are added in order, not their rows.
    """
    totals = {"_sum": F.col(value), "_n": F.col(value).isNotNull().cast("long")}
    summed = running_totals(df, by, order, totals)
    return summed.groupBy(*by).agg((F.max_by("_sum", "_n") / F.nullif(F.max("_n"), F.lit(0))).alias(name))


def gather(df: DataFrame, keys: list[str], pos: str, cols: dict[str, Column]) -> DataFrame:
    """Ordered arrays, one row per group: for groups that are one record by nature (a conversation, a table, a sample)."""
    packed = F.sort_array(F.collect_list(F.struct(F.col(pos).alias("_p"), *[c.alias(n) for n, c in cols.items()])))
    out = df.groupBy(*keys).agg(packed.alias("_s"))
    return out.select(*keys, *[F.col(f"_s.{n}").alias(n) for n in cols])


def shuffled_order(key: Column, seed: str) -> Column:
    """Reproducible shuffle key: independent of partitioning and of the engine."""
    return F.md5(F.concat(key.cast("string"), F.lit(seed)))
