"""Length-balanced parts: a window-free serpentine deal for large tables, exact splits per batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.operators.ranks import row_index


def serpentine(rank: Column, parts: int) -> Column:
    """0..k-1, k-1..0, 0..k-1, ... by rank."""
    turn = F.floor(rank / parts) % 2
    return F.when(turn == 0, rank % parts).otherwise(parts - 1 - rank % parts).cast("long")


def serpentine_parts(df: DataFrame, length: str, key: str, parts: int, by: list[str] | None = None) -> DataFrame:
    """Deal rows, longest first, back and forth over the parts: equal sizes, near-equal sums."""
    ranked = row_index(df, [-F.col(length), F.col(key)], by, "_rk")
    return ranked.withColumn("part", serpentine(F.col("_rk"), parts)).drop("_rk")


def differencing(lengths: list[int], k: int, equal: bool) -> list[int]:
    """Part of each item by largest differencing: join the two most uneven part sets until one is left."""
    import heapq

    order = sorted(range(len(lengths)), key=lambda i: (lengths[i], i))
    heap: list = []
    tick = 0

    def push(sums):
        # sums: list of (total, members) sorted from largest to smallest
        nonlocal tick
        heapq.heappush(heap, (sums[-1][0] - sums[0][0], tick, sums))
        tick += 1

    if equal:
        if len(lengths) % k:
            raise ValueError("equal parts need a row count divisible by the number of parts")
        for a in range(0, len(order), k):
            group = [(lengths[i], [i]) for i in order[a : a + k]]
            push(sorted(group, key=lambda s: -s[0]))
    else:
        for i in order:
            push([(lengths[i], [i])] + [(0, [])] * (k - 1))
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        joined = [(x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b))]
        push(sorted(joined, key=lambda s: -s[0]))
    sets = sorted((sorted(m) for _, m in heap[0][2]), key=lambda m: m[:1] or [len(lengths)])
    if any(not m for m in sets):
        # every part is non-empty: spread the longest-first deal instead
        part_of = [0] * len(lengths)
        for r, i in enumerate(sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))):
            part_of[i] = r % k
        return part_of
    part_of = [0] * len(lengths)
    for p, members in enumerate(sets):
        for i in members:
            part_of[i] = p
    return part_of


def exact_parts(df: DataFrame, batch: str, key: str, length: str, parts: Column, equal: bool) -> DataFrame:
    """Exact differencing per batch; a batch is a training step, so a group is small by definition."""
    def split(pdf):
        pdf = pdf.sort_values(key)
        k = int(pdf["_k"].iloc[0])
        return pdf.drop(columns="_k").assign(part=differencing([int(x) for x in pdf[length]], k, equal))

    src = df.select(batch, key, length, parts.alias("_k"))
    schema = f"{batch} long, {key} long, {length} long, part long"
    return src.groupBy(batch).applyInPandas(split, schema)


def micro_batch_count(df: DataFrame, batch: str, length: str, budget: int, at_least: int = 1, divisor: int = 1) -> DataFrame:
    """min(rows, ceil(tokens / budget)), raised to a minimum and rounded up to a divisor."""
    n = F.least(F.count("*"), F.ceil(F.sum(length) / budget))
    n = F.greatest(n, F.lit(at_least))
    return df.groupBy(batch).agg((F.ceil(n / divisor) * divisor).cast("long").alias("k"))
