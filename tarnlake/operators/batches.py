"""Batch operations on row positions: samples, splits, repeats, padding, chunks, reorderings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.operators.ranks import at_or_before, gather, nth_keys, row_index, shuffled_order, with_table_stats
from tarnlake.session import durable

TOP_N_ROWS = 10_000


def progress_eta(df: DataFrame, run: str, order: list[Column], secs: str, last: int) -> DataFrame:
    """Mean of the last few durations times the steps left.

    Positions are cut into blocks and each block also gets the ``last - 1`` rows before it, so a run
    of any length is not held by one task.
    """
    placed = row_index(df, order, [run], "_pos")
    total = df.groupBy(run).agg(F.count("*").alias("_n"))
    width = 8192
    own = F.floor(F.col("_pos") / width)
    spill = F.floor((F.col("_pos") + (last - 1)) / width)
    copies = placed.withColumn("_b", F.explode(F.when(own == spill, F.array(own)).otherwise(F.array(own, spill))))
    w = Window.partitionBy(run, "_b").orderBy("_pos").rowsBetween(-(last - 1), 0)
    seen = copies.withColumn("mean_secs", F.avg(secs).over(w)).filter(F.col("_b") == own)
    out = seen.join(total, run).withColumn("left_steps", F.col("_n") - F.col("_pos") - 1)
    return out.withColumn("eta", F.col("mean_secs") * F.col("left_steps")).drop("_pos", "_n", "_b")


def first_n(df: DataFrame, order: list[Column], n: int, hex_first: bool = False) -> DataFrame:
    """Exactly the first n rows by order (all, if there are fewer); of rows that tie, those with the smallest row hash.

    A small n is Spark's top-n.  For a larger one the key of the n-th row is looked up and rows are filtered.
    """
    if n <= TOP_N_ROWS:
        return df.orderBy(*order, row_hash(df)).limit(n)
    total = df.count()
    if n >= total:
        return df
    return cut_at(df, order, [n], total, hex_first).filter(F.col("_cut") == 0).drop("_cut")


def row_hash(df: DataFrame) -> Column:
    """Hash of the whole row, to put rows that tie in an order that does not depend on partitions."""
    # maps cannot be hashed; their entries can
    cols = [F.map_entries(f.name) if f.dataType.typeName() == "map" else F.col(f"`{f.name}`") for f in df.schema]
    return F.xxhash64(*cols)


def sample_n(df: DataFrame, key: str, seed: str, n: int | None) -> DataFrame:
    """Exactly min(n, rows) rows in a reproducible shuffle; all rows when n is None."""
    if n is None:
        return df
    return first_n(df, [shuffled_order(F.col(key), seed), F.col(key)], n, hex_first=True)


def allocate(df: DataFrame, subset: str, key: str, seed: str, target: int, sizes: DataFrame, strict: bool = True) -> DataFrame:
    """Sample floor(target * |subset| / total) rows per subset; sizes come from before filtering.

    A target of -1 keeps all rows.  With ``strict`` a subset with too few rows is an error.
    """
    if target == -1:
        return df
    quotas = with_table_stats(sizes, _total=F.sum("n")).select(
        subset, F.floor(F.lit(target) * F.col("n") / F.col("_total")).alias("_quota")
    )
    ranked = row_index(df, [shuffled_order(F.col(key), seed), F.col(key)], [subset], "_rn")
    if strict:
        have = df.groupBy(subset).agg(F.count("*").alias("_have"))
        short = F.raise_error(F.concat(F.lit("too few rows in subset "), F.col(subset).cast("string"))).cast("boolean")
        quotas = quotas.join(have, subset, "left").filter(
            F.when(F.coalesce("_have", F.lit(0)) < F.col("_quota"), short).otherwise(True)
        ).drop("_have")
    return ranked.join(quotas, subset).filter(F.col("_rn") < F.col("_quota")).drop("_rn", "_quota")


def random_split(df: DataFrame, key: str, seed: str, train: float, test: float) -> DataFrame:
    """Exact seeded split sizes; rows past both shares are dropped."""
    if train + test > 1.0 + 1e-9:
        raise ValueError("split shares must not exceed 1")
    n = df.count()
    a, b = int(n * train + 1e-9), int(n * test + 1e-9)
    out = cut_at(df, [shuffled_order(F.col(key), seed), F.col(key)], [a, a + b], n, hex_first=True)
    split = F.when(F.col("_cut") == 0, "train").when(F.col("_cut") == 1, "test")
    return out.withColumn("split", split).filter(F.col("split").isNotNull()).drop("_cut")


def cut_at(df: DataFrame, order: list[Column], ends: list[int], n: int, hex_first: bool = False) -> DataFrame:
    """Number of the piece (_cut) a row falls in, for pieces that end after exactly the given row counts.

    The keys of the end rows are looked up and rows compared with them; none is ranked or moved.  Only where
    several rows tie with a key and the cut lies between them, these rows are ranked by a hash of the row
    (rows that are equal throughout, by the place they were stored at).
    """
    inner = sorted({e for e in ends if 0 < e < n})
    keys = dict(zip(inner, nth_keys(df, order, inner, hex_first=hex_first)))
    own = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])

    def literal(key):
        return F.struct(*[F.lit(v).alias(f"k{i}") for i, v in enumerate(key)])

    piece = F.lit(0)
    for e in ends:
        if e <= 0:
            piece = piece + 1
        elif e < n:
            piece = piece + F.when(at_or_before(order, keys[e]), 0).otherwise(1)
    cut = df.withColumn("_cut", piece)
    named = list({tuple(k): k for k in keys.values()}.values())
    if not named:
        return cut
    counts = df.agg(*[f(c).alias(f"{x}{i}") for i, k in enumerate(named) for x, c, f in (("b", own < literal(k), F.count_if), ("t", own == literal(k), F.count_if))]).first()
    upto = {tuple(k): (counts[f"b{i}"], counts[f"b{i}"] + counts[f"t{i}"]) for i, k in enumerate(named)}
    split = {tuple(keys[e]): keys[e] for e in inner if upto[tuple(keys[e])][1] != e}
    if not split:
        return cut
    start = F.lit(None).cast("long")
    for t, k in split.items():
        start = F.when(own == literal(k), F.lit(upto[t][0]).cast("long")).otherwise(start)
    tied = durable(df.withColumns({"_start": start, "_row": row_hash(df)}).filter(F.col("_start").isNotNull()).withColumn("_place", F.monotonically_increasing_id()), "tied_rows")
    place = row_index(tied, [F.col("_row"), F.col("_place")], ["_start"], "_nth")
    at = F.col("_start") + F.col("_nth")
    exact = place.withColumn("_cut", sum((F.when(at >= e, 1).otherwise(0) for e in ends), F.lit(0))).select(*cut.columns)
    return cut.withColumn("_start", start).filter(F.col("_start").isNull()).drop("_start").unionByName(exact)


def with_table_stats_of(df: DataFrame, counted: DataFrame) -> DataFrame:
    """Add the row count of ``counted`` as _n (a one-row side)."""
    return df.crossJoin(F.broadcast(counted.agg(F.count("*").alias("_n"))))


def positional_split(df: DataFrame, order: list[Column], share: float) -> DataFrame:
    """First share of the rows by position is train, the rest test."""
    n = df.count()
    out = cut_at(df, order, [int(n * share + 1e-9)], n)
    return out.withColumn("split", F.when(F.col("_cut") == 0, "train").otherwise("test")).drop("_cut")


def mini_batches(df: DataFrame, key: str, seed: str, size: int, epochs: int) -> DataFrame:
    """(epoch, batch) of every row, reshuffled per epoch."""
    parts = []
    for e in range(epochs):
        ranked = row_index(df, [shuffled_order(F.col(key), f"{seed}-{e}"), F.col(key)], name="_rn")
        parts.append(ranked.select("*", F.lit(e).alias("epoch"), F.floor(F.col("_rn") / size).cast("long").alias("batch")).drop("_rn"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def repeat_rows(df: DataFrame, row_no: str, n: int, interleave: bool) -> DataFrame:
    """n copies of each row with their new position: A A B B, or A B A B."""
    copies = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    if interleave:
        return copies.withColumn("new_pos", F.col(row_no) * n + F.col("copy"))
    return with_table_stats_of(copies, df).withColumn("new_pos", F.col("copy") * F.col("_n") + F.col(row_no)).drop("_n")


def repeat_each(df: DataFrame, times: Column) -> DataFrame:
    """Row i is repeated times_i times; zero drops it."""
    return df.withColumn("copy", F.explode(F.when(times > 0, F.sequence(F.lit(0), (times - 1).cast("int")))))


def pad_to_divisor(df: DataFrame, row_no: str, divisor: int) -> DataFrame:
    """Repeat rows from the start, round and round, until the row count divides."""
    n = df.agg(F.count("*").alias("_n"))
    counted = df.crossJoin(F.broadcast(n))
    gap = F.pmod(-F.col("_n"), F.lit(divisor))
    rounds = F.floor((gap - F.col(row_no) - 1) / F.col("_n"))
    extra = counted.filter(F.col(row_no) < gap).withColumn("_r", F.explode(F.sequence(F.lit(0).cast("long"), rounds)))
    extra = extra.withColumn(row_no, F.col("_n") + F.col("_r") * F.col("_n") + F.col(row_no)).drop("_r")
    return (
        counted.withColumn("is_pad", F.lit(False)).unionByName(extra.withColumn("is_pad", F.lit(True))).drop("_n")
    )


def unpad(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("is_pad")).drop("is_pad")


def chunk(df: DataFrame, order: list[Column], k: int, strict: bool = True) -> DataFrame:
    """k chunks along the row order; the first chunks take the remainder unless it is an error."""
    n = df.count()
    if strict and n % k:
        raise ValueError("rows do not divide into equal chunks")
    ends, at = [], 0
    for i in range(k - 1):
        at += n // k + (i < n % k)
        ends.append(at)
    return cut_at(df, order, ends, n).withColumn("chunk", F.col("_cut").cast("long")).drop("_cut")


def reorder(df: DataFrame, row_no: str, permutation: DataFrame) -> DataFrame:
    """Rows in the order of a (new_pos, source_pos) table."""
    return df.join(permutation.withColumnRenamed("source_pos", row_no), row_no)


def inverse(permutation: DataFrame) -> DataFrame:
    return permutation.select(F.col("source_pos").alias("new_pos"), F.col("new_pos").alias("source_pos"))


def unfold_column(df: DataFrame, col: str, n: int, width: Column) -> DataFrame:
    """A width-w array becomes n rows of w/n values; other columns are repeated."""
    step = (width / n).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.slice(col, i * step + 1, step))
    rest = [c for c in df.columns if c != col]
    return df.select(*rest, F.posexplode(pieces).alias("piece", col))


def fold_rows(df: DataFrame, row_no: str, k: int, cols: list[str]) -> DataFrame:
    """[b] -> [b/k, k]: k consecutive rows become arrays (k is a constant)."""
    folded = df.withColumns({"fold": F.floor(F.col(row_no) / k).cast("long"), "_in": F.col(row_no) % k})
    return gather(folded, ["fold"], "_in", {c: F.col(c) for c in cols})


def unfold_rows(df: DataFrame, fold: str, k: int, cols: list[str]) -> DataFrame:
    z = df.select(fold, F.posexplode(F.arrays_zip(*cols)).alias("_i", "_z"))
    return z.select((F.col(fold) * k + F.col("_i")).alias("row_no"), *[F.col(f"_z.{c}").alias(c) for c in cols])


def rows_to_columns(rows: str, fields: list[str]) -> dict[str, Column]:
    """Array of structs -> one array per field."""
    return {f: F.col(f"{rows}.{f}") for f in fields}


def columns_to_rows(fields: dict[str, Column]) -> Column:
    """Parallel arrays -> array of structs; check ``column_lengths_differ`` first."""
    return F.arrays_zip(*[c.alias(n) for n, c in fields.items()])


def column_lengths_differ(fields: dict[str, Column]) -> Column:
    cols = list(fields.values())
    bad = F.lit(False)
    for c in cols[1:]:
        bad = bad | (F.size(cols[0]) != F.size(c))
    return bad


def union_columns(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Columns of two batches side by side; shared columns must agree and rows must match one to one."""
    shared = [c for c in a.columns if c in b.columns and c not in keys]
    right = b.select(*keys, F.lit(True).alias("_in_b"), *[F.col(c).alias(f"_b_{c}") for c in b.columns if c not in keys])
    j = a.withColumn("_in_a", F.lit(True)).join(right, keys, "full")
    clash = F.lit(False)
    for c in shared:
        clash = clash | ~F.col(c).eqNullSafe(F.col(f"_b_{c}"))
    fail = F.raise_error
    ok = (
        F.when(F.col("_in_a").isNull() | F.col("_in_b").isNull(), fail(F.lit("batches differ in rows")).cast("boolean"))
        .when(clash, fail(F.lit("batches disagree on a shared column")).cast("boolean")).otherwise(True)
    )
    new = [c for c in b.columns if c not in a.columns]
    return j.filter(ok).select(*a.columns, *[F.col(f"_b_{c}").alias(c) for c in new])
