"""Concatenation, exact deduplication, merged maps and pair closures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.operators.ranks import gather, row_index


def concat_strict(*parts: DataFrame) -> DataFrame:
    """Union of tables whose columns must agree."""
    names = set(parts[0].columns)
    for p in parts[1:]:
        if set(p.columns) != names:
            raise ValueError(f"columns differ: {sorted(names ^ set(p.columns))}")
    return reduce(lambda a, b: a.unionByName(b), parts)


def normalised_question(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def dedup_exact(df: DataFrame, text: Column, key: str, priority: Column) -> DataFrame:
    """One row per normalised text: best priority, then smallest key.

    Only a 256-bit digest and the key are shuffled; copies collapse before the shuffle.
    """
    digest = F.sha2(normalised_question(text), 256)
    keep = df.groupBy(digest.alias("_d")).agg(F.min_by(key, F.struct(priority, F.col(key))).alias(key))
    return df.join(keep.select(key), key, "left_semi")


def merge_maps(parts: list[DataFrame], key: str, value: str) -> DataFrame:
    """Union of (key, value) tables; the same key with different values is an error."""
    both = reduce(lambda a, b: a.unionByName(b), parts)
    agg = both.groupBy(key).agg(F.min(value).alias(value), F.max(value).alias("_hi"))
    clash = F.raise_error(F.concat(F.lit("conflicting values for "), F.col(key).cast("string"))).cast("boolean")
    return agg.filter(F.when(F.col(value).eqNullSafe(F.col("_hi")), True).otherwise(clash)).drop("_hi")


def append_by_key(df: DataFrame, key: str, value: str, order: list[Column]) -> DataFrame:
    """Values listed by key in order."""
    ranked = row_index(df, order, [key], "_rn")
    return gather(ranked, [key], "_rn", {"values": F.col(value)})


def pair_closure(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Each pair, its mirror image, and every item with itself."""
    plain = pairs.select(F.col(a).alias("a"), F.col(b).alias("b"))
    mirror = plain.select(F.col("b").alias("a"), F.col("a").alias("b"))
    own = plain.select("a").union(plain.select("b")).select("a", F.col("a").alias("b"))
    return plain.union(mirror).union(own).distinct()
