"""Centroid clustering in whole numbers, with rotated coordinates as a filter before exact distances.

Vectors become whole numbers once.  A rotation onto the principal axes of all vectors is found from their
summed products; a vector's record keeps its leading rotated coordinates and the norm of the rest.  For a
vector x and a centroid c with leading parts y and rests of norm r, |x - c|^2 is at least |y_x - y_c|^2 +
(r_x - r_c)^2, since two rests are at least as far apart as their norms differ.  A centroid whose bound lies
above the exact distance to the one with the least bound cannot be nearest; the survivors are measured in
whole numbers, so floating point decides nothing but how many of them there are.

What passes the driver does not grow with the table: k centroids, their sums, and one matrix of products.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.common import saved

CHUNK = 512  # vectors that a task measures at once
LIMIT = 1 << 27  # components from here on could carry a squared distance beyond 64 bits
SLACK = 1e-9  # share of |x|^2 + |c|^2, far above what rounding can do to a bound


def whole_vectors(vectors: DataFrame, vec_id: Column, vector: Column, size: int = 64, scale: int = 256) -> DataFrame:
    """vec_id and v = floor(scale * x) of the vectors with exactly ``size`` components, all finite numbers."""
    x = vector.cast("array<double>")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    rows = vectors.select(vec_id.alias("vec_id"), x.alias("x")).filter((F.size("x") == size) & F.coalesce(finite, F.lit(False)))
    large = F.exists("x", lambda e: F.abs(e * scale) >= LIMIT)
    checked = F.when(large, F.raise_error(F.lit(f"a component reaches {LIMIT} after scaling; scale vectors down"))).otherwise(F.lit(0))
    return rows.select("vec_id", F.transform("x", lambda e: (F.floor(e * scale) + checked).cast("int")).alias("v"))


def first_centroids(whole: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors with the smallest sha256 of ``seed:vec_id``, in that order (ties: smaller components first)."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = whole.select(name.alias("name"), "v").orderBy("name", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def _matrix(column) -> np.ndarray:
    """Rows of equal length from an Arrow list column."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def principal_axes(whole: DataFrame, size: int, held: float):
    """(mean, rotation, leading): the axes by falling variance, from all vectors, and how many hold the share ``held`` of it."""
    def moments(batches: Iterator) -> Iterator:
        import pyarrow as pa

        n, total, product = 0, np.zeros(size), np.zeros((size, size))
        for batch in batches:
            v = _matrix(batch.column(0)).astype(float)
            if len(v):
                n, total, product = n + len(v), total + v.sum(axis=0), product + v.T @ v
        if n:
            flat = np.concatenate([[float(n)], total, product.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["at", "value"])

    sums = whole.select("v").mapInArrow(moments, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    flat = np.zeros(1 + size + size * size)
    flat[sums["at"].to_numpy()] = sums["value"].to_numpy()
    n, mean = max(flat[0], 1.0), flat[1 : 1 + size] / max(flat[0], 1.0)
    spread = flat[1 + size :].reshape(size, size) / n - np.outer(mean, mean)
    variance, axes = np.linalg.eigh((spread + spread.T) / 2)
    sums = np.cumsum(np.maximum(variance[::-1], 0))
    return mean, axes[:, ::-1], min(size, 1 + int(np.searchsorted(sums, held * sums[-1])))


def _parts(v: np.ndarray, mean: np.ndarray, axes: np.ndarray, leading: int):
    """Leading rotated coordinates, and the norm of the others."""
    z = (v - mean) @ axes
    return z[:, :leading], np.sqrt((z[:, leading:] ** 2).sum(axis=1))


def rotated(whole: DataFrame, mean: np.ndarray, axes: np.ndarray, leading: int) -> DataFrame:
    """vec_id, v, its leading rotated coordinates and the norm of the rest."""
    def turn(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if len(batch):
                y, rest = _parts(_matrix(batch.column(1)).astype(float), mean, axes, leading)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, y.shape[1]), pa.int32()), pa.array(y.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists, pa.array(rest)], ["vec_id", "v", "leading", "rest"])

    kind = whole.schema["vec_id"].dataType.simpleString()
    return whole.mapInArrow(turn, f"vec_id {kind}, v array<int>, leading array<double>, rest double")


def nearest(v: np.ndarray, y: np.ndarray, rest: np.ndarray, c: np.ndarray, cy: np.ndarray, crest: np.ndarray):
    """(cluster, squared distance, exact distances taken) of each vector; ties go to the smaller number."""
    own, theirs = (y**2).sum(axis=1) + rest**2, (cy**2).sum(axis=1) + crest**2
    size = own[:, None] + theirs[None, :]
    bound = size - 2 * (y @ cy.T + rest[:, None] * crest[None, :]) - SLACK * size - 1e-6
    guess = bound.argmin(axis=1)
    far = np.iinfo(np.int64).max
    exact = np.full(bound.shape, far, np.int64)
    at = np.arange(len(v))
    exact[at, guess] = ((v - c[guess]) ** 2).sum(axis=1)
    i, j = np.nonzero((bound <= exact[at, guess][:, None]) & (exact == far))
    exact[i, j] = ((v[i] - c[j]) ** 2).sum(axis=1)
    cluster = exact.argmin(axis=1)
    return cluster, exact[at, cluster], len(v) + len(i)


def _measured(batches: Iterator, c, cy, crest):
    """(ids, vectors, cluster, distance) by chunks of the rotated table's batches."""
    for batch in batches:
        for at in range(0, len(batch), CHUNK):
            part = batch.slice(at, CHUNK)
            v, y = _matrix(part.column(1)).astype(np.int64), _matrix(part.column(2))
            rest = part.column(3).to_numpy(zero_copy_only=False)
            cluster, distance, _ = nearest(v, y, rest, c, cy, crest)
            yield part.column(0), v, cluster, distance


def _sums(table: DataFrame, centroids: np.ndarray, turned) -> np.ndarray:
    """The next centroids: exact floors of the mean of each cluster's vectors; an empty cluster's stays."""
    k, size = centroids.shape

    def add(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros((k, size + 1), np.int64)
        for _, v, cluster, _ in _measured(batches, centroids, *turned):
            np.add.at(total[:, :size], cluster, v)
            total[:, size] += np.bincount(cluster, minlength=k)
        if total[:, size].any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["at", "value"])

    sums = table.mapInArrow(add, "at long, value long").groupBy("at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    total = {r["at"]: int(r["value"]) for r in sums}
    new = centroids.copy()
    for j in range(k):
        if n := total.get(j * (size + 1) + size, 0):
            new[j] = [total[j * (size + 1) + i] // n for i in range(size)]
    return new


def cluster_vectors(
    vectors: DataFrame, vec_id: Column, vector: Column, k: int = 40, rounds: int = 5, seed: str = "2", size: int = 64, scale: int = 256, held: float = 0.9
) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of exactly ``size`` components that are all numbers and finite; the rest, null vectors
    included, have no row.  Repeated ids and equal vectors are rows of their own; a null id stays null (its
    name for the choice of first centroids is empty).  Fewer than ``k`` kept vectors give as many centroids,
    an empty table gives no rows.  Equal distances go to the smaller number.  Other columns are ignored.
    A component of 2^27 or more after scaling stops the job, as its squared distance could not be told.
    """
    spark = vectors.sparkSession
    whole = saved(whole_vectors(vectors, vec_id, vector, size, scale), "whole_vectors")
    centroids = first_centroids(whole, k, seed)
    if not len(centroids):
        none = whole.filter(F.lit(False))
        return none.select(
            "vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")],
            F.lit("").alias("centroid_sha256"),
        )
    mean, axes, leading = principal_axes(whole, size, held)
    table = saved(rotated(whole, mean, axes, leading), "rotated_vectors")
    for _ in range(rounds):
        centroids = _sums(table, centroids, _parts(centroids, mean, axes, leading))
    turned = _parts(centroids, mean, axes, leading)

    def assign(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for ids, _, cluster, distance in _measured(batches, centroids, *turned):
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    kind = whole.schema["vec_id"].dataType.simpleString()
    found = saved(table.mapInArrow(assign, f"vec_id {kind}, cluster int, distance long"), "assigned_vectors")
    inertia = {r["cluster"]: int(r["d"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    named = [
        (j, inertia.get(j, 0), sum(inertia.values()), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids.tolist())
    ]
    facts = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # k rows
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
