import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnlake.llm import clusters as C


def brute(rows, k, rounds, size, scale=256):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    c = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, x)), j) for j, x in enumerate(c))

    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        for j in range(len(c)):
            own = [v for (_, v), a in zip(kept, at) if a == j]
            if own:
                c[j] = [sum(x) // len(own) for x in zip(*own)]
    got = [(i, *near(v)) for i, v in kept]
    total = [sum(d for _, d, j in got if j == n) for n in range(len(c))]
    sha = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return sorted(((i, j, d, total[j], sum(total), sha[j]) for i, d, j in got), key=str)


def result(df):
    return sorted((tuple(r) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)


def vectors(seed, n, size):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        centre = rnd.randrange(6)
        rows.append((i, [rnd.gauss(centre if k % 7 == centre else 0, 0.3) for k in range(size)]))
    return rows


@pytest.mark.parametrize("held", [0.3, 0.9, 1.0])
def test_equals_plain_rounds(spark, held):
    rows = vectors(3, 300, 12)
    rows += [(1000 + i, list(rows[5][1])) for i in range(60)]  # equal vectors
    rows += [(7, list(rows[9][1])), (None, list(rows[11][1])), (None, [0.0] * 12)]  # a repeated id, two without
    rows += [(2000, None), (2001, []), (2002, [0.1] * 11), (2003, [0.1] * 13), (2004, [None] + [0.1] * 11), (2005, [float("nan")] * 12), (2006, [float("-inf")] + [0.0] * 11)]
    df = spark.createDataFrame([(i, v, "x", 1, 2.0) for i, v in rows], "vec_id long, embedding array<double>, cluster string, v int, distance double").repartition(5)
    got = C.cluster_vectors(df, F.col("vec_id"), F.col("embedding"), k=9, rounds=3, size=12, held=held)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert result(got) == brute(rows, 9, 3, 12)


def test_ties_go_to_the_smaller_number_and_few_vectors_give_few_centroids(spark):
    rows = [(i, [0.5, -0.5]) for i in range(20)] + [(20, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = C.cluster_vectors(df, F.col("vec_id"), F.col("embedding"), k=40, rounds=2, size=2)
    assert result(got) == brute(rows, 40, 2, 2)


def test_empty_tables_and_large_components(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    none = C.cluster_vectors(df, F.col("vec_id"), F.col("embedding"))
    assert none.columns[0] == "vec_id" and none.count() == 0
    big = spark.createDataFrame([(1, [1e9, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="scale vectors down"):
        C.cluster_vectors(big, F.col("vec_id"), F.col("embedding"), size=2).count()


def test_bound_never_exceeds_the_distance_and_spares_work():
    rng = np.random.default_rng(5)
    v = (rng.normal(size=(400, 16)) * np.linspace(300, 1, 16)).astype(np.int64)
    c = v[:10]
    _, axes = np.linalg.eigh(np.cov(v.T))
    mean, axes = v.mean(axis=0), axes[:, ::-1]
    y, rest = C._parts(v.astype(float), mean, axes, 8)
    cy, crest = C._parts(c.astype(float), mean, axes, 8)
    exact = ((v[:, None] - c[None]) ** 2).sum(axis=2)
    low = ((y[:, None] - cy[None]) ** 2).sum(axis=2) + (rest[:, None] - crest[None]) ** 2
    assert (low <= exact + 1e-6 * exact + 1e-6).all()
    cluster, distance, taken = C.nearest(v, y, rest, c, cy, crest)
    assert (cluster == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()
    assert taken < 0.5 * exact.size
