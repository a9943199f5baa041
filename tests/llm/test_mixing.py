import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnlake.llm import mixing as M

DIMS = ["source", "lang", "topic"]


def rows(spark, n=3000, seed=1):
    rnd = random.Random(seed)
    data = [(i, rnd.choice("aaab") if i % 3 else "hot", rnd.choice(["en", "en", "de"]), rnd.choice(["p", "p", "p", "t"]), rnd.randint(1, 400)) for i in range(n)]
    return data, spark.createDataFrame(data, "doc_id long, source string, lang string, topic string, n_tokens long")


def ipf(data, goals, rounds=200):
    t = np.array([x[4] for x in data], float)
    w = np.ones(len(data))
    for _ in range(rounds):
        for d, goal in goals.items():
            col = np.array([x[1 + DIMS.index(d)] for x in data])
            for v, share in goal.items():
                m = col == v
                w[m] *= share * t.sum() / (t[m] * w[m]).sum()
    return t, w


def test_raking_matches_iterative_fitting(spark):
    data, df = rows(spark)
    goals = {"source": {"hot": 0.2, "a": 0.5, "b": 0.3}, "lang": {"en": 0.5, "de": 0.5}, "topic": {"p": 0.7, "t": 0.3}}
    cells = M.cells_of(df, DIMS, "n_tokens")
    mix = M.rake(cells, goals, 0.2 * sum(x[4] for x in data), tolerance=1e-10)
    t, w = ipf(data, goals)
    got = {r.doc_id: (r.weight, r.probability, r.taken) for r in M.mix_documents(df, mix).collect()}
    assert np.allclose([got[i][0] for i in range(len(data))], w, rtol=1e-4)
    p = np.array([got[i][1] for i in range(len(data))])
    assert (p <= 1).all() and (p * t).sum() == pytest.approx(0.2 * t.sum(), rel=1e-6)
    taken = np.array([got[i][2] for i in range(len(data))])
    assert (t * taken).sum() == pytest.approx(0.2 * t.sum(), rel=0.15)


def test_full_cells_pass_their_rest_on(spark):
    data, df = rows(spark)
    total = sum(x[4] for x in data)
    goals = {"source": {"b": 0.9, "a": 0.05, "hot": 0.05}}
    mix = M.rake(M.cells_of(df, DIMS, "n_tokens"), goals, 0.6 * total)
    got = M.mix_documents(df, mix).collect()
    assert sum(r.probability * r.n_tokens for r in got) == pytest.approx(0.6 * total, rel=1e-6)
    assert {r.probability for r in got if r.source == "b"} == {1.0}


def test_values_without_target_keep_their_share(spark):
    data, df = rows(spark)
    mix = M.rake(M.cells_of(df, DIMS, "n_tokens"), {"source": {"hot": 1.0, "a": 1.0, "gone": 5.0}}, 10.0)
    assert set(mix.factors["source"]) == {"hot", "a"}
    total = sum(x[4] for x in data)
    kept = sum(x[4] for x in data if x[1] == "b")
    got = M.mix_documents(df, mix)
    assert got.filter("source = 'b'").agg(F.sum(F.col("weight") * F.col("n_tokens"))).first()[0] == pytest.approx(kept)
    assert got.agg(F.sum(F.col("weight") * F.col("n_tokens"))).first()[0] == pytest.approx(total)


def test_edges(spark, make, edge_texts):
    docs = make(edge_texts)
    d = M.with_dimensions(docs, F.length("text"))
    d = d.withColumn("n_tokens", F.coalesce("n_tokens", F.lit(0)))
    out = M.mix_documents(d, M.fit_mix(d, 0.5, 0.7)).collect()
    assert len(out) == len(edge_texts) and all(0 <= r.probability <= 1 for r in out)
    again = M.mix_documents(d, M.fit_mix(d, 0.5, 0.7)).collect()
    assert {r.doc_id: r.taken for r in out} == {r.doc_id: r.taken for r in again}
    none = d.filter("false")
    assert M.mix_documents(none, M.fit_mix(none, 0.5, 0.7)).count() == 0
    twice = d.unionByName(d)
    per = M.mix_documents(twice, M.fit_mix(twice, 0.5, 0.7)).groupBy("doc_id").agg(F.countDistinct("taken").alias("n"))
    assert per.filter("n > 1").count() == 0


def test_topics(spark):
    texts = ["Released under the MIT License.", "a | b | c | d", "1 2 3 4 a", "a!! b!! c##", "plain words only", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(M.topic_of(F.col("t"))).collect()] == ["rights", "table", "figures", "marks", "prose", "prose", "prose"]
