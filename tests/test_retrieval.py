import math
import random
from collections import Counter

import numpy as np
import pytest

from tarnlake.operators import retrieval as R


def plain_bm25(queries, corpus, k, k1=0.9, b=0.4):
    docs = {i: Counter(t.lower().split()) for i, t in corpus if t is not None}
    average = sum(sum(c.values()) for c in docs.values()) / len(docs)
    df = Counter(t for c in docs.values() for t in c)
    n = len(corpus)
    out = {}
    for q, text in queries:
        scores = []
        for i, c in docs.items():
            s = [math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * c[t] / (c[t] + k1 * (1 - b + b * sum(c.values()) / average)) for t, f in Counter(text.lower().split()).items() if c[t]]
            if s:
                scores.append((-round(sum(s), 9), i))
        out[q] = [(i, round(-s, 6)) for s, i in sorted(scores)[:k]]
    return {q: x for q, x in out.items() if x}


def texts(seed, n):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    # a few terms stand almost everywhere
    weights = [400 / (i + 1) for i in range(400)]
    rows = [(i, " ".join(rnd.choices(vocab, weights, k=rnd.randrange(1, 60)))) for i in range(n)]
    return rows + [(n + i, rows[3][1]) for i in range(25)] + [(n + 30, None), (n + 31, ""), (n + 32, "W1 W1 w1 " * 3000)]


@pytest.mark.parametrize(("tokens", "wanted", "terms"), [(1 << 21, 32 << 20, 1 << 18), (300, 0, 40)])
def test_bm25_equals_all_pairs(spark, monkeypatch, tokens, wanted, terms):
    monkeypatch.setattr(R, "SEGMENT_TOKENS", tokens)
    monkeypatch.setattr(R, "WANTED_BYTES", wanted)
    monkeypatch.setattr(R, "QUERY_TERMS", terms)
    build = R.inverted
    monkeypatch.setattr(R, "inverted", lambda corpus, wanted: build(corpus, wanted, tokens))
    corpus, queries = texts(1, 700), [(i, t) for i, t in texts(2, 60) if t] + [(900, "unknown words"), (901, "")]
    got: dict = {}
    rows = R.bm25_top_k(spark.createDataFrame(queries, "query_id long, text string"), spark.createDataFrame(corpus, "doc_id long, text string").repartition(5), 7)
    for r in sorted(rows.collect(), key=lambda r: (r["query_id"], r["rank_no"])):
        got.setdefault(r["query_id"], []).append((r["doc_id"], round(r["score"], 6)))
    assert got == plain_bm25(queries, corpus, 7)


def test_bar_skips_most_of_the_common_lists():
    """With a bar the scorer returns exactly the documents at or above it."""
    rnd = np.random.default_rng(3)
    counts = [3000, 2500, 40, 12]
    row = {
        "terms": ["a", "b", "c", "d"], "counts": np.array(counts), "docs": np.arange(4000), "lengths": rnd.integers(5, 90, 4000),
        "posted": np.concatenate([np.sort(rnd.choice(4000, n, replace=False)) for n in counts]), "freqs": rnd.integers(1, 6, sum(counts)),
    }
    posts = R._Postings(row, 40.0, 0.9, 0.4)
    asked = [("a", 0.1), ("b", 0.2), ("c", 4.0), ("d", 6.0), ("not there", 9.0)]
    met, all_scores = posts.scores(asked, 0.0)
    exact = dict(zip(met, all_scores))
    for bar in np.quantile(all_scores, [0.2, 0.9, 0.99, 0.999]):
        met, some = posts.scores(asked, bar)
        got = {m: s for m, s in zip(met, some) if s >= bar}
        want = {m: s for m, s in exact.items() if s >= bar}
        assert got.keys() == want.keys() and all(abs(got[m] - want[m]) < 1e-12 for m in got)
    assert len(met) < 100
    assert len(posts.scores(asked, 99.0)[0]) == 0


def test_bm25_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    one = spark.createDataFrame([(1, "a b")], "query_id long, text string")
    assert R.bm25_top_k(one, none, 3).count() == 0
    assert R.bm25_top_k(none.withColumnRenamed("doc_id", "query_id"), one.withColumnRenamed("query_id", "doc_id"), 3).count() == 0


def test_dense_top_k_with_many_queries(spark, monkeypatch):
    monkeypatch.setattr(R, "CELL_BYTES", 60_000)
    monkeypatch.setattr(R, "PRODUCT", 4096)
    rng = np.random.default_rng(1)
    q, c = rng.integers(-4, 5, (10_000, 6)).astype(float), rng.integers(-4, 5, (700, 6)).astype(float)  # whole numbers tie often
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, vec array<double>")
    corpus = spark.createDataFrame([(3 * i, v.tolist()) for i, v in enumerate(c)], "doc_id long, vec array<double>").repartition(4)
    got = np.array([tuple(r) for r in R.dense_top_k(queries, corpus, 5).select("query_id", "rank_no", "doc_id", "score").orderBy("query_id", "rank_no").collect()])
    s = q @ c.T
    order = np.lexsort((np.broadcast_to(np.arange(700), s.shape), -s), axis=1)[:, :5]
    assert (got[:, 2].reshape(-1, 5) == 3 * order).all()
    assert np.allclose(got[:, 3].reshape(-1, 5), np.take_along_axis(s, order, 1))


def test_dense_top_k_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, vec array<double>")
    one = spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, vec array<double>")
    assert R.dense_top_k(one, none, 3).count() == 0
    assert R.dense_top_k(none.withColumnRenamed("doc_id", "query_id"), one.withColumnRenamed("query_id", "doc_id"), 3).count() == 0
