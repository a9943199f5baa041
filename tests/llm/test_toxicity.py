import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnlake.llm import toxicity as X
from tarnlake.llm.common import held_out
from tarnlake.llm.words import lower_table, word_table


def test_sentences():
    data = np.frombuffer("One two. Three!? four\n\n five".encode(), np.uint8)
    h, number, begin, end = X.sentences_of(data, word_table(), lower_table())
    assert number.tolist() == [0, 0, 1, 2, 3] * 2  # words, then their stems
    assert [bytes(data[a:b]).decode() for a, b in zip(begin, end)] == ["One two", "Three", "four", "five"]
    empty = X.sentences_of(np.zeros(0, np.uint8), word_table(), lower_table())
    assert all(len(x) == 0 for x in empty)


def test_bags_blame_the_right_word():
    rows = []
    for i in range(300):
        toxic = i % 4 == 0
        rows.append({"label": int(toxic), "n_sentences": 5, "sentence": [0, 1, 2] + [3] * toxic, "word": [0, 1, i % 2] + [2] * toxic})
    w, b, leak = X.fit_bags(rows, 3)
    assert w[2] + b > 0 > max(w[0], w[1]) + b and leak < 0.2


def test_score_is_the_noisy_or_of_its_sentences(spark):
    model = X.BagModel([], [], -2.0, 0.1)
    df = spark.createDataFrame([(0, "a. b. c.", "x"), (1, "", "x"), (2, None, "x")], "doc_id long, text string, __tox string")
    got = {r.doc_id: (r[X.SCORE], r[X.COUNT]) for r in X.score_toxicity(df, model).collect()}
    p = 1 / (1 + np.exp(2.0))
    assert got[0] == (pytest.approx(1 - 0.9 * (1 - p) ** 3), 3) and got[1] == got[2] == (pytest.approx(0.1), 0)


@pytest.fixture(scope="module")
def fitted(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi").select("doc_id", "text").repartition(8).cache()
    return docs, labels, X.learn_from(docs, labels)


def test_held_out_documents(fitted):
    docs, labels, model = fitted
    out = X.score_toxicity(docs, model).join(labels.filter(held_out(F.col("doc_id"))), "doc_id")
    n = {(r.toxic, r.p): r["count"] for r in out.withColumn("p", F.col(X.SCORE) >= 0.5).groupBy("toxic", "p").count().collect()}
    right, missed, wrong = n.get((1, True), 0), n.get((1, False), 0), n.get((0, True), 0)
    assert right / (right + missed) > 0.8 and wrong / n[(0, False)] < 0.01


def test_offending_sentences_are_found(spark, fitted):
    _, _, model = fitted
    text = "Ä quiet line. You are a moron, scum! And the rest 🙂 is fine."
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    spans = X.score_toxicity(df, model).first()[X.SPANS]
    assert [text[s.start : s.end] for s in spans] == ["You are a moron, scum"]


def test_edges(spark, make, edge_texts, fitted, sf_dir):
    _, _, model = fitted
    df = make(edge_texts)
    out = X.score_toxicity(df.unionByName(df), model).collect()
    assert len(out) == 2 * len(edge_texts) and all(0 <= r[X.SCORE] <= 1 for r in out)
    assert {r.doc_id for r in out if r.score != 0.5} == set()  # other columns pass through
    assert X.score_toxicity(df.filter("false"), model).count() == 0
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    for few in (labels.filter("false"), labels.filter("toxic = 0")):
        m = X.learn_from(df, few)
        assert all(0 <= r[X.SCORE] <= 1 for r in X.score_toxicity(df, m, spans=False).collect())


def test_query_names_offending_sentences(spark, sf_dir):
    from tarnlake.llm.queries import toxicity

    out = toxicity(spark, sf_dir)
    assert out.filter("n_offending != size(offending) OR n_offending IS NULL").count() == 0
    # a sentence at the bound alone makes the document toxic
    assert out.filter("n_offending > 0 AND predicted = 0").count() == 0
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.char_length("text").alias("n"))
    spans = out.join(texts, "doc_id").select("n", F.explode("offending").alias("s"))
    assert spans.count() > 0 and spans.filter("s.start < 0 OR s.end <= s.start OR s.end > n OR s.score < 0.5").count() == 0
