import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tarnlake.llm import ensemble, rules
from tarnlake.llm.common import held_out, training_rows
from tarnlake.llm.statistics import BASE, RATES, with_statistics


def counts(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    triples = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = Counter(triples)
    covered = {j for i, x in enumerate(triples) if seen[x] > 1 for j in (i, i + 1, i + 2)}
    lines, dup, before = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)], 0, set()
    for x in lines:
        dup += x in before
        before.add(x)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered)


def test_counts_against_brute_force(spark, docs, make, edge_texts):
    extra = make([*edge_texts, "a b c a b c a", "x x x x", "a b c d\na b c d\na\n\n \n", "a b c b c a b c"])
    for df in (docs, extra):
        got = {r.doc_id: tuple(r[c] for c in BASE) for r in with_statistics(df, F.col("text"), rates=False).collect()}
        want = {r.doc_id: counts(r.text) for r in df.select("doc_id", "text").collect()}
        assert got == want


def test_rates_are_shares(make, edge_texts):
    for r in with_statistics(make(edge_texts), F.col("text")).collect():
        assert all(r[c] >= 0 for c in RATES)
        assert r.n_words or not any(r[c] for c in RATES)


def synthetic(n=900):
    return [{"doc_id": i, "_label": 0 if (i % 10 == 0 or i % 13 == 0) else 1, "a": float(i % 10), "b": float(i % 13), "c": float(i * 7 % 11)} for i in range(n)]


def test_decision_list_finds_the_rules():
    found = rules.learn_decision_list(synthetic(), ["a", "b", "c"])
    assert {c.feature for r in found for c in r} == {"a", "b"} and len(found) == 2
    assert rules.learn_decision_list([], ["a"]) == [] and rules.learn_decision_list([r for r in synthetic() if r["_label"]], ["a", "b"]) == []


def test_compiled_list_is_the_learned_one(spark):
    data = synthetic()
    found = rules.learn_decision_list(data, ["a", "b", "c"])
    df = spark.createDataFrame([(r["doc_id"], r["a"], r["b"], r["c"]) for r in data], "doc_id int, a double, b double, c double")
    got = {r.doc_id: r.why for r in df.withColumn("why", rules.decision(found)).collect()}
    for r in data:
        first = next((" and ".join(map(str, x)) for x in found if all((r[c.feature] >= c.value) if c.above else (r[c.feature] <= c.value) for c in x)), None)
        assert got[r["doc_id"]] == first


def test_training_rows_leave_the_fold_out(spark, docs, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = training_rows(docs, labels.unionByName(labels), "quality", 10_000)
    ids = [r.doc_id for r in got.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and all(zlib.crc32(str(i).encode()) % 5 for i in ids)
    assert training_rows(docs, labels, "quality", 7).count() == 7
    marks = spark.createDataFrame([(None,), (5,)], "d long").select(held_out(F.col("d"))).collect()
    assert [r[0] for r in marks] == [True, zlib.crc32(b"5") % 5 == 0]


def accuracy(df, labels, column):
    joined = df.join(labels.filter(held_out(F.col("doc_id"))), "doc_id")
    bad, good = joined.filter("quality = 0"), joined.filter("quality = 1")
    return bad.filter(~F.col(column)).count() / max(1, bad.count()), good.filter(F.col(column)).count() / max(1, good.count())


def test_held_out_documents(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet").join(labels.select("doc_id").limit(2500), "doc_id", "left_semi").repartition(8).cache()
    judged = rules.judge(docs, rules.learn_from(docs, labels), F.col("text")).select("doc_id", "base_failed", "kept").cache()
    caught, kept = accuracy(judged.filter("not base_failed"), labels, "kept")
    assert caught > 0.9 and kept > 0.98
    model = ensemble.learn_from(docs, labels)
    assert 0 < len(model.weights) < 150
    scored = ensemble.score_quality(docs, model, F.col("text")).select("doc_id", (F.col("__quality") >= 0.3).alias("yes")).cache()
    caught, kept = accuracy(scored, labels, "yes")
    assert caught > 0.9 and kept > 0.97


def test_compiled_ensemble_is_the_fitted_one(spark):
    import math

    data = synthetic()
    model = ensemble.fit_rules(data, ["a", "b", "c"])
    df = spark.createDataFrame([(r["doc_id"], r["a"], r["b"], r["c"]) for r in data], "doc_id int, a double, b double, c double")
    got = {r.doc_id: r.s for r in df.withColumn("s", model.score()).collect()}
    for r in data:
        z = model.intercept + sum(w for x, w in model.weights if all((r[c.feature] >= c.value) if c.above else (r[c.feature] <= c.value) for c in x))
        assert got[r["doc_id"]] == pytest.approx(1 / (1 + math.exp(-z)))
    assert all((got[r["doc_id"]] >= 0.5) == bool(r["_label"]) for r in data)


def test_models_of_one_class_or_none(spark):
    one = ensemble.fit_rules([r for r in synthetic() if r["_label"]], ["a"])
    assert one.weights == [] and one.intercept > 2
    assert ensemble.fit_rules([], ["a"]).intercept == 0.0


def test_edges(spark, make, edge_texts, sf_dir):
    df = make(edge_texts)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    for none in (labels.filter("false"), labels):
        found = rules.learn_from(df, none)
        out = rules.judge(df, found, F.col("text")).collect()
        assert len(out) == len(edge_texts) and not any(r.kept for r in out if r.n_words < 50)
        scores = [r["__quality"] for r in ensemble.score_quality(df, ensemble.learn_from(df, none), F.col("text")).collect()]
        assert len(scores) == len(edge_texts) and all(0 <= s <= 1 for s in scores)
    assert rules.judge(df.filter("false"), [], F.col("text")).count() == 0
    twice = rules.judge(df.unionByName(df), [], F.col("text")).groupBy("doc_id").agg(F.countDistinct("kept").alias("n"))
    assert twice.filter("n > 1").count() == 0


def test_training_rows_hold_one_row_per_id(spark):
    docs = spark.range(3000).selectExpr("7L AS doc_id", "CAST(id % 50 AS STRING) AS text").unionByName(
        spark.createDataFrame([(8, None), (8, "b"), (None, "c")], "doc_id long, text string"))
    labels = spark.createDataFrame([(7, 1), (8, 0), (None, 1)], "doc_id long, quality int")
    free = {r.doc_id for r in labels.filter(~held_out(F.col("doc_id"))).collect()}
    got = training_rows(docs, labels, "quality", 100).collect()
    want = {7: (1, "0"), 8: (0, None)}  # the least text, null first
    assert {r.doc_id: (r._label, r.text) for r in got} == {k: want[k] for k in free} and len(got) == len(free) > 0
