import corpus_pipeline as C
import pytest
from pyspark.sql import functions as F
from test_jaccard import brute

from tarnlake.llm import rules, toxicity


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root, out = tmp_path_factory.mktemp("stages"), [docs]
    for k, (_, f) in enumerate(C.STAGES):
        f(spark, out[-1], sf_dir).write.parquet(f"{root}/{k}")
        out.append(spark.read.parquet(f"{root}/{k}"))
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").distinct().collect())


def test_columns_and_rows_of_the_stages(stages):
    docs = stages[0]
    for before, after in zip(stages, stages[1:-1]):
        assert after.columns == docs.columns
        assert after.exceptAll(before).count() == 0 and 0 < after.count() <= before.count()


def test_rejections_take_effect(spark, sf_dir, stages):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = rules.judge(stages[0], rules.learn_from(stages[0], labels), F.col("text"))
    assert ids(stages[1]) == ids(judged.filter("kept"))
    scored = toxicity.score_toxicity(stages[1], toxicity.learn_from(stages[0], labels), spans=False)
    assert ids(stages[2]) == ids(scored.filter(F.col(toxicity.SCORE) < 0.5))


def test_one_document_of_each_group_stays(stages):
    rows = [(r.doc_id, r.text) for r in stages[2].collect()]
    roots = brute(rows, 5, 80, 100)
    assert ids(stages[3]) == sorted({r for _, r in roots.values()})


def test_packing_holds_every_token_once(stages):
    want = {r.doc_id: r.n for r in stages[4].select("doc_id", C.pack_tokens(F.col("text")).alias("n")).collect()}
    got = {r.doc_id: r.n for r in stages[5].groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()}
    assert got == want


def test_stages_with_odd_rows(spark, sf_dir, make, edge_texts):
    docs = make([*edge_texts, *[f"A plain text number {i} " + " ".join(f"w{i}{k}" for k in range(80)) for i in range(8)]])
    nameless = docs.filter("doc_id > 14").withColumn("doc_id", F.lit(None).cast("long"))
    odd = docs.unionByName(docs).unionByName(nameless)
    for name, f in C.STAGES:
        if name != "n-gram Jaccard join":  # its own tests have the empty table
            assert f(spark, odd.filter("false"), sf_dir).count() == 0, name
        out = f(spark, odd, sf_dir)
        if name != C.STAGES[-1][0]:
            assert out.columns == odd.columns
        if name == "n-gram Jaccard join":
            assert out.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").count() == 0
        out.collect()
