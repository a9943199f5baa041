"""Cases in which rows, ties or digits used to get lost."""

import pytest
from pyspark.sql import functions as F

from tarnlake.functions import prompts as B
from tarnlake.functions.policy import masked_mean, masked_var
from tarnlake.operators import evaluation as E
from tarnlake.operators import pass_rates as P
from tarnlake.operators import scoring as S
from tarnlake.operators.batches import first_n
from tarnlake.operators.ranks import gather, with_table_stats
from tarnlake.session import require_local
from tarnlake.sources import files as A


def scored(spark, rows, names, **kw):
    df = spark.createDataFrame(rows, "id int, r string, t string, s string, v double")
    return {x.id: x.score for x in S.score_responses(df, "r", "t", "s", names, **kw).collect()}


def test_every_row_gets_a_score(spark):
    rows = [(1, "\\boxed{1}", "1", "math_default", None), (2, '{"output": 3}', '"output": 3', "json_answer", None), (3, "x", "y", "judge", 1.0)]
    assert scored(spark, rows, ["math_default", "json_answer", "judge"], verdict="v") == {1: 1.0, 2: 1.0, 3: 1.0}


@pytest.mark.parametrize("scorer", [None, "no_such_scorer", "table"])
@pytest.mark.parametrize("names", [["math_default"], ["math_default", "json_answer"]])
def test_a_row_without_its_scorer_is_an_error(spark, scorer, names):
    with pytest.raises(Exception, match="no scorer for a row of"):
        scored(spark, [(1, "1", "1", "math_default", None), (2, "1", "1", scorer, None)], names)


def test_a_missing_verdict_is_an_error(spark):
    with pytest.raises(Exception, match="no verdict"):
        scored(spark, [(1, "x", "y", "judge", None)], ["judge"], verdict="v")
    with pytest.raises(ValueError):
        scored(spark, [(1, "x", "y", "judge", None)], ["judge"])


def test_unknown_task_and_source_are_errors(spark):
    df = spark.createDataFrame([("plot_unscrambling", "a", "b", None), ("typos", "a", "a", None)], "task string, t string, r string, v double")
    with pytest.raises(Exception, match="no grader and no verdict"):
        S.task_scores(df, "task", "t", "r").collect()
    told = S.task_scores(df.withColumn("v", F.lit(0.5)), "task", "t", "r", "v")
    assert {x.task: x.score for x in told.collect()}["plot_unscrambling"] == 0.5
    row = spark.createDataFrame([(1, "nowhere", "r", "t", 1.0, "typos", ["punctuation:no_comma"], ["{}"])],
                                "id int, src string, r string, t string, v double, task string, ids array<string>, kw array<string>")
    with pytest.raises(Exception, match="no scorer for source"):
        S.score_mixed(row, F.col("src"), F.lit(None).cast("string"), "r", "t", "v", "task", "ids", "kw", F.lit("en")).collect()


def test_mixed_rows_need_no_key(spark):
    """Null and repeated keys, several instructions in a row, none at all, blank and null responses."""
    comma = "punctuation:no_comma"
    rows = [
        (None, "one, two", [comma], ["{}"], 0.0), (None, "one two", [comma], ["{}"], 1.0), (7, "right", [comma], ["{}"], 1.0),
        (7, "wro,ng", [comma], ["{}"], 0.0), (8, "a b", [comma, "keywords:existence"], ["{}", '{"keywords": ["b"]}'], 1.0),
        (8, "a c", [comma, "keywords:existence"], ["{}", '{"keywords": ["b"]}'], 0.0), (9, "anything, at all", [], [], 1.0),
        (9, "anything, at all", None, None, 1.0), (9, " ", [], [], 0.0), (9, None, [comma], ["{}"], 0.0), (9, "no arguments", [comma], None, 1.0),
    ]
    df = spark.createDataFrame(
        [(k, "ood__ifeval", r, "", None, "typos", i, kw, want) for k, r, i, kw, want in rows],
        "id int, src string, r string, t string, v double, task string, ids array<string>, kw array<string>, want double")
    out = S.score_mixed(df, F.col("src"), F.lit(None).cast("string"), "r", "t", "v", "task", "ids", "kw", F.lit("en"))
    assert out.count() == len(rows)
    assert out.filter("score != want").collect() == []


@pytest.mark.parametrize("n", [9_999, 10_000, 10_001, 10_003, 15_000])
def test_first_n_is_exact_with_ties(spark, n):
    df = spark.range(20_000).withColumn("k", F.floor(F.col("id") / 4))
    got = first_n(df, [F.col("k")], n)
    assert got.count() == n
    assert got.agg(F.max("k")).first()[0] == (n - 1) // 4


def test_long_chat_is_one_text(spark):
    turns = spark.range(1500).select(F.lit(1).alias("c"), F.col("id").alias("pos"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    chat = gather(turns, ["c"], "pos", {"role": F.lit("user"), "content": F.col("text")})
    zipped = F.arrays_zip(F.col("role"), F.col("content"))
    texts = [x[0] for x in chat.select(B.render_chat(zipped, True)).collect()]
    assert len(texts) == 1 and texts[0].count("<|im_start|>assistant") == 1 and "t1499" in texts[0]


def test_moments_far_from_zero(spark):
    far = spark.createDataFrame([(1e8 + (i * 37 % 1000) / 1000, 1.0, "s", "p") for i in range(1000)], "x double, m double, s string, p string")
    want = far.agg(F.var_samp("x")).first()[0]
    got = with_table_stats(far, _mean=masked_mean(F.col("x"), F.col("m"))).agg(masked_var(F.col("x"), F.col("m"), F.col("_mean"))).first()[0]
    assert got == pytest.approx(want, rel=1e-3)
    assert P.difficulty_summary(far, F.col("x")).first()["std"] == pytest.approx(want**0.5, rel=1e-2)
    best = E.best_worst_at_n(far, "s", "p", "x").orderBy("n").first()
    assert best["best_std"] == pytest.approx(want**0.5, rel=0.7) and best["best_std"] > 0.1


def test_metric_document_has_one_row(spark, tmp_path):
    for n in (0, 2):
        with pytest.raises(ValueError):
            A.write_metrics(spark.range(n), str(tmp_path / "m"))


def test_local_scratch_only_on_a_local_master():
    for master in ("local", "local[8]", "local[*]"):
        require_local(master)
    for master in ("yarn", "spark://host:7077", "k8s://https://host", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError):
            require_local(master)


def test_late_steps_do_not_take_later_coefficients(spark, tmp_path):
    from tarnlake.streaming import incremental as I

    root = str(tmp_path)
    for rows in ([("a", 1, 9.0), ("a", 2, 1.0), ("b", 5, 9.0)], [("a", 4, 9.0), ("c", 1, 9.0)], [("a", 3, 9.0), ("a", 5, 1.0), ("b", 6, 9.0)]):
        spark.createDataFrame(rows, "run string, step long, kl double").write.mode("append").parquet(f"{root}/in")
        I.kl_coefficients(I.arriving(spark, f"{root}/in", "run string, step long, kl double"), "run", ["step"], "kl", 1.0, 3.0, 10.0, 5, f"{root}/out", f"{root}/ckpt")
    got = {(r.run, r.step): (r.kl_coef, r.late) for r in spark.read.parquet(f"{root}/out").collect()}
    up, down = 1 + 0.2 * 0.5, 1 - 0.2 * 0.5
    assert got.pop(("a", 3)) == (None, True)
    want = {("a", 1): up, ("a", 2): up * down, ("a", 4): up * down * up, ("a", 5): up * down * up * down, ("b", 5): up, ("b", 6): up * up, ("c", 1): up}
    assert {k: v[0] for k, v in got.items()} == pytest.approx(want) and not any(v[1] for v in got.values())
    assert spark.read.parquet(f"{root}/out_last").groupBy("batch_id", "run").count().filter("count > 1").count() == 0


def test_preference_tables(spark, tmp_path):
    from tarnlake.operators import prompts as P
    from tarnlake.sources.files import read_table, write_tables

    for n, cut in ((0, 0), (2, 2), (6, 4), (14, 10), (41, 31)):
        df = spark.createDataFrame([(i, f"p{i}", f"c{i}", None if i == 1 else f"r{i}") for i in range(n)], "id long, q string, c string, r string")
        rows = P.preference_tables(df, [F.col("id")], F.col("q"), F.col("c"), F.col("r"), F.col("c"), F.lit("set"))
        path = f"{tmp_path}/{n}"
        write_tables(rows, path)
        if not n:
            assert rows.count() == 0
            continue
        got = {name: read_table(spark, path, name, cols).orderBy("row_no").collect() for name, cols in P.PREFERENCE_TABLES.items()}
        assert [(r["prompt"], r["response"]) for r in got["sft"]] == [(f"p{i}", x) for i in range(n) for x in (f"c{i}", None if i == 1 else f"r{i}")]
        assert [r["split"] for r in got["rm"]] == ["train"] * cut + ["test"] * (n - cut)
        assert [(r["prompt"], r["chosen"], r["row_no"]) for r in got["rm"]] == [(f"p{i}", f"c{i}", i) for i in range(n)]
        assert [(r["messages"][0]["role"], r["messages"][0]["content"], r["extra_info"]["index"]) for r in got["rl"]] == [("user", f"p{i}", i) for i in range(n)]


@pytest.mark.parametrize("query", ["e21_difficulty_histogram", "s7_accumulating_scores"])
def test_histogram_adds_scores_in_the_order_of_the_file(spark, tmp_path, query):
    """Means on the edge of a bin (0.06 as 0.06 or 0.060000000000000005) fall by the order of adding, not by partitions."""
    import functools
    import math
    import random

    from tarnlake.plans import REGISTRY

    rnd = random.Random(3)
    li = [(rnd.randrange(1500), rnd.randrange(11) / 100) for _ in range(9000)]
    one = spark.createDataFrame(li, "l_orderkey long, l_discount double").coalesce(1)
    zero = {c: F.lit(0.0) for c in ("l_tax", "l_quantity", "l_extendedprice")}
    one = one.withColumns({**zero, "l_returnflag": F.lit("A"), "l_linestatus": F.lit("F"), "l_partkey": F.lit(1).cast("long")})
    one.write.option("parquet.block.size", 4096).parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(1500).select(F.col("id").alias("o_orderkey"), F.lit("p").alias("o_orderpriority")).write.parquet(f"{tmp_path}/orders.parquet")
    values = {}
    for k, v in li:
        values.setdefault(k, []).append(v)
    means = [functools.reduce(lambda a, b: a + b, v) / len(v) for v in values.values()]
    lo, hi = min(means), max(means)
    want = {}
    for m in means:
        b = min(math.floor((m - lo) / (hi - lo) * 10), 9)
        want[b] = want.get(b, 0) + 1
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = REGISTRY[query].run(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {r.bin: r.n for r in got if r.asDict().get("scope", "p") == "p"} == want


def test_queries_bound_the_shuffled_bytes_of_a_task(spark, sf_dir):
    from tarnlake.plans import REGISTRY

    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "64m")
    try:
        REGISTRY["i3_drop_set_union"].run(spark, sf_dir)
        assert spark.conf.get(key) == "16m"
    finally:
        spark.conf.set(key, before)


def test_documents_without_text_do_not_end_the_length_filter(spark, tmp_path):
    import duckdb

    from tarnlake.functions import predicates as C
    from tarnlake.plans import REGISTRY

    texts = [None, "", " ", "a " * 19, "a " * 20, "a " * 1948, "a " * 1949]
    spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    query = REGISTRY["c1_length_filter"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(r.doc_id for r in query.run(spark, str(tmp_path)).collect()) == sorted(r[0] for r in con.execute(query.sql).fetchall()) == [4, 5]
    # where rows must have a prompt, one without is still an error
    with pytest.raises(Exception, match="no prompt found in row"):
        spark.range(1).select(C.prompt_text(F.lit(""), F.lit(None).cast("string"))).collect()
