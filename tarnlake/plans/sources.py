"""Source, sink and streaming queries: what is written is read back and compared with the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnlake.operators import pass_rates as P
from tarnlake.operators.ranks import ordered_mean
from tarnlake.plans.registry import query
from tarnlake.plans.token_metrics import rnd
from tarnlake.plans.views import PLACE, documents, responses, steps, table, with_views
from tarnlake.session import durable, scratch_path
from tarnlake.sources import files as A
from tarnlake.streaming import incremental as S


@query("a1_nested_parquet_scan", "SELECT vec_id, label, len(embedding) AS dims, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM embeddings")
def a1(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return rnd(e.select("vec_id", "label", F.size("embedding").cast("long").alias("dims"), F.col("embedding")[0].cast("double").alias("first")))


@query("a2_multi_file_concat", """
SELECT doc_id AS id, source, true AS apply_chat_template FROM documents UNION ALL SELECT item_id, NULL, true FROM benchmark""")
def a2(spark, d):
    root = scratch_path(spark, "concat")
    documents(spark, d).select(F.col("doc_id").alias("id"), "source").write.parquet(f"{root}/a")
    table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.lit(True).alias("apply_chat_template")).write.parquet(f"{root}/b")
    return A.read_prompts(spark, f"{root}/a", f"{root}/b").select("id", "source", "apply_chat_template")


@query("a3_json_lines", "SELECT o_orderkey AS uid, o_orderpriority AS data_source FROM orders")
def a3(spark, d):
    path = scratch_path(spark, "lines")
    table(spark, d, "orders").select(F.col("o_orderkey").alias("uid"), F.col("o_orderpriority").alias("data_source")).write.json(path)
    return A.read_json(spark, path, "uid long, data_source string")


@query("a4_json_documents", "SELECT source AS name, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY source")
def a4(spark, d):
    path = scratch_path(spark, "tasks")
    per = documents(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    # one file per document: the text sink with one row per partition folder
    body = per.select(F.col("source").alias("name"), F.to_json(F.struct("source", "n", "chars")).alias("value"))
    body.write.partitionBy("name").text(path)
    docs = A.read_documents(spark, path, "source string, n long, chars long")
    return docs.select(F.regexp_extract("path", r"name=([^/]+)/", 1).alias("name"), "n", "chars")


@query("a5_sharded_batches", with_views("responses", """
SELECT CAST(CASE status WHEN 'F' THEN 0 ELSE 1 END AS INTEGER) AS rank, concat('batch_00001_', uid) AS key, resp_idx, pred FROM responses"""))
def a5(spark, d):
    root = scratch_path(spark, "shards")
    r = responses(spark, d, source=False).select("uid", "resp_idx", "pred", "status")
    for rank, status in enumerate(["F", "O"]):
        r.filter(F.col("status") == status).drop("status").write.json(f"{root}/dp{rank}/batch_00001.json")
    return A.read_shards(spark, root, "uid long, resp_idx long, pred string").select("rank", "key", "resp_idx", "pred")


@query("a6_sized_parquet_sink", """
SELECT concat('docs_', CASE WHEN n < 1000 THEN CAST(n AS VARCHAR) WHEN n % 1000 = 0 THEN concat(n // 1000, 'k') ELSE concat(round(n / 1000.0, 1), 'k') END) AS name, n AS rows FROM (SELECT count(*) AS n FROM documents)""")
def a6(spark, d):
    path, _ = A.write_sized(documents(spark, d).select("doc_id"), scratch_path(spark, "sized"), "docs")
    name = F.regexp_extract(F.lit(path), r"/([^/]+)\.parquet$", 1)
    return spark.read.parquet(path).agg(F.count("*").alias("rows")).select(name.alias("name"), "rows")


@query("a7_rate_map_sink", with_views("responses", """
SELECT data_source AS dataset, 'low' AS model, CAST(uid AS VARCHAR) AS idx, round(avg(score), 6) AS pass_rate FROM responses GROUP BY 1, 3
UNION ALL SELECT data_source, 'high', CAST(uid AS VARCHAR), round(avg(score_hi), 6) FROM responses GROUP BY 1, 3"""))
def a7(spark, d):
    r = responses(spark, d, index=False)
    both = None
    for model, col in (("low", "score"), ("high", "score_hi")):
        m = P.pass_rate(r, ["data_source", "uid"], F.col(col)).select(
            F.col("data_source").alias("dataset"), F.lit(model).alias("model"), F.col("uid").cast("string").alias("idx"), "pass_rate")
        both = m if both is None else both.unionByName(m)
    path = scratch_path(spark, "rates")
    A.write_rates(both, path)
    out = spark.read.schema("idx string, pass_rate double, dataset string, model string").parquet(path)
    return rnd(out.select("dataset", "model", "idx", "pass_rate"))


@query("a8_rollout_dump", with_views("responses", """
SELECT uid AS input, pred AS output, score, resp_idx, CAST(resp_len AS INTEGER) AS step FROM responses"""))
def a8(spark, d):
    path = scratch_path(spark, "dump")
    r = responses(spark, d, source=False)
    A.write_dump(r.select(F.col("uid").alias("input"), F.col("pred").alias("output"), "score", "resp_idx", F.col("resp_len").alias("step")), path)
    return A.read_json(spark, path, "input long, output string, score double, resp_idx long, step int").select("input", "output", "score", "resp_idx", "step")


@query("a9_metric_document", with_views("responses", """
SELECT round(avg(score) * 100, 6) AS accuracy, count(*) AS responses FROM responses"""))
def a9(spark, d):
    path = scratch_path(spark, "metrics")
    r = responses(spark, d, index=False)
    A.write_metrics(r.agg((F.avg("score") * 100).alias("accuracy"), F.count("*").alias("responses")), path)
    return rnd(A.read_json(spark, path, "accuracy double, responses long"))


@query("a10_column_pruning", "SELECT o_orderkey AS uid, o_orderpriority AS data_source FROM orders")
def a10(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("uid"), F.col("o_orderpriority").alias("data_source"))


ARRIVAL = "uid long, resp_idx long, pred string, status string"


def arrivals(spark, d, status=None):
    r = responses(spark, d, source=False).select("uid", "resp_idx", "pred", "status")
    return r if status is None else r.filter(F.col("status") == status)


def graded():
    return (F.col("pred") == "A").cast("double")


@query("s1_incremental_scoring", with_views("responses", "SELECT uid, resp_idx, score FROM responses"))
def s1(spark, d):
    root = scratch_path(spark, "s1")
    # two deliveries and two runs: the second run must take the new files only
    for status in ("F", "O"):
        arrivals(spark, d, status).write.mode("append").parquet(f"{root}/in")
        S.append_scored(S.arriving(spark, f"{root}/in", ARRIVAL), graded(), f"{root}/out", f"{root}/ckpt")
    return spark.read.parquet(f"{root}/out").select("uid", "resp_idx", "score")


@query("s2_running_pass_rate", with_views("responses", """
SELECT uid, count(*) AS n_responses, round(avg(score), 6) AS pass_rate FROM responses GROUP BY uid"""))
def s2(spark, d):
    root = scratch_path(spark, "s2")
    for status in ("F", "O"):
        arrivals(spark, d, status).withColumn("score", graded()).write.mode("append").parquet(f"{root}/in")
        S.running_pass_rates(S.arriving(spark, f"{root}/in", ARRIVAL + ", score double"), "uid", "score", f"{root}/out", f"{root}/ckpt")
    return rnd(S.current_pass_rates(spark, "uid", f"{root}/ckpt").select("uid", "n_responses", "pass_rate"))


@query("s3_completion_detection", """
SELECT o_orderpriority AS run, count(DISTINCT o_orderstatus) AS ranks, count(DISTINCT o_orderstatus) = 3 AS complete FROM orders GROUP BY 1""")
def s3(spark, d):
    m = table(spark, d, "orders").select(F.col("o_orderpriority").alias("run"), F.col("o_orderstatus").alias("rank"))
    return S.finished(m, 3)


@query("s4_idempotent_rescore", with_views("responses", "SELECT uid, resp_idx, score FROM responses"))
def s4(spark, d):
    root = scratch_path(spark, "s4")
    # the first delivery is repeated in full by the second; responses get their positions once for both
    sent = durable(arrivals(spark, d), "s4")
    for delivery in (sent.filter(F.col("status") == "F"), sent):
        delivery.write.mode("append").parquet(f"{root}/in")
        S.score_once(S.arriving(spark, f"{root}/in", ARRIVAL), ["uid", "resp_idx"], graded(), f"{root}/out", f"{root}/ckpt")
    return spark.read.parquet(f"{root}/out").select("uid", "resp_idx", "score")


KL_SQL = """
SELECT run_id, event_id, round(0.2 * exp(sum(ln(1 + least(greatest(value / 50.0 - 1, -0.2), 0.2) * 64 / 10000.0))
  OVER (PARTITION BY run_id ORDER BY ts, event_id)), 6) AS kl_coef FROM steps"""
KL_STEPS = "run_id long, ts timestamp, event_id long, value double"


@query("s6_kl_coefficient_state", with_views("steps", KL_SQL))
def s6(spark, d):
    root = scratch_path(spark, "s6")
    st = steps(spark, d).select("run_id", "ts", "event_id", "value")
    st = st.withColumn("ts", F.col("ts").cast("timestamp"))
    middle = st.agg(F.percentile_approx(F.unix_micros("ts"), 0.5).alias("m"))
    second = F.coalesce(F.unix_micros("ts") > F.col("m"), F.lit(False)).cast("int")
    # the approximate middle may come out otherwise when computed again, so both deliveries are written by one reading
    st.crossJoin(F.broadcast(middle)).withColumn("sent", second).drop("m").write.partitionBy("sent").parquet(f"{root}/sent")
    for k in range(2):
        sent = spark.read.schema(f"{KL_STEPS}, sent int").parquet(f"{root}/sent").filter(F.col("sent") == k)
        sent.drop("sent").write.mode("append").parquet(f"{root}/in")
        S.kl_coefficients(
            S.arriving(spark, f"{root}/in", KL_STEPS),
            "run_id", ["ts", "event_id"], "value", 0.2, 50.0, 10000.0, 64, f"{root}/out", f"{root}/ckpt",
        )
    return rnd(spark.read.parquet(f"{root}/out").select("run_id", "event_id", "kl_coef"))


@query("s6_reordered_steps", with_views("steps", KL_SQL))
def s6_reordered(spark, d):
    root = scratch_path(spark, "s6r")
    st = steps(spark, d).select("run_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "value")
    # each step is delivered up to four days after its event time; five deliveries of six days
    days = F.floor((F.unix_micros("ts") - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))) / 86_400_000_000)
    sent = F.floor((days + F.pmod(F.col("event_id") * 7919, F.lit(4))) / 6)
    st.withColumn("sent", F.least(sent, F.lit(4)).cast("int")).write.partitionBy("sent").parquet(f"{root}/sent")
    args = ("run_id", ["ts", "event_id"], "value", 0.2, 50.0, 10000.0, 64, f"{root}/out")
    for k in range(5):
        spark.read.schema(KL_STEPS).parquet(f"{root}/sent/sent={k}").write.mode("append").parquet(f"{root}/in")
        S.kl_coefficients(S.arriving(spark, f"{root}/in", KL_STEPS), *args, f"{root}/ckpt", delay="5 days")
    out = spark.read.parquet(f"{root}/out").unionByName(S.pending_kl_coefficients(spark, *args, KL_STEPS), allowMissingColumns=True)
    return rnd(out.select("run_id", "event_id", "kl_coef"))


@query("s7_accumulating_scores", with_views("responses", """
, per AS (SELECT data_source, uid, avg(reward) AS m FROM responses GROUP BY 1, 2), e AS (SELECT min(m) AS lo, max(m) AS hi FROM per)
SELECT data_source AS step, CAST(least(floor((m - lo) / (hi - lo) * 10), 9) AS BIGINT) AS bin, count(*) AS n
FROM per JOIN (SELECT data_source AS ds, min(m) AS lo, max(m) AS hi FROM per GROUP BY 1) ON ds = data_source GROUP BY 1, 2"""))
def s7(spark, d):
    root = scratch_path(spark, "s7")
    r = responses(spark, d, index=False, place=True).select("data_source", "uid", "reward", *PLACE)
    per = ordered_mean(r, ["data_source", "uid"], "reward", [F.col(c) for c in PLACE], "score")
    per.select(F.col("data_source").alias("step"), "score").write.parquet(f"{root}/in")
    S.append_step_scores(S.arriving(spark, f"{root}/in", "step string, score double"), f"{root}/out", f"{root}/ckpt")
    kept = spark.read.parquet(f"{root}/out").select(F.col("step").cast("string").alias("step"), "score")
    edges = kept.groupBy("step").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    width = F.col("hi") - F.col("lo")
    b = F.when(width > 0, F.least(F.floor((F.col("score") - F.col("lo")) / width * 10), F.lit(9))).otherwise(0)
    return kept.join(edges, "step").groupBy("step", b.cast("long").alias("bin")).agg(F.count("*").alias("n"))
