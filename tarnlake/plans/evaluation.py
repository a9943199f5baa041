"""Evaluation queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tarnlake.functions.text import token_count
from tarnlake.operators import evaluation as E
from tarnlake.operators.ranks import row_index, shuffled_order
from tarnlake.plans.registry import query
from tarnlake.plans.views import PLACE, documents, responses, steps, table, with_views
from tarnlake.session import durable


def rounded(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query("e7_pass_at_k", with_views("responses", """
, per AS (SELECT uid, count(*) AS n, count(*) FILTER (score = 1.0) AS c FROM responses GROUP BY uid),
each AS (SELECT n, c, CAST(k AS BIGINT) AS k FROM per, (SELECT unnest(list_transform(range(21), lambda i: CAST(pow(2, i) AS BIGINT))) AS k) WHERE k <= n)
SELECT k, count(*) AS prompts, round(avg(CASE WHEN n - c < k THEN 1.0 WHEN c = 0 THEN 0.0 ELSE
  1.0 - list_reduce(list_transform(range(n - c + 1, n + 1), lambda j: 1.0 - CAST(k AS DOUBLE) / j), lambda a, b: a * b) END) * 100, 6) AS pass_at_k
FROM each GROUP BY k"""))
def e7(spark, d):
    r = responses(spark, d, index=False)
    return rounded(E.pass_at_k(r, ["uid"], F.col("score")), "pass_at_k").select("k", F.col("prompts"), "pass_at_k")


@query("e7_pass_at_k_last_row_n", with_views("responses", """
, per AS (SELECT uid, count(*) AS own, count(*) FILTER (score = 1.0) AS c0 FROM responses GROUP BY uid),
last AS (SELECT own AS n FROM per ORDER BY uid DESC LIMIT 1),
each AS (SELECT n, least(c0, n) AS c, CAST(k AS BIGINT) AS k FROM per, last, (SELECT unnest(list_transform(range(21), lambda i: CAST(pow(2, i) AS BIGINT))) AS k) WHERE k <= n)
SELECT k, count(*) AS prompts, round(avg(CASE WHEN n - c < k THEN 1.0 WHEN c = 0 THEN 0.0 ELSE
  1.0 - list_reduce(list_transform(range(n - c + 1, n + 1), lambda j: 1.0 - CAST(k AS DOUBLE) / j), lambda a, b: a * b) END) * 100, 6) AS pass_at_k
FROM each GROUP BY k"""))
def e7_compat(spark, d):
    r = responses(spark, d, index=False)
    return rounded(E.pass_at_k_fixed(r, ["uid"], F.col("score"), F.col("uid")), "pass_at_k")


@query("e8_average_at_k", with_views("responses", """
, per AS (SELECT data_source, uid, avg(score) AS m FROM responses GROUP BY 1, 2)
SELECT coalesce(data_source, 'overall') AS scope, count(*) AS prompts, round(avg(m) * 100, 6) AS avg_at_k
FROM per GROUP BY GROUPING SETS ((data_source), ())"""))
def e8(spark, d):
    r = responses(spark, d, index=False)
    return rounded(E.average_at_k(r, ["uid"], "data_source", F.col("score")), "avg_at_k")


METRICS_SQL = """
, per AS (SELECT data_source, uid, count(*) AS n, avg(score) AS ms, stddev_pop(score) AS ss, avg(reward) AS mr, stddev_pop(reward) AS sr
          FROM responses GROUP BY 1, 2),
long AS (
  SELECT data_source, 'acc' AS variable, concat('mean@', n) AS metric, ms AS x FROM per
  UNION ALL SELECT data_source, 'acc', concat('std@', n), ss FROM per WHERE n > 1
  UNION ALL SELECT data_source, 'reward', concat('mean@', n), mr FROM per
  UNION ALL SELECT data_source, 'reward', concat('std@', n), sr FROM per WHERE n > 1),
metrics AS (SELECT data_source, variable, metric, avg(x) AS value, count(*) AS prompts FROM long GROUP BY 1, 2, 3)
"""


def metrics(spark, d):
    r = responses(spark, d, index=False).withColumnRenamed("score", "acc")
    return E.prompt_level_metrics(r, "data_source", "uid", ["acc", "reward"])


@query("e9_mean_std_at_n", with_views("responses", METRICS_SQL + """
SELECT data_source, variable, metric, round(value, 6) AS value, prompts FROM metrics"""))
def e9(spark, d):
    return rounded(metrics(spark, d), "value")


@query("e10_best_worst_at_n", with_views("responses", """
, hist AS (SELECT data_source, uid, reward, count(*) AS c FROM responses GROUP BY 1, 2, 3),
cum AS (SELECT *, sum(c) OVER (PARTITION BY uid ORDER BY reward) AS upto, sum(c) OVER (PARTITION BY uid) AS total FROM hist),
each AS (SELECT *, n FROM (SELECT *, unnest(list_concat(list_filter(list_transform(range(21), lambda i: CAST(pow(2, i) AS BIGINT)), lambda k: k > 1 AND k < total), [CAST(total AS BIGINT)])) AS n FROM cum WHERE total > 1)),
p AS (SELECT data_source, uid, n, reward AS x,
        pow(upto / total, n) - pow((upto - c) / total, n) AS b, pow(1 - (upto - c) / total, n) - pow(1 - upto / total, n) AS w FROM each),
per AS (SELECT data_source, uid, n, sum(x * b) AS bm, sum(x * x * b) AS b2, sum(x * w) AS wm, sum(x * x * w) AS w2 FROM p GROUP BY 1, 2, 3)
SELECT data_source, CAST(n AS BIGINT) AS n, count(*) AS prompts, round(avg(bm), 6) AS best_mean, round(avg(sqrt(greatest(b2 - bm * bm, 0))), 6) AS best_std,
       round(avg(wm), 6) AS worst_mean, round(avg(sqrt(greatest(w2 - wm * wm, 0))), 6) AS worst_std
FROM per GROUP BY 1, 2"""))
def e10(spark, d):
    r = responses(spark, d, index=False)
    out = E.best_worst_at_n(r, "data_source", "uid", "reward")
    return rounded(out, "best_mean", "best_std", "worst_mean", "worst_std")


# draws of drawn_position by number of responses and n, as arrays of 1-based positions
DRAWS_SQL = """
, r AS (SELECT data_source, uid, list(reward ORDER BY resp_idx) AS xs, list(pred ORDER BY resp_idx) AS vs, count(*) AS total
        FROM responses GROUP BY 1, 2 HAVING count(*) > 1),
plan AS (SELECT DISTINCT total, unnest(list_concat(list_filter(list_transform(range(1, 21), lambda i: CAST(pow(2, i) AS BIGINT)), lambda k: k < total), [CAST(total AS BIGINT)])) AS n FROM r),
slots AS (SELECT total, n, draw, slot, CAST(concat('0x', substr(md5(concat('42_', n, '_', draw, '_', slot)), 1, 13)) AS BIGINT) % total + 1 AS pick
          FROM (SELECT *, unnest(range(n)) AS slot FROM (SELECT total, n, unnest(range(1000)) AS draw FROM plan))),
draws AS (SELECT total, n, list(pick ORDER BY slot) AS picks FROM slots GROUP BY total, n, draw),
-- equal draws of prompts of one size count once
kinds AS (SELECT total, n, picks, count(*) AS times FROM draws GROUP BY ALL),
each AS (SELECT data_source, uid, k.n, times, list_select(xs, picks) AS x, list_select(vs, picks) AS v FROM r JOIN kinds k ON r.total = k.total),
won AS (SELECT data_source, uid, n, times, list_max(x) AS best, list_min(x) AS worst, x[list_position(v, list_aggregate(v, 'mode'))] AS majority FROM each),
per AS (SELECT data_source, uid, n, sum(best * times) / 1000 AS best, sum(worst * times) / 1000 AS worst, sum(majority * times) / 1000 AS majority FROM won GROUP BY 1, 2, 3)
SELECT data_source AS source, CAST(n AS BIGINT) AS n, count(*) AS prompts, round(avg(best), 9) AS best_mean, round(avg(worst), 9) AS worst_mean, round(avg(majority), 9) AS majority_mean
FROM per GROUP BY 1, 2"""


@query("e10_e11_seeded_bootstrap")
def e10_seeded(spark, d):
    r = responses(spark, d)
    return E.bootstrap(r, "data_source", "uid", "resp_idx", "pred", "reward")


@query("e10_e11_counted_bootstrap", with_views("responses", DRAWS_SQL))
def e10_counted(spark, d):
    r = responses(spark, d)
    out = E.bootstrap(r, "data_source", "uid", "resp_idx", "pred", "reward", counter=True)
    return rounded(out, "best_mean", "worst_mean", "majority_mean", digits=9)


@query("u4_bootstrap_reduce_functions", with_views("responses", """
, p AS (SELECT data_source, reward, row_number() OVER (PARTITION BY data_source ORDER BY uid, resp_idx) - 1 AS pos, count(*) OVER (PARTITION BY data_source) AS total FROM responses),
t AS (SELECT DISTINCT data_source, total FROM p),
slots AS (SELECT data_source, draw, CAST(concat('0x', substr(md5(concat('42_', data_source, '_', draw, '_', slot)), 1, 13)) AS BIGINT) % total AS at
          FROM (SELECT *, unnest(range(16)) AS slot FROM (SELECT *, unnest(range(200)) AS draw FROM t))),
each AS (SELECT s.data_source, draw, max(reward) AS best, median(reward) AS mid FROM slots s JOIN p ON s.data_source = p.data_source AND s.at = p.pos GROUP BY 1, 2)
SELECT data_source, round(avg(best), 6) AS best_mean, round(stddev_pop(best), 6) AS best_std, round(avg(mid), 6) AS median_mean, round(stddev_pop(mid), 6) AS median_std
FROM each GROUP BY 1"""))
def u4(spark, d):
    # counted, cut into buckets, summed and ranked: four readings
    r = durable(responses(spark, d).select("data_source", "uid", "resp_idx", "reward"), "responses")
    pos = row_index(r, [F.col("uid"), F.col("resp_idx")], ["data_source"], "pos")
    out = E.bootstrap_reduce(
        pos, ["data_source"], "pos", "reward", 16, {"best": lambda x: x.max(1), "median": lambda x: np.median(x, axis=1)}, draws=200
    )
    return rounded(out, "best_mean", "best_std", "median_mean", "median_std")


@query("e11_majority_at_n", with_views("responses", """
, votes AS (SELECT uid, pred, count(*) AS c, min(resp_idx) AS first, arg_min(reward, resp_idx) AS v FROM responses GROUP BY 1, 2)
SELECT uid, CAST(sum(c) OVER (PARTITION BY uid) AS BIGINT) AS n, pred AS majority, v AS majority_value FROM votes
QUALIFY row_number() OVER (PARTITION BY uid ORDER BY c DESC, first) = 1"""))
def e11(spark, d):
    return E.majority_at_n(responses(spark, d, source=False), ["uid"], "resp_idx", "pred", "reward")


@query("e12_core_metric_routing", with_views("responses", METRICS_SQL + """
, tops AS (SELECT data_source, variable, max(CAST(split_part(metric, '@', 2) AS INTEGER)) AS top FROM metrics GROUP BY 1, 2)
SELECT m.data_source, m.variable, m.metric, round(value, 6) AS value, prompts,
  CASE WHEN m.variable = 'acc' AND contains(m.metric, concat('@', top)) THEN 'val-core' ELSE 'val-aux' END AS section
FROM metrics m JOIN tops t ON m.data_source = t.data_source AND m.variable = t.variable"""))
def e12(spark, d):
    return rounded(E.route_metrics(metrics(spark, d), "data_source"), "value")


@query("e13_score_by_dataset", with_views("responses", """
SELECT data_source, CASE WHEN status = 'F' THEN 'final' ELSE 'unknown' END AS dataset, round(avg(score), 6) AS mean_score, count(*) AS n
FROM responses GROUP BY 1, 2"""))
def e13(spark, d):
    r = responses(spark, d, index=False)
    return rounded(E.score_by_dataset(r, "data_source", F.when(F.col("status") == "F", "final"), "score"), "mean_score")


@query("e20_reduce_by_name", with_views("steps", """
SELECT metric, round(CASE WHEN contains(metric, 'max') THEN max(value) WHEN contains(metric, 'min') THEN min(value) ELSE avg(value) END, 6) AS value
FROM (SELECT concat(stage, '/', CASE run_id % 3 WHEN 0 THEN 'max_reward' WHEN 1 THEN 'min_error' ELSE 'loss' END) AS metric, value FROM steps)
GROUP BY metric"""))
def e20(spark, d):
    kind = F.when(F.col("run_id") % 3 == 0, "max_reward").when(F.col("run_id") % 3 == 1, "min_error").otherwise("loss")
    named = steps(spark, d).select(F.concat("stage", F.lit("/"), kind).alias("metric"), "value")
    return rounded(E.reduce_by_name(named, "metric", "value"), "value")


@query("e21_difficulty_histogram", with_views("responses", """
, per AS (SELECT data_source, uid, avg(reward) AS m FROM responses GROUP BY 1, 2),
scoped AS (SELECT data_source AS scope, m FROM per UNION ALL SELECT 'overall', m FROM per),
ends AS (SELECT scope, min(m) AS lo, max(m) AS hi FROM scoped GROUP BY scope)
SELECT s.scope, CAST(least(floor((m - lo) / (hi - lo) * 10), 9) AS BIGINT) AS bin, round(lo, 6) AS lo, round(hi, 6) AS hi, count(*) AS n
FROM scoped s JOIN ends e ON s.scope = e.scope GROUP BY 1, 2, 3, 4"""))
def e21(spark, d):
    r = responses(spark, d, index=False, place=True).select("data_source", "uid", "reward", *PLACE)
    return rounded(E.difficulty_histogram(r, "data_source", "uid", "reward", order=[F.col(c) for c in PLACE]), "lo", "hi")


@query("e22_merge_by_first_message", """
SELECT md5(text) AS prompt_hash, string_agg(concat(CAST(doc_id AS VARCHAR), ',', CAST(n_chars AS VARCHAR)), ',' ORDER BY doc_id) AS responses,
       arg_min(source, doc_id) AS source FROM documents GROUP BY text""")
def e22(spark, d):
    docs = documents(spark, d).withColumn("items", F.array(F.col("doc_id").cast("string"), F.col("n_chars").cast("string")))
    out = E.merge_by_first_message(docs, "text", "doc_id", "items", ["source"])
    return out.select(
        F.md5("text").alias("prompt_hash"),
        F.array_join("items", ",").alias("responses"), "source",
    )


@query("e24_prompt_token_stats", """
SELECT min(n) AS min_tokens, max(n) AS max_tokens, round(avg(n), 6) AS mean_tokens, round(stddev_pop(n), 6) AS std_tokens
FROM (SELECT CAST(len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]')) AS BIGINT) AS n FROM conversations WHERE role = 'user')""")
def e24(spark, d):
    c = table(spark, d, "conversations").filter(F.col("role") == "user")
    return rounded(E.token_stats(c, token_count(F.col("text"))), "mean_tokens", "std_tokens")


@query("e34_validation_sample_pivot", """
WITH r AS (SELECT source, doc_id, md5(text) AS h, n_chars, row_number() OVER (PARTITION BY source ORDER BY md5(concat(CAST(doc_id AS VARCHAR), '42')), doc_id) AS i FROM documents)
SELECT source AS step, max(CASE WHEN i = 1 THEN h END) AS input_1, max(CASE WHEN i = 1 THEN n_chars END) AS score_1,
       max(CASE WHEN i = 2 THEN h END) AS input_2, max(CASE WHEN i = 2 THEN n_chars END) AS score_2,
       max(CASE WHEN i = 3 THEN h END) AS input_3, max(CASE WHEN i = 3 THEN n_chars END) AS score_3
FROM r WHERE i <= 3 GROUP BY source""")
def e34(spark, d):
    docs = documents(spark, d).select(F.col("source").alias("step"), "doc_id", "text", "n_chars")
    order = [shuffled_order(F.col("doc_id"), "42"), F.col("doc_id")]
    return E.sample_pivot(docs, "step", order, 3, {"input": F.md5("text"), "score": F.col("n_chars")})


CODE_SQL = """
, cases AS (SELECT uid, resp_idx AS case_no, CASE pred WHEN 'A' THEN 1 WHEN 'N' THEN 0 ELSE CASE WHEN reward < 0.03 THEN -4 ELSE -1 END END AS code FROM responses)
"""


def cases(spark, d):
    r = responses(spark, d, source=False)
    code = F.when(F.col("pred") == "A", 1).when(F.col("pred") == "N", 0).when(F.col("reward") < 0.03, -4).otherwise(-1)
    return r.select("uid", F.col("resp_idx").alias("case_no"), code.alias("code"))


@query("e35_test_case_score", with_views("responses", CODE_SQL + """
SELECT uid, count(*) AS cases, round(avg(CAST(code = 1 AS INTEGER)), 6) AS share_all,
  round(coalesce(avg(CAST(code = 1 AS INTEGER)) FILTER (case_no < 10), 0.0), 6) AS share_first,
  round(CASE WHEN bool_and(code = 1) THEN 1.0 ELSE coalesce(avg(CAST(code = 1 AS INTEGER)) FILTER (case_no < 10), 0.0) END, 6) AS all_or_share
FROM cases GROUP BY uid"""))
def e35(spark, d):
    return rounded(E.case_scores(cases(spark, d), ["uid"], "case_no", "code"), "share_all", "share_first", "all_or_share")


@query("e36_compile_error_propagation", with_views("responses", CODE_SQL + """
, firsts AS (SELECT uid, min(case_no) AS first FROM cases WHERE code = -4 GROUP BY uid)
SELECT c.uid, case_no, CASE WHEN case_no > first THEN -4 ELSE code END AS code,
  CASE WHEN case_no > first AND code <> -4 THEN 'compile_error_skipped' ELSE 'as_run' END AS status
FROM cases c LEFT JOIN firsts f ON c.uid = f.uid"""))
def e36(spark, d):
    return E.spread_compile_errors(cases(spark, d), ["uid"], "case_no", "code")
