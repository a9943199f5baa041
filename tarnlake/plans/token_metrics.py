"""Token-table metrics and logged-policy diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnlake.functions import policy as L
from tarnlake.operators import token_metrics as M
from tarnlake.operators.balance import serpentine_parts
from tarnlake.operators.pass_rates import rank_slices
from tarnlake.plans.registry import query
from tarnlake.plans.views import responses, steps, table, tokens, with_views


def rnd(df, digits=6, skip=()):
    return df.select(*[
        F.round(c, digits).alias(c) if t == "double" and c not in skip else F.col(c) for c, t in df.dtypes
    ])


@query("e14_sequence_score", with_views("tokens", "SELECT seq_id, round(sum(reward), 6) AS seq_score FROM tokens GROUP BY seq_id"))
def e14(spark, d):
    return rnd(M.sequence_scores(tokens(spark, d), "seq_id", F.col("reward")))


@query("e15_batch_metrics", with_views("tokens", """
, tk AS (SELECT *, reward - value AS adv, reward + value AS ret FROM tokens),
tp AS (SELECT avg(adv) AS advantage_mean, max(adv) AS advantage_max, min(adv) AS advantage_min, avg(ret) AS return_mean, max(ret) AS return_max, min(ret) AS return_min,
         avg(value) AS value_mean, max(value) AS value_max, min(value) AS value_min, 1 - var_samp(ret - value) / (var_samp(ret) + 1e-5) AS explained_variance FROM tk WHERE mask = 1),
per AS (SELECT seq_id, sum(reward) AS score, sum(reward - 0.1 * value) AS rw, count(*) AS response_length, sum(resp_len) AS prompt_length FROM tk GROUP BY seq_id),
sp AS (SELECT avg(score) AS score_mean, max(score) AS score_max, min(score) AS score_min, avg(rw) AS reward_mean, max(rw) AS reward_max, min(rw) AS reward_min,
         avg(response_length) AS response_length_mean, max(response_length) AS response_length_max, min(response_length) AS response_length_min,
         avg(prompt_length) AS prompt_length_mean, CAST(max(prompt_length) AS BIGINT) AS prompt_length_max, CAST(min(prompt_length) AS BIGINT) AS prompt_length_min,
         avg(CAST(response_length = (SELECT max(response_length) FROM per) AS DOUBLE)) AS response_length_clip_ratio,
         avg(CAST(prompt_length = (SELECT max(prompt_length) FROM per) AS DOUBLE)) AS prompt_length_clip_ratio FROM per)
SELECT round(advantage_mean, 6) AS advantage_mean, round(advantage_max, 6) AS advantage_max, round(advantage_min, 6) AS advantage_min,
  round(return_mean, 6) AS return_mean, round(return_max, 6) AS return_max, round(return_min, 6) AS return_min,
  round(value_mean, 6) AS value_mean, round(value_max, 6) AS value_max, round(value_min, 6) AS value_min, round(explained_variance, 6) AS explained_variance,
  round(score_mean, 6) AS score_mean, round(score_max, 6) AS score_max, round(score_min, 6) AS score_min,
  round(reward_mean, 6) AS reward_mean, round(reward_max, 6) AS reward_max, round(reward_min, 6) AS reward_min,
  round(response_length_mean, 6) AS response_length_mean, response_length_max, response_length_min,
  round(prompt_length_mean, 6) AS prompt_length_mean, prompt_length_max, prompt_length_min,
  round(response_length_clip_ratio, 6) AS response_length_clip_ratio, round(prompt_length_clip_ratio, 6) AS prompt_length_clip_ratio FROM tp, sp"""))
def e15(spark, d):
    tk = tokens(spark, d).withColumns({
        "adv": F.col("reward") - F.col("value"), "ret": F.col("reward") + F.col("value"),
        "rw": F.col("reward") - 0.1 * F.col("value"),
    })
    out = M.batch_metrics(
        tk, "seq_id", "reward", "rw", "adv", "ret", "value", "mask",
        {"response_length": F.count("*"), "prompt_length": F.sum("resp_len")},
    )
    return rnd(out)


@query("e16_explained_variance", with_views("tokens", """
SELECT round(1 - var_samp(reward + value - value * 0.5) / (var_samp(reward + value) + 1e-5), 6) AS explained_variance FROM tokens WHERE mask = 1"""))
def e16(spark, d):
    tk = tokens(spark, d).filter("mask = 1")
    return rnd(tk.agg(M.explained_variance(F.col("value") * 0.5, F.col("reward") + F.col("value")).alias("explained_variance")))


@query("e17_source_metrics", with_views("responses", """
SELECT data_source, round(avg(resp_len), 6) AS length_mean, max(resp_len) AS length_max, min(resp_len) AS length_min, round(avg(CAST(resp_len = 50 AS DOUBLE)), 6) AS clip_ratio,
  round(avg(reward), 6) AS score_mean, max(reward) AS score_max, min(reward) AS score_min, round(stddev_samp(reward), 6) AS score_std FROM responses GROUP BY data_source"""))
def e17(spark, d):
    return rnd(M.source_metrics(responses(spark, d, index=False), "data_source", "resp_len", "reward", 50))


STAGES = "CASE stage WHEN 'click' THEN 'gen' WHEN 'view' THEN 'ref' WHEN 'purchase' THEN 'values' WHEN 'error' THEN 'adv' ELSE 'update_actor' END"


@query("e18_timing_per_token", with_views("steps responses", f"""
, tk AS (SELECT sum(resp_len) AS response_tokens, sum(resp_len + length(pred) * 7) AS all_tokens FROM responses),
tm AS (SELECT {STAGES} AS stage, sum(value) AS secs FROM steps GROUP BY 1)
SELECT stage, round(secs * 1000.0 / CASE WHEN stage = 'gen' THEN response_tokens ELSE all_tokens END, 6) AS ms_per_token FROM tm, tk"""))
def e18(spark, d):
    stage = F.expr(STAGES)
    tm = steps(spark, d).groupBy(stage.alias("stage")).agg(F.sum("value").alias("secs"))
    tk = responses(spark, d, index=False).agg(
        F.sum("resp_len").alias("response_tokens"), F.sum(F.col("resp_len") + F.length("pred") * 7).alias("all_tokens")
    )
    return rnd(M.timing_per_token(tm, "stage", "secs", tk))


@query("e19_throughput", with_views("steps responses", """
, tk AS (SELECT data_source, sum(resp_len) AS tokens FROM responses GROUP BY 1), tm AS (SELECT sum(value) AS secs FROM steps)
SELECT data_source, round(tokens / (secs * 2), 6) AS tokens_per_device_sec FROM tk, tm"""))
def e19(spark, d):
    tk = responses(spark, d, index=False).groupBy("data_source").agg(F.sum("resp_len").alias("tokens"))
    tm = steps(spark, d).agg(F.sum("value").alias("secs"))
    j = tk.crossJoin(F.broadcast(tm))
    return rnd(j.select("data_source", M.throughput(F.col("tokens"), F.col("secs"), 2).alias("tokens_per_device_sec")))


@query("e26_policy_drift", with_views("tokens", """
SELECT round(max(abs(exp(old_logp) - exp(logp))), 6) AS max_drift, round(avg(abs(exp(old_logp) - exp(logp))), 6) AS mean_drift,
       round(stddev_samp(abs(exp(old_logp) - exp(logp))), 6) AS std_drift FROM tokens WHERE mask = 1"""))
def e26(spark, d):
    return rnd(M.drift_stats(tokens(spark, d), F.col("old_logp"), F.col("logp"), F.col("mask")))


@query("e27_loss_modes", with_views("tokens", """
, per AS (SELECT seq_id, sum(reward * mask) AS s, sum(mask) AS n FROM tokens GROUP BY seq_id)
SELECT round(sum(s) / (sum(n) + 1e-8), 6) AS token_mean, round(avg(s), 6) AS seq_mean_token_sum,
  round(avg(s / nullif(n, 0)), 6) AS seq_mean_token_mean, round(sum(s) / 16, 6) AS seq_mean_token_sum_norm FROM per"""))
def e27(spark, d):
    return rnd(M.loss_modes(tokens(spark, d), "seq_id", F.col("reward"), F.col("mask"), 16))


@query("e28_imbalance_report", """
WITH s AS (SELECT o_orderkey AS id, CAST(floor(o_totalprice / 100) AS BIGINT) AS len FROM orders),
r AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS pos, row_number() OVER (ORDER BY len DESC, id) - 1 AS rk, count(*) OVER () AS n FROM s),
p AS (SELECT *, least(pos // greatest(n // 8, 1), 7) AS slice, CASE WHEN (rk // 8) % 2 = 0 THEN rk % 8 ELSE 7 - rk % 8 END AS part FROM r),
a AS (SELECT min(t) AS plain_min, max(t) AS plain_max, sum(t) AS total FROM (SELECT sum(len) AS t FROM p GROUP BY slice)),
b AS (SELECT min(t) AS balanced_min, max(t) AS balanced_max, avg(t) AS mean FROM (SELECT sum(len) AS t FROM p GROUP BY part))
SELECT CAST(plain_min AS BIGINT) AS plain_min, CAST(plain_max AS BIGINT) AS plain_max, CAST(total AS BIGINT) AS total, CAST(balanced_min AS BIGINT) AS balanced_min,
  CAST(balanced_max AS BIGINT) AS balanced_max, round(mean, 6) AS mean, CAST(plain_max - plain_min AS BIGINT) AS plain_diff FROM a, b""")
def e28(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.floor(F.col("o_totalprice") / 100).alias("len"))
    sliced = rank_slices(o, [F.col("id")], 8)
    parts = serpentine_parts(sliced, "len", "id", 8)
    return rnd(M.imbalance(parts, F.col("rank"), F.col("part"), "len"))


@query("e32_masked_stats", with_views("tokens", """
, m AS (SELECT sum(reward * mask) / (sum(mask) + 1e-8) AS mu, sum(mask) AS n FROM tokens)
SELECT round(sum(reward * mask), 6) AS masked_sum, round(any_value(mu), 6) AS masked_mean,
  round(sum(mask * (reward - mu) * (reward - mu)) / (any_value(n) + 1e-8), 8) AS masked_var_biased,
  round(sum(mask * (reward - mu) * (reward - mu)) / (any_value(n) + 1e-8) * any_value(n) / (any_value(n) - 1), 8) AS masked_var FROM tokens, m"""))
def e32(spark, d):
    out = M.masked_stats(tokens(spark, d), F.col("reward"), F.col("mask"))
    return rnd(rnd(out, 6, ("masked_var_biased", "masked_var")), 8)


@query("e33_flops_estimate", with_views("steps responses", """
, tm AS (SELECT sum(value) AS secs FROM steps),
a AS (SELECT sum(CAST(resp_len AS DOUBLE)) AS tk, sum(CAST(resp_len AS DOUBLE) * resp_len) AS sq, CAST(sum(resp_len) AS BIGINT) AS tokens FROM responses)
SELECT round((6.0::DOUBLE * ((1024.0::DOUBLE * 2816 * 3 + 1024.0::DOUBLE * (1024 + 2 * 8 * 64 + 16 * 64)) * 24 + 32000.0::DOUBLE * 1024 * 2) * tk
   + 12.0::DOUBLE * sq * 64 * 16 * 24) / secs / 1e12, 6) AS tflops, tokens FROM a, tm"""))
def e33(spark, d):
    secs = steps(spark, d).agg(F.sum("value").alias("secs"))
    r = responses(spark, d, index=False).crossJoin(F.broadcast(secs))
    return rnd(M.flops(r, "resp_len", F.max("secs"), 1024, 2816, 24, 16, 8, 32000))


@query("f21_clipped_policy_diagnostics", with_views("tokens", """
, x AS (SELECT mask, reward - 0.05 AS adv, logp * 8 - old_logp * 8 AS lr FROM tokens),
y AS (SELECT mask, adv, lr, -adv * exp(lr) AS p1, -adv * least(greatest(exp(lr), 0.8), 1.28) AS p2, -adv * 3.0 AS p3 FROM x),
z AS (SELECT *, greatest(p1, p2) AS u FROM y)
SELECT round(sum(mask * CASE WHEN adv < 0 THEN least(p3, u) ELSE u END) / (sum(mask) + 1e-8), 6) AS loss,
  round(sum(mask * CAST(p2 > p1 AS INTEGER)) / (sum(mask) + 1e-8), 6) AS clipped_high,
  round(sum(mask * CAST(u > p3 AND adv < 0 AS INTEGER)) / (sum(mask) + 1e-8), 6) AS clipped_low,
  round(sum(mask * -lr) / (sum(mask) + 1e-8), 6) AS approx_kl, round(sum(mask * exp(lr)) / (sum(mask) + 1e-8), 6) AS ratio FROM z"""))
def f21(spark, d):
    terms = L.policy_terms(F.col("reward") - 0.05, F.col("logp") * 8, F.col("old_logp") * 8, 0.2, 0.28, 3.0)
    return rnd(tokens(spark, d).agg(*[L.masked_mean(c, F.col("mask")).alias(n) for n, c in terms.items()]))


@query("f22_clipped_value_diagnostics", with_views("tokens", """
, x AS (SELECT mask, value + reward * 2 AS pred, value, reward + value * 3 AS ret FROM tokens),
y AS (SELECT mask, pow(pred - ret, 2) AS a, pow(least(greatest(pred, value - 0.1), value + 0.1) - ret, 2) AS b FROM x)
SELECT round(sum(mask * 0.5 * greatest(a, b)) / (sum(mask) + 1e-8), 6) AS loss, round(sum(mask * CAST(b > a AS INTEGER)) / (sum(mask) + 1e-8), 6) AS clipped FROM y"""))
def f22(spark, d):
    terms = L.value_terms(
        F.col("value") + F.col("reward") * 2, F.col("value"), F.col("reward") + F.col("value") * 3, 0.1
    )
    return rnd(tokens(spark, d).agg(*[L.masked_mean(c, F.col("mask")).alias(n) for n, c in terms.items()]))
