"""Group-relative advantages, returns and token masks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarnlake.functions import policy as L
from tarnlake.operators import advantages as A
from tarnlake.operators.ranks import row_index
from tarnlake.plans.registry import query
from tarnlake.plans.views import responses, steps, table, tokens, with_views


def r6(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


STATS = """
, g AS (SELECT uid, count(*) AS n, avg(score) AS m, stddev_samp(score) AS s, sum(score * resp_len) / sum(resp_len) AS b,
               max(score) AS hi FROM responses GROUP BY uid)
"""


@query("f1_group_advantage", with_views("responses", STATS + """
SELECT r.uid, resp_idx, round(CASE WHEN n > 1 THEN (score - m) / (s + 1e-6) ELSE score / (1 + 1e-6) END, 6) AS advantage
FROM responses r JOIN g ON r.uid = g.uid"""))
def f1(spark, d):
    out = A.group_advantage(responses(spark, d, source=False), ["uid"], "score")
    return r6(out.select("uid", "resp_idx", "advantage"), "advantage")


@query("f2_group_advantage_no_std", with_views("responses", STATS + """
SELECT r.uid, resp_idx, round(CASE WHEN n > 1 THEN score - m ELSE score END, 6) AS advantage
FROM responses r JOIN g ON r.uid = g.uid"""))
def f2(spark, d):
    out = A.group_advantage(responses(spark, d, source=False), ["uid"], "score", divide_by_std=False)
    return r6(out.select("uid", "resp_idx", "advantage"), "advantage")


@query("f3_best_only_advantage", with_views("responses", """
, top AS (SELECT uid, resp_idx, reward, row_number() OVER (PARTITION BY uid ORDER BY reward DESC, resp_idx) AS r,
            lead(reward) OVER (PARTITION BY uid ORDER BY reward DESC, resp_idx) AS second,
            stddev_samp(reward) OVER (PARTITION BY uid) AS s FROM responses)
SELECT uid, resp_idx, round(CASE WHEN r = 1 AND second IS NOT NULL THEN (reward - second) / (s + 1e-6) ELSE 0.0 END, 6) AS advantage FROM top"""))
def f3(spark, d):
    r = responses(spark, d, source=False)
    out = A.best_only_advantage(r, ["uid"], "resp_idx", "reward", strict=False)
    return r6(out.select("uid", "resp_idx", "advantage"), "advantage")


@query("f4_baseline_whitened", with_views("responses", STATS + """
, c AS (SELECT r.uid, resp_idx, resp_len, CASE WHEN n > 1 THEN score - m ELSE score END AS x FROM responses r JOIN g ON r.uid = g.uid),
mu AS (SELECT sum(x * resp_len) / (sum(resp_len) + 1e-8) AS mean, sum(resp_len) AS n FROM c),
v AS (SELECT sum(resp_len * (x - mean) * (x - mean)) / (any_value(n) + 1e-8) * any_value(n) / (any_value(n) - 1) AS var FROM c, mu)
SELECT uid, resp_idx, round((x - mean) / sqrt(var + 1e-8), 6) AS advantage FROM c, mu, v"""))
def f4(spark, d):
    out = A.baseline_whitened(responses(spark, d, source=False), ["uid"], "score", "resp_len")
    return r6(out.select("uid", "resp_idx", "advantage"), "advantage")


@query("f5_leave_one_out", with_views("responses", STATS + """
SELECT r.uid, resp_idx, round(CASE WHEN n > 1 THEN (score - m) * n / (n - 1) ELSE score END, 6) AS advantage
FROM responses r JOIN g ON r.uid = g.uid"""))
def f5(spark, d):
    out = A.leave_one_out(responses(spark, d, source=False), ["uid"], "score")
    return r6(out.select("uid", "resp_idx", "advantage"), "advantage")


@query("f6_length_weighted_baseline", with_views("responses", STATS + """
SELECT r.uid, resp_idx, round(CASE WHEN n > 1 THEN score - b ELSE score END, 6) AS advantage
FROM responses r JOIN g ON r.uid = g.uid"""))
def f6(spark, d):
    out = A.length_weighted_baseline(responses(spark, d, source=False), ["uid"], "score", "resp_len")
    return r6(out.select("uid", "resp_idx", "advantage"), "advantage")


@query("f7_greedy_baseline_advantage", with_views("tokens", """
SELECT seq_id, t, round(sum(reward * mask) OVER w, 6) AS returns,
       round(sum(reward * mask) OVER w - 0.05 * (seq_id % 3) * mask, 6) + 0.0 AS advantage
FROM tokens WINDOW w AS (PARTITION BY seq_id ORDER BY t DESC)"""))
def f7(spark, d):
    tk = tokens(spark, d).withColumn("greedy", 0.05 * (F.col("seq_id") % 3))
    out = A.greedy_baseline_advantage(tk, "seq_id", "t", "reward", "mask", "greedy")
    return r6(out.select("seq_id", "t", "returns", "advantage"), "returns", "advantage")


@query("f8_discounted_returns", with_views("tokens", """
, seqs AS (SELECT seq_id, list(reward ORDER BY t) AS r, list(mask ORDER BY t) AS m FROM tokens GROUP BY seq_id),
rets AS (
  SELECT seq_id, unnest(range(len(r))) AS t, r, m FROM seqs),
vals AS (
  SELECT seq_id, t, m[t + 1] AS mask,
    list_reduce(list_concat([struct_pack(x := 0.0::DOUBLE, nm := 0)],
      list_transform(list_reverse(range(t + 1, len(r) + 1)), lambda i: struct_pack(x := r[i], nm := CASE WHEN i < len(r) THEN m[i + 1] ELSE 0 END))),
      lambda a, b: struct_pack(x := b.x + 0.9 * b.nm * a.x, nm := 0)).x AS returns FROM rets),
mu AS (SELECT sum(returns * mask) / (sum(mask) + 1e-8) AS mean, sum(mask) AS n FROM vals),
v AS (SELECT sum(mask * (returns - mean) * (returns - mean)) / (any_value(n) + 1e-8) * any_value(n) / (any_value(n) - 1) AS var FROM vals, mu)
SELECT seq_id, t, round(returns, 6) AS returns, round((returns - mean) / sqrt(var + 1e-8) * mask, 6) + 0.0 AS advantage FROM vals, mu, v"""))
def f8(spark, d):
    out = A.discounted_returns(tokens(spark, d), "seq_id", "t", "reward", "mask", 0.9)
    return r6(out.select("seq_id", "t", "returns", "advantage"), "returns", "advantage")


@query("f9_gae", with_views("tokens", """
, delta AS (SELECT seq_id, t, mask, value, reward + 0.99 * coalesce(lead(value) OVER (PARTITION BY seq_id ORDER BY t), 0) - value AS dl FROM tokens),
pairs AS (SELECT a.seq_id, a.t, any_value(a.mask) AS mask, any_value(a.value) AS value, sum(pow(0.99 * 0.95, b.t - a.t) * b.dl) AS adv
          FROM delta a JOIN delta b ON a.seq_id = b.seq_id AND b.t >= a.t GROUP BY 1, 2),
mu AS (SELECT sum(adv * mask) / (sum(mask) + 1e-8) AS mean, sum(mask) AS n FROM pairs),
v AS (SELECT sum(mask * (adv - mean) * (adv - mean)) / (any_value(n) + 1e-8) * any_value(n) / (any_value(n) - 1) AS var FROM pairs, mu)
SELECT seq_id, t, round(adv + value, 6) AS returns, round((adv - mean) / sqrt(var + 1e-8), 6) AS advantage FROM pairs, mu, v"""))
def f9(spark, d):
    out = A.gae(tokens(spark, d), "seq_id", "t", "reward", "value", "mask", 0.99, 0.95)
    return r6(out.select("seq_id", "t", "returns", "advantage"), "returns", "advantage")


@query("f10_masked_whitening", with_views("tokens", """
, mu AS (SELECT sum(reward * mask) / (sum(mask) + 1e-8) AS mean, sum(mask) AS n FROM tokens),
v AS (SELECT sum(mask * (reward - mean) * (reward - mean)) / (any_value(n) + 1e-8) * any_value(n) / (any_value(n) - 1) AS var FROM tokens, mu)
SELECT seq_id, t, round((reward - mean) / sqrt(var + 1e-8), 6) AS whitened, round((reward - mean) / sqrt(var + 1e-8) + mean, 6) AS with_mean FROM tokens, mu, v"""))
def f10(spark, d):
    tk = A.whiten(tokens(spark, d), "reward", F.col("mask"), "whitened")
    tk = A.whiten(tk, "reward", F.col("mask"), "with_mean", shift_mean=False)
    return r6(tk.select("seq_id", "t", "whitened", "with_mean"), "whitened", "with_mean")


@query("f11_multi_source_leave_one_out", with_views("tokens", """
, tk AS (SELECT t.*, o_custkey AS prompt, CAST(o_orderstatus = 'F' AS DOUBLE) AS acc FROM tokens t JOIN orders ON seq_id = o_orderkey),
ps AS (SELECT prompt, seq_id, sum(reward * mask) / sum(mask) AS mean, max(acc) AS a, sum(mask) AS valid FROM tk GROUP BY 1, 2 HAVING sum(mask) > 0),
g AS (SELECT prompt, count(*) AS n, sum(mean) AS sr, sum(a) AS sa FROM ps GROUP BY prompt HAVING count(*) > 1),
x AS (SELECT tk.seq_id, t, mask, mask * (0.333331 * (CASE WHEN mask = 1 THEN reward * n / (n - 1) - sr / (n - 1) ELSE 0 END)
        + 0.777773 * (CASE WHEN t = valid - 1 THEN a * n / (n - 1) - sa / (n - 1) ELSE 0 END)) AS v
      FROM tk JOIN ps ON tk.seq_id = ps.seq_id JOIN g ON ps.prompt = g.prompt),
ret AS (SELECT seq_id, t, mask, sum(v) OVER (PARTITION BY seq_id ORDER BY t DESC) AS returns FROM x),
mu AS (SELECT sum(returns * mask) / (sum(mask) + 1e-8) AS mean, sum(mask) AS n FROM ret),
vv AS (SELECT sum(mask * (returns - mean) * (returns - mean)) / (any_value(n) + 1e-8) * any_value(n) / (any_value(n) - 1) AS var FROM ret, mu)
SELECT seq_id, t, round(returns, 6) + 0.0 AS returns, round((returns - mean) / sqrt(var + 1e-8), 6) + 0.0 AS advantage FROM ret, mu, vv"""))
def f11(spark, d):
    o = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("seq_id"), F.col("o_custkey").alias("prompt"),
        (F.col("o_orderstatus") == "F").cast("double").alias("acc"),
    )
    tk = tokens(spark, d).join(o, "seq_id")
    out = A.multi_source_rloo(tk, "prompt", "seq_id", "t", "reward", "mask", "acc", 0.333331, 0.777773)
    return r6(out.select("seq_id", "t", "returns", "advantage"), "returns", "advantage")


@query("f12_soft_mean_baseline", with_views("responses", """
, m AS (SELECT ln(avg(exp(2.0 * reward))) / 2.0 AS b FROM responses)
SELECT uid, resp_idx, round(reward - b, 6) AS advantage FROM responses, m"""))
def f12(spark, d):
    out = A.soft_mean_baseline(responses(spark, d, source=False), "reward", 2.0)
    return r6(out.select("uid", "resp_idx", "advantage"), "advantage")


PAIRS = """
, paired AS (SELECT uid, resp_idx // 2 AS pair_no, resp_idx % 2 AS side, reward, score, tax, resp_len, price FROM responses),
pairs AS (SELECT * FROM paired WHERE (uid, pair_no) IN (SELECT (uid, pair_no) FROM paired WHERE side = 1))
"""


def pairs(spark, d):
    """Complete response pairs: positions 2i and 2i+1 of a prompt."""
    r = responses(spark, d, source=False)
    p = r.withColumns({"pair_no": F.floor(F.col("resp_idx") / 2).cast("long"), "side": F.col("resp_idx") % 2})
    # one reading, and rows stay where the positions were made; in the order of preference_mask, so that it sorts no more
    w = Window.partitionBy("uid", "pair_no").orderBy(F.col("reward").desc(), F.col("side"))
    full = F.max("side").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) == 1
    return p.filter(F.col("uid").isNotNull()).withColumn("_full", full).filter("_full").drop("_full")


@query("f13_online_preference_mask", with_views("responses", PAIRS + """
SELECT uid, pair_no, side, row_number() OVER (PARTITION BY uid, pair_no ORDER BY reward DESC, side) = 1 AS chosen FROM pairs"""))
def f13(spark, d):
    out = A.preference_mask(pairs(spark, d), ["uid", "pair_no"], "side", "reward")
    return out.select("uid", "pair_no", "side", "chosen")


@query("f14_kl_estimators", with_views("tokens", """
SELECT seq_id, t, round(logp - ref_logp, 6) AS k1, round(abs(logp - ref_logp), 6) AS k_abs,
  round(0.5 * (logp - ref_logp) * (logp - ref_logp), 6) AS k2,
  round(least(greatest(exp(ref_logp - logp) - (ref_logp - logp) - 1, -10), 10), 6) AS k3 FROM tokens"""))
def f14(spark, d):
    a, b = F.col("logp"), F.col("ref_logp")
    kinds = {"k1": "k1", "k_abs": "abs", "k2": "k2", "k3": "k3"}
    return tokens(spark, d).select(
        "seq_id", "t", *[F.round(L.kl_estimate(a, b, k), 6).alias(n) for n, k in kinds.items()]
    )


@query("f15_kl_penalised_reward", with_views("tokens", """
SELECT seq_id, t, round(reward - 0.1 * (old_logp - ref_logp) * mask, 6) AS token_reward FROM tokens"""))
def f15(spark, d):
    tk = A.kl_penalised(tokens(spark, d), "reward", L.kl_estimate(F.col("old_logp"), F.col("ref_logp"), "k1"), "mask", 0.1)
    return r6(tk.select("seq_id", "t", "token_reward"), "token_reward")


@query("f15_mean_sequence_kl", with_views("tokens", """
SELECT round(avg(k), 6) AS mean_kl, count(*) AS sequences FROM (
  SELECT seq_id, sum((old_logp - ref_logp) * mask) / (sum(mask) + 1e-8) AS k FROM tokens GROUP BY seq_id)"""))
def f15_mean(spark, d):
    tk = A.kl_penalised(tokens(spark, d), "reward", L.kl_estimate(F.col("old_logp"), F.col("ref_logp"), "k1"), "mask", 0.1)
    return r6(A.mean_sequence_kl(tk, "seq_id", "mask"), "mean_kl")


@query("f16_adaptive_kl_coefficient", with_views("steps", """
SELECT run_id, event_id, round(0.2 * exp(sum(ln(1 + least(greatest(value / 50.0 - 1, -0.2), 0.2) * 64 / 10000.0))
  OVER (PARTITION BY run_id ORDER BY ts, event_id)), 6) AS kl_coef FROM steps"""))
def f16(spark, d):
    st = row_index(steps(spark, d), [F.col("ts"), F.col("event_id")], ["run_id"], "step")
    out = A.adaptive_coefficient(st.select("run_id", "step", "event_id", "value"), "run_id", "step", "value", 0.2, 50.0, 10000.0, 64)
    return r6(out.select("run_id", "event_id", "kl_coef"), "kl_coef")


@query("f17_first_eos_mask", with_views("tokens", """
SELECT seq_id, t, CAST(sum(CAST(resp_len > 45 AS INTEGER)) OVER (PARTITION BY seq_id ORDER BY t) - CAST(resp_len > 45 AS INTEGER) = 0 AS INTEGER) AS response_mask FROM tokens"""))
def f17(spark, d):
    return A.eos_mask(tokens(spark, d), "seq_id", "t", F.col("resp_len") > 45).select("seq_id", "t", "response_mask")


@query("f18_position_ids", with_views("tokens", """
SELECT seq_id, t, CAST(greatest(sum(mask) OVER (PARTITION BY seq_id ORDER BY t) - 1, 0) AS BIGINT) AS position_id, t * mask AS arange_position_id FROM tokens"""))
def f18(spark, d):
    return A.position_ids(tokens(spark, d), "seq_id", "t", "mask").select("seq_id", "t", "position_id", "arange_position_id")


@query("f19_overlong_shaping", with_views("responses", """
SELECT uid, resp_idx, round(score + least(-(resp_len - (50 - 16)) / 16.0 * 1.0, 0), 6) AS shaped, least(-(resp_len - (50 - 16)) / 16.0, 0) < 0 AS overlong FROM responses"""))
def f19(spark, d):
    pen = L.overlong_penalty(F.col("resp_len"), 50, 16, 1.0)
    return responses(spark, d, source=False).select(
        "uid", "resp_idx", F.round(F.col("score") + pen, 6).alias("shaped"), (pen < 0).alias("overlong")
    )


@query("f20_reward_placement", with_views("tokens", """
, n AS (SELECT seq_id, count(*) AS len, sum(reward) AS score FROM tokens GROUP BY seq_id)
SELECT t.seq_id, t.t, round(CASE WHEN t.t = len - 1 THEN score ELSE 0 END, 6) AS placed FROM tokens t JOIN n ON t.seq_id = n.seq_id"""))
def f20(spark, d):
    from tarnlake.operators.ranks import with_group_stats

    tk = with_group_stats(tokens(spark, d), ["seq_id"], len=F.count("*"), total=F.sum("reward"))
    placed = F.when(F.col("t") == F.col("len") - 1, F.col("total")).otherwise(0.0)
    return tk.select("seq_id", "t", F.round(placed, 6).alias("placed"))


@query("f28_leave_in_kl_reward", with_views("tokens", """
SELECT seq_id, t, round(reward - (old_logp - ref_logp) * 0.3, 6) AS token_reward FROM tokens"""))
def f28(spark, d):
    return tokens(spark, d).select(
        "seq_id", "t", F.round(F.col("reward") - (F.col("old_logp") - F.col("ref_logp")) * 0.3, 6).alias("token_reward")
    )


WEIGHTS_SQL = """
, ends AS (SELECT min(reward) AS lo, max(reward) AS hi FROM responses)
"""


@query("f29_resample_weights", with_views("responses", WEIGHTS_SQL + """
SELECT uid, resp_idx, round(pow(abs(reward), 2.0) + 1e-8, 8) AS w_pow, CASE WHEN reward = hi OR reward = lo THEN 1.0 ELSE 0.0 END + 1e-8 AS w_ends,
  CASE WHEN reward = hi THEN 0.4 ELSE 0.1 END + 1e-8 AS w_top FROM responses, ends"""))
def f29(spark, d):
    from tarnlake.operators.ranks import with_table_stats

    r = with_table_stats(responses(spark, d, source=False), lo=F.min("reward"), hi=F.max("reward"))
    w = {n: A.resample_weights(F.col("reward"), k, 2.0, F.col("lo"), F.col("hi"))
         for n, k in {"w_pow": "pow", "w_ends": "max_min", "w_top": "max_random"}.items()}
    return r.select("uid", "resp_idx", F.round(w["w_pow"], 8).alias("w_pow"), w["w_ends"].alias("w_ends"), w["w_top"].alias("w_top"))


@query("d8_weighted_resample", with_views("responses", """
, w AS (SELECT uid, resp_idx, pow(abs(reward), 2.0) + 1e-8 AS w FROM responses),
c AS (SELECT uid, resp_idx, sum(w) OVER (ORDER BY uid, resp_idx) AS hi, w, sum(w) OVER () AS total FROM w),
draws AS (SELECT uid AS draw_uid, resp_idx AS draw_resp_idx, CAST(concat('0x', substr(md5(concat(uid, '_', resp_idx, '7')), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u FROM responses)
SELECT draw_uid, draw_resp_idx, uid, resp_idx FROM draws ASOF JOIN (SELECT uid, resp_idx, (hi - w) / total AS a FROM c) s ON draws.u >= s.a"""))
def d8(spark, d):
    r = responses(spark, d, source=False)
    r = r.withColumn("w", A.resample_weights(F.col("reward"), "pow", 2.0, F.lit(0.0), F.lit(1.0)))
    r = r.select("uid", "resp_idx", "w")
    key = F.concat_ws("_", F.col("uid").cast("string"), F.col("resp_idx").cast("string"))
    return A.weighted_resample(r, ["uid", "resp_idx"], "w", A.md5_uniform(key, "7"))


@query("f30_attempt_penalty", """
SELECT conv_id, attempt, CASE WHEN reward > lag(reward, 1, 0.0) OVER (PARTITION BY conv_id ORDER BY attempt) THEN CAST(0.0 AS DOUBLE) ELSE -0.05 END AS penalty
FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS attempt, CAST(length(text) % 7 AS DOUBLE) AS reward
      FROM conversations WHERE role = 'assistant')""")
def f30(spark, d):
    c = table(spark, d, "conversations").filter(F.col("role") == "assistant")
    c = row_index(c, [F.col("turn")], ["conv_id"], "attempt").withColumn("reward", (F.length("text") % 7).cast("double"))
    return A.attempt_penalty(c, "conv_id", "attempt", "reward").select("conv_id", "attempt", "penalty")


@query("g9_accumulate_full_batch", with_views("responses", """
, ok AS (SELECT uid, count(*) AS n FROM responses GROUP BY uid HAVING min(score) <> max(score) OR count(*) = 1),
f AS (SELECT uid FROM ok ORDER BY uid LIMIT 256)
SELECT uid, resp_idx FROM (SELECT uid, resp_idx, row_number() OVER (ORDER BY uid, resp_idx) AS rn FROM responses WHERE uid IN (SELECT uid FROM f)) WHERE rn <= 1024"""))
def g9(spark, d):
    return A.full_batch(responses(spark, d, source=False), "uid", "resp_idx", "score", 256, 4).select("uid", "resp_idx")
