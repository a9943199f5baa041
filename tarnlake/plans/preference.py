"""Preference pairs, losses and peer comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnlake.operators import preference as P
from tarnlake.operators.advantages import preference_mask
from tarnlake.plans.advantages import PAIRS, pairs
from tarnlake.plans.registry import query
from tarnlake.plans.token_metrics import rnd
from tarnlake.plans.views import responses, tokens, with_views

SIDES = PAIRS + """
, marked AS (SELECT *, row_number() OVER (PARTITION BY uid, pair_no ORDER BY reward DESC, side) = 1 AS chosen FROM pairs),
two AS (SELECT uid, pair_no,
  max(CASE WHEN chosen THEN -tax * resp_len END) AS cl, max(CASE WHEN NOT chosen THEN -tax * resp_len END) AS rl,
  max(CASE WHEN chosen THEN -reward * resp_len END) AS rcl, max(CASE WHEN NOT chosen THEN -reward * resp_len END) AS rrl,
  max(CASE WHEN chosen THEN reward END) AS cs, max(CASE WHEN NOT chosen THEN reward END) AS rs,
  max(CASE WHEN chosen THEN resp_len END) AS cn, max(CASE WHEN NOT chosen THEN resp_len END) AS rn FROM marked GROUP BY 1, 2)
"""
LSIG = "-(greatest(-({0}), 0) + ln(1 + exp(-abs({0}))))"


def two(spark, d):
    marked = preference_mask(pairs(spark, d), ["uid", "pair_no"], "side", "reward")
    out = P.two_sides(marked, ["uid", "pair_no"], F.col("chosen"), {
        "logp": -F.col("tax") * F.col("resp_len"), "ref_logp": -F.col("reward") * F.col("resp_len"),
        "score": F.col("reward"), "len": F.col("resp_len"),
    })
    return out.withColumnsRenamed({"chosen_ref_logp": "ref_chosen_logp", "rejected_ref_logp": "ref_rejected_logp"})


@query("f23_pair_loss_sigmoid", with_views("responses", SIDES + f"""
SELECT round(avg(-({LSIG.format('0.1 * m')}) * 0.9 - ({LSIG.format('-0.1 * m')}) * 0.1), 6) AS loss, count(*) AS pairs
FROM (SELECT (cl - rl) - (rcl - rrl) AS m FROM two)"""))
def f23(spark, d):
    return rnd(P.pair_loss(two(spark, d), 0.1, 0.1))


@query("f23_pair_loss_squared", with_views("responses", SIDES + """
SELECT round(avg(pow((cl - rl) - 1 / (2 * 0.1), 2)), 6) AS loss, count(*) AS pairs FROM two"""))
def f23_ipo(spark, d):
    return rnd(P.pair_loss(two(spark, d), 0.1, kind="ipo", reference_free=True))


@query("e29_preference_metrics", with_views("responses", SIDES + """
SELECT round(avg(cl), 6) AS chosen_logp_mean, round(avg(rl), 6) AS rejected_logp_mean, round(avg(cs - rs), 6) AS score_margin_mean, round(max(cs - rs), 6) AS score_margin_max,
  round(min(cs - rs), 6) AS score_margin_min, round(avg(cn), 6) AS chosen_len_mean, round(avg(rn), 6) AS rejected_len_mean,
  round(avg(CAST(cs > rs AS DOUBLE)), 6) AS strict_win_rate, count(*) AS pairs FROM two"""))
def e29(spark, d):
    return rnd(P.preference_metrics(two(spark, d), "score"))


PEERS = """
, peers AS (SELECT a.uid, a.resp_idx, a.score, a.reward,
    coalesce(avg(b.reward) FILTER (CASE WHEN a.score > 0 THEN b.score < a.score ELSE b.score > a.score END), 0.0) AS peer_mean,
    count(*) AS n, avg(CAST(b.reward <= a.reward AS DOUBLE)) AS sq, avg(CAST(b.score <= a.score AS DOUBLE)) AS sa
  FROM responses a JOIN responses b ON a.uid = b.uid GROUP BY 1, 2, 3, 4)
"""


@query("d10_peer_comparison", with_views("responses", PEERS + "SELECT uid, resp_idx, round(peer_mean, 6) AS peer_mean FROM peers"))
def d10(spark, d):
    out = P.peer_means(responses(spark, d, source=False), ["uid"], "score", "reward")
    return rnd(out.select("uid", "resp_idx", "peer_mean"))


@query("f24_cross_entropy_loss", with_views("responses", f"""
SELECT round(avg(-(score * ({LSIG.format('0.5 * reward * resp_len')}) + (1 - score) * ({LSIG.format('-0.5 * reward * resp_len')}))), 6) AS ce_loss FROM responses"""))
def f24_ce(spark, d):
    r = responses(spark, d, source=False, index=False)
    return rnd(P.cross_entropy(r, F.col("reward") * F.col("resp_len"), F.col("score"), 0.5))


@query("f24_detached_loss", with_views("responses", PEERS + f"""
, l AS (SELECT -({LSIG.format("(reward * 2.0 - peer_mean * 2.0) * CASE WHEN score > 0 THEN 1.0 ELSE -1.0 END")}) AS loss, n, sq, sa FROM peers)
SELECT round(avg(loss), 6) AS loss_plain, round(sum(loss * n * pow(sq, n - 1)), 4) AS loss_bon_score, round(sum(loss * n * pow(sa, n - 1)), 4) AS loss_bon_acc FROM l"""))
def f24(spark, d):
    out = P.detached_loss(responses(spark, d, source=False, index=False), ["uid"], "score", "reward", 2.0)
    return out.select(
        F.round("loss_plain", 6).alias("loss_plain"), F.round("loss_bon_score", 4).alias("loss_bon_score"),
        F.round("loss_bon_acc", 4).alias("loss_bon_acc"),
    )


PAIRWISE = """
, p AS (SELECT a.uid, abs({x} - {y}) AS w, CAST((a.reward > b.reward) = ({x} > {y}) AS INTEGER) AS ok
        FROM responses a JOIN responses b ON a.uid = b.uid AND a.resp_idx < b.resp_idx),
g AS (SELECT uid, CASE WHEN sum(w) = 0 THEN 0.5 ELSE sum(w * ok) / sum(w) END AS acc FROM p GROUP BY uid),
u AS (SELECT DISTINCT uid FROM responses)
SELECT u.uid, round(coalesce(acc, 0.5), 6) AS accuracy FROM u LEFT JOIN g ON u.uid = g.uid
"""


@query("f25_pairwise_accuracy", with_views("responses", PAIRWISE.format(x="a.score", y="b.score")))
def f25(spark, d):
    out = P.pairwise_accuracy(responses(spark, d, source=False), ["uid"], "resp_idx", "reward", "score")
    return rnd(out.select("uid", "accuracy"))


@query("d9_pair_join_graded", with_views("responses", PAIRWISE.format(x="a.resp_len", y="b.resp_len")))
def d9(spark, d):
    r = responses(spark, d, source=False).withColumn("grade", F.col("resp_len").cast("double"))
    return rnd(P.pairwise_accuracy(r, ["uid"], "resp_idx", "reward", "grade").select("uid", "accuracy"))


@query("f26_sign_accuracy", with_views("responses", """
SELECT round(avg(CAST(sign(reward - 0.05) = sign(score * 2 - 1) AS DOUBLE)), 6) AS sign_accuracy FROM responses"""))
def f26(spark, d):
    r = responses(spark, d, source=False, index=False)
    return rnd(P.sign_accuracy(r, F.col("reward") - 0.05, F.col("score")))


@query("f27_squared_margin_loss", with_views("tokens", """
SELECT round(avg(pow(d - 0.7 * r, 2)), 6) AS loss, count(*) AS sequences FROM (
  SELECT seq_id, sum((logp - old_logp) * mask) AS d, max(reward) AS r, sum(mask) AS n FROM tokens GROUP BY seq_id) WHERE n > 0"""))
def f27(spark, d):
    return rnd(P.squared_margin_loss(tokens(spark, d), "seq_id", "logp", "old_logp", "mask", "reward", 0.7))
