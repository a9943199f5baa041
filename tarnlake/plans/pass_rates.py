"""Pass rates, difficulty and the filters that use them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnlake.functions.text import token_count
from tarnlake.operators import pass_rates as P
from tarnlake.operators.ranks import row_index
from tarnlake.plans.registry import query
from tarnlake.plans.views import documents, responses, table, with_views


def r6(c):
    return F.round(c, 6)


RATES = """, rates AS (
  SELECT CAST(uid AS VARCHAR) AS idx, data_source, avg(score) AS low_rate, avg(score_hi) AS high_rate
  FROM responses GROUP BY uid, data_source)
"""


def rate_map(spark, d, col):
    r = responses(spark, d, index=False)
    return P.pass_rate(r, ["uid", "data_source"], F.col(col)).withColumn("idx", F.col("uid").cast("string"))


@query("e1_pass_rate_per_prompt", with_views("responses", """
SELECT uid, data_source, count(*) AS n_responses, round(avg(CASE WHEN score >= 1.0 THEN 1.0 ELSE 0.0 END), 6) AS pass_rate
FROM responses GROUP BY uid, data_source"""))
def e1(spark, d):
    r = responses(spark, d, index=False)
    return P.pass_rate(r, ["uid", "data_source"], F.col("score")).withColumn("pass_rate", r6("pass_rate"))


@query("e2_pass_rate_per_batch", with_views("responses", RATES + """
SELECT CAST(CAST(idx AS BIGINT) // 128 AS BIGINT) AS batch, round(avg(low_rate), 6) AS batch_rate, count(*) AS prompts
FROM rates GROUP BY 1"""))
def e2(spark, d):
    out = P.mean_rate_by_batch(rate_map(spark, d, "score"), F.floor(F.col("uid") / 128).cast("long"))
    return out.withColumn("batch_rate", r6("batch_rate"))


@query("e3_run_summary", with_views("responses", """
SELECT count(*) AS responses, count(DISTINCT uid) AS prompts, CAST(sum(resp_len) AS BIGINT) AS elapsed,
       round(CAST(sum(resp_len) AS DOUBLE) / greatest(count(*), 1), 6) AS avg_reward_time FROM responses"""))
def e3(spark, d):
    per = responses(spark, d, source=True, index=False).groupBy("uid").agg(
        F.count("*").alias("n"), F.sum("resp_len").alias("secs")
    )
    return per.agg(
        F.sum("n").alias("responses"), F.count("*").alias("prompts"), F.sum("secs").alias("elapsed"),
        r6(F.sum("secs").cast("double") / F.greatest(F.sum("n"), F.lit(1))).alias("avg_reward_time"),
    )


@query("e4_pass_rate_map", with_views("responses", RATES + """
SELECT concat(data_source, '_', idx) AS id, round(low_rate, 6) AS pass_rate FROM rates"""))
def e4(spark, d):
    rates = rate_map(spark, d, "score").withColumn("extra", F.create_map(F.lit("index"), F.col("idx")))
    keyed = rates.select(P.row_key(F.col("extra"), F.col("data_source")).alias("id"), "pass_rate")
    return P.require_unique(keyed, ["id"]).withColumn("pass_rate", r6("pass_rate"))


@query("e5_difficulty_summary", with_views("responses", RATES + """
SELECT data_source, count(*) AS n, round(avg(low_rate), 6) AS mean, round(quantile_cont(low_rate, 0.5), 6) AS median,
       round(stddev_pop(low_rate), 6) AS std FROM rates GROUP BY data_source"""))
def e5(spark, d):
    out = P.difficulty_summary(rate_map(spark, d, "score"), F.col("pass_rate"), ["data_source"])
    return out.select("data_source", "n", *[r6(c).alias(c) for c in ("mean", "median", "std")])


CLASS_SQL = """, classes AS (
  SELECT data_source, count(*) AS total,
    count(*) FILTER (low_rate = 0) AS c0,
    count(*) FILTER (low_rate > 0 AND low_rate <= 0.2) AS c1,
    count(*) FILTER (low_rate {ge} 0.2 AND low_rate <= 0.4) AS c2,
    count(*) FILTER (low_rate {ge} 0.4 AND low_rate <= 0.6) AS c3,
    count(*) FILTER (low_rate {ge} 0.6 AND low_rate <= 0.8) AS c4,
    count(*) FILTER (low_rate {ge} 0.8 AND low_rate < 1) AS c5,
    count(*) FILTER (low_rate = 1) AS c6
  FROM rates GROUP BY data_source)
SELECT data_source, class_no, class_name, n, round(100.0 * n / total, 6) AS percent FROM (
  SELECT data_source, total, 0 AS class_no, 'Impossible' AS class_name, c0 AS n FROM classes
  UNION ALL SELECT data_source, total, 1, 'Very Hard', c1 FROM classes
  UNION ALL SELECT data_source, total, 2, 'Hard', c2 FROM classes
  UNION ALL SELECT data_source, total, 3, 'Medium', c3 FROM classes
  UNION ALL SELECT data_source, total, 4, 'Easy', c4 FROM classes
  UNION ALL SELECT data_source, total, 5, 'Very Easy', c5 FROM classes
  UNION ALL SELECT data_source, total, 6, 'Perfect', c6 FROM classes)"""


@query("e6_difficulty_classes", with_views("responses", RATES + CLASS_SQL.format(ge=">=")))
def e6(spark, d):
    out = P.difficulty_classes(rate_map(spark, d, "score"), F.col("pass_rate"), ["data_source"])
    return out.withColumn("percent", r6("percent"))


@query("e6_difficulty_classes_disjoint", with_views("responses", RATES + CLASS_SQL.format(ge=">")))
def e6_disjoint(spark, d):
    out = P.difficulty_classes(rate_map(spark, d, "score"), F.col("pass_rate"), ["data_source"], disjoint=True)
    return out.withColumn("percent", r6("percent"))


@query("e23_response_length_mean", """
SELECT CAST(conv_id AS BIGINT) AS conv_id,
       coalesce(round(avg(len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]'))) FILTER (role = 'assistant'), 6), 0.0) AS mean_tokens
FROM conversations GROUP BY conv_id""")
def e23(spark, d):
    c = table(spark, d, "conversations")
    n = F.when(F.col("role") == "assistant", token_count(F.col("text")))
    return c.groupBy("conv_id").agg(F.coalesce(r6(F.avg(n)), F.lit(0.0)).alias("mean_tokens"))


@query("e30_subset_totals", """
SELECT source, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM documents GROUP BY source""")
def e30(spark, d):
    return P.subset_totals(documents(spark, d), "source")


@query("e31_data_source_counts", with_views("responses", "SELECT data_source, count(*) AS n FROM responses GROUP BY 1"))
def e31(spark, d):
    return P.data_source_counts(responses(spark, d, index=False))


@query("d1_pass_rate_annotation", with_views("responses", RATES + """
SELECT o_orderkey AS uid, round(coalesce(l.low_rate, 0.0), 6) AS low_rate, round(coalesce(l.high_rate, 0.0), 6) AS high_rate
FROM orders LEFT JOIN rates l ON CAST(o_orderkey AS VARCHAR) = l.idx"""))
def d1(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("uid"), F.col("o_orderkey").cast("string").alias("idx"))
    out = P.annotate_rates(o, rate_map(spark, d, "score"), rate_map(spark, d, "score_hi"))
    return out.select("uid", r6("low_rate").alias("low_rate"), r6("high_rate").alias("high_rate"))


@query("d2_drop_set_exclusion", with_views("responses", RATES + """
SELECT o_orderkey AS uid FROM orders WHERE CAST(o_orderkey AS VARCHAR) NOT IN (SELECT idx FROM rates WHERE low_rate <= 0.0)"""))
def d2(spark, d):
    drop = rate_map(spark, d, "score").filter(F.col("pass_rate") <= 0.0).select("idx")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("uid"), F.col("o_orderkey").cast("string").alias("idx"))
    return o.join(drop, "idx", "left_anti").select("uid")


@query("c13_pass_rate_band", with_views("responses", RATES + """
SELECT o_orderkey AS uid, o_orderpriority AS data_source FROM orders
WHERE CAST(o_orderkey AS VARCHAR) NOT IN (SELECT idx FROM rates WHERE low_rate <= 0.1 OR high_rate >= 0.9)"""))
def c13(spark, d):
    o = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("uid"), F.col("o_orderpriority").alias("data_source"),
        F.col("o_orderkey").cast("string").alias("idx"),
    )
    low = P.last_per_key(rate_map(spark, d, "score").select("idx", "pass_rate"), ["idx"], F.col("pass_rate"))
    out = P.filter_band(o, low, rate_map(spark, d, "score_hi"), 0.1, 0.9)
    return out.select("uid", "data_source")


@query("c13_last_duplicate_wins", """
SELECT l_orderkey AS id, l_linenumber AS pos, max(l_extendedprice) AS price FROM lineitem
WHERE (l_orderkey, l_linenumber) IN (SELECT (l_orderkey, max(l_linenumber)) FROM lineitem GROUP BY l_orderkey)
GROUP BY 1, 2""")
def c13_last(spark, d):
    li = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("pos"), F.col("l_extendedprice").alias("price")
    )
    return P.last_per_key(li, ["id"], F.struct("pos", "price"))


@query("d11_scores_regrouped", with_views("responses", """
SELECT uid, string_agg(CAST(CAST(score AS BIGINT) AS VARCHAR), ',' ORDER BY resp_idx) AS scores,
       string_agg(pred, ',' ORDER BY resp_idx) AS preds FROM responses GROUP BY 1"""))
def d11(spark, d):
    r = responses(spark, d, source=False).withColumn("score", F.col("score").cast("long").cast("string"))
    out = P.merge_scores(r, ["uid"], "resp_idx", ["score", "pred"])
    return out.select("uid", *[F.array_join(c, ",").alias(c) for c in ("scores", "preds")])


@query("i3_drop_set_union", with_views("responses", RATES + """
SELECT DISTINCT idx FROM rates WHERE low_rate <= 0.0 OR high_rate >= 1.0"""))
def i3(spark, d):
    return P.drop_ids(rate_map(spark, d, "score"), rate_map(spark, d, "score_hi"), 0.0, 1.0)


@query("i4_combine_maps_last_wins", with_views("responses", RATES + """
SELECT idx, round(coalesce(any_value(high_rate), 0), 6) AS pass_rate FROM rates GROUP BY idx"""))
def i4(spark, d):
    low = rate_map(spark, d, "score").select("idx", "pass_rate", F.lit(0).alias("file_no"))
    high = rate_map(spark, d, "score_hi").select("idx", "pass_rate", F.lit(1).alias("file_no"))
    out = P.last_per_key(low.unionByName(high), ["idx"], F.col("file_no"))
    return out.select("idx", r6("pass_rate").alias("pass_rate"))


@query("i4_combine_maps_strict", with_views("responses", RATES + """
SELECT idx, round(low_rate, 6) AS pass_rate FROM rates"""))
def i4_strict(spark, d):
    rates = rate_map(spark, d, "score").select("idx", "pass_rate")
    even = F.col("idx").cast("long") % 2 == 0
    combined = rates.filter(even).unionByName(rates.filter(~even))
    return P.require_unique(combined, ["idx"]).withColumn("pass_rate", r6("pass_rate"))


@query("i5_chunk_family", """
SELECT CASE WHEN count(DISTINCT split_part(name, '_chunk', 1)) = 1 THEN min(split_part(name, '_chunk', 1)) ELSE 'combined' END AS family,
       count(DISTINCT name) AS n_chunks
FROM (SELECT concat(source, '_chunk', CAST(doc_id % 7 AS VARCHAR)) AS name FROM documents)""")
def i5(spark, d):
    names = documents(spark, d).select(F.concat("source", F.lit("_chunk"), F.col("doc_id") % 7).alias("name"))
    return P.combined_name(names, "name")


@query("a11_rank_slices", """
SELECT o_orderkey AS uid, CAST(least((row_number() OVER (ORDER BY o_orderkey) - 1) // greatest(count(*) OVER () // 7, 1), 6) AS BIGINT) AS rank
FROM orders""")
def a11(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("uid"))
    return P.rank_slices(o, [F.col("uid")], 7).select("uid", "rank")


@query("c15_too_long_flag", """
SELECT doc_id, CAST(len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]')) AS BIGINT) AS token_length,
       len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]')) > 200 AS too_long FROM documents""")
def c15(spark, d):
    out = P.length_flag(documents(spark, d), token_count(F.col("text")), 200)
    return out.select("doc_id", "token_length", "too_long")


@query("c17_varied_groups", with_views("responses", """
SELECT uid, resp_idx, score FROM responses WHERE uid IN (
  SELECT uid FROM responses GROUP BY uid HAVING min(score) <> max(score) OR count(*) = 1)"""))
def c17(spark, d):
    return P.varied_groups(responses(spark, d), ["uid"], "score").select("uid", "resp_idx", "score")


@query("c18_prefer_and_downsample", with_views("responses", """
, groups AS (
  SELECT uid, CASE WHEN avg(score) BETWEEN 0.2 AND 0.8 AND max(resp_len) < 48 THEN 0 ELSE 1 END AS bad FROM responses GROUP BY uid)
SELECT uid, resp_idx FROM (
  SELECT r.uid, resp_idx, row_number() OVER (ORDER BY bad, r.uid, resp_idx) AS rn, count(*) OVER () AS n
  FROM responses r JOIN groups g ON r.uid = g.uid) WHERE rn <= floor(n / 2.0)"""))
def c18(spark, d):
    out = P.prefer_groups(responses(spark, d), "uid", "resp_idx", "score", "resp_len", 0.2, 0.8, 49, 2.0)
    return out.select("uid", "resp_idx")


@query("c19_first_rows", """
SELECT o_orderkey AS uid, o_orderpriority AS data_source FROM orders ORDER BY o_orderkey LIMIT 48""")
def c19(spark, d):
    o = table(spark, d, "orders")
    return o.orderBy("o_orderkey").limit(48).select(
        F.col("o_orderkey").alias("uid"), F.col("o_orderpriority").alias("data_source")
    )


@query("c19_skip_first_batches", """
SELECT batch, count(*) AS n FROM (
  SELECT CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 100 AS BIGINT) AS batch, count(*) OVER () AS total FROM orders)
WHERE batch >= floor(0.25 * ceil(total / 100.0)) GROUP BY batch""")
def c19_skip(spark, d):
    o = row_index(table(spark, d, "orders").select("o_orderkey"), [F.col("o_orderkey")])
    batches = o.groupBy(F.floor(F.col("row_no") / 100).cast("long").alias("batch")).agg(F.count("*").alias("n"))
    first = batches.agg(F.floor(F.count("*") * 0.25).alias("first"))
    return batches.crossJoin(F.broadcast(first)).filter(F.col("batch") >= F.col("first")).select("batch", "n")


@query("s5_progress_eta", with_views("steps", """
, ordered AS (
  SELECT run_id, ts, event_id, value, row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) AS rn,
         count(*) OVER (PARTITION BY run_id) AS n FROM steps)
SELECT run_id, event_id, round(avg(value) OVER (PARTITION BY run_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS mean_secs,
       n - rn AS left_steps,
       round(avg(value) OVER (PARTITION BY run_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) * (n - rn), 6) AS eta
FROM ordered"""))
def s5(spark, d):
    from tarnlake.operators.batches import progress_eta
    from tarnlake.plans.views import steps

    out = progress_eta(steps(spark, d), "run_id", [F.col("ts"), F.col("event_id")], "value", 10)
    return out.select("run_id", "event_id", r6("mean_secs").alias("mean_secs"), "left_steps", r6("eta").alias("eta"))


