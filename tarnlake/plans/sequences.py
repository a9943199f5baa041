"""Sequence preparation over message and document texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnlake.functions.text import token_count
from tarnlake.operators import sequences as K
from tarnlake.operators.advantages import preference_mask
from tarnlake.operators.ranks import gather
from tarnlake.plans.advantages import PAIRS, pairs
from tarnlake.plans.registry import query
from tarnlake.plans.views import documents, table, with_views


def ids_of(text):
    """Word lengths stand in for token ids."""
    return F.transform(F.split(text, " "), lambda w: F.length(w))


def joined(arr):
    return F.array_join(F.transform(arr, lambda x: x.cast("string")), ",")


IDS = "list_transform(string_split({0}, ' '), lambda w: CAST(length(w) AS INTEGER))"
JOIN = "array_to_string({0}, ',')"


def rep(value, n):
    return f"list_transform(range(greatest({n}, 0)), lambda z: {value})"


@query("k1_pad_and_truncate", f"""
WITH a AS (SELECT doc_id, {IDS.format('text')} AS x FROM documents),
b AS (SELECT doc_id, len(x) AS n, x[1:64] AS r, x[greatest(len(x) - 64, 0) + 1:] AS l, CASE WHEN len(x) > 64 THEN list_concat(x[1:32], x[len(x) - 31:]) ELSE x END AS m FROM a)
SELECT doc_id, {JOIN.format(f"list_concat(r, {rep('0', '64 - len(r)')})")} AS right_ids, {JOIN.format(f"list_concat({rep('0', '64 - len(l)')}, l)")} AS left_ids,
  {JOIN.format(f"list_concat(m, {rep('0', '64 - len(m)')})")} AS middle_ids, CAST(least(n, 64) AS INTEGER) AS valid FROM b""")
def k1(spark, d):
    docs = documents(spark, d).select("doc_id", ids_of(F.col("text")).alias("x"))
    r, mask = K.pad_or_cut(F.col("x"), 64, 0, False, "right")
    le, _ = K.pad_or_cut(F.col("x"), 64, 0, True, "left")
    m, _ = K.pad_or_cut(F.col("x"), 64, 0, False, "middle")
    return docs.select("doc_id", joined(r).alias("right_ids"), joined(le).alias("left_ids"), joined(m).alias("middle_ids"),
                       F.aggregate(mask, F.lit(0), lambda a, v: a + v).alias("valid"))


TURNS = f"""
WITH u AS (SELECT conv_id, turn, {IDS.format('text')} AS p FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, turn, {IDS.format('text')} AS r FROM conversations WHERE role = 'assistant'),
t AS (SELECT u.conv_id, u.turn, p, r FROM u JOIN a ON u.conv_id = a.conv_id AND a.turn = u.turn)
"""


def turns(spark, d):
    c = table(spark, d, "conversations")
    u = c.filter(F.col("role") == "user").select("conv_id", "turn", ids_of(F.col("text")).alias("p"))
    a = c.filter(F.col("role") == "assistant").select("conv_id", "turn", ids_of(F.col("text")).alias("r"))
    return u.join(a, ["conv_id", "turn"])


@query("k2_tuned_sequence", TURNS.replace("a.turn = u.turn", "a.turn = u.turn + 1") + f"""
, s AS (SELECT conv_id, turn, len(p) AS np, len(p) + len(r) + 1 AS n, list_concat(p, r, [99])[1:128] AS ids FROM t)
SELECT conv_id, turn, {JOIN.format(f"list_concat(ids, {rep('0', '128 - len(ids)')})")} AS ids,
  {JOIN.format("list_transform(range(128), lambda i: CASE WHEN i < least(np, 128) - 1 OR i = least(n, 128) - 1 OR i >= n THEN 0 ELSE 1 END)")} AS loss_mask FROM s""")
def k2(spark, d):
    c = table(spark, d, "conversations")
    u = c.filter(F.col("role") == "user").select("conv_id", "turn", ids_of(F.col("text")).alias("p"))
    a = c.filter(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), ids_of(F.col("text")).alias("r"))
    ids, loss = K.tuned_sequence(F.col("p"), F.col("r"), 99, 128, 0)
    return u.join(a, ["conv_id", "turn"]).select("conv_id", "turn", joined(ids).alias("ids"), joined(loss).alias("loss_mask"))


@query("k3_multi_turn_loss_spans", """
WITH n AS (SELECT conv_id, turn, role, CAST(len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]')) + 4 AS BIGINT) AS k FROM conversations)
SELECT conv_id, turn, CAST(sum(k) OVER w - k AS BIGINT) AS start, CAST(sum(k) OVER w AS BIGINT) AS "end", CAST(role = 'assistant' AS INTEGER) AS loss FROM n
WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def k3(spark, d):
    out = K.turn_spans(table(spark, d, "conversations"), "conv_id", "turn", token_count(F.col("text")) + 4)
    return out.select("conv_id", "turn", "start", "end", "loss")


@query("k4_preference_sequences", f"""
WITH a AS (SELECT doc_id, {IDS.format('source')} AS p, {IDS.format('text')} AS x FROM documents),
s AS (SELECT doc_id, list_concat(p, x)[1:32] AS c, list_concat(p, list_reverse(x))[1:32] AS r FROM a)
SELECT doc_id, {JOIN.format(f"list_concat(c, {rep('0', '32 - len(c)')})")} AS chosen_ids, {JOIN.format(f"list_concat(r, {rep('0', '32 - len(r)')})")} AS rejected_ids, CAST(len(c) AS INTEGER) AS valid FROM s""")
def k4(spark, d):
    docs = documents(spark, d).select("doc_id", ids_of(F.col("source")).alias("p"), ids_of(F.col("text")).alias("x"))
    s = K.preference_sequences(F.col("p"), F.col("x"), F.reverse("x"), 32)
    valid = F.aggregate(s["chosen_mask"], F.lit(0), lambda a, v: a + v)
    return docs.select("doc_id", joined(s["chosen_ids"]).alias("chosen_ids"), joined(s["rejected_ids"]).alias("rejected_ids"), valid.alias("valid"))


@query("k5_unpad", f"SELECT doc_id, {JOIN.format(f'({IDS.format(chr(116)+chr(101)+chr(120)+chr(116))})[1:64]')} AS ids FROM documents")
def k5(spark, d):
    docs = documents(spark, d).select("doc_id", ids_of(F.col("text")).alias("x"))
    ids, mask = K.pad_or_cut(F.col("x"), 64, 0, True, "right")
    return docs.select("doc_id", joined(K.unpad(ids, mask)).alias("ids"))


@query("k6_ragged_to_rectangular", f"""
WITH a AS (SELECT item_id, {IDS.format('text')} AS x FROM benchmark), m AS (SELECT max(len(x)) AS top FROM a)
SELECT item_id, {JOIN.format(f"list_concat(x, {rep('0', 'top - len(x)')})")} AS ids FROM a, m""")
def k6(spark, d):
    b = table(spark, d, "benchmark").select("item_id", ids_of(F.col("text")).alias("ids"))
    return K.rectangular(b, "ids", 0).select("item_id", joined(F.col("ids")).alias("ids"))


@query("k7_prompt_response_lengths", f"""
WITH a AS (SELECT doc_id, list_transform({IDS.format('text')}, lambda x: CAST(x > 3 AS INTEGER)) AS m FROM documents)
SELECT doc_id, CAST(coalesce(list_sum(m[1:greatest(len(m) - 16, 0)]), 0) AS INTEGER) AS prompt_length, CAST(coalesce(list_sum(m[greatest(len(m) - 16, 0) + 1:]), 0) AS INTEGER) AS response_length FROM a""")
def k7(spark, d):
    mask = F.transform(ids_of(F.col("text")), lambda x: (x > 3).cast("int"))
    docs = documents(spark, d).select("doc_id", mask.alias("m"))
    p, r = K.split_lengths(F.col("m"), 16)
    return docs.select("doc_id", p.alias("prompt_length"), r.alias("response_length"))


@query("k8_conversation_assembly", """
WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations)
SELECT conv_id, string_agg(role, ',' ORDER BY pos) AS roles, md5(string_agg(concat(role, ':', text), chr(10) ORDER BY pos)) AS text_hash FROM c GROUP BY 1""")
def k8(spark, d):
    c = K.assemble_conversations(table(spark, d, "conversations"), "conv_id", "turn")
    out = gather(c, ["conv_id"], "pos", {"role": F.col("role"), "line": F.concat("role", F.lit(":"), "text")})
    return out.select("conv_id", F.array_join("role", ",").alias("roles"), F.md5(F.array_join("line", "\n")).alias("text_hash"))


@query("k9_preference_table", with_views("responses", PAIRS + """
, m AS (SELECT *, row_number() OVER (PARTITION BY uid, pair_no ORDER BY reward DESC, side) = 1 AS chosen FROM pairs)
SELECT uid, pair_no, max(concat('5,6,', resp_len)) FILTER (chosen) AS chosen_ids, max(concat('-100,-100,', resp_len)) FILTER (chosen) AS chosen_labels,
  max(concat('-100,-100,', resp_len)) FILTER (NOT chosen) AS rejected_labels, round(max(-reward * resp_len) FILTER (chosen), 6) AS chosen_ref_logp,
  round(max(-reward * resp_len) FILTER (NOT chosen), 6) AS rejected_ref_logp FROM m GROUP BY 1, 2"""))
def k9(spark, d):
    marked = preference_mask(pairs(spark, d), ["uid", "pair_no"], "side", "reward")
    marked = marked.withColumns({
        "ids": F.array(F.lit(5).cast("long"), F.lit(6).cast("long"), F.col("resp_len")), "logp": -F.col("reward") * F.col("resp_len"),
    })
    out = K.preference_table(marked, ["uid", "pair_no"], "chosen", "ids", 2, "logp")
    return out.select("uid", "pair_no", joined(F.col("chosen_ids")).alias("chosen_ids"), joined(F.col("chosen_labels")).alias("chosen_labels"),
                      joined(F.col("rejected_labels")).alias("rejected_labels"), F.round("chosen_ref_logp", 6).alias("chosen_ref_logp"),
                      F.round("rejected_ref_logp", 6).alias("rejected_ref_logp"))
