"""Sampling, splits, batch algebra, balancing, set operations and usage."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnlake.operators import balance as H
from tarnlake.operators import batches as B
from tarnlake.operators import sets as S
from tarnlake.operators import usage as U
from tarnlake.operators.ranks import row_index, shuffled_order, top_rows
from tarnlake.plans.registry import query
from tarnlake.plans.token_metrics import rnd
from tarnlake.plans.views import calls, documents, responses, table, with_views


def orders(spark, d):
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("uid"), F.col("o_orderpriority").alias("data_source"),
        F.floor(F.col("o_totalprice") / 100).alias("len"),
    )


O = """
WITH o AS (SELECT o_orderkey AS uid, o_orderpriority AS data_source, CAST(floor(o_totalprice / 100) AS BIGINT) AS len FROM orders),
ox AS (SELECT *, row_number() OVER (ORDER BY uid) - 1 AS row_no, count(*) OVER () AS n FROM o)
"""
SHUF = "md5(concat(CAST({0} AS VARCHAR), '{1}')), {0}"


@query("g1_seeded_sample", O + f"SELECT uid, data_source FROM o ORDER BY {SHUF.format('uid', '42')} LIMIT 12000")
def g1(spark, d):
    return B.sample_n(orders(spark, d), "uid", "42", 12000).select("uid", "data_source")


@query("g2_first_rows", O + "SELECT uid, data_source FROM o ORDER BY uid LIMIT 14000")
def g2(spark, d):
    return B.first_n(orders(spark, d), [F.col("uid")], 14000).select("uid", "data_source")


@query("g3_proportional_allocation", O + f"""
, q AS (SELECT data_source, floor((sum(count(*)) OVER () // 3) * count(*) / sum(count(*)) OVER ()) AS quota FROM o GROUP BY 1),
r AS (SELECT uid, data_source, row_number() OVER (PARTITION BY data_source ORDER BY {SHUF.format('uid', '42')}) AS rn FROM o WHERE len > 100)
SELECT uid, r.data_source FROM r JOIN q ON r.data_source = q.data_source WHERE rn <= quota""")
def g3(spark, d):
    o = orders(spark, d)
    sizes = o.groupBy("data_source").agg(F.count("*").alias("n"))
    return B.allocate(o.filter("len > 100"), "data_source", "uid", "42", o.count() // 3, sizes).select("uid", "data_source")


@query("g4_random_split", O + f"""
SELECT uid, CASE WHEN rn <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS split FROM (
  SELECT uid, n, row_number() OVER (ORDER BY {SHUF.format('uid', '42')}) AS rn FROM ox) WHERE rn <= floor(n * 0.8) + floor(n * 0.2)""")
def g4(spark, d):
    return B.random_split(orders(spark, d), "uid", "42", 0.8, 0.2).select("uid", "split")


@query("g5_positional_split", O + "SELECT uid, CASE WHEN row_no < floor(n * 0.75) THEN 'train' ELSE 'test' END AS split FROM ox")
def g5(spark, d):
    return B.positional_split(orders(spark, d), [F.col("uid")], 0.75).select("uid", "split")


@query("g6_validation_samples", """
SELECT doc_id, md5(text) AS input_hash FROM documents ORDER BY md5(concat(text, '42')), doc_id LIMIT 128""")
def g6(spark, d):
    docs = documents(spark, d)
    return docs.orderBy(shuffled_order(F.col("text"), "42"), "doc_id").limit(128).select("doc_id", F.md5("text").alias("input_hash"))


@query("g7_top_k_per_group", with_views("responses", """
SELECT data_source, uid, resp_idx, rank_no FROM (
  SELECT data_source, uid, resp_idx, CAST(row_number() OVER (PARTITION BY data_source ORDER BY price DESC, uid, resp_idx) AS INTEGER) AS rank_no FROM responses) WHERE rank_no <= 10"""))
def g7(spark, d):
    r = responses(spark, d)
    return top_rows(r, ["data_source"], [F.col("price").desc(), F.col("uid"), F.col("resp_idx")], 10).select(
        "data_source", "uid", "resp_idx", "rank_no"
    )


@query("g10_mini_batches", O + f"""
SELECT uid, 0 AS epoch, CAST((row_number() OVER (ORDER BY {SHUF.format('uid', '1-0')}) - 1) // 256 AS BIGINT) AS batch FROM o
UNION ALL SELECT uid, 1, CAST((row_number() OVER (ORDER BY {SHUF.format('uid', '1-1')}) - 1) // 256 AS BIGINT) FROM o""")
def g10(spark, d):
    return B.mini_batches(orders(spark, d), "uid", "1", 256, 2).select("uid", "epoch", "batch")


@query("g11_repeat_rows", O + """
, c AS (SELECT unnest(range(3)) AS copy)
SELECT uid, 'interleaved' AS mode, CAST(row_no * 3 + copy AS BIGINT) AS new_pos FROM ox, c
UNION ALL SELECT uid, 'stacked', CAST(copy * n + row_no AS BIGINT) FROM ox, c""")
def g11(spark, d):
    o = row_index(orders(spark, d), [F.col("uid")])
    a = B.repeat_rows(o, "row_no", 3, True).select("uid", F.lit("interleaved").alias("mode"), "new_pos")
    return a.unionByName(B.repeat_rows(o, "row_no", 3, False).select("uid", F.lit("stacked").alias("mode"), "new_pos"))


@query("g12_repeat_each_row", O + "SELECT uid, CAST(c AS INTEGER) AS copy FROM (SELECT uid, unnest(range(len % 4)) AS c FROM o)")
def g12(spark, d):
    return B.repeat_each(orders(spark, d), F.col("len") % 4).select("uid", "copy")


@query("g13_pad_to_divisor", O + """
SELECT uid, row_no, false AS is_pad FROM ox
UNION ALL SELECT uid, n + row_no, true FROM ox WHERE row_no < (97 - n % 97) % 97""")
def g13(spark, d):
    o = row_index(orders(spark, d), [F.col("uid")])
    return B.pad_to_divisor(o, "row_no", 97).select("uid", "row_no", "is_pad")


@query("g13_unpad", O + "SELECT uid, row_no FROM ox")
def g13_unpad(spark, d):
    o = row_index(orders(spark, d), [F.col("uid")])
    return B.unpad(B.pad_to_divisor(o, "row_no", 97)).select("uid", "row_no")


@query("g14_equal_chunks", O + "SELECT uid, CAST(ntile(7) OVER (ORDER BY uid) - 1 AS BIGINT) AS chunk FROM o")
def g14(spark, d):
    return B.chunk(orders(spark, d), [F.col("uid")], 7, strict=False).select("uid", "chunk")


@query("g15_select_rename_slice", O + "SELECT uid AS prompt_id, row_no, len FROM ox WHERE row_no >= 100 AND row_no < n - 100")
def g15(spark, d):
    o = row_index(orders(spark, d), [F.col("uid")]).drop("data_source").withColumnRenamed("uid", "prompt_id")
    n = B.with_table_stats_of(o, orders(spark, d))
    return n.filter((F.col("row_no") >= 100) & (F.col("row_no") < F.col("_n") - 100)).select("prompt_id", "row_no", "len")


PERM = O + f", p AS (SELECT uid, row_no, row_number() OVER (ORDER BY {SHUF.format('uid', '9')}) - 1 AS new_pos FROM ox)"


def permutation(spark, d):
    o = row_index(orders(spark, d), [F.col("uid")])
    return row_index(o, [shuffled_order(F.col("uid"), "9"), F.col("uid")], name="new_pos").select(
        "new_pos", F.col("row_no").alias("source_pos")
    )


@query("g16_reorder", PERM + " SELECT uid, new_pos FROM p")
def g16(spark, d):
    o = row_index(orders(spark, d), [F.col("uid")])
    return B.reorder(o, "row_no", permutation(spark, d)).select("uid", "new_pos")


@query("g16_inverse_permutation", PERM + " SELECT row_no AS new_pos, new_pos AS source_pos FROM p")
def g16_inv(spark, d):
    return B.inverse(permutation(spark, d))


@query("g17_unfold_column", """
SELECT vec_id, CAST(piece AS INTEGER) AS piece, len(c) AS width, round(list_sum(list_transform(c, lambda x: CAST(x AS DOUBLE))), 6) AS total FROM (
  SELECT vec_id, piece, embedding[piece * 16 + 1 : piece * 16 + 16] AS c FROM embeddings, (SELECT unnest(range(4)) AS piece))""")
def g17(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    out = B.unfold_column(e, "v", 4, F.size("v"))
    return rnd(out.select("vec_id", "piece", F.size("v").cast("long").alias("width"),
                          F.aggregate("v", F.lit(0.0), lambda a, x: a + x).alias("total")))


@query("g18_fold_rows", O + "SELECT CAST(row_no // 4 AS BIGINT) AS fold, string_agg(uid, ',' ORDER BY row_no) AS uids FROM ox GROUP BY 1")
def g18(spark, d):
    o = row_index(orders(spark, d), [F.col("uid")])
    out = B.fold_rows(o, "row_no", 4, ["uid", "len"])
    return out.select("fold", F.array_join(F.transform("uid", lambda x: x.cast("string")), ",").alias("uids"))


@query("g18_unfold_rows", O + "SELECT row_no, uid, len FROM ox")
def g18_un(spark, d):
    o = row_index(orders(spark, d), [F.col("uid")])
    return B.unfold_rows(B.fold_rows(o, "row_no", 4, ["uid", "len"]), "fold", 4, ["uid", "len"]).select("row_no", "uid", "len")


@query("g19_rows_to_columns", """
SELECT doc_id, string_agg(w, '|' ORDER BY i) AS words, string_agg(CAST(length(w) AS VARCHAR), '|' ORDER BY i) AS sizes FROM (
  SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents) GROUP BY doc_id""")
def g19(spark, d):
    docs = documents(spark, d)
    rows = F.transform(F.split("text", " "), lambda w: F.struct(w.alias("word"), F.length(w).cast("string").alias("size")))
    cols = B.rows_to_columns("rows", ["word", "size"])
    return docs.select("doc_id", rows.alias("rows")).select(
        "doc_id", F.array_join(cols["word"], "|").alias("words"), F.array_join(cols["size"], "|").alias("sizes")
    )


@query("g19_columns_to_rows", """
SELECT doc_id, i - 1 AS pos, w AS word, length(w) AS size FROM (
  SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents)""")
def g19_back(spark, d):
    docs = documents(spark, d).select("doc_id", F.split("text", " ").alias("word"))
    docs = docs.withColumn("size", F.transform("word", lambda w: F.length(w).cast("long")))
    fields = {"word": F.col("word"), "size": F.col("size")}
    checked = docs.filter(~B.column_lengths_differ(fields))
    z = checked.select("doc_id", F.posexplode(B.columns_to_rows(fields)).alias("pos", "z"))
    return z.select("doc_id", F.col("pos").cast("long").alias("pos"), "z.word", "z.size")


@query("h1_balanced_parts", O + """
, r AS (SELECT *, row_number() OVER (ORDER BY len DESC, uid) - 1 AS rk FROM o)
SELECT uid, CAST(CASE WHEN (rk // 8) % 2 = 0 THEN rk % 8 ELSE 7 - rk % 8 END AS BIGINT) AS part FROM r""")
def h1(spark, d):
    return H.serpentine_parts(orders(spark, d), "len", "uid", 8).select("uid", "part")


def batch_rows(spark, d, size=128):
    o = row_index(orders(spark, d), [F.col("uid")])
    return o.withColumn("batch", F.floor(F.col("row_no") / size).cast("long"))


@query("h1_exact_differencing")
def h1_exact(spark, d):
    out = H.exact_parts(batch_rows(spark, d), "batch", "uid", "len", F.lit(8), False)
    return out.groupBy("batch", "part").agg(F.count("*").alias("rows"), F.sum("len").alias("tokens"))


@query("h2_micro_batch_counts", O + """
SELECT CAST(row_no // 128 AS BIGINT) AS batch, CAST(ceil(greatest(least(count(*), ceil(sum(len) / 100000.0)), 2) / 4.0) * 4 AS BIGINT) AS k FROM ox GROUP BY 1""")
def h2(spark, d):
    return H.micro_batch_count(batch_rows(spark, d), "batch", "len", 100000, 2, 4)


@query("h2_token_budget_parts")
def h2_parts(spark, d):
    rows = batch_rows(spark, d)
    k = H.micro_batch_count(rows, "batch", "len", 100000)
    out = H.exact_parts(rows.join(k, "batch"), "batch", "uid", "len", F.least(F.col("k"), F.lit(128)), False)
    return out.groupBy("batch", "part").agg(F.count("*").alias("rows"), F.sum("len").alias("tokens"))


@query("h3_balanced_reorder", O + """
, r AS (SELECT *, row_number() OVER (ORDER BY len DESC, uid) - 1 AS rk FROM o),
p AS (SELECT uid, CASE WHEN (rk // 8) % 2 = 0 THEN rk % 8 ELSE 7 - rk % 8 END AS part FROM r)
SELECT uid, row_number() OVER (ORDER BY part, uid) - 1 AS new_pos FROM p""")
def h3(spark, d):
    parts = H.serpentine_parts(orders(spark, d), "len", "uid", 8)
    return row_index(parts, [F.col("part"), F.col("uid")], name="new_pos").select("uid", "new_pos")


@query("d5_column_union", with_views("responses", "SELECT uid, resp_idx, score, reward, resp_len FROM responses"))
def d5(spark, d):
    r = responses(spark, d, source=False)
    return B.union_columns(r.select("uid", "resp_idx", "score", "reward"), r.select("uid", "resp_idx", "score", "resp_len"), ["uid", "resp_idx"])


@query("i1_concatenate", """
SELECT doc_id AS id, 'doc' AS kind, md5(text) AS h FROM documents UNION ALL SELECT item_id, 'item', md5(text) FROM benchmark
UNION ALL SELECT conv_id, 'turn', md5(text) FROM conversations""")
def i1(spark, d):
    docs = documents(spark, d).select(F.col("doc_id").alias("id"), F.lit("doc").alias("kind"), F.md5("text").alias("h"))
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.lit("item").alias("kind"), F.md5("text").alias("h"))
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("id"), F.lit("turn").alias("kind"), F.md5("text").alias("h"))
    return S.concat_strict(docs, items, turns)


@query("i2_exact_dedup", """
SELECT doc_id, source FROM documents
QUALIFY row_number() OVER (PARTITION BY lower(trim(regexp_replace(text, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'))) ORDER BY source, doc_id) = 1""")
def i2(spark, d):
    return S.dedup_exact(documents(spark, d), F.col("text"), "doc_id", F.col("source")).select("doc_id", "source")


@query("i6_merge_maps", """
SELECT CAST(o_orderkey AS VARCHAR) AS key, o_orderpriority AS value FROM orders UNION SELECT CAST(l_orderkey AS VARCHAR), o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def i6(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderpriority").alias("value"))
    r = responses(spark, d, index=False).select(F.col("uid").cast("string").alias("key"), F.col("data_source").alias("value"))
    return S.merge_maps([o, r], "key", "value")


@query("i6_append_by_key", """
SELECT user_id, string_agg(event_type, ',' ORDER BY rn) AS values FROM (
  SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) GROUP BY 1""")
def i6_append(spark, d):
    e = table(spark, d, "events")
    out = S.append_by_key(e, "user_id", "event_type", [F.col("ts"), F.col("event_id")])
    return out.select("user_id", F.array_join("values", ",").alias("values"))


@query("i7_pair_closure", """
WITH p AS (SELECT DISTINCT o_orderstatus AS a, o_orderpriority AS b FROM orders)
SELECT a, b FROM p UNION SELECT b, a FROM p UNION SELECT a, a FROM p UNION SELECT b, b FROM p""")
def i7(spark, d):
    return S.pair_closure(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority")


PRICES = [
    ("click", "north", "small", ["text"], 0.15, 0.6),
    ("view", "north", "large", ["text", "image"], 2.5, 10.0),
    ("purchase", "south", "large", ["text", "code"], 3.0, 15.0),
    ("error", "south", "small", ["code"], 0.1, 0.3),
    ("signup", "east", "medium", ["text", "code", "image"], 1.0, 4.0),
    ("idle", "east", "medium", ["text"], 1.0, 4.0),
]
PRICE_SQL = ", prices(model, provider, tier, price_in, price_out) AS (VALUES " + ", ".join(
    f"('{m}', '{p}', '{t}', {i}::DOUBLE, {o}::DOUBLE)" for m, p, t, _, i, o in PRICES
) + ")"


@query("d6_cost_join", with_views("calls", PRICE_SQL + """
SELECT event_id, round(tok_in / 1e6 * price_in + tok_out / 1e6 * price_out, 9) AS cost FROM calls c JOIN prices p ON c.model = p.model"""))
def d6(spark, d):
    return rnd(U.with_cost(calls(spark, d), U.price_table(spark, PRICES)).select("event_id", "cost"), 9)


@query("e25_g8_usage_rollup", with_views("calls", PRICE_SQL + """
, per AS (SELECT c.model, count(*) AS calls, CAST(sum(tok_in) AS BIGINT) AS tokens_in, CAST(sum(tok_out) AS BIGINT) AS tokens_out,
   sum(tok_in / 1e6 * price_in + tok_out / 1e6 * price_out) AS cost, max(ts) AS last_used FROM calls c JOIN prices p ON c.model = p.model GROUP BY 1)
SELECT model, calls, tokens_in, tokens_out, round(cost, 6) AS cost, last_used, round(sum(cost) OVER (), 6) AS total_cost FROM per ORDER BY cost DESC"""))
def e25(spark, d):
    return rnd(U.usage_rollup(U.with_cost(calls(spark, d), U.price_table(spark, PRICES))))


@query("c20_used_models", with_views("calls", PRICE_SQL + """
SELECT model, provider, tier FROM prices WHERE tier = 'large' AND model IN (SELECT model FROM calls)"""))
def c20(spark, d):
    prices = U.price_table(spark, PRICES)
    usage = calls(spark, d).groupBy("model").agg(F.count("*").alias("calls"))
    return U.used_models(U.catalogue(prices, capability="text", tier="large"), usage).select("model", "provider", "tier")
