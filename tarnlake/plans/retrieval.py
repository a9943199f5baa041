"""Retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnlake.operators import retrieval as R
from tarnlake.plans.registry import query
from tarnlake.plans.token_metrics import rnd
from tarnlake.plans.views import documents, table

NORMED = """
WITH x AS (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS d FROM embeddings),
n AS (SELECT vec_id, sqrt(sum(CAST(v AS DOUBLE) * CAST(v AS DOUBLE))) AS norm FROM x GROUP BY 1),
c AS (SELECT x.vec_id, label, d, CAST(v AS DOUBLE) / norm AS v FROM x JOIN n ON x.vec_id = n.vec_id),
p AS (SELECT label, d, avg(v) AS m FROM c GROUP BY 1, 2),
pn AS (SELECT label, sqrt(sum(m * m)) AS norm FROM p GROUP BY 1),
q AS (SELECT p.label, d, m / norm AS v FROM p JOIN pn ON p.label = pn.label)
"""


def vectors(spark, d):
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("doc_id"), "label", R.normalised(F.col("embedding")).alias("vec"))


def centroids(spark, d):
    """Query vectors: the normalised mean vector of each label."""
    c = R.pooled(vectors(spark, d), ["label"], "vec")
    return c.select(F.col("label").cast("long").alias("query_id"), R.normalised(F.col("vec")).alias("vec"))


@query("l1_dense_top_k", NORMED + """
, s AS (SELECT q.label AS query_id, c.vec_id AS doc_id, sum(q.v * c.v) AS score FROM q JOIN c ON q.d = c.d GROUP BY 1, 2)
SELECT CAST(query_id AS BIGINT) AS query_id, doc_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank_no FROM s
QUALIFY rank_no <= 10""")
def l1(spark, d):
    return rnd(R.dense_top_k(centroids(spark, d), vectors(spark, d), 10))


TERMS = """
WITH qt AS (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]')) AS term FROM benchmark),
q AS (SELECT query_id, term, count(*) AS qtf FROM qt GROUP BY 1, 2),
t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]') AS ts FROM documents),
st AS (SELECT count(*) AS docs, avg(len(ts)) AS avgdl FROM t),
tf AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM t) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
sc AS (SELECT query_id, doc_id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * qtf * tf / (tf + 0.9 * (1 - 0.4 + 0.4 * dl / avgdl))) AS score
  FROM q JOIN df ON q.term = df.term JOIN tf ON q.term = tf.term, st GROUP BY 1, 2),
hits AS (SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS INTEGER) AS rank_no FROM sc QUALIFY rank_no <= 5)
"""


def hits(spark, d):
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return R.bm25_top_k(q, documents(spark, d).select("doc_id", "text"), 5)


@query("l2_bm25_top_k", TERMS + "SELECT query_id, doc_id, round(score, 6) AS score, rank_no FROM hits")
def l2(spark, d):
    return rnd(hits(spark, d))


@query("l2_queries_short_of_hits", TERMS + """
SELECT item_id AS query_id, coalesce(n, 0) AS hits FROM benchmark LEFT JOIN (SELECT query_id, count(*) AS n FROM hits GROUP BY 1) ON item_id = query_id WHERE coalesce(n, 0) < 5""")
def l2_short(spark, d):
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"))
    return R.short_of_hits(hits(spark, d), q, 5)


@query("d4_hit_document_lookup", TERMS + """
SELECT query_id, rank_no, hits.doc_id, source, md5(text) AS text_hash FROM hits JOIN documents ON hits.doc_id = documents.doc_id""")
def d4(spark, d):
    out = R.with_documents(hits(spark, d), documents(spark, d))
    return out.select("query_id", "rank_no", "doc_id", "source", F.md5("text").alias("text_hash"))


@query("l3_title_and_text", """
SELECT doc_id, trim(split_part(text, chr(10), 1), '"') AS title, md5(CASE WHEN contains(text, chr(10)) THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END) AS rest_hash FROM documents""")
def l3(spark, d):
    title, rest = R.title_and_text(F.col("text"))
    return documents(spark, d).select("doc_id", title.alias("title"), F.md5(rest).alias("rest_hash"))


@query("l4_result_text", TERMS + """
, b AS (SELECT query_id, rank_no, concat('Doc ', rank_no, ' (Title: ', trim(split_part(text, chr(10), 1), '"'), ')', chr(10),
   CASE WHEN contains(text, chr(10)) THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END, chr(10), chr(10)) AS block FROM hits JOIN documents ON hits.doc_id = documents.doc_id)
SELECT query_id, md5(string_agg(block, '' ORDER BY rank_no)) AS result_hash, count(*) AS hits, CASE WHEN count(*) > 0 THEN 'success' ELSE 'empty' END AS status FROM b GROUP BY query_id""")
def l4(spark, d):
    title, rest = R.title_and_text(F.col("text"))
    out = R.result_text(R.with_documents(hits(spark, d), documents(spark, d)), "query_id", "rank_no", title, rest)
    return out.select("query_id", F.md5("result").alias("result_hash"), "hits", F.when(F.col("hits") > 0, "success").otherwise("empty").alias("status"))


@query("l5_mean_pooling", """
SELECT label, CAST(d - 1 AS INTEGER) AS dim, round(avg(CAST(v AS DOUBLE)), 6) AS mean FROM (
  SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS d FROM embeddings) GROUP BY 1, 2""")
def l5(spark, d):
    pooled = R.pooled(table(spark, d, "embeddings").withColumnRenamed("embedding", "vec"), ["label"], "vec")
    return rnd(pooled.select("label", F.posexplode("vec").alias("dim", "mean")))


@query("l6_l2_normalisation", NORMED + "SELECT vec_id, round(sum(v * v), 6) AS squared, round(sum(v), 6) AS total FROM c GROUP BY 1")
def l6(spark, d):
    v = vectors(spark, d)
    return rnd(v.select(
        F.col("doc_id").alias("vec_id"), F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x).alias("squared"),
        F.aggregate("vec", F.lit(0.0), lambda a, x: a + x).alias("total"),
    ))
