"""Registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnlake.llm.common import held_out, table, word_count
from tarnlake.llm.registry import QUERIES, query  # noqa: F401
from tarnlake.session import scratch_path

PACK_LENGTHS = [512, 1024, 2048, 4096, 8192]
SHARDS = 16
MIX_BUDGET = 0.5  # share of the tokens that the mix takes
MIX_EXPONENT = 0.7  # of the natural shares, for targets


def pack_tokens(text):
    """Words of the document and one mark that ends it."""
    return word_count(text) + 1


@query("op1_best_fit_packing")
def best_fit_packing(spark, d):
    from tarnlake.llm.packing import pack_best_fit

    return pack_best_fit(table(spark, d, "documents"), pack_tokens(F.col("text")), PACK_LENGTHS)


@query("op2_balanced_sharding")
def balanced_sharding(spark, d):
    from tarnlake.llm.sharding import balanced_shards

    text = F.coalesce("text", F.lit(""))
    docs = table(spark, d, "documents").select(
        "doc_id", F.sha2(text, 256).alias("link"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32")
    )
    return balanced_shards(docs, SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


OP8_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
k AS (
  SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha1(body) AS hex, min(page_id) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(0, 8), lambda i: list_aggregate(list_transform(range(0, 4), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(hex, (i * 5 + 1)::INT, 5))::INT >> (15 - 5 * j)::INT) & 31) + 1)::INT, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM k
"""


@query("op8_warc", OP8_SQL)
def warc(spark, d):
    from tarnlake.llm.warc import read_warc, write_warc

    path = scratch_path(spark, "warc")
    write_warc(table(spark, d, "pages"), path, F.col("page_id"), F.col("url"), F.col("html"))
    return read_warc(spark, path).select(
        F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to")
    )


@query("op3_mixing")
def mixing(spark, d):
    from tarnlake.llm.common import saved
    from tarnlake.llm.mixing import fit_mix, mix_documents, with_dimensions

    rows = saved(with_dimensions(table(spark, d, "documents"), pack_tokens(F.col("text"))), "mix_rows")
    return mix_documents(rows, fit_mix(rows, MIX_BUDGET, MIX_EXPONENT))


@query("op4_ngram_jaccard")
def ngram_jaccard(spark, d):
    from tarnlake.llm.jaccard import near_duplicates

    return near_duplicates(table(spark, d, "documents"), width=4, p=85, q=100)


@query("op5_toxicity")
def toxicity(spark, d):
    from tarnlake.llm.toxicity import SCORE, SPANS, learn_from, score_toxicity

    docs = table(spark, d, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, learn_from(docs, table(spark, d, "labels")))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col(SCORE).alias("score"), (F.col(SCORE) >= 0.5).cast("int").alias("predicted"),
        F.size(SPANS).cast("long").alias("n_offending"), F.col(SPANS).alias("offending"),
    )


@query("op6_document_fingerprints")
def document_fingerprints(spark, d):
    from tarnlake.llm.syncmers import fingerprint_pairs

    return fingerprint_pairs(table(spark, d, "documents"), F.col("text"))


@query("op7_quality_rules")
def quality_rules(spark, d):
    from tarnlake.llm import rules
    from tarnlake.llm.statistics import BASE

    docs = table(spark, d, "documents").select("doc_id", "text")
    judged = rules.judge(docs, rules.learn_from(docs, table(spark, d, "labels")), F.col("text"))
    return judged.select("doc_id", *BASE, "base_failed", "kept")


@query("op9_quality_classifier")
def quality_classifier(spark, d):
    from tarnlake.llm.ensemble import learn_from, score_quality

    docs = table(spark, d, "documents").select("doc_id", "text")
    scored = score_quality(docs, learn_from(docs, table(spark, d, "labels")), F.col("text"))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__quality").alias("score"), (F.col("__quality") >= 0.3).cast("int").alias("predicted")
    )


@query("op10_license_scan")
def license_scan(spark, d):
    from tarnlake.llm.licenses import licence_report

    return licence_report(table(spark, d, "documents"), F.col("text"))


OP11_CENTROIDS, OP11_ROUNDS = 40, 5


def _op11_sql() -> str:
    """Rounds of assignment and floored means, one after another, as plain SQL."""
    def assigned(i):
        return f"""a{i} AS MATERIALIZED (
  SELECT rid, any_value(v.v) AS v, min([list_sum(list_transform(list_zip(v.v, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, c.cluster]) AS near
  FROM v, c{i} c GROUP BY rid)"""

    def moved(i):
        return f"""c{i + 1} AS MATERIALIZED (
  SELECT c.cluster, coalesce(n.c, c.c) AS c FROM c{i} c LEFT JOIN (
    SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY pos) AS c FROM (
      SELECT cluster, pos, sum(x)::BIGINT AS s, count(*) AS n
      FROM (SELECT near[2] AS cluster, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM a{i}) GROUP BY 1, 2) GROUP BY cluster) n USING (cluster))"""

    rounds = ",\n".join(f"{assigned(i)},\n{moved(i)}" for i in range(OP11_ROUNDS))
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS cluster, v AS c FROM (
    SELECT sha256('2:' || coalesce(vec_id::VARCHAR, '')) AS h, v FROM v ORDER BY h, v LIMIT {OP11_CENTROIDS})),
{rounds},
{assigned(OP11_ROUNDS)}
SELECT v.vec_id, near[2]::INT AS cluster, near[1] AS distance, (sum(near[1]) OVER (PARTITION BY near[2]))::BIGINT AS cluster_inertia,
  (sum(near[1]) OVER ())::BIGINT AS inertia, sha256(list_aggregate(c.c, 'string_agg', ',')) AS centroid_sha256
FROM a{OP11_ROUNDS} a JOIN v USING (rid) JOIN c{OP11_ROUNDS} c ON c.cluster = near[2]
"""


@query("op11_centroid_clustering", _op11_sql())
def centroid_clustering(spark, d):
    from tarnlake.llm.clusters import cluster_vectors

    return cluster_vectors(table(spark, d, "embeddings"), F.col("vec_id"), F.col("embedding"), k=OP11_CENTROIDS, rounds=OP11_ROUNDS)


OP12_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[\\x20\\x09-\\x0D]+', ''), '[\\x20\\x09-\\x0D]+$', ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (
  SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2)
SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (r.first < k.doc_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (r.first IS NULL OR r.first = k.doc_id), '')) AS kept_sha256
FROM k LEFT JOIN r USING (key) GROUP BY k.doc_id
"""


@query("op12_line_dedup", OP12_SQL)
def line_dedup(spark, d):
    from tarnlake.llm.lines import drop_repeated_lines

    return drop_repeated_lines(table(spark, d, "documents"), F.col("doc_id"), F.col("text"), shortest=10)


OP13_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    list_transform(regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+'),
      lambda t: translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS terms FROM documents),
t AS (SELECT rid, lang, source, unnest(terms) AS term FROM d),
l AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= 30),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM l GROUP BY lang),
c AS (SELECT t.lang, source, term, count(*) AS n FROM t JOIN l USING (lang, term) GROUP BY t.lang, source, term),
g AS (
  SELECT d.lang, d.source, coalesce(sum(c.n), 0) AS total
  FROM (SELECT DISTINCT lang, source FROM d) d LEFT JOIN c ON c.lang = d.lang AND c.source = d.source GROUP BY d.lang, d.source),
p AS (
  SELECT g.lang, g.source, l.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.total + 5 * v.v)::HUGEINT AS p,
    1 + (1000000000::HUGEINT * (l.n + 5)) // (v.total + 5 * v.v)::HUGEINT AS q
  FROM g JOIN l ON l.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = l.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(x.p - y.p)) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY a.lang, a.source, b.source),
items AS (
  SELECT lang, source, 'pair' AS part, item, coalesce(value, 0)::BIGINT AS value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM items)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""


@query("op13_source_divergence", OP13_SQL)
def source_divergence_audit(spark, d):
    from tarnlake.llm.divergence import source_divergence

    return source_divergence(table(spark, d, "documents"), F.col("lang"), F.col("source"), F.col("text"))


@query("pipeline")
def pipeline(spark, d):
    from corpus_pipeline import run

    return run(spark, d)
