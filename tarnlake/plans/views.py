"""How the shared tables stand in for prompts, responses, tokens, logs and messages.

Each view exists twice: as a DataFrame and as the SQL text with the same meaning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.operators.ranks import row_index

PLACE = ["file", "file_row"]
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def responses(spark: SparkSession, sf_dir: str, source: bool = True, index: bool = True, place: bool = False) -> DataFrame:
    """One row per response: order = prompt, line = response; ``place`` adds where the row stands in the files."""
    li = table(spark, sf_dir, "lineitem")
    if place:
        li = li.select("*", F.col("_metadata.file_name").alias(PLACE[0]), F.col("_metadata.row_index").alias(PLACE[1]))
    if index:
        li = row_index(li, [F.col(c) for c in LINE_ORDER], ["l_orderkey"], "resp_idx")
    cols = [
        F.col("l_orderkey").alias("uid"),
        *([F.col("resp_idx")] if index else []),
        (F.col("l_returnflag") == "A").cast("double").alias("score"),
        F.col("l_returnflag").isin("A", "N").cast("double").alias("score_hi"),
        F.col("l_discount").alias("reward"),
        F.col("l_tax").alias("tax"),
        F.col("l_quantity").cast("long").alias("resp_len"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_returnflag").alias("pred"),
        F.col("l_linestatus").alias("status"),
        F.col("l_partkey").alias("part"),
        *(PLACE if place else []),
    ]
    out = li.select(*cols)
    if source:
        orders = table(spark, sf_dir, "orders").select(
            F.col("o_orderkey").alias("uid"), F.col("o_orderpriority").alias("data_source")
        )
        out = out.join(orders, "uid")
    return out


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per token: order = sequence, line position = token position."""
    r = responses(spark, sf_dir, source=False)
    return r.select(
        F.col("uid").alias("seq_id"),
        F.col("resp_idx").alias("t"),
        F.col("reward"),
        F.col("tax").alias("value"),
        (-F.col("reward")).alias("old_logp"),
        (-F.col("tax")).alias("ref_logp"),
        (-(F.col("reward") + F.col("tax")) / 2).alias("logp"),
        (F.col("status") == "F").cast("int").alias("mask"),
        "resp_len", "part", "price",
    )


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step logs: user = run, ordered by time."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"), "ts", "event_id", F.col("event_type").alias("stage"), "value", "props"
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model call log: event type = model, props length and value = tokens in and out."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("event_type").alias("model"),
        F.length("props").cast("long").alias("tok_in"),
        F.floor("value").cast("long").alias("tok_out"),
        "ts",
        F.col("user_id").alias("caller"),
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthesised responses: a reasoning part, then a boxed number; the truth is the part size."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("uid"),
        F.col("p_type").alias("data_source"),
        F.concat(
            F.lit("<think>"), F.col("p_name"), F.lit("</think> The answer is \\boxed{"),
            F.col("p_size").cast("string"), F.lit("}."),
        ).alias("response"),
        F.col("p_size").cast("string").alias("ground_truth"),
        "p_name", "p_brand", "p_type", "p_size", "p_retailprice",
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts."""
    return table(spark, sf_dir, "documents")


SQL_VIEWS = {
    "responses": """
responses AS (
  SELECT l_orderkey AS uid, o_orderpriority AS data_source,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS resp_idx,
         CAST(l_returnflag = 'A' AS DOUBLE) AS score,
         CAST(l_returnflag IN ('A', 'N') AS DOUBLE) AS score_hi,
         l_discount AS reward, l_tax AS tax, CAST(l_quantity AS BIGINT) AS resp_len,
         l_extendedprice AS price, l_returnflag AS pred, l_linestatus AS status, l_partkey AS part
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "tokens": """
tokens AS (
  SELECT uid AS seq_id, resp_idx AS t, reward, tax AS value, -reward AS old_logp, -tax AS ref_logp,
         -(reward + tax) / 2 AS logp, CAST(status = 'F' AS INTEGER) AS mask, resp_len, part, price
  FROM responses)""",
    "steps": """
steps AS (SELECT user_id AS run_id, ts, event_id, event_type AS stage, value, props FROM events)""",
    "calls": """
calls AS (SELECT event_id, event_type AS model, CAST(length(props) AS BIGINT) AS tok_in,
                 CAST(floor(value) AS BIGINT) AS tok_out, ts, user_id AS caller FROM events)""",
    "answers": """
answers AS (
  SELECT p_partkey AS uid, p_type AS data_source,
         concat('<think>', p_name, '</think> The answer is \\boxed{', CAST(p_size AS VARCHAR), '}.') AS response,
         CAST(p_size AS VARCHAR) AS ground_truth, p_name, p_brand, p_type, p_size, p_retailprice
  FROM part)""",
}
NEEDS = {"tokens": ["responses"]}


def with_views(names: str, body: str) -> str:
    """Put the named view definitions in front of a SQL body (which may go on with ', x AS (...)')."""
    wanted: list[str] = []
    for n in names.split():
        for need in [*NEEDS.get(n, []), n]:
            if need not in wanted:
                wanted.append(need)
    return "WITH" + ",".join(SQL_VIEWS[n] for n in wanted) + "\n" + body.strip()
