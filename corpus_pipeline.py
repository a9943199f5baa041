"""Corpus pipeline: quality rules, toxicity, near duplicates, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a table; all but the last return the columns of
``documents`` for the rows that they keep.  ``run`` writes each stage's table to the shared folder and reads
it again for the next, so that a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.llm import jaccard, mixing, packing, rules, toxicity
from tarnlake.llm.common import saved, table
from tarnlake.llm.queries import MIX_BUDGET, MIX_EXPONENT, PACK_LENGTHS, pack_tokens

_ROW = "__document"


def _held(docs: DataFrame) -> DataFrame:
    """The id and text of each row beside the whole row, so that no column of it can clash with a stage's own."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(_ROW))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the base checks or the learned decision list reject."""
    learned = rules.learn_from(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rules.judge(_held(docs), learned, F.col("text")).filter("kept").select(f"{_ROW}.*")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with a toxicity of one half or more."""
    model = toxicity.learn_from(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(_held(docs), model, spans=False).filter(F.col(toxicity.SCORE) < 0.5).select(f"{_ROW}.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group whose sets of five-word runs reach a similarity of 0.8.

    It is the one with the smallest id; of rows that repeat an id one stays.  Rows without an id stay.
    The rows that go are named by id, since they are fewer than those that stay, and only where ids repeat
    are rows gathered by id.
    """
    found = jaccard.near_duplicates(docs, width=5, p=80, q=100)
    gone = saved(found.filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct(), "removed_ids")
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    repeated = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 AND doc_id IS NOT NULL").select("doc_id")
    repeated = saved(repeated, "repeated_ids")
    if repeated.isEmpty():
        return kept
    one_each = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.join(repeated, "doc_id", "left_anti").unionByName(one_each).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sample documents so that sources, languages and topics come near tempered shares of the tokens."""
    tokens = pack_tokens(F.col("text"))
    rows = docs.select(
        *[mixing.dimension(F.col(c)).alias(c) for c in ("source", "lang")], mixing.topic_of(F.col("text")).alias("topic"),
        tokens.alias("n_tokens"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(_ROW),
    )
    mix = mixing.fit_mix(rows.select("source", "lang", "topic", "n_tokens"), MIX_BUDGET, MIX_EXPONENT)
    return rows.filter(mixing.chosen(F.col(f"{_ROW}.doc_id"), mix.probability())).select(f"{_ROW}.*")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of several permitted lengths."""
    return packing.pack_best_fit(docs, pack_tokens(F.col("text")), PACK_LENGTHS)


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", best_fit_packing),
]

# learned models, connected components and raking have no SQL form; tests/llm compares with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), "stage_" + name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
