"""Mixing sources to target weights: iterative proportional fitting, then sampling by calibrated probabilities.

Documents are summed to cells of their dimensions (source, language, topic).  Raking scales the cells'
token weights to each marginal in turn until all hold.  A cell's factor, scaled to the token budget, is the
probability with which each of its documents is taken; probabilities stop at one, and the rest of the
budget is shared out again.

The cells stay in Spark.  Each step is one sum by a dimension; only marginal totals, one for each value
that has a target, come back, and factors go out as columns.  Taking is a hash of the id against the
probability: no shuffle, no collected group, however large a source is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.common import saved

ROUNDS = 50
TOLERANCE = 1e-4
PROBABILITY = "__mix_probability"
NULL = "\x00null"  # stands for a null value of a dimension


def topic_of(text: Column) -> Column:
    """A coarse topic from the whole text: notices of rights, tables, figures, marks, or prose.

    The first that holds is taken; a text without characters is prose.
    """
    t = F.coalesce(text, F.lit(""))
    n = F.length(t)
    many = lambda pattern, share: F.regexp_count(t, F.lit(pattern)) > n * share
    return (
        F.when(t.rlike(r"(?i)\b(licen[cs]ed?|copyright|all rights reserved)\b"), "rights").when(many(r"\|", 0.02), "table")
        .when(many("[0-9]", 0.05), "figures").when(many(r"[#*$%&!<>{}]", 0.02), "marks").otherwise("prose")
    )


def dimension(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(NULL))


def cells_of(rows: DataFrame, dims: list[str], tokens: str) -> DataFrame:
    """One row for each combination of values that occurs: its tokens and documents, from partial sums."""
    return saved(rows.groupBy(*dims).agg(F.sum(tokens).cast("double").alias("tokens"), F.count("*").alias("n_docs")), "mix_cells")


def tempered(cells: DataFrame, dim: str, exponent: float) -> dict[str, float]:
    """Target shares proportional to the natural shares to a power below 1: small values gain, large ones lose."""
    rows = cells.groupBy(dim).agg(F.sum("tokens").alias("t")).filter("t > 0").collect()
    weights = {r[dim]: r["t"] ** exponent for r in rows}
    total = sum(weights.values())
    return {k: v / total for k, v in weights.items()}


def _lookup(dim: str, factors: dict[str, float]) -> Column:
    """Factor of a row's value; values without one keep their natural weight."""
    if not factors:
        return F.lit(1.0)
    table = F.create_map(*[x for k, v in sorted(factors.items()) for x in (F.lit(k), F.lit(float(v)))])
    return F.coalesce(F.element_at(table, F.col(dim)), F.lit(1.0))


@dataclass
class Mix:
    factors: dict[str, dict[str, float]]  # by dimension and value
    scale: float  # from relative weights to probabilities
    rounds: int
    error: float  # largest deviation of a marginal share from its target

    def weight(self) -> Column:
        """Calibrated weight of a token relative to its natural weight."""
        w = F.lit(1.0)
        for dim, f in self.factors.items():
            w = w * _lookup(dim, f)
        return w

    def probability(self) -> Column:
        return F.least(F.lit(1.0), self.weight() * F.lit(self.scale))


def rake(cells: DataFrame, targets: dict[str, dict[str, float]], budget: float, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> Mix:
    """Factors that bring the cells' marginal token shares to the targets, and the scale for a token budget.

    Targets of values that do not occur are left out and the others scaled up; values without a target keep
    their share of the whole.  Where cells are missing the targets may contradict each other; the rounds then
    end at their limit and ``error`` tells what is left.  No tokens at all give factors of one.
    """
    total = cells.agg(F.sum("tokens").alias("t")).first()["t"] or 0.0
    mix = Mix({d: {} for d in targets}, 0.0, 0, 0.0)
    if total <= 0:
        return mix
    goal: dict[str, dict[str, float]] = {}
    for d, shares in targets.items():
        held = {r[d]: r["t"] for r in cells.filter(F.col(d).isin(list(shares))).groupBy(d).agg(F.sum("tokens").alias("t")).filter("t > 0").collect()}
        wanted = {v: s for v, s in shares.items() if v in held and s >= 0}
        free = sum(held.values())  # tokens of the values with targets; the others keep theirs
        goal[d] = {v: free * s / sum(wanted.values()) for v, s in wanted.items()} if sum(wanted.values()) > 0 else {}
        mix.factors[d] = dict.fromkeys(goal[d], 1.0)
    for mix.rounds in range(1, rounds + 1):
        mix.error = 0.0
        for d, g in goal.items():
            if not g:
                continue
            now = cells.filter(F.col(d).isin(list(g))).groupBy(d).agg(F.sum(F.col("tokens") * mix.weight()).alias("t")).collect()
            for r in now:
                mix.error = max(mix.error, abs(r["t"] - g[r[d]]) / total)
                mix.factors[d][r[d]] *= g[r[d]] / r["t"] if r["t"] > 0 else 1.0
        if mix.error <= tolerance:
            break
    mix.scale = _scale(cells, mix.weight(), min(budget, total))
    return mix


def _scale(cells: DataFrame, weight: Column, budget: float) -> float:
    """The scale s for which the tokens times min(1, s * weight) sum to the budget; each step settles what is full."""
    s = budget
    weighed = cells.select("tokens", weight.alias("w"))
    first = weighed.agg(F.sum(F.col("tokens") * F.col("w")).alias("t")).first()["t"]
    s = budget / first if first else 0.0
    for _ in range(ROUNDS):
        full = F.col("w") * s >= 1
        r = weighed.agg(F.sum(F.when(full, F.col("tokens"))).alias("full"), F.sum(F.when(~full, F.col("tokens") * F.col("w"))).alias("rest")).first()
        if not r["rest"]:
            break
        new = (budget - (r["full"] or 0.0)) / r["rest"]
        if new <= s * (1 + 1e-9):
            break
        s = new
    return s


def chosen(doc_id: Column, probability: Column, seed: int = 0) -> Column:
    """Whether a document is taken: its place in [0, 1), a hash of its id, lies below its probability."""
    return F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(1 << 40)) / float(1 << 40) < probability


def with_dimensions(docs: DataFrame, tokens: Column, topic: Column | None = None) -> DataFrame:
    """doc_id, source, lang, topic and n_tokens of every document; null source and language are values of their own."""
    return docs.select(
        "doc_id", dimension(F.col("source")).alias("source"), dimension(F.col("lang")).alias("lang"),
        (topic if topic is not None else topic_of(F.col("text"))).alias("topic"), tokens.cast("long").alias("n_tokens"),
    )


def fit_mix(rows: DataFrame, budget_share: float, exponent: float, targets: dict[str, dict[str, float]] | None = None) -> Mix:
    """Rake rows with dimensions to given targets, or to tempered shares of all three dimensions."""
    cells = cells_of(rows, ["source", "lang", "topic"], "n_tokens")
    targets = targets or {d: tempered(cells, d, exponent) for d in ("source", "lang", "topic")}
    total = cells.agg(F.sum("tokens").alias("t")).first()["t"] or 0.0
    return rake(cells, targets, budget_share * total)


def mix_documents(rows: DataFrame, mix: Mix, seed: int = 0) -> DataFrame:
    """Add ``weight``, ``probability`` and ``taken`` to rows with dimensions.

    Each row is decided by its id alone, so repeated rows are decided alike, and so are all rows without an
    id.  Documents without tokens have their cell's probability.  An empty table stays empty.
    """
    return rows.withColumns({"weight": mix.weight(), "probability": mix.probability()}).withColumn(
        "taken", chosen(F.col("doc_id"), F.col("probability"), seed)
    )
