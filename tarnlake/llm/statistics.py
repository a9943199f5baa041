"""Statistics of whole texts as built-in column expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.functions.text import let
from tarnlake.llm.common import SPACE_CLASS, WORD_PATTERN, words_of

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RATES = [
    "mean_word_chars", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "exclaim_rate", "pipe_rate", "digit_rate",
    "distinct_rate", "words_per_line",
]
_T, _W, _L, _H = "__stat_text", "__stat_words", "__stat_lines", "__stat_windows"


def _covered(hashes: Column) -> Column:
    """Number of words in three-word windows whose hash occurs twice or more.

    Windows are sorted by hash, equal neighbours are marked, and the marked positions put back in order:
    each covers the words up to the next marked one, three at most.
    """
    by_hash = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    twice = lambda s: F.filter(F.transform(s, lambda x, i: F.when((x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]), x["p"])), lambda p: p.isNotNull())
    total = lambda q: F.aggregate(F.transform(q, lambda p, i: F.least(F.lit(3), F.get(q, i + 1) - p)), F.lit(0), lambda a, b: a + b)
    return let(by_hash, lambda s: let(F.sort_array(twice(s)), total))


def _rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def fence(df: DataFrame) -> DataFrame:
    """Keep later filters above this point: pushed below, they would repeat the statistics' expressions many times over."""
    return df.observe(f"statistics-{uuid.uuid4().hex}", F.count(F.lit(1)).alias("rows"))


def with_statistics(docs: DataFrame, text: Column, rates: bool = True) -> DataFrame:
    """Add the counts in BASE (long) and, if asked for, the rates in RATES (double).

    A null text counts as empty: all counts and rates are 0.  Every row is treated on its own, so ties,
    repeated rows and other columns play no part.  Columns of the same names are replaced.
    """
    d = docs.withColumn(_T, F.coalesce(text, F.lit("")))
    d = d.withColumns({_W: words_of(F.col(_T)), _L: F.filter(F.split(_T, "\n"), lambda x: x.rlike(WORD_PATTERN))})
    triple = lambda w, i: F.xxhash64(w, F.get(F.col(_W), i + 1), F.get(F.col(_W), i + 2))
    d = d.withColumn(_H, F.transform(F.slice(_W, F.lit(1), F.greatest(F.size(_W) - 2, F.lit(0))), triple))
    counts = {
        "n_words": F.size(_W), "word_chars": F.length(F.regexp_replace(_T, f"{SPACE_CLASS}+", "")),
        "n_symbols": F.regexp_count(_T, F.lit("[#*$%&|<>]")), "n_dup_lines": F.size(_L) - F.size(F.array_distinct(_L)),
        "n_repeat_words": F.when(F.size(F.array_distinct(_H)) == F.size(_H), F.lit(0)).otherwise(_covered(F.col(_H))),
    }
    if rates:
        counts |= {
            "__upper": F.regexp_count(_T, F.lit(r"\p{Lu}")), "__exclaim": F.regexp_count(_T, F.lit("!")), "__pipe": F.regexp_count(_T, F.lit(r"\|")),
            "__digit": F.regexp_count(_T, F.lit("[0-9]")), "__distinct": F.size(F.array_distinct(_W)), "__lines": F.size(_L),
        }
    d = d.withColumns({k: c.cast("long") for k, c in counts.items()}).drop(_T, _W, _L, _H)
    if not rates:
        return fence(d)
    n, chars, lines = F.col("n_words"), F.col("word_chars"), F.col("__lines")
    d = d.withColumns({
        "mean_word_chars": _rate(chars, n), "symbol_rate": _rate(F.col("n_symbols"), chars), "dup_line_rate": _rate(F.col("n_dup_lines"), lines),
        "repeat_rate": _rate(F.col("n_repeat_words"), n), "upper_rate": _rate(F.col("__upper"), chars), "exclaim_rate": _rate(F.col("__exclaim"), chars),
        "pipe_rate": _rate(F.col("__pipe"), chars), "digit_rate": _rate(F.col("__digit"), chars), "distinct_rate": _rate(F.col("__distinct"), n),
        "words_per_line": _rate(n, lines),
    })
    return fence(d.drop("__upper", "__exclaim", "__pipe", "__digit", "__distinct", "__lines"))
