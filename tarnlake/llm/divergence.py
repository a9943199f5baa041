"""Divergence of the sources of a language from one another and from the whole, over a cube of cells.

Occurrences are counted per language, source and term; a language keeps the terms that enough of its
documents hold.  Sources and kept terms are dealt by hash to blocks of about 32 and 4,096.  A slice is what
one block of sources counts of one block of terms, so its size has a bound whatever the corpus is.  A task
owns a cell (source block, source block, term block): it gets the two slices, which are sent to all cells
they are part of, and adds up the differences of every pair of its sources over its terms.  These partial
sums are added along the term axis.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.llm.common import saved, text_batches

UNIT = 1_000_000_000  # shares are whole numbers of this part
ADDED = 5  # to every count
SOURCES, TERMS = 32, 4096  # of a block, on average
HELD = 300_000  # terms that a task counts before it sends them on


def term_table() -> bytes:
    """Byte map under which terms are what white space separates: A-Z in lower case, all that is no letter a blank.

    Every byte of a code point beyond ASCII is 0x80 or more, so the map holds for UTF-8.
    """
    return bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def counted_terms(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), n_docs.  ``docs``: lang, source, text, none of them null."""
    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from collections import Counter

        letters = term_table()
        groups: dict = {}

        def send():
            flat = [(g, t, n[t], d) for g, (n, seen) in groups.items() for t, d in seen.items()]
            names = [pa.array([g[i] for g, *_ in flat], pa.string()) for i in (0, 1)]
            terms = pa.array([t for _, t, _, _ in flat], pa.binary()).cast(pa.string())
            numbers = [pa.array([x[i] for x in flat], pa.int64()) for i in (2, 3)]
            return pa.RecordBatch.from_arrays([*names, terms, *numbers], ["lang", "source", "term", "n", "n_docs"])

        held = 0
        for batch in batches:
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang, source, text in zip(langs, sources, batch.column(2).cast(pa.binary())):
                own = Counter(text.as_py().translate(letters).split())
                if (lang, source) not in groups:
                    groups[lang, source] = (Counter(), Counter())
                n, seen = groups[lang, source]
                before = len(seen)
                n.update(own)
                seen.update(own.keys())
                held += len(seen) - before
                if held >= HELD:
                    yield send()
                    groups, held = {}, 0
        if held:
            yield send()

    rows = docs.select("lang", "source", "text").mapInArrow(count, "lang string, source string, term string, n long, n_docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def in_blocks(rows: DataFrame, value: str, size: int, block: str, number: str) -> DataFrame:
    """The values of each language dealt by hash to blocks of about ``size``, and numbered from 0 in each."""
    many = rows.groupBy("lang").agg(F.ceil(F.count("*") / size).cast("int").alias("_n"))
    dealt = rows.join(many, "lang").withColumn(block, F.pmod(F.xxhash64(value), F.col("_n")).cast("int")).drop("_n")
    # the join leaves rows dealt by language, which would do for the window, and put a language in one task
    return dealt.repartition("lang", block).withColumn(number, F.row_number().over(Window.partitionBy("lang", block).orderBy(value)) - 1)


def share(n: np.ndarray, total: np.ndarray, kept: int) -> np.ndarray:
    """p = 1 + floor(UNIT (n + 5) / (N + 5 V)), by long division in steps of a thousand: exact up to totals of 9e15."""
    a, b = n + ADDED, total + ADDED * kept
    q, r = a // b, a % b
    for _ in range(3):
        r = r * 1000
        q, r = q * 1000 + r // b, r % b
    return 1 + q


def _share(n: Column, total: Column, kept: Column) -> Column:
    whole = (n + ADDED).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return (F.lit(1) + F.call_function("div", whole, (total + kept * ADDED).cast("decimal(20,0)"))).cast("long")


def _cell(key, part):
    """Sum over the cell's terms of |p - q| for all pairs of sources of the two blocks, row by row."""
    import pyarrow as pa

    lang, i, j = key[0].as_py(), key[1].as_py(), key[2].as_py()
    tables = {}
    for row, counts in zip(part.drop_columns(["counts"]).to_pylist(), part["counts"]):
        n = np.zeros((len(row["totals"]), row["n_terms"]), np.int64)
        if counts.is_valid:
            number, place, held = (counts.values.field(c).to_numpy() for c in ("number", "place", "n"))
            n[number, place] = held
        tables[row["block"]] = share(n, np.array(row["totals"], np.int64)[:, None], row["kept"])
    x, y = tables[i], tables[j]
    sums = np.stack([np.abs(y - p).sum(axis=1) for p in x])
    return pa.table({"lang": [lang], "i": pa.array([i], pa.int32()), "j": pa.array([j], pa.int32()), "sums": pa.array([sums.ravel().tolist()], pa.list_(pa.int64()))})


def source_divergence(docs: DataFrame, lang: Column, source: Column, text: Column, least_docs: int = 30, ranks: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank.

    Null languages, sources and texts count as empty ones.  Every (lang, source) that occurs has one ``pair``
    row per other source of its language (value 0 if the language keeps no term), and up to ``ranks`` ``term``
    rows: kept terms that it holds with a share above the language's.  Ranks run from 1 by falling value and
    rising item in order of bytes.  Every row is a document of its own, repeated ones too.  An empty table
    gives no rows; other columns are ignored.
    """
    text_batches(docs.sparkSession)
    rows = docs.select(*[F.coalesce(c.cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    counted = saved(counted_terms(rows), "counted_terms")
    words = counted.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("n_docs").alias("d")).filter(F.col("d") >= least_docs).drop("d")
    kept = saved(in_blocks(words, "term", TERMS, "term_block", "place"), "kept_terms")
    counts = saved(counted.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n", "term_block", "place"), "kept_counts")

    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "kept", "lang_total")])
    groups = saved(in_blocks(groups, "source", SOURCES, "block", "number"), "divergence_groups")

    pairs = _pairs(groups, kept, counts)
    over = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(over))

    facts = groups.select("lang", "source", "total", "kept", "lang_total")
    held = counts.filter("n > 0").join(facts, ["lang", "source"])
    p = held.select(
        "lang", "source", F.col("term").alias("item"), _share(F.col("n"), F.col("total"), F.col("kept")).alias("p"),
        _share(F.col("lang_n"), F.col("lang_total"), F.col("kept")).alias("q"),
    ).filter("p > q")
    terms = p.select("lang", "source", F.lit("term").alias("part"), "item", (F.col("p") - F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(over)).filter(F.col("rank") <= ranks)
    return pairs.unionByName(terms)


def _pairs(groups: DataFrame, kept: DataFrame, counts: DataFrame) -> DataFrame:
    """lang, source, item, value of all ordered pairs of two sources of a language."""
    blocks = groups.groupBy("lang", "block").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("number", "total"))), lambda g: g["total"]).alias("totals"), F.first("kept").alias("kept"))
    sizes = kept.groupBy("lang", "term_block").agg(F.count("*").cast("int").alias("n_terms"))
    # a language without kept terms still has one cell per pair of blocks, with no term in it
    frames = blocks.join(sizes, "lang", "left").fillna(0, ["term_block", "n_terms"])
    packed = counts.join(groups.select("lang", "source", "block", "number"), ["lang", "source"]).groupBy("lang", "block", "term_block").agg(
        F.collect_list(F.struct("number", "place", "n")).alias("counts"))
    slices = saved(frames.join(packed, ["lang", "block", "term_block"], "left"), "slices")

    many = groups.groupBy("lang").agg((F.max("block") + 1).alias("n_blocks"))
    sent = slices.join(many, "lang").withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    sent = sent.withColumns({"i": F.least("block", "o"), "j": F.greatest("block", "o")}).drop("n_blocks", "o")
    cells = sent.groupBy("lang", "i", "j", "term_block").applyInArrow(_cell, "lang string, i int, j int, sums array<long>")
    sums = cells.select("lang", "i", "j", F.posexplode("sums").alias("at", "value")).groupBy("lang", "i", "j", "at").agg(F.sum("value").alias("value"))

    size = groups.groupBy("lang", "block").agg(F.count("*").alias("m"))
    sums = sums.join(size.withColumnRenamed("block", "j"), ["lang", "j"])
    sums = sums.select("lang", "i", "j", F.expr("cast(at div m as int)").alias("a"), F.expr("cast(at % m as int)").alias("b"), "value")
    sums = saved(sums, "pair_sums")
    ends = F.array(F.struct("i", "a", F.col("j").alias("k"), F.col("b").alias("c")), F.struct(F.col("j").alias("i"), F.col("b").alias("a"), F.col("i").alias("k"), F.col("a").alias("c")))
    # a cell of one block with itself has both directions already
    both = sums.filter("i < j").select("lang", "value", F.inline(ends)).unionByName(
        sums.filter("i = j AND a != b").select("lang", "value", "i", "a", F.col("j").alias("k"), F.col("b").alias("c")))
    name = groups.select("lang", "block", "number", "source")
    first = name.select("lang", F.col("block").alias("i"), F.col("number").alias("a"), "source")
    other = name.select("lang", F.col("block").alias("k"), F.col("number").alias("c"), F.col("source").alias("item"))
    return both.join(first, ["lang", "i", "a"]).join(other, ["lang", "k", "c"]).select("lang", "source", "item", "value")
