"""Document fingerprints from closed syncmers of words.

A run of k words is an anchor if its smallest inner substring (here one word, by hash) is the first or
the last.  Whether a run is chosen depends on nothing outside of it, so two texts that share a passage
share its anchors wherever it stands, and their positions tell how the passages lie to each other.  The
record keeps all anchors with their positions; the fingerprint is a digest of them.  All steps are array
expressions on the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.functions.text import let
from tarnlake.llm.common import saved, words_of

K = 4
CELLS = 1024
BUCKET_BYTES = 8 << 20


def anchor_hashes(words: Column, k: int = K) -> Column:
    """Hash of each anchor in order of its position, null where the run of words is none.

    Words are compared by hash.  A text without a closed run, such as any of fewer than k words, has one
    anchor, all its words; a text without words has none.
    """
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def runs(h: Column) -> Column:
        def anchor(first, i):
            rest = [F.get(h, i + j) for j in range(1, k)]
            inner = rest[:-1]
            closed = F.least(first, rest[-1]) <= (F.least(*inner) if len(inner) > 1 else inner[0])
            return F.when(closed, F.xxhash64(first, *rest))

        whole = F.when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))
        closed = F.transform(F.slice(h, F.lit(1), F.greatest(F.size(h) - (k - 1), F.lit(0))), anchor)
        return let(closed, lambda c: F.when(F.exists(c, lambda x: x.isNotNull()), c).otherwise(whole))

    return let(hashes, runs)


def anchors(words: Column, k: int = K) -> Column:
    """Anchors as structs of hash and word position."""
    return F.filter(F.transform(anchor_hashes(words, k), lambda h, i: F.struct(h.alias("hash"), i.alias("pos"))), lambda a: a["hash"].isNotNull())


def first_places(a: Column) -> Column:
    """Anchors without repetitions, each at its first place, in order of their hashes."""
    return let(F.sort_array(a), lambda s: F.filter(s, lambda x, i: (i == 0) | (x["hash"] != F.get(s, i - 1)["hash"])))


def compared(a: Column, b: Column) -> Column:
    """How two texts lie to each other, from their ``first_places``: near, shared, shift and aligned.

    ``near`` is the Jaccard likeness of all anchors, ``shared`` their common number, ``shift`` the distance of
    places at which most of these agree and ``aligned`` how many do, as in ``passage_matches``; without a
    common anchor shift is null.  Two texts without words are alike (1), one and another text not at all (0).
    """
    def side(x: Column, n: int) -> Column:
        return F.transform(x, lambda y: F.struct(y["hash"].alias("hash"), F.lit(n).alias("side"), y["pos"].alias("pos")))

    def shifts(m: Column) -> Column:
        at = F.transform(m, lambda x, i: F.when(F.get(m, i + 1)["hash"] == x["hash"], F.get(m, i + 1)["pos"] - x["pos"]))
        return F.sort_array(F.array_compact(at))

    def run(acc: Column, x: Column) -> Column:
        n = F.when(acc["at"] == x, acc["n"] + 1).otherwise(F.lit(1))
        value = F.struct(n.alias("n"), (-F.abs(x)).alias("d"), x.alias("shift"))
        return F.struct(x.alias("at"), n.alias("n"), F.greatest(acc["best"], value).alias("best"))

    def result(d: Column) -> Column:
        none = F.lit(None).cast("int")
        empty = F.struct(none.alias("at"), F.lit(0).alias("n"), F.struct(F.lit(0).alias("n"), none.alias("d"), none.alias("shift")).alias("best"))
        best = F.aggregate(d, empty, run, lambda acc: acc["best"])
        union = F.size(a) + F.size(b) - F.size(d)
        near = F.when(union == 0, F.lit(1.0)).otherwise(F.size(d) / union)
        return let(best, lambda v: F.struct(near.alias("near"), F.size(d).alias("shared"), v["shift"].alias("shift"), v["n"].alias("aligned")))

    return let(F.sort_array(F.concat(side(a, 0), side(b, 1))), lambda m: let(shifts(m), result))


def as_text(a: Column) -> Column:
    """Digest of all anchors and their places; '' where there is none."""
    parts = F.transform(a, lambda x: F.concat_ws(":", F.hex(x["hash"]), x["pos"].cast("string")))
    return F.when(F.size(a) == 0, F.lit("")).otherwise(F.sha2(F.concat_ws(" ", parts), 256))


def passage_matches(docs: DataFrame, others: DataFrame, text: str = "text", k: int = K) -> DataFrame:
    """Pairs of documents of two tables with the shift at which most anchors agree, and how many do.

    Anchors that stand more than once in one text are matched by their first place.
    """
    def side(d: DataFrame, name: str) -> DataFrame:
        rows = d.select(F.col("doc_id").alias(name), F.explode(anchors(words_of(F.col(text)), k)).alias("_anchor"))
        return rows.groupBy(name, F.col("_anchor.hash").alias("hash")).agg(F.min("_anchor.pos").alias(f"{name}_pos"))

    met = side(docs, "a").join(side(others, "b"), "hash").groupBy("a", "b", (F.col("b_pos") - F.col("a_pos")).alias("shift")).agg(F.count("*").alias("n"))
    return met.groupBy("a", "b").agg(F.max(F.struct("n", (-F.abs("shift")).alias("d"), "shift")).alias("m"), F.sum("n").alias("shared")).select(
        "a", "b", F.col("m.shift").alias("shift"), F.col("m.n").alias("aligned"), "shared"
    )


def _bucketed(docs: DataFrame, bucket_bytes: int) -> DataFrame:
    """Add ``bucket``, ascending with doc_id and of about equal bytes: even cells of the id range, each cut by its bytes."""
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    bounds = docs.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).first()
    low, high = (bounds["a"] or 0), (bounds["z"] or 0)
    width = max(1.0, (high - low + 1) / CELLS)
    place = (F.col("doc_id").cast("double") - float(low)) / width  # never falls as the id grows
    cell = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(F.floor(place)).cast("long")
    sizes = docs.select(cell.alias("cell"), F.octet_length("text").alias("b")).groupBy("cell").agg(F.sum("b").alias("b"))
    # a row for each of at most CELLS + 1 cells
    parts = sizes.select("cell", F.greatest(F.lit(1), F.ceil(F.col("b") / bucket_bytes)).cast("long").alias("parts"))
    inside = F.floor((place - F.col("cell")) * F.col("parts"))
    return docs.withColumns({"cell": cell, "order_key": key}).join(F.broadcast(parts), "cell").withColumn(
        "bucket", F.struct(F.col("cell"), F.coalesce(inside, F.lit(0)).cast("long").alias("part"))
    ).drop("cell", "parts")


def with_next(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Documents (doc_id, text) with the text of the next one by ascending doc_id; the last is followed by the first.

    Rows are dealt by ranges of the id; the first rows of each range are also sent to the range before it.
    Null ids come first, and rows with equal ids follow each other by their text.
    """
    rows = _bucketed(docs, bucket_bytes)
    firsts = rows.groupBy("bucket").agg(F.min("order_key").alias("first"))
    firsts = saved(firsts, "range_firsts")
    # one row for each range, numbered by blocks of cells
    order = Window.orderBy("bucket")
    before = firsts.select(F.col("first"), F.lag("bucket").over(order).alias("before"), F.max("bucket").over(Window.partitionBy(F.lit(0))).alias("last"))
    before = before.select("first", F.coalesce("before", "last").alias("before"), F.col("before").isNull().alias("wraps"))
    sent = rows.join(before, F.col("order_key") == F.col("first"), "left")
    own = F.struct(F.col("bucket").alias("to"), F.lit(0).alias("turn"))
    copy = F.struct(F.col("before").alias("to"), F.when(F.col("wraps"), 2).otherwise(1).alias("turn"))
    sent = sent.select("doc_id", "text", "order_key", F.explode(F.when(F.col("first").isNull(), F.array(own)).otherwise(F.array(own, copy))).alias("x"))
    w = Window.partitionBy("x.to").orderBy("x.turn", "order_key", "text")
    out = sent.withColumn("next_text", F.lead("text").over(w)).filter("x.turn = 0")
    return out.select("doc_id", "text", "next_text")


def edited_text(text: Column, following: Column) -> Column:
    """The last quarter (rounded down) replaced by as many code points from the start of the following text, or all it has."""
    n = F.length(text)
    cut = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - cut), F.substring(following, F.lit(1), cut))


def fingerprint_pairs(docs: DataFrame, text: Column, k: int = K, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Each document's anchors and fingerprint, those of its edited text, and how it lies to that and to the next document.

    A null text is an empty one.  Without rows there are none; a single row is its own next one.  Equal
    texts have equal fingerprints; other columns are ignored.
    """
    base = docs.select("doc_id", F.coalesce(text, F.lit("")).alias("text"))
    pairs = with_next(base, bucket_bytes).withColumn("edited", edited_text(F.col("text"), F.col("next_text")))
    all_of = lambda c: anchors(words_of(F.col(c)), k)

    def record(a: Column, e: Column, n: Column) -> Column:
        own = first_places(a)
        return let(own, lambda o: F.struct(
            a.alias("anchors"), e.alias("edited_anchors"), as_text(a).alias("fingerprint"), as_text(e).alias("edited_fingerprint"),
            let(first_places(e), lambda b: compared(o, b)).alias("edited"), let(first_places(n), lambda b: compared(o, b)).alias("next"),
        ))

    made = let(F.struct(all_of("text").alias("a"), all_of("edited").alias("e"), all_of("next_text").alias("n")), lambda x: record(x["a"], x["e"], x["n"]))
    out = pairs.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), made.alias("r"))
    places = [F.col(f"r.{t}.{c}").alias(f"{t}_{c}") for t in ("edited", "next") for c in ("shared", "shift", "aligned")]
    return out.select(
        "doc_id", "n_chars", "edited_sha256", "r.fingerprint", "r.edited_fingerprint", F.col("r.edited.near").alias("near_edited"),
        F.col("r.next.near").alias("near_next"), *places, "r.anchors", "r.edited_anchors",
    )
