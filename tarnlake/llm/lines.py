"""Lines that several documents share, found by two Bloom filters of once-seen and twice-seen hashes.

Hashes of lines are dealt to segments of the hash space, each with two filters of its own: a hash that is
already in the first goes into the second.  Segments are of equal size, so the filters grow with the lines
and no task holds more than one segment's.  A hash counts once per document, and a task sends no hash more
than twice, so a line that stands everywhere does not fill its segment.

The second filter says of every line whether it may be repeated; it never misses one that is.  Documents
without such a line are done.  Of the others the suspected lines alone are gathered, by their 256-bit digest,
which confirms the repeats and names the smallest document that holds each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.common import saved, text_batches
from tarnlake.llm.words import mix

SEGMENT_LINES = 1 << 17
ONCE_BITS, TWICE_BITS = 8 * SEGMENT_LINES, 4 * SEGMENT_LINES
FLUSH = 1 << 20  # hashes that a task holds before it sends them
FILTER_LIMIT = 1 << 27  # bytes of the second filter up to which every task gets all of it
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"  # fixed values
LAST = (1 << 63) - 1  # stands for the id of rows that have none


def keys_of(text: bytes, shortest: int) -> Iterator:
    """(line, digest of its key or None if the key is short) of each line of a text."""
    for line in text.split(b"\n"):
        key = line.strip(SPACE).lower()
        # a code point takes four bytes at most
        long = len(key) >= shortest and (len(key) >= 4 * shortest or key.isascii() or len(key.decode("utf-8", "replace")) >= shortest)
        yield line, hashlib.sha256(key).digest() if long else None


def places(hashes: np.ndarray, bits: int):
    """Two positions in a segment's filter, from values of their own: the hash itself names the segment."""
    a = mix(hashes)
    return (a % np.uint64(bits)).astype(np.int64), (mix(a) % np.uint64(bits)).astype(np.int64)


def _texts(batch):
    """Bytes of the texts of a batch, null as empty, one at a time."""
    import pyarrow as pa

    return (v.as_py() or b"" for v in batch.column(1).cast(pa.binary()))


def _short(digests) -> np.ndarray:
    """The hash of each digest: its first eight bytes."""
    return np.frombuffer(b"".join(d[:8] for d in digests), np.uint64)


def twice_seen(docs: DataFrame, segments: int, shortest: int) -> DataFrame:
    """segment, bits: the second filter of each segment that has one set.  ``docs``: _doc, text."""
    def send(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def packed(held):
            values, n = np.unique(np.concatenate(held), return_counts=True)
            values = np.concatenate([values, values[n > 1]])
            part = (values % np.uint64(segments)).astype(np.int64)
            values = values[at := np.argsort(part, kind="stable")]
            numbers, first = np.unique(part[at], return_index=True)
            ends = np.append(first[1:], len(values))
            return pa.RecordBatch.from_arrays(
                [pa.array(numbers), pa.array([values[a:b].tobytes() for a, b in zip(first, ends)], pa.binary())], ["segment", "hashes"])

        held, size = [], 0
        for batch in batches:
            for text in _texts(batch):
                own = {d for _, d in keys_of(text, shortest) if d}
                if own:
                    held.append(_short(own))
                    size += len(own)
                if size >= FLUSH:
                    yield packed(held)
                    held, size = [], 0
        if held:
            yield packed(held)

    def sift(batches: Iterator) -> Iterator:
        import pyarrow as pa

        now, once, twice = None, None, None

        def row():
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([np.packbits(twice, bitorder="little").tobytes()], pa.binary())], ["segment", "bits"])

        for batch in batches:
            for segment, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                if segment != now:
                    if now is not None and twice.any():
                        yield row()
                    now, once, twice = segment, np.zeros(ONCE_BITS, bool), np.zeros(TWICE_BITS, bool)
                values, n = np.unique(np.frombuffer(packed.as_buffer(), np.uint64), return_counts=True)
                a, b = places(values, ONCE_BITS)
                again = values[once[a] & once[b] | (n > 1)]
                once[a] = once[b] = True
                a, b = places(again, TWICE_BITS)
                twice[a] = twice[b] = True
        if now is not None and twice.any():
            yield row()

    sent = docs.select("_doc", "text").mapInArrow(send, "segment long, hashes binary")
    return sent.repartition("segment").sortWithinPartitions("segment").mapInArrow(sift, "segment long, bits binary")


def _suspected(digests: list, bits: np.ndarray, rows: np.ndarray | None) -> np.ndarray:
    """Which digests the second filter holds.  ``rows``: the filter's row of each segment (-1: none)."""
    h = _short(digests)
    row = rows[(h % np.uint64(len(rows))).astype(np.int64)] if rows is not None else np.zeros(len(h), np.int64)
    a, b = places(h, TWICE_BITS)
    byte = lambda x: bits[np.maximum(row, 0), x >> 3] >> (x & 7).astype(np.uint8) & 1
    return (row >= 0) & (byte(a) & byte(b) == 1)


PROBED = "doc_id long, _doc long, n_lines long, kept_sha256 string, text string, suspects array<binary>"


def _probe_with_all(docs: DataFrame, found: DataFrame, segments: int, shortest: int, texts: bool) -> DataFrame:
    """Documents without a suspected line with their result, the others (or all, if ``texts``) with their text."""
    table = found.toArrow()
    rows = np.full(segments, -1, np.int64)
    rows[table["segment"].to_numpy()] = np.arange(len(table))
    bits = np.frombuffer(b"".join(x.as_py() for x in table["bits"]) or bytes(TWICE_BITS >> 3), np.uint8).reshape(-1, TWICE_BITS >> 3)
    shared = docs.sparkSession.sparkContext.broadcast((bits, rows))

    def probe(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bits, rows = shared.value
        for batch in batches:
            lines, digests, owners = [], [], []
            for i, text in enumerate(_texts(batch)):
                keys = list(keys_of(text, shortest))
                lines.append(len(keys))
                own = {d for _, d in keys if d}
                digests.extend(own)
                owners.extend([i] * len(own))
            suspects: list = [None] * len(lines)
            if digests:
                for k in np.flatnonzero(_suspected(digests, bits, rows)):
                    suspects[owners[k]] = (suspects[owners[k]] or []) + [digests[k]]
            done = [s is None for s in suspects]
            whole = [hashlib.sha256(t).hexdigest() if d else None for t, d in zip(_texts(batch), done)]
            held = pa.array([t if texts or not d else None for t, d in zip(_texts(batch), done)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(2), batch.column(0), pa.array(lines, pa.int64()), pa.array(whole, pa.string()), held, pa.array(suspects, pa.list_(pa.binary()))],
                ["doc_id", "_doc", "n_lines", "kept_sha256", "text", "suspects"])

    return docs.select("_doc", "text", "doc_id").mapInArrow(probe, PROBED)


def _probe_by_segment(docs: DataFrame, found: DataFrame, segments: int, shortest: int, texts: bool) -> DataFrame:
    """The same by a join of the digests with their segment's filter, for filters that are too large to send to every task."""
    def send(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), _texts(batch)):
                own = sorted({d for _, d in keys_of(text, shortest) if d})
                part = (_short(own) % np.uint64(segments)).astype(np.int64) if own else []
                held: dict = {}
                for d, s in zip(own, part):
                    held.setdefault(int(s), []).append(d)
                out.extend((s, doc, x) for s, x in held.items())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.list_(pa.binary())))], ["segment", "_doc", "digests"])

    def probe(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            docs_, out = [], []
            for doc, digests, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                hit = _suspected(digests, np.frombuffer(packed.as_buffer(), np.uint8).reshape(1, -1), None)
                out.extend(d for d, h in zip(digests, hit) if h)
                docs_.extend([doc] * int(hit.sum()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(docs_, pa.int64()), pa.array(out, pa.binary())], ["_doc", "digest"])

    sent = docs.select("_doc", "text").mapInArrow(send, "segment long, _doc long, digests array<binary>")
    hits = sent.join(found, "segment").select("_doc", "digests", "bits").mapInArrow(probe, "_doc long, digest binary")
    lists = hits.groupBy("_doc").agg(F.collect_set("digest").alias("suspects"))
    text = F.coalesce("text", F.lit(""))
    joined = docs.join(lists, "_doc", "left")
    lines = (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    return joined.select(
        "doc_id", "_doc", lines.alias("n_lines"), F.when(F.col("suspects").isNull(), F.sha2(text, 256)).alias("kept_sha256"),
        F.when(F.col("suspects").isNotNull() | F.lit(texts), text).alias("text"), "suspects")


def drop_repeated_lines(docs: DataFrame, doc_id: Column, text: Column, shortest: int = 10, filter_limit: int = FILTER_LIMIT, texts: bool = False) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, kept_sha256 (and ``kept_text`` if ``texts``).

    A line's key is the line without white space at its ends, A-Z in lower case.  Keys of at least ``shortest``
    code points that two documents or more hold lose all their lines but in the one with the smallest id.

    A null or empty text is one empty line.  Rows that repeat an id are one document: what only they share
    stays in each, and what they hold first stays in all of them.  Rows without an id together count as one
    document after all others.  An empty table gives no rows.  Other columns are ignored.
    """
    spark = docs.sparkSession
    text_batches(spark)
    source = docs.select(doc_id.cast("long").alias("doc_id"), text.alias("text")).withColumn("_doc", F.coalesce("doc_id", F.lit(LAST)))
    count = source.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).alias("n")).first()["n"] or 0
    segments = max(1, -(-count // SEGMENT_LINES))
    found = saved(twice_seen(source, segments, shortest), "twice_seen")
    probe = _probe_with_all if segments * (TWICE_BITS >> 3) <= filter_limit else _probe_by_segment
    probed = saved(probe(source, found, segments, shortest, texts), "probed_lines")

    suspects = probed.filter(F.col("suspects").isNotNull()).select("_doc", F.explode("suspects").alias("digest"))
    repeated = suspects.groupBy("digest").agg(F.min("_doc").alias("first"), F.max("_doc").alias("last")).filter("first < last")
    gone = suspects.join(saved(repeated.select("digest", "first"), "repeated_lines"), "digest").filter("_doc > first")
    lists = saved(gone.groupBy("_doc").agg(F.collect_set("digest").alias("gone")), "lines_to_drop")

    def keep(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            dropped, names, kept = [], [], []
            for value, out in zip(_texts(batch), batch.column(2)):
                out = set(out.as_py() or ())
                lines = list(keys_of(value, shortest))
                rest = [line for line, d in lines if d not in out]
                whole = b"\n".join(rest)
                dropped.append(len(lines) - len(rest))
                names.append(hashlib.sha256(whole).hexdigest())
                kept.append(whole)
            columns = [batch.column(0), batch.column(3), pa.array(dropped, pa.int64()), pa.array(names, pa.string())]
            if texts:
                columns.append(pa.array(kept, pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_lines", "n_dropped", "kept_sha256", "kept_text"][: len(columns)])

    schema = "doc_id long, n_lines long, n_dropped long, kept_sha256 string" + (", kept_text string" if texts else "")
    rest = probed.filter(F.col("suspects").isNotNull()).join(lists, "_doc", "left").select("doc_id", "text", "gone", "n_lines").mapInArrow(keep, schema)
    done = probed.filter(F.col("suspects").isNull()).select(
        "doc_id", "n_lines", F.lit(0).cast("long").alias("n_dropped"), "kept_sha256", *([F.col("text").alias("kept_text")] if texts else []))
    return rest.unionByName(done)
