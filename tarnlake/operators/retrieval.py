"""Batch retrieval: dense and BM25 top-k, document lookup and result texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.functions.text import TOKEN_PATTERN
from tarnlake.operators.ranks import gather, top_rows
from tarnlake.session import durable

CELL_BYTES = 32 << 20  # vectors of one block
PRODUCT = 8 << 20  # scores that a task holds at once
SPREAD = 8  # pieces of work that a small input is cut into
TASKS = 20_000  # at most, of one step
SEGMENT_TOKENS = 1 << 21  # of an index segment
DOCS = 50_000  # whose texts one task reads
QUERY_TERMS = 1 << 18  # (query, term) pairs of a block of queries
WANTED_BYTES = 32 << 20  # query terms that are broadcast


def normalised(vec: Column) -> Column:
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(vec, lambda x: x.cast("double") / norm)


def pooled(df: DataFrame, key: list[str], vec: str, mask: Column | None = None) -> DataFrame:
    """Masked mean of the vectors of each key, dimension by dimension with partial sums."""
    rows = df if mask is None else df.filter(mask)
    dims = rows.select(*key, F.posexplode(vec).alias("_d", "_x"))
    means = dims.groupBy(*key, "_d").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    packed = F.transform(F.sort_array(F.collect_list(F.struct("_d", "_m"))), lambda s: s["_m"])
    return means.groupBy(*key).agg(packed.alias(vec))


def _blocks(n_bytes: int, rows: int, least_rows: int) -> int:
    """Blocks of about CELL_BYTES; a small table is still dealt over the cores, if it has rows enough."""
    return max(1, -(-n_bytes // CELL_BYTES), min(SPREAD, rows // least_rows))


def _best(scores, names, k: int):
    """Positions of the k best by score, then by smaller name; only what may be among them is sorted."""
    import numpy as np

    if len(scores) > k:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((names[near], -scores[near]))[:k]]


def _cells(left: DataFrame, right: DataFrame, cells: int):
    """Both sides by cell (i, j), a cell or more to a task."""
    n = min(cells, TASKS)
    return left.repartition(n, "i", "j").groupBy("i", "j").cogroup(right.repartition(n, "i", "j").groupBy("i", "j"))


def dense_top_k(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """k best inner products per query, for queries(query_id, vec) and corpus(doc_id, vec).

    Both sides are dealt by hash to blocks of bounded bytes, and a task owns a pair of blocks: one matrix
    product in pieces, of which the k best per query leave it.  Queries never pass the driver, and the corpus
    is read once (besides its row count) whatever the number of queries.
    """
    queries = durable(queries.select(F.col("query_id").cast("long").alias("query_id"), "vec"), "queries")
    width = queries.agg(F.max(F.size("vec")).alias("d"), F.count("*").alias("n")).first()
    size, n_queries, n_docs = 8 * max(1, width["d"] or 1), width["n"], corpus.count()
    left, right = _blocks(n_docs * size, n_docs, 256), _blocks(n_queries * size, 0, 1)
    docs = corpus.select(F.col("doc_id").cast("long").alias("doc_id"), "vec", F.pmod(F.xxhash64("doc_id", "vec"), F.lit(left)).cast("int").alias("i"))
    docs = docs.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(right - 1))))
    asked = queries.withColumns({"j": F.pmod(F.xxhash64("query_id", "vec"), F.lit(right)).cast("int"), "i": F.explode(F.sequence(F.lit(0), F.lit(left - 1)))})

    def score(docs, asked):
        import numpy as np
        import pyarrow as pa

        found = []
        if docs.num_rows and asked.num_rows:
            names, ids = docs["doc_id"].to_numpy(), asked["query_id"].to_numpy()
            v = docs["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(len(names), -1).T
            q = asked["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(len(ids), -1)
            step = max(1, PRODUCT // len(names))
            for at in range(0, len(ids), step):
                for one, s in zip(ids[at : at + step], q[at : at + step] @ v):
                    best = _best(s, names, k)
                    found.append((np.full(len(best), one), names[best], s[best]))
        out = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0)] * 3
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "doc_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    hits = _cells(docs, asked, left * right).applyInArrow(score, "query_id long, doc_id long, score double")
    return top_rows(hits, ["query_id"], [F.col("score").desc(), F.col("doc_id")], k, "rank_no")


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))


INDEX = (
    "first long, n_docs long, n_texts long, n_tokens long, terms array<string>, counts array<int>, docs array<long>, lengths array<int>, "
    "posted array<int>, freqs array<int>"
)


def inverted(corpus: DataFrame, wanted: frozenset | None, tokens: int = SEGMENT_TOKENS) -> DataFrame:
    """Segments of an inverted index for corpus(doc_id, text), each over documents with about ``tokens`` tokens.

    A text is tokenised once, by the pattern of ``terms``.  ``posted`` holds the places in ``docs`` of each
    term's documents, term after term as ``counts`` says, ``freqs`` the occurrences.  With ``wanted`` only
    these terms are posted; lengths and totals are of whole texts.
    """
    def build(batches):
        from collections import Counter

        import pyarrow as pa
        import regex

        # the same tokens as in ``terms``: Java's \\s is ASCII white space
        token = regex.compile(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_ \t\n\x0B\f\r]")

        def segment():
            posts: dict = {}
            for place, (_, own) in enumerate(held):
                for t, f in own.items():
                    posts.setdefault(t, []).append((place, f))
            flat = [x for t in posts for x in posts[t]]
            row = {
                "first": [held[0][0] if held else 0], "n_docs": [docs], "n_texts": [texts], "n_tokens": [sum(lengths)], "terms": [list(posts)],
                "counts": [[len(x) for x in posts.values()]], "docs": [[i for i, _ in held]], "lengths": [lengths],
                "posted": [[p for p, _ in flat]], "freqs": [[f for _, f in flat]],
            }
            ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
            kinds = [pa.int64()] * 4 + [pa.list_(pa.string()), ints, longs, ints, ints, ints]
            return pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(row.values(), kinds)], list(row))

        held, lengths, docs, texts, size = [], [], 0, 0, 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                docs += 1
                if not text.is_valid:
                    continue
                found = token.findall(text.as_py().lower())
                own = Counter(found if wanted is None else filter(wanted.__contains__, found))
                texts, size = texts + 1, size + len(found)
                held.append((doc, own))
                lengths.append(len(found))
                if size >= tokens:
                    yield segment()
                    held, lengths, docs, texts, size = [], [], 0, 0, 0
        if docs:
            yield segment()

    return corpus.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(build, INDEX)


class _Postings:
    """One segment: each term's documents by falling impact, so that the first impact bounds the list, and by place."""

    def __init__(self, row: dict, average: float, k1: float, b: float):
        import numpy as np

        self.docs = row["docs"]
        self.at = {t: i for i, t in enumerate(row["terms"])}
        self.ends = np.concatenate([[0], np.cumsum(row["counts"])]).astype("int64")
        self.places, f = row["posted"], row["freqs"].astype("float64")
        self.impacts = f / (f + k1 * (1 - b + b * row["lengths"][self.places] / average))
        order = np.lexsort((-self.impacts, np.repeat(np.arange(len(self.at)), row["counts"])))
        self.falling = self.places[order], -self.impacts[order]

    def scores(self, asked: list, least: float):
        """(places, scores) of all documents that reach ``least``; a score below it may be too low.

        A document of a list's tail, which stays below ``least`` with all other terms at their bounds, is
        skipped.  Lists are taken by falling bound; once those that remain cannot lift a document to ``least``
        together they bring no new one, and are looked up for the documents that they can still lift.
        """
        import numpy as np

        found = [(i, w) for t, w in asked if (i := self.at.get(t)) is not None]
        none = np.zeros(0, "int64"), np.zeros(0)
        if not found:
            return none
        ids, w = np.array([i for i, _ in found]), np.array([w for _, w in found])
        places, fallen = self.falling
        bound = -w * fallen[self.ends[ids]]
        order = np.argsort(-bound, kind="stable")
        ids, w, bound = ids[order], w[order], bound[order]
        rest = np.append(np.cumsum(bound[::-1])[::-1], 0.0)
        if rest[0] < least:
            return none
        new, many = [], int((rest[:-1] >= least).sum())
        for i, f, own in zip(ids[:many], w[:many], bound[:many]):
            a, b = self.ends[i], self.ends[i + 1]
            if least > rest[0] - own:
                b = a + np.searchsorted(fallen[a:b], -(least - rest[0] + own) / f, side="right")
            new.append((places[a:b], -f * fallen[a:b]))
        total = np.bincount(np.concatenate([x for x, _ in new]), np.concatenate([x for _, x in new]), len(self.docs))
        met = np.flatnonzero(total)
        for n in range(many, len(ids)):
            met = met[total[met] + rest[n] >= least]
            a, b = self.ends[ids[n]], self.ends[ids[n] + 1]
            own = self.places[a:b]
            at = np.minimum(np.searchsorted(own, met), len(own) - 1)
            hit = own[at] == met
            total[met[hit]] += w[n] * self.impacts[a:b][at[hit]]
        return met, total[met]


def bm25_top_k(queries: DataFrame, corpus: DataFrame, k: int, k1: float = 0.9, b: float = 0.4) -> DataFrame:
    """k best Okapi BM25 scores per query, for queries(query_id, text) and corpus(doc_id, text).

    The corpus becomes an inverted index in segments, once.  Blocks of queries meet lanes of segments, and a
    task owns one such pair: it keeps the k best of each query, whose last score is the bar for the segments
    after it, and sends k rows per query on.  Query terms are broadcast to the indexing only up to a checked
    number of bytes; beyond it all terms are posted.
    """
    q = queries.select(F.col("query_id").cast("long").alias("query_id"), F.explode(terms(F.col("text"))).alias("term"))
    q = durable(q.groupBy("query_id", "term").agg(F.count("*").alias("qtf")), "query_terms")
    distinct = q.select("term").distinct()
    size = distinct.agg(F.coalesce(F.sum(F.octet_length("term") + 64), F.lit(0)).alias("b")).first()["b"]
    wanted = frozenset(r["term"] for r in distinct.collect()) if size <= WANTED_BYTES else None
    # reading a text costs some ten times what moving it does, so row groups of any size are evened out first
    dealt = corpus.select("doc_id", "text").repartition(max(SPREAD, corpus.count() // DOCS), "doc_id")
    index = durable(inverted(dealt, wanted), "inverted_index")
    whole = index.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_docs", "n_texts", "n_tokens")], F.count("*").alias("segments")).first()
    average = whole["n_tokens"] / max(1, whole["n_texts"]) or 1.0

    held = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.counts").alias("df"))
    weight = F.log(1 + (F.lit(whole["n_docs"]) - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("qtf")
    asked = q.join(held, "term").select("query_id", "term", weight.alias("w"))
    pairs = q.count()
    lanes, blocks = max(1, min(whole["segments"], max(SPREAD, whole["segments"] // 4))), max(1, -(-pairs // QUERY_TERMS))
    asked = asked.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("j")).agg(F.collect_list(F.struct("query_id", "term", "w")).alias("asked"))
    asked = asked.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    dealt = index.withColumns({"i": F.pmod(F.xxhash64("first", "n_tokens"), F.lit(lanes)).cast("int"), "j": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})

    def score(segments, blocks):
        import numpy as np
        import pyarrow as pa

        by_query: dict = {}
        for block in blocks["asked"].to_pylist():
            for x in block:
                by_query.setdefault(x["query_id"], []).append((x["term"], x["w"]))
        best: dict = {}
        for n in range(segments.num_rows if by_query else 0):
            row = {c: segments[c][n].values.to_numpy(zero_copy_only=False) for c in ("counts", "docs", "lengths", "posted", "freqs")}
            posts = _Postings({**row, "terms": segments["terms"][n].as_py()}, average, k1, b)
            for one, own in by_query.items():
                names, top = best.get(one, (np.zeros(0, "int64"), np.zeros(0)))
                # a margin for rounding: equal scores are put in order of documents
                least = top[-1] - 1e-8 if len(top) == k else 0.0
                met, found = posts.scores(own, least)
                keep = found >= least
                names, top = np.concatenate([names, posts.docs[met[keep]]]), np.concatenate([top, found[keep]])
                at = _best(np.round(top, 9), names, k)
                best[one] = (names[at], top[at])
        out = [(np.full(len(names), one), names, top) for one, (names, top) in best.items()]
        ids, names, top = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0)] * 3
        return pa.table({"query_id": pa.array(ids, pa.int64()), "doc_id": pa.array(names, pa.int64()), "score": pa.array(top, pa.float64())})

    hits = _cells(dealt, asked, lanes * blocks).applyInArrow(score, "query_id long, doc_id long, score double")
    return top_rows(hits, ["query_id"], [F.round("score", 9).desc(), F.col("doc_id")], k, "rank_no")


def short_of_hits(hits: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Queries with fewer than k hits."""
    n = hits.groupBy("query_id").agg(F.count("*").alias("hits"))
    return queries.select("query_id").join(n, "query_id", "left").withColumn("hits", F.coalesce("hits", F.lit(0))).filter(F.col("hits") < k)


def with_documents(hits: DataFrame, corpus: DataFrame) -> DataFrame:
    """Document rows of the hits; the rank keeps their order."""
    return hits.join(corpus, "doc_id")


def title_and_text(contents: Column) -> tuple[Column, Column]:
    """First line without quotes, and the rest."""
    title = F.regexp_replace(F.substring_index(contents, "\n", 1), '^"+|"+$', "")
    rest = F.when(F.contains(contents, F.lit("\n")), F.substring(contents, F.locate("\n", contents) + 1, F.length(contents))).otherwise("")
    return title, rest


def result_text(hits: DataFrame, query: str, rank: str, title: Column, text: Column) -> DataFrame:
    """'Doc i (Title: t)' blocks per query in rank order (k hits at most)."""
    block = F.concat(F.lit("Doc "), F.col(rank).cast("string"), F.lit(" (Title: "), title, F.lit(")\n"), text, F.lit("\n\n"))
    out = gather(hits.withColumn("_pos", F.col(rank) - 1), [query], "_pos", {"blocks": block})
    return out.select(query, F.array_join("blocks", "").alias("result"), F.size("blocks").cast("long").alias("hits"))
