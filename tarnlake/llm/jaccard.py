"""Exact n-gram Jaccard join: size-banded tiles, bitmap bounds, exact intersection of sorted arrays.

Two shingle sets of a and b elements (a <= b) with J >= t differ in at most D(a) elements.  Sizes fall into
bands [2^i, 2^(i+1)); a set stands in its own band's scheme, and in the one below if sets of that band can
be similar to it.  A scheme deals shingles by hash to more than D parts, so two similar sets agree in some
part altogether: they meet in the tile named by that part's content.  A set enters the tiles of its first
D + 1 parts of two or more shingles (of one or more if it has too few of those, and in the end all parts);
that this suffices is shown at ``tiles_of``.  So tiles hold near-identical sets, not all that share a passage.

Equal sets are one class with one representative before anything is compared.  In a tile, the smallest
member is compared with all others first; what is linked then need not be compared again, and only tiles
that still hold several components compare members across components, those outside the largest one with
all, in blocks of bounded size, where bit counts of hashed bitmaps bound the overlap from above.  Survivors are intersected exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.common import saved, text_batches
from tarnlake.llm.words import SPACE, lower_table, mix, shingle_set, text_bytes, word_table, words_in

MEMBER_BITS = 8  # of the filter that spares the second reading most texts
BLOOM_LIMIT = 1 << 28  # bits up to which the filter is sent to the tasks; beyond that ids are joined
BLOCK_ROWS = 128
BITS_MIN, BITS_MAX = 64, 8192


def most_different(a: int, p: int, q: int) -> int:
    """D(a): elements in which a set of a and a similar one of a or more can differ, for J >= p / q."""
    return (a + a * q // p) * (q - p) // (p + q)


def parts_of(band: int, p: int, q: int) -> int:
    d = most_different((2 << band) - 1, p, q)
    return 1 if d == 0 else -(-13 * d // 10) + 2


def tiles_of(shingles: np.ndarray, p: int, q: int) -> np.ndarray:
    """Names of the tiles of a sorted shingle set.

    Let x and y differ in D elements at most, and order the parts.  A part in which they differ costs an
    element.  Of x's first D + 1 parts with s or more shingles, one is equal in y, hence one of y's with s or
    more.  If u of the parts before it are such in y but not in x, these cost u elements, so it is already
    among x's first D + 1 - u and among y's first D + 1.  If x has fewer such parts it enters all of them,
    which covers a y that has enough, and goes on at the next lower s, which covers a y that has too few too.
    """
    n = len(shingles)
    if n == 0 or most_different(n, p, q) == 0 and most_different(max(1, n - 1), p, q) == 0:
        return np.zeros(0, np.uint64)
    band = n.bit_length() - 1
    bands = [band]
    if band and n <= ((1 << band) - 1) * q // p:
        bands.append(band - 1)
    order, content = mix(shingles ^ np.uint64(0xA5A5A5A55A5A5A5A)), mix(shingles + np.uint64(0x51ED2701A8F36C27))
    out = []
    for b in bands:
        d = min(most_different(n, p, q), most_different((2 << b) - 1, p, q))
        if d == 0:
            continue
        k = parts_of(b, p, q)
        part = (order % np.uint64(k)).astype(np.int64)
        at = np.argsort(part, kind="stable")
        numbers, first = np.unique(part[at], return_index=True)
        sums = np.add.reduceat(content[at], first)
        sizes = np.diff(np.append(first, n))
        names = mix(sums ^ mix(numbers.astype(np.uint64) + np.uint64(k << 20) + np.uint64(b << 56)))
        several = np.flatnonzero(sizes > 1)
        if len(several) > d:
            out.append(names[several[: d + 1]])
        elif len(numbers) > d:
            out.append(np.union1d(names[several], names[: d + 1]))
        else:
            empty = np.setdiff1d(np.arange(k), numbers).astype(np.uint64)
            out.append(np.concatenate([names, mix(mix(empty + np.uint64(k << 20) + np.uint64(b << 56)))]))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def bitmap_of(shingles: np.ndarray) -> bytes:
    """A bit for each hash value that occurs; four to eight bits a shingle, within fixed limits."""
    n = len(shingles)
    bits = min(BITS_MAX, max(BITS_MIN, 1 << (4 * n - 1).bit_length()))
    m = np.zeros(bits, bool)
    m[(mix(shingles) % np.uint64(bits)).astype(np.int64)] = True
    return np.packbits(m, bitorder="little").tobytes()


def folded(bitmap: np.ndarray, size: int) -> np.ndarray:
    """The bitmap at a smaller size: hash values modulo that size."""
    return np.bitwise_or.reduce(bitmap.reshape(-1, size), axis=0)


def _signer(width: int, p: int, q: int):
    def sign(batches: Iterator) -> Iterator:
        import pyarrow as pa

        in_word, lower = word_table(SPACE), lower_table()
        for batch in batches:
            sizes, low, high, maps, tiles = [], [], [], [], []
            for value in batch.column(1):
                s = shingle_set(words_in(text_bytes(value), in_word, lower)[2], width)
                sizes.append(len(s))
                low.append(int(mix(s).sum(dtype=np.uint64).astype(np.int64)))
                high.append(int(mix(s * np.uint64(0x9FB21C651E98DF25) + np.uint64(1)).sum(dtype=np.uint64).astype(np.int64)))
                maps.append(bitmap_of(s))
                tiles.append(tiles_of(s, p, q).view(np.int64))
            at = np.cumsum([0, *map(len, tiles)])
            flat = pa.array(np.concatenate(tiles)) if tiles else pa.array([], pa.int64())
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(sizes, pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(maps, pa.binary()),
                pa.ListArray.from_arrays(pa.array(at, pa.int32()), flat),
            ], ["doc_id", "n_shingles", "set_low", "set_high", "bitmap", "tiles"])

    return sign


def _shingler(width: int, bloom):
    def shingles(batches: Iterator) -> Iterator:
        import pyarrow as pa

        in_word, lower, bits = word_table(SPACE), lower_table(), bloom.value
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            a, b = bloom_places(np.where(known, ids, 0).astype(np.int64), 8 * len(bits))
            has = lambda x: (bits[x >> 3] >> (x & 7)) & 1 == 1
            for rows in np.array_split(np.flatnonzero(has(a) & has(b) & known), max(1, len(ids) // 500)):
                sets = [shingle_set(words_in(text_bytes(batch.column(1)[int(i)]), in_word, lower)[2], width).tobytes() for i in rows]
                if sets:
                    yield pa.RecordBatch.from_arrays([pa.array(ids[rows].astype(np.int64)), pa.array(sets, pa.binary())], ["doc_id", "shingles"])

    return shingles


def bloom_places(ids: np.ndarray, bits: int):
    h = mix(ids.view(np.uint64))
    return (h % np.uint64(bits)).astype(np.int64), (mix(h) % np.uint64(bits)).astype(np.int64)


def _bloom(ids: DataFrame, bits: int):
    """Bits of all ids, gathered by the word."""
    def places(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            at = np.concatenate(bloom_places(batch.column(0).to_numpy().astype(np.int64), bits))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 5), pa.array(np.left_shift(np.int64(1), at & 31))], ["word", "bit"])

    words = ids.mapInArrow(places, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits >> 5, np.uint32)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)
    return ids.sparkSession.sparkContext.broadcast(out.view(np.uint8))


def _sets_of(source: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """doc_id, shingles of the members (and of a few others), from a second reading of the texts.

    The filter grows with the members; where it would be too large to send, the members are joined instead
    and it lets everything through.
    """
    bits = max(1 << 20, 1 << (MEMBER_BITS * members.count() - 1).bit_length())
    if bits > BLOOM_LIMIT:
        source, bits = source.join(members, "doc_id", "left_semi"), 0
    bloom = _bloom(members, bits) if bits else source.sparkSession.sparkContext.broadcast(np.full(1, 255, np.uint8))
    return source.mapInArrow(_shingler(width, bloom), "doc_id long, shingles binary")


def _verify(pairs: DataFrame, sets: DataFrame, p: int, q: int) -> DataFrame:
    """The pairs (a, b) whose sets have J >= p / q, by exact intersection of the sorted arrays."""
    def check(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([s, t])
                both.sort(kind="stable")
                n = int((both[1:] == both[:-1]).sum())
                if q * n >= p * (len(both) - n):
                    keep.append(i)
            if keep:
                yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(keep)) for k in (0, 1)], ["a", "b"])

    x = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a")
    y = x.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b").select("a", "b", "sa", "sb")
    return y.mapInArrow(check, "a long, b long")


def components(edges: DataFrame, name: str = "component") -> DataFrame:
    """(node, root): the smallest node that is reachable by edges (a, b); alternating large and small stars.

    Each step sends a node's neighbours to the smallest of them, found by a partial minimum, so a node
    with very many neighbours is no single task's work.
    """
    def large(e: DataFrame) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        m = saved(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), name)
        return both.filter("b > a").join(m, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        m = saved(down.groupBy("a").agg(F.min("b").alias("m")), name)
        moved = down.join(m, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.unionByName(m.select("a", F.col("m").alias("b"))).distinct()

    def state(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = saved(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    before = state(e)
    while before[0]:
        e = saved(small(large(e)), name)
        now = state(e)
        if now == before:
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _across(tiles: DataFrame, p: int, q: int) -> DataFrame:
    """Pairs (a, b) of members of one tile and different components that their bitmaps do not rule out.

    ``tiles``: tile, doc_id, component, n_shingles, bitmap.  The members of a tile's largest component need
    not meet one another, so each is sent once for every block of the others, and the others to all blocks.
    A pair of blocks is one piece of work of bounded size, so no task holds a tile that is large, and a few
    outsiders cost a large tile no more than its own size.
    """
    parts = saved(tiles.groupBy("tile", "component").agg(F.count("*").alias("n")), "tile_parts")
    whole = parts.groupBy("tile").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("n"))
    blocks = whole.select("tile", F.col("top.component").alias("main"), *[
        F.ceil(n / BLOCK_ROWS).cast("int").alias(c) for n, c in ((F.col("n") - F.col("top.n"), "others"), (F.col("top.n"), "mains"))
    ])
    dealt = tiles.join(saved(blocks, "tile_blocks"), "tile")
    hashed, is_main = F.xxhash64("doc_id"), F.col("component") == F.col("main")
    block = F.when(is_main, F.col("others") + F.pmod(hashed, F.col("mains"))).otherwise(F.pmod(hashed, F.greatest("others", F.lit(1)))).cast("int")
    among = F.sequence(F.lit(0), F.col("others") - 1)
    beside = F.transform(F.sequence(F.col("others"), F.col("others") + F.col("mains") - 1), lambda m: F.struct(F.col("block").alias("i"), m.alias("j")))
    meets = F.when(is_main, F.transform(among, lambda o: F.struct(o.alias("i"), F.col("block").alias("j")))).otherwise(
        F.concat(F.transform(among, lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j"))), beside))
    rows = dealt.withColumn("block", block).select("tile", "doc_id", "component", "n_shingles", "bitmap", "block", F.explode(meets).alias("o"))
    rows = rows.select("tile", "o.i", "o.j", "block", "doc_id", "component", "n_shingles", "bitmap")

    def bounded(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def group(part):
            """Candidate pairs of one block pair; within a block for i = j, between the two else."""
            own, comp, n = part["block"].to_numpy(), part["component"].to_numpy(), part["n_shingles"].to_numpy()
            ids, same = part["doc_id"].to_numpy(), part["i"][0].as_py() == part["j"][0].as_py()
            maps = [np.frombuffer(x.as_buffer(), np.uint8) for x in part["bitmap"]]
            width = min(map(len, maps))
            m = np.stack([folded(x, width) for x in maps])
            ones = np.bitwise_count(m).sum(axis=1, dtype=np.int64)
            left, right = (np.arange(len(n)),) * 2 if same else (np.flatnonzero(own == part["i"][0].as_py()), np.flatnonzero(own == part["j"][0].as_py()))
            out = []
            for x in left:
                y = right[(right > x) | (not same)]
                y = y[(comp[y] != comp[x]) & (q * np.minimum(n[x], n[y]) >= p * np.maximum(n[x], n[y]))]
                if not len(y):
                    continue
                met = np.bitwise_count(m[y] & m[x]).sum(axis=1, dtype=np.int64)
                # each bit of one that the other lacks stands for an element that the other lacks
                most = np.minimum(n[x] - (ones[x] - met), n[y] - (ones[y] - met))
                ok = y[q * most >= p * (n[x] + n[y] - most)]
                out.append(np.stack([np.minimum(ids[x], ids[ok]), np.maximum(ids[x], ids[ok])], axis=1))
            return out

        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])]).combine_chunks()
            key = np.stack([t[c].to_numpy() for c in ("tile", "i", "j")], axis=1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1)]
            found = [x for a, b in zip(cuts, cuts[1:]) for x in (group(t.slice(a, b - a)) if b - a > 1 else ())]
            held = t.slice(cuts[-1]) if len(key) else t
            if found:
                yield _pairs(found)
        if held is not None and len(held) > 1 and (found := group(held)):
            yield _pairs(found)

    def _pairs(found):
        import pyarrow as pa

        x = np.concatenate(found)
        return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], ["a", "b"])

    dealt_out = rows.repartition("tile", "i", "j").sortWithinPartitions("tile", "i", "j", "doc_id")
    return dealt_out.mapInArrow(bounded, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, text: str = "text", width: int = 5, p: int = 80, q: int = 100) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id that links reach, its own included).

    Words are runs of bytes other than white space, A-Z in lower case; a set is the distinct runs of ``width``
    words, or the whole sequence if it is shorter.  Documents link when 100 J >= 100 p / q, exactly.  Null,
    empty and blank texts have empty sets and link with nothing.  A row without id takes the component of
    rows with an equal set, or none.  Repeated rows are rows of one component; ids are taken to be one text's
    (of an id with several texts each row has its component, but a link of one of them may be missed).  Other
    columns are ignored.
    """
    spark = docs.sparkSession
    text_batches(spark)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = saved(source.mapInArrow(
        _signer(width, p, q), "doc_id long, n_shingles long, set_low long, set_high long, bitmap binary, tiles array<long>"
    ), "signed")
    key = ["n_shingles", "set_low", "set_high"]
    some = signed.filter("n_shingles > 0")
    classes = saved(some.groupBy(*key).agg(F.min("doc_id").alias("rep")), "classes")

    # tiles of one member of each class: equal sets have equal tiles
    single = some.groupBy(*key).agg(F.min("doc_id").alias("doc_id"), F.any_value("tiles").alias("tiles")).filter(F.col("doc_id").isNotNull())
    placed = saved(single.select("doc_id", F.explode("tiles").alias("tile")), "placed")
    # totals of a tile and a join, not a window: a tile may hold most of the table
    hubs = placed.groupBy("tile").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("last")).filter("hub < last").select("tile", "hub")
    shared = saved(placed.join(saved(hubs, "hubs"), "tile").select("tile", "doc_id", "hub"), "shared_tiles")
    members = saved(shared.select("doc_id").distinct(), "members")
    # one row per id before it is saved: the joins below then read plain exchanges, which Spark can split
    sets = saved(_sets_of(source, members, width).dropDuplicates(["doc_id"]), "sets")

    stars = shared.filter("doc_id != hub").groupBy("doc_id").agg(F.min("hub").alias("b")).select(F.col("doc_id").alias("a"), "b")
    links = saved(_verify(stars, sets, p, q), "star_links")
    roots = components(links)

    known = saved(
        members.join(roots, members["doc_id"] == roots["node"], "left").select("doc_id", F.coalesce("root", "doc_id").alias("component")), "member_components"
    )
    told = saved(shared.select("tile", "doc_id").join(known, "doc_id"), "told_tiles")
    # two unlinked sets that differ in a few parts share all other tiles: of tiles with the same members one is enough
    members_sum = [F.sum(F.xxhash64(F.lit(i), "doc_id").cast("decimal(38,0)")).alias(f"s{i}") for i in (0, 1)]
    seen = told.groupBy("tile").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("n"), *members_sum)
    open_tiles = seen.filter("x < y").groupBy("x", "y", "n", "s0", "s1").agg(F.min("tile").alias("tile")).select("tile")
    bits = signed.select("doc_id", "n_shingles", "bitmap").join(members, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    mixed = told.join(saved(open_tiles, "open_tiles"), "tile", "left_semi").join(bits, "doc_id")
    more = _verify(saved(_across(mixed, p, q), "candidates"), sets, p, q)
    roots = components(links.unionByName(more))

    named = classes.join(roots, classes["rep"] == roots["node"], "left").select(*key, F.coalesce("root", "rep").alias("component_id"))
    named = saved(named, "class_components")
    rows = signed.select("doc_id", *key)
    full = rows.filter("n_shingles > 0").join(named, key).select("doc_id", "n_shingles", "component_id")
    return full.unionByName(rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
