import random
import re

import numpy as np
import pytest

from tarnlake.llm import jaccard as J
from tarnlake.llm.words import SPACE, lower_table, shingle_set, word_table, words_in


def sets_of(rows, width):
    out = {}
    for i, t in rows:
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        out[i] = {tuple(w)} if 0 < len(w) < width else {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if w else set()
    return out


def roots_of(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def brute(rows, width, p, q):
    sets = sets_of(rows, width)
    ids = sorted(i for i in sets if sets[i])
    links = []
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if min(len(x), len(y)) * q >= p * max(len(x), len(y)) and q * (n := len(x & y)) >= p * (len(x) + len(y) - n):
                links.append((a, b))
    roots = roots_of(sets, links)
    return {i: (len(sets[i]), roots[i]) for i in sets}


def near_copies(seed, n=260):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    passage = [rnd.choice(vocab) for _ in range(60)]
    base = [[rnd.choice(vocab) for _ in range(rnd.choice([3, 6, 9, 15, 30, 60, 150, 400]))] for _ in range(40)]
    rows = []
    for i in range(n):
        w = list(rnd.choice(base))
        if rnd.random() < 0.3:
            w = w + passage
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 4, 8])):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        text = " ".join(w)
        rows.append((i, text.upper() if rnd.random() < 0.1 else text))
    return rows


@pytest.mark.parametrize("width, p, seed", [(4, 85, 1), (5, 80, 2)])
def test_against_all_pairs(spark, width, p, seed):
    rows = near_copies(seed) + [(1000, None), (1001, ""), (1002, " \n"), (1003, "a"), (1004, "A")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.near_duplicates(df, width=width, p=p).collect()}
    assert got == brute(rows, width, p, 100)


def test_a_large_group_of_near_copies_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_ROWS", 8)
    rnd = random.Random(4)
    base = [f"v{rnd.randrange(5000)}" for _ in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(3):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.near_duplicates(df, width=4, p=85).collect()}
    assert got == brute(rows, 4, 85, 100)


@pytest.mark.parametrize("p", [80, 85, 95])
def test_similar_sets_share_a_tile(p):
    rnd = np.random.default_rng(p)
    for n in [*range(1, 40), 63, 64, 65, 127, 128, 200, 500, 2000]:
        for _ in range(12):
            x = rnd.integers(0, 1 << 62, n).astype(np.uint64)
            b = int(rnd.integers(n, n * 100 // p + 1))
            # as different as the threshold allows
            common = min(n, -(-p * (n + b) // (100 + p)))
            y = np.concatenate([x[:common], rnd.integers(0, 1 << 62, b - common).astype(np.uint64)])
            if 100 * common < p * (n + b - common) or (n == b == common):
                continue
            assert np.intersect1d(J.tiles_of(np.unique(x), p, 100), J.tiles_of(np.unique(y), p, 100)).size, (n, b, common)


def test_bitmaps_never_rule_out_too_much():
    rnd = np.random.default_rng(1)
    for n in (5, 40, 300, 5000):
        x = np.unique(rnd.integers(0, 1 << 62, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[: n * 9 // 10], rnd.integers(0, 1 << 62, n // 5).astype(np.uint64)]))
        a, b = (np.frombuffer(J.bitmap_of(s), np.uint8) for s in (x, y))
        size = min(len(a), len(b))
        a, b = J.folded(a, size), J.folded(b, size)
        met = int(np.bitwise_count(a & b).sum())
        most = min(len(x) - (int(np.bitwise_count(a).sum()) - met), len(y) - (int(np.bitwise_count(b).sum()) - met))
        assert most >= np.intersect1d(x, y).size


def test_shingles_of_long_texts_do_not_depend_on_blocks(monkeypatch):
    from tarnlake.llm import words as W

    data = np.frombuffer((" ".join(f"Word{i}" for i in range(4000)) + " " + "z" * 3000).encode(), np.uint8)
    args = (word_table(SPACE), lower_table())
    whole = shingle_set(words_in(data, *args)[2], 4)
    monkeypatch.setattr(W, "BLOCK", 100)
    assert np.array_equal(shingle_set(W.words_in(data, *args)[2], 4), whole)


def test_components(spark):
    rnd = random.Random(9)
    links = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(260)] + [(0, i) for i in range(500, 700)] + [(i, i + 1) for i in range(800, 860)]
    got = {r.node: r.root for r in J.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots_of({x for e in links for x in e}, links)
    assert all(got.get(i, i) == r for i, r in want.items())
    assert J.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_edges(spark, make, edge_texts):
    df = make(edge_texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.near_duplicates(df).collect()}
    assert got == brute(list(enumerate(edge_texts)), 5, 80, 100)
    twice = J.near_duplicates(df.unionByName(df)).collect()
    assert len(twice) == 2 * len(edge_texts) and all(got[r.doc_id] == (r.n_shingles, r.component_id) for r in twice)
    nameless = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (None, "only here")], "doc_id long, text string")
    assert sorted(str(r.component_id) for r in J.near_duplicates(nameless).collect()) == ["4", "4", "None"]
    assert J.near_duplicates(df.filter("false")).count() == 0


def test_one_outsider_does_not_multiply_a_tile(spark):
    """Members of the largest component are sent once for each block of the others."""
    ids = list(range(5000)) + [9001, 9002, 9003]
    maps = {i: J.bitmap_of(np.arange(40, dtype=np.uint64) + np.uint64(1000 if i > 9000 else 0)) for i in ids}
    tiles = spark.createDataFrame([(7, i, 0 if i < 9000 else i, 40, bytearray(maps[i])) for i in ids], "tile long, doc_id long, component long, n_shingles long, bitmap binary")
    sent = []
    plain = type(tiles).repartition

    def count(self, *cols):
        if cols == ("tile", "i", "j"):
            sent.append(self.count())
        return plain(self, *cols)

    try:
        type(tiles).repartition = count
        found = {(r["a"], r["b"]) for r in J._across(tiles, 85, 100).collect()}
    finally:
        type(tiles).repartition = plain
    assert sent and sent[0] < 3 * len(ids)
    assert found == {(9001, 9002), (9001, 9003), (9002, 9003)}  # the outsiders share a bitmap of their own


def test_members_are_joined_where_the_filter_would_be_too_large(spark, monkeypatch):
    rows = near_copies(8, 200)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(J, "BLOOM_LIMIT", 1)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.near_duplicates(df, width=4, p=85, q=100).collect()}
    assert got == brute(rows, 4, 85, 100)


def test_of_tiles_with_the_same_members_one_is_compared(spark, monkeypatch):
    """Two texts that are unlike in a few words share nearly all tiles."""
    words = [f"w{i}" for i in range(400)]
    other = list(words)
    for at in range(40, 400, 40):
        other[at] = "x"
    rows = [(0, " ".join(words)), (1, " ".join(other)), (2, "alone " + " ".join(words[::-1]))]
    kept, plain = {}, J.saved

    def seen(df, name):
        kept[name] = plain(df, name)
        return kept[name]

    monkeypatch.setattr(J, "saved", seen)
    found = J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4, p=85)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()}
    assert got == brute(rows, 4, 85, 100) and got[1][1] == 1
    assert kept["told_tiles"].select("tile").distinct().count() > 5 and kept["open_tiles"].count() == 1
