import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tarnlake.llm import syncmers as S
from tarnlake.llm.common import words_of


def edited(rows):
    """Brute force: each text with its last quarter replaced by the start of the next one's."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: r[0])
    out = {}
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        cut = len(t) // 4
        out[i] = t[: len(t) - cut] + following[:cut]
    return out


@pytest.mark.parametrize("bucket_bytes", [8 << 20, 300])
def test_edited_texts(spark, bucket_bytes):
    rnd = random.Random(3)
    ids = rnd.sample(range(10**6), 40) + rnd.sample(range(10**12, 10**12 + 100), 40) + [-5]
    rows = [(i, "".join(rnd.choice("aä🙂 b\n") for _ in range(rnd.choice([0, 1, 3, 4, 50, 200])))) for i in ids] + [(7 * 10**8, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in S.fingerprint_pairs(df, F.col("text"), bucket_bytes=bucket_bytes).collect()}
    want = edited(rows)
    assert len(got) == len(rows)
    for i, t in rows:
        assert got[i].n_chars == len(t or "")
        assert got[i].edited_sha256 == hashlib.sha256(want[i].encode()).hexdigest()


def test_anchors_are_closed_syncmers(spark):
    rnd = random.Random(1)
    words = [f"w{rnd.randrange(30)}" for _ in range(200)]
    df = spark.createDataFrame([(" ".join(words),)], "text string")
    got = [(a.hash, a.pos) for a in df.select(S.anchors(words_of(F.col("text")))).first()[0]]
    one = {w: h for w, h in spark.createDataFrame([(w,) for w in set(words)], "w string").select("w", F.xxhash64("w")).collect()}
    h = [one[w] for w in words]
    want = [i for i in range(len(h) - 3) if min(h[i : i + 4]) in (h[i], h[i + 3])]
    assert [p for _, p in got] == want


def test_a_passage_keeps_its_anchors_anywhere(spark):
    rnd = random.Random(2)
    passage = " ".join(f"p{rnd.randrange(10**6)}" for _ in range(60))
    a = "alpha beta gamma delta " + passage + " omega"
    b = passage + " " + " ".join(f"q{i}" for i in range(40))
    left = spark.createDataFrame([(1, a)], "doc_id long, text string")
    right = spark.createDataFrame([(2, b), (3, "nothing in common at all here")], "doc_id long, text string")
    got = S.passage_matches(left, right).collect()
    assert len(got) == 1 and got[0].b == 2 and got[0]["shift"] == -4 and got[0].aligned >= 15


def test_likeness(spark, docs):
    out = S.fingerprint_pairs(docs, F.col("text"))
    rows = out.join(docs.select("doc_id", "text"), "doc_id").collect()
    by = {}
    for r in rows:
        assert by.setdefault(r.text, r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    long = [r for r in rows if r.n_chars > 400]
    assert sum(r.near_edited > r.near_next for r in long) > 0.97 * len(long)
    assert 0.4 < sum(r.near_edited for r in long) / len(long) < 0.8


def test_edges(spark, make, edge_texts):
    df = make(edge_texts)
    got = {r.doc_id: r for r in S.fingerprint_pairs(df, F.col("text")).collect()}
    want = edited(list(enumerate(edge_texts)))
    assert {i: r.edited_sha256 for i, r in got.items()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in want.items()}
    assert got[0].fingerprint == got[1].fingerprint == "" and got[0].near_next == 1.0
    assert got[6].fingerprint == got[7].fingerprint and got[6].near_next == 1.0
    assert S.fingerprint_pairs(df.filter("false"), F.col("text")).count() == 0
    only = S.fingerprint_pairs(df.filter("doc_id = 6"), F.col("text")).first()
    assert only.near_next == 1.0
    assert S.fingerprint_pairs(df.unionByName(df), F.col("text")).count() == 2 * len(edge_texts)
    nameless = spark.createDataFrame([(None, "abcd"), (1, "efgh")], "doc_id long, text string")
    assert S.fingerprint_pairs(nameless, F.col("text")).count() == 2


def test_short_texts_differ(spark):
    rnd = random.Random(4)
    texts = [" ".join(f"w{rnd.randrange(10**6)}" for _ in range(n)) for n in (4, 5) for _ in range(30)] + [""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = S.fingerprint_pairs(df, F.col("text")).collect()
    assert len({r.fingerprint for r in rows}) == len(texts)
    assert all((r.fingerprint == "") == (r.doc_id == len(texts) - 1) and r.near_next == 0.0 for r in rows)


def test_all_anchors_of_long_texts_count(spark):
    rnd = random.Random(6)
    long = lambda: [f"w{rnd.randrange(10**6)}" for _ in range(3000)]
    passage = [f"p{i}" for i in range(50)]
    a, b = long(), long()
    a[100:150], b[2000:2050] = passage, passage
    texts = [" ".join(a), " ".join(b), "no words in common with them at all"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in S.fingerprint_pairs(df, F.col("text")).collect()}
    sets = {i: {x.hash for x in r.anchors} for i, r in got.items()}
    for i in got:
        other, edit = sets[(i + 1) % 3], {x.hash for x in got[i].edited_anchors}
        assert got[i].near_next == pytest.approx(len(sets[i] & other) / len(sets[i] | other))
        assert got[i].near_edited == pytest.approx(len(sets[i] & edit) / len(sets[i] | edit))
        assert got[i].next_shared == len(sets[i] & other)
    assert got[0].next_shift == 1900 and got[0].next_aligned == got[0].next_shared >= 10
    assert got[0].edited_shift == 0 and got[1].next_shift is None and got[1].next_aligned == 0
    want = S.passage_matches(df.filter("doc_id = 0"), df.filter("doc_id = 1")).first()
    assert (want["shift"], want.aligned, want.shared) == (got[0].next_shift, got[0].next_aligned, got[0].next_shared)
