import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tarnlake.llm import lines as L

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, shortest=10):
    last = 1 << 70
    name = lambda i: last if i is None else i
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders: dict = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= shortest:
                holders.setdefault(key(line), set()).add(name(i))
    out = []
    for i, t in rows:
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == name(i)]
        out.append((i, len(all_lines), len(all_lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest(), "\n".join(kept)))
    return sorted(out, key=str)


def corpus(seed, n=400):
    rnd = random.Random(seed)
    shared = ["Terms and Conditions apply", "  terms AND conditions apply\t", "short", "ééééééééé", "éééééééééÉ", "日本語の文章はここにあります。", "x" * 500, "\x0bCookie notice of site\r"]
    rows = []
    for i in range(n):
        ls = [rnd.choice(shared) if rnd.random() < 0.3 else f"line {rnd.randrange(10**6)} of its own" for _ in range(rnd.randrange(1, 12))]
        rows.append((i * 3, "\n".join(ls)))
    return rows + [(rnd.randrange(n) * 3 + 1, rows[k][1]) for k in range(40)]


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, suspects string, n_lines int").repartition(6)
    got = L.drop_repeated_lines(df, F.col("doc_id"), F.col("text"), texts=True, **kw)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256", "kept_text"]
    return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.mark.parametrize("limit", [L.FILTER_LIMIT, 0])
def test_equals_brute_force_on_both_probes(spark, monkeypatch, limit):
    monkeypatch.setattr(L, "SEGMENT_LINES", 64)  # many segments
    rows = corpus(1)
    rows = list({i: (i, t) for i, t in rows}.values())
    rows += [(5000, None), (5001, ""), (5002, "\n\n"), (5003, "Terms and conditions apply\n" * 3 + "terms and conditions apply"), (5004, "own repeated line\nown repeated line")]
    rows += [(5005, "a very long line " * 60000 + "\n" + "Terms and Conditions apply"), (-4, "terms and conditions apply")]
    assert run(spark, rows, filter_limit=limit) == brute(rows)


@pytest.mark.parametrize("limit", [L.FILTER_LIMIT, 0])
def test_repeated_and_missing_ids(spark, limit):
    rows = [(1, "a line that repeats\nb"), (1, "a line that repeats\nb"), (1, "a line that repeats\nanother line of one"), (2, "A LINE that repeats\nc"),
            (None, "a line that repeats\nonly without an id"), (None, "only without an id"), (9, "only of the document nine"), (9, "only of the document nine")]
    assert run(spark, rows, filter_limit=limit) == brute(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert L.drop_repeated_lines(df, F.col("doc_id"), F.col("text")).count() == 0


def test_second_filter_holds_every_repeat_and_spares_most_others(spark):
    own = [f"line number {i} of the only document" for i in range(60000)]
    rows = [(i, "\n".join(own[i * 100 : i * 100 + 100]) + "\nshared by all of them") for i in range(600)]
    df = spark.createDataFrame(rows, "_doc long, text string").repartition(7)
    found = L.twice_seen(df, 2, 10).collect()
    import numpy as np

    bits, rows_ = np.zeros((2, L.TWICE_BITS >> 3), np.uint8), np.full(2, -1)
    for n, r in enumerate(found):
        bits[n], rows_[r["segment"]] = np.frombuffer(r["bits"], np.uint8), n
    digest = lambda s: hashlib.sha256(s.encode()).digest()
    assert L._suspected([digest("shared by all of them")], bits, rows_).all()
    assert L._suspected([digest(x) for x in own], bits, rows_).mean() < 0.01
