import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnlake.llm import divergence as D

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, ranks):
    n, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = [t.translate(LOWER) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        groups.add((lang, source))
        n[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, d in docs[lang].items() if d >= least]
        own = sorted(s for x, s in groups if x == lang)
        whole = Counter()
        for s in own:
            whole.update(n[lang, s])
        p = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[k] for k in kept) + 5 * len(kept)) for t in kept}
        share, q = {s: p(n[lang, s]) for s in own}, p(whole)
        for s in own:
            pairs = [(o, sum(abs(share[s][t] - share[o][t]) for t in kept)) for o in own if o != s]
            terms = [(t, share[s][t] - q[t]) for t in kept if n[lang, s][t] and share[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, ranks)):
                for k, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]):
                    out.append((lang, s, part, item, value, k + 1))
    return sorted(out)


def corpus(seed, n=600):
    rnd = random.Random(seed)
    vocab = [f"{a}{b}" for a in ("term", "Wort", "été", "ÉTÉ", "日本", "mot") for b in "abcdefghij"]
    rows = []
    for _ in range(n):
        lang, s = rnd.choice(["en", "en", "fr", None]), rnd.choice([f"site{k}" for k in range(9)] + ["hot"] * 6 + [None])
        start = hash((lang, s)) % 7
        rows.append((lang, s, rnd.choice([" ", "1", "-", "_", "[", "{", "\x7f"]).join(rnd.choice(vocab[start:]) for _ in range(rnd.randrange(0, 30)))))
    return rows + [("de", "a", None), ("de", "b", ""), ("de", None, "ein einziges Dokument"), ("it", "alone", "uno")]


@pytest.mark.parametrize(("sources", "terms", "held"), [(32, 4096, 300_000), (2, 5, 20)])
def test_equals_brute_force(spark, monkeypatch, sources, terms, held):
    monkeypatch.setattr(D, "SOURCES", sources)
    monkeypatch.setattr(D, "TERMS", terms)
    monkeypatch.setattr(D, "HELD", held)
    rows = corpus(4)
    rows += rows[:50] + [("en", "hot", "terma " * 200000)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, source string, text string, n int, item string").repartition(5)
    got = D.source_divergence(df, F.col("lang"), F.col("source"), F.col("text"), least_docs=30, ranks=5)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 30, 5)


def test_empty_table(spark):
    df = spark.createDataFrame([], "lang string, source string, text string")
    assert D.source_divergence(df, F.col("lang"), F.col("source"), F.col("text")).count() == 0


def test_shares_are_exact_for_large_counts(spark):
    cases = [(0, 0, 1), (10**15, 10**15, 7), (123456789012345, 8 * 10**15, 10**6), (1, 3, 2)]
    for n, total, kept in cases:
        want = 1 + 10**9 * (n + 5) // (total + 5 * kept)
        assert D.share(np.array([n]), np.array([total]), kept)[0] == want
        row = spark.range(1).select(D._share(F.lit(n).cast("long"), F.lit(total).cast("long"), F.lit(kept).cast("long")).alias("p")).first()
        assert row["p"] == want
