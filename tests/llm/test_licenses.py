import re
from collections import Counter

from pyspark.sql import functions as F

from tarnlake.llm import licenses as L


def words(t):
    return [w for w in re.split(r"[^\w]|_", t.lower()) if w]


def pairs(t):
    w = words(t)
    return Counter(zip(w, w[1:]))


def brute(text, threshold):
    """Best dice of each licence over lines, paragraphs and the whole text."""
    t = text or ""
    units = t.split("\n") + (re.split(r"\n[\x20\x09-\x0D]*\n", t) if re.search(r"\n[\x20\x09-\x0D]*\n", t) else []) + ([t] if "\n" in t else [])
    best = {}
    for u in units:
        a = pairs(u)
        for name, body in L.TEMPLATES:
            b = pairs(body)
            if a and b:
                d = 2 * (a & b).total() / (a.total() + b.total())
                if d >= threshold:
                    best[name] = max(best.get(name, 0), d)
    return best


def test_against_brute_force(spark, docs):
    for row in L.TEMPLATES[:3]:
        assert brute(row[1], 0.8)
    mit, apache = L.TEMPLATES[2][1], L.TEMPLATES[4][1]
    texts = [
        mit, "intro line\n\n" + mit.replace("\n", " ") + "\n\nmore", apache.upper(), "\n".join(["released under the MIT license!!"] * 2), "Licensed under CC BY 4.0.",
        "Released under the MIT Licence", "the the the the", mit + " " + mit, " ".join(words(mit)[::2]), "x\nLicensed under CC BY-NC 4.0.\ny",
    ]
    extra = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(extra)
    got = {}
    for r in L.scan_licences(rows, F.col("text")).collect():
        d = got.setdefault(r.doc_id, {})
        d[r.licence] = max(d.get(r.licence, 0), r.dice)
    want = {r.doc_id: b for r in rows.collect() if (b := brute(r.text, 0.8))}
    assert {i: {k: round(v, 9) for k, v in d.items()} for i, d in got.items()} == {i: {k: round(v, 9) for k, v in d.items()} for i, d in want.items()}


def test_report_has_a_row_for_each_document(spark, make, edge_texts):
    df = make([*edge_texts, "Released under the MIT License.\nReleased under the MIT License."])
    rows = L.licence_report(df.unionByName(df), F.col("text")).collect()
    assert len(rows) == 2 * (len(edge_texts) + 1)
    last = [r for r in rows if r.doc_id == len(edge_texts)]
    assert all(r.licence == "MIT" and r.dice == 1.0 and r.n_units == 2 and r.licences == ["MIT"] for r in last)
    assert all(r.licence is None and r.dice == 0.0 for r in rows if r.doc_id < len(edge_texts))
    assert L.licence_report(df.filter("false"), F.col("text")).count() == 0
    nameless = spark.createDataFrame([(None, "Released under the MIT License."), (None, "x")], "doc_id long, text string")
    assert sorted(str(r.licence) for r in L.licence_report(nameless, F.col("text")).collect()) == ["MIT", "None"]


def body(name, least=100):
    return next(t for n, t in L.TEMPLATES if n == name and len(words(t)) > least)


def test_licences_inside_longer_texts(spark):
    prose = "Some words of an introduction that have nothing to do with it. "
    mit = "MIT License\n\nCopyright (c) 2020 A. Person\n\n" + body("MIT").replace(" The above", "\n\nThe above").replace(" THE SOFTWARE IS", "\n\nTHE SOFTWARE IS")
    apache = "# " + body("Apache-2.0", 50).replace(" You may", "\n#\n#     You may").replace(" Unless", "\n\n# Unless") + "\nimport os\nprint(os)\n"
    whole = dict(L.whole_bank())
    texts = {
        "MIT": "int x;\n" + mit + "\n\nint y;", "Apache-2.0": "#!/bin/sh\n" + apache, "BSD-2-Clause": "Copyright 2020\n\n" + body("BSD-2-Clause", 150),
        "BSD-3-Clause": prose + body("BSD-3-Clause", 200), "GPL-3.0": prose + whole["GPL-3.0"] + prose, "MPL-2.0": whole["MPL-2.0"] + "\n\nmore text",
        "CC-BY-4.0": prose + "Licensed under CC BY 4.0. " + prose,
    }
    df = spark.createDataFrame(list(enumerate(texts.values())), "doc_id long, text string")
    got = {r.doc_id: r for r in L.licence_report(df, F.col("text")).collect()}
    assert [got[i].licence for i in range(len(texts))] == list(texts)
    assert all(r.licences == [r.licence] and r.dice > 0.9 for r in got.values())


def test_every_run_of_words_is_looked_at(spark):
    import random

    rnd = random.Random(5)
    bank = [("one", "a b c a b d e a b c"), ("two", "f g h i j"), ("three", "e d c b a f g a b a b")]
    texts = [" ".join(rnd.choice("abcdefghijxyz"[: rnd.choice([5, 9, 13])]) for _ in range(rnd.randrange(60))) for _ in range(150)]
    texts += [" ".join(rnd.choice("xyz") for _ in range(5)) + " " + " ".join(w for w in b.split() if rnd.random() < 0.93) + " x y" for _, b in bank * 20]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for name, t in bank:
        got = {}
        for r in L.licence_windows(df, F.col("text"), [(name, t)], 0.7).collect():
            w = words(texts[r.doc_id])
            assert r.dice == 2 * (pairs(" ".join(w[r.first : r["last"] + 2])) & pairs(t)).total() / (r["last"] - r.first + 1 + pairs(t).total())
            got[r.doc_id] = max(got.get(r.doc_id, 0), r.shared)
        want = set()
        for i, x in enumerate(texts):
            w, b = words(x), pairs(t)
            for a in range(len(w)):
                for z in range(a + 2, len(w) + 1):
                    if 2 * (pairs(" ".join(w[a:z])) & b).total() / (z - a - 1 + b.total()) >= 0.7:
                        want.add(i)
        assert set(got) == want and want
