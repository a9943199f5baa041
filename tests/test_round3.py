"""Work that must not be repeated per row, per draw or per piece, and words with combining marks."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tarnlake.functions import benchmarks as B
from tarnlake.functions import instructions as I
from tarnlake.functions import prompts as P
from tarnlake.operators import ranks as R


def test_words_end_at_combining_marks(spark):
    """As in Python, where an accent of its own is no word character; \u00bd is one."""
    text = F.lit("cafe\u0301s the\u0301 \u00bd")  # words: cafe s the \u00bd
    at_least = lambda n: I.CHECKS["length_constraints:number_words"](text, {"relation": F.lit(I.AT_LEAST), "n": F.lit(n)})
    barred = I.CHECKS["keywords:forbidden_words"](text, {"keywords": F.array(F.lit("the"))})
    assert tuple(spark.range(1).select(at_least(4), at_least(5), barred).first()) == (True, False, False)


def test_a_blank_end_is_no_paragraph(spark):
    """The reference leaves blank pieces at both ends out."""
    n = lambda t: I.CHECKS["length_constraints:number_paragraphs"](F.lit(t), {"n": F.lit(1)})
    assert tuple(spark.range(1).select(n("a***"), n("*** a"), n("a *** b")).first()) == (True, True, False)


def test_plain_tables_need_no_parser(spark, monkeypatch):
    from html.parser import HTMLParser

    tables = pd.Series(['<table><tr><th colspan="2">a &amp; b</th></tr>\n<tr><td> 1</td><td><b>x</b> y</td></tr></table>', None, "no table"])
    other = pd.Series(["<table><tr><td>a<!-- <td> --><br/>b</td></tr></table>"])
    convert = P.html_to_markdown().func
    assert list(convert(other)) == ["| ab |\n| --- |"]
    monkeypatch.setattr(HTMLParser, "feed", lambda *_: pytest.fail("parsed"))
    assert list(convert(tables)) == ["| a & b |  |\n| --- | --- |\n| 1 | x y |", None, ""]


def test_equal_and_single_sentences_are_not_matched(spark, monkeypatch):
    import difflib

    score = B.sentence_order().func
    assert score(pd.Series(["one. two."]), pd.Series(["twoo. onee."])).tolist() == [0.0]
    monkeypatch.setattr(difflib, "get_close_matches", lambda *_, **__: pytest.fail("matched"))
    assert score(pd.Series(["one. two."] * 3), pd.Series(["one. two.", "two. one.", "one."])).tolist() == [1.0, 0.0, 0.5]


def test_a_deeper_look_does_not_find_buckets_again(spark, monkeypatch):
    plans, plain = [], R._cut_points
    monkeypatch.setattr(R, "_cut_points", lambda df, n: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or plain(df, n))
    df = spark.range(4000).select((F.col("id") * 7919 % 4001).alias("k"))
    rows = sorted(i * 7919 % 4001 for i in range(4000))
    assert [k["k0"] for k in R.nth_keys(df, [F.col("k")], [900, 3000], direct=5)] == [rows[899], rows[2999]]
    assert len(plans) > 1 and not any("lambda" in p for p in plans[1:])
