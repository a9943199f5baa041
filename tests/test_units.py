"""Literal cases whose results are known."""

import pytest
from pyspark.sql import functions as F

from tarnlake.functions import answers as G
from tarnlake.functions import instructions as I
from tarnlake.functions import policy as L
from tarnlake.operators import advantages as A
from tarnlake.operators import balance as H
from tarnlake.operators import batches as B
from tarnlake.operators import evaluation as E
from tarnlake.operators import pass_rates as P
from tarnlake.operators import prompts as Q
from tarnlake.operators import scoring as S
from tarnlake.operators import sets
from tarnlake.operators import token_metrics as M
from tarnlake.sources.files import size_suffix, write_sized


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_size_suffix():
    assert [size_suffix(n) for n in (200, 1500, 2000)] == ["200", "1.5k", "2k"]


def test_write_sized(spark, tmp_path):
    path, n = write_sized(spark.range(1500), str(tmp_path), "set")
    assert path.endswith("set_1.5k.parquet") and n == 1500


def test_group_advantages(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (1, 1, 0.0), (1, 2, 0.0), (1, 3, 0.0), (2, 0, 0.7)], "uid long, i long, s double")
    got = {(r.uid, r.i): r.advantage for r in A.group_advantage(df, ["uid"], "s").collect()}
    assert got[(1, 0)] == pytest.approx(1.5, abs=1e-4) and got[(1, 1)] == pytest.approx(-0.5, abs=1e-4)
    assert got[(2, 0)] == pytest.approx(0.7, abs=1e-4)
    two = spark.createDataFrame([(1, 0, 1.0), (1, 1, 0.0)], "uid long, i long, s double")
    assert sorted(r.advantage for r in A.leave_one_out(two, ["uid"], "s").collect()) == [-1.0, 1.0]
    with pytest.raises(Exception, match="at least two"):
        A.best_only_advantage(df, ["uid"], "i", "s").collect()


def test_pass_at_k(spark):
    vals = {(n, c, k): one(spark, E.pass_at_k_of(*[F.lit(v).cast("long") for v in (n, c, k)]))
            for n, c, k in [(4, 0, 2), (4, 1, 2), (4, 4, 2), (8, 3, 1)]}
    assert [vals[x] for x in [(4, 0, 2), (4, 1, 2), (4, 4, 2)]] == [0.0, pytest.approx(0.5), 1.0]
    assert vals[(8, 3, 1)] == pytest.approx(3 / 8)
    with pytest.raises(Exception, match="larger"):
        one(spark, E.pass_at_k_of(F.lit(2), F.lit(1), F.lit(4)))


def test_majority(spark):
    rows = [(1, 0, "A", 0.9), (1, 1, "B", 0.8), (1, 2, "A", 0.7), (2, 0, "A", 0.9), (2, 1, "B", 0.8), (2, 2, "B", 0.7), (2, 3, "A", 0.6)]
    df = spark.createDataFrame(rows, "uid long, pos long, vote string, v double")
    got = {r.uid: r.majority_value for r in E.majority_at_n(df, ["uid"], "pos", "vote", "v").collect()}
    assert got == {1: 0.9, 2: 0.9}


def test_mean_at_two(spark):
    df = spark.createDataFrame([("s", "p", 0.8), ("s", "p", 0.9)], "src string, p string, score double")
    got = {r.metric: r.value for r in E.prompt_level_metrics(df, "src", "p", ["score"]).collect()}
    assert got["mean@2"] == pytest.approx(0.85) and got["std@2"] == pytest.approx(0.05)


def test_reduce_by_name(spark):
    rows = [("loss", 1.0), ("loss", 2.0), ("loss", 3.0), ("max_reward", 5.0), ("max_reward", 8.0), ("min_error", 0.1), ("min_error", 0.05)]
    got = dict(E.reduce_by_name(spark.createDataFrame(rows, "m string, v double"), "m", "v").collect())
    assert got == {"loss": 2.0, "max_reward": 8.0, "min_error": 0.05}


def test_edge_rate_counts_twice(spark):
    df = spark.createDataFrame([(0.2,)], "r double")
    both = {r.class_name: r.n for r in P.difficulty_classes(df, F.col("r")).collect()}
    once = {r.class_name: r.n for r in P.difficulty_classes(df, F.col("r"), disjoint=True).collect()}
    assert (both["Very Hard"], both["Hard"]) == (1, 1) and (once["Very Hard"], once["Hard"]) == (1, 0)


def test_overlong(spark):
    assert one(spark, L.overlong_penalty(F.lit(18432), 20480, 4096, 1.0)) == -0.5


def test_throughput(spark):
    assert one(spark, M.throughput(F.lit(600), F.lit(2.0), 1)) == 300 and one(spark, M.throughput(F.lit(600), F.lit(2.0), 2)) == 150


@pytest.mark.parametrize("ids, eos, mask", [
    ([20, 10, 34, 1, 0, 0, 0], [1], [1, 1, 1, 1, 0, 0, 0]), ([78, 0, 76, 2, 1, 0, 0], [1, 2], [1, 1, 1, 1, 0, 0, 0]),
])
def test_eos_mask(spark, ids, eos, mask):
    df = spark.createDataFrame([(0, t, x) for t, x in enumerate(ids)], "seq long, t long, x int")
    got = A.eos_mask(df, "seq", "t", F.col("x").isin(eos)).orderBy("t").collect()
    assert [r.response_mask for r in got] == mask


def test_unfold(spark):
    df = spark.createDataFrame([(i, list(range(4 * i + 1, 4 * i + 5))) for i in range(3)], "id long, obs array<int>")
    got = B.unfold_column(df, "obs", 2, F.size("obs")).orderBy("id", "piece").collect()
    assert [r.obs for r in got] == [[1, 2], [3, 4], [5, 6], [7, 8], [9, 10], [11, 12]]


def test_union_conflict(spark):
    a = spark.createDataFrame([(1, 0.5)], "id long, x double")
    assert B.union_columns(a, a.withColumn("y", F.lit(1)), ["id"]).count() == 1
    with pytest.raises(Exception, match="disagree"):
        B.union_columns(a, a.withColumn("x", F.lit(0.6)), ["id"]).collect()
    with pytest.raises(Exception, match="differ in rows"):
        B.union_columns(a, a.filter("id > 1"), ["id"]).collect()


def test_duplicate_and_conflict_errors(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "k string, v double")
    with pytest.raises(Exception, match="duplicate id"):
        P.require_unique(df, ["k"]).collect()
    with pytest.raises(Exception, match="conflicting"):
        sets.merge_maps([df], "k", "v").collect()
    with pytest.raises(Exception, match="no entry"):
        Q.lookup(df, spark.createDataFrame([("b",)], "k string"), "k").collect()


def test_allocation_shortage(spark):
    df = spark.range(10).select(F.lit("s").alias("src"), "id")
    sizes = df.groupBy("src").agg(F.count("*").alias("n"))
    with pytest.raises(Exception, match="too few"):
        B.allocate(df.filter("id < 3"), "src", "id", "1", 8, sizes).collect()
    assert B.allocate(df, "src", "id", "1", -1, sizes).count() == 10


def test_chunks_must_divide(spark):
    with pytest.raises(ValueError, match="equal chunks"):
        B.chunk(spark.range(10), [F.col("id")], 3)


def test_differencing():
    lengths = [5, 9, 3, 8, 1, 7, 2, 6]
    for equal in (True, False):
        parts = H.differencing(lengths, 4, equal)
        sums = [sum(x for x, p in zip(lengths, parts) if p == k) for k in range(4)]
        assert max(sums) - min(sums) <= 1 and set(parts) == set(range(4))
        if equal:
            assert all(parts.count(k) == 2 for k in range(4))


@pytest.mark.parametrize("answer, truth, score", [
    ("\\boxed{a | b|c}", "b|c|a", 1.0), (" Aboriginal population", "aboriginal population", 1.0), ("\\boxed{12%}", "0.12", 1.0),
    ("\\boxed{a|b}", "a|b|c", 0.0),
])
def test_table_answer(spark, answer, truth, score):
    assert one(spark, G.table_answer(F.lit(answer), F.lit(truth))) == score


def test_json_answers(spark):
    rows = [('{"output": {"answer": true}}', '"output": {"answer": "true"}', True), ('{"input": {"upper_limit": 2924}}', '"input": {"upper_limit": 2719}', False)]
    df = spark.createDataFrame(rows, "r string, t string, want boolean").select(G.json_match()("r", "t").alias("got"), "want")
    assert all(r.got == r.want for r in df.collect())


def test_repetition_against_definition(spark):
    texts = ["abab" * 30, "the quick brown fox jumps", "aaaaaaaaaa", "x", "", "mississippi river mississippi"]

    def brute(s):
        suf = sorted(s[i:] for i in range(len(s)))
        total = 0
        for a, b in zip(suf, suf[1:]):
            while_n = 0
            while while_n < min(len(a), len(b)) and a[while_n] == b[while_n]:
                while_n += 1
            total += while_n
        return total * 2 / (len(s) * (len(s) + 1)) if len(s) > 1 else 0.0

    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", G.repetitive()("t").alias("x"))
    assert all(r.x == pytest.approx(brute(r.t)) for r in df.collect())


@pytest.mark.parametrize("a, b, n", [("abc", "abd", 1), ("", "xy", 2), ("kitten", "sitting", 3)])
def test_list_edit_distance(spark, a, b, n):
    arr = lambda s: F.array(*[F.lit(x) for x in s]) if s else F.array().cast("array<string>")
    assert one(spark, G.list_edit_distance(arr(a), arr(b))) == n


CHECK_CASES = [
    ("detectable_format:bigram_wrapping", "<<a b>> <<c d>>", {}, True), ("detectable_format:bigram_wrapping", "a b>>", {}, False),
    ("count:count_unique", "one two three", {}, True), ("count:count_unique", "one two one", {}, False),
    ("keywords:no_adjacent_consecutive", "apple bear", {}, False), ("keywords:no_adjacent_consecutive", "apple cat", {}, True),
    ("copy:repeat_phrase", "red big fox and red old fox", {"phrase": "red big fox", "n": 2}, True),
    ("copy:repeat_phrase", "red big fox and red big fox", {"phrase": "red big fox", "n": 2}, False),
    ("keywords:keyword_specific_position", "One here. Two there now.", {"n": 2, "m": 2, "keyword": "there"}, True),
    ("first_word:first_word_sent", "So it is. So be it.", {"word": "so"}, True), ("last_word:last_word_sent", "End now. Go now!", {"word": "now"}, True),
    ("paragraphs:paragraphs", "a *** b", {}, True), ("paragraphs:paragraphs2", "a\n\nb\n\nc", {}, False),
    ("length_constraints:nth_paragraph_first_word", "x y\n\n'Hello, you", {"n": 2, "nth": 2, "word": "hello"}, True),
    ("count:counting_composition", "a b. c d. *** e f. g h. *** i j. k l.", {"n_sent": 2, "n_words": 3}, True),
    ("keywords:start_end", "word in word", {}, True), ("copy:copying_multiple", "p******P ******p", {"prompt": "p", "n": 3}, True),
    ("new:copy_span_idx", "ell", {"prompt": "hello", "start": 1, "end": 4}, True),
    ("detectable_format:square_brackets", "[a] [b]", {}, True), ("detectable_format:sentence_hyphens", "a-b-c", {}, True),
    ("length_constraints:number_sentences", "One. Two! Three?", {"relation": "at least", "n": 3}, True),
    ("change_case:capital_word_frequency", "A BIG one", {"relation": "less than", "n": 2}, False),
    ("count:lowercase_counting", "One two Three", {"n": 1}, True), ("startend:quotation", '"hi"', {}, True),
]


@pytest.mark.parametrize("name, text, args, want", CHECK_CASES)
def test_instruction(spark, name, text, args, want):
    cols = {k: F.lit(v) for k, v in args.items()}
    assert one(spark, I.CHECKS[name](F.lit(text), cols)) is want


def test_every_instruction_is_known():
    assert len(I.CHECKS) == 54


def test_scorer_from_file(spark, tmp_path):
    f = tmp_path / "mine.py"
    f.write_text("def grade(source, response, truth, extra, scale=1):\n    return {'score': scale * (response == truth)}\n")
    S.register_scorer("mine", S.load_scorer(str(f), "grade", scale=2))
    df = spark.createDataFrame([("a", "a", "mine"), ("a", "b", "mine")], "r string, t string, s string")
    assert sorted(r.score for r in S.score_responses(df, "r", "t", "s", ["mine"]).collect()) == [0.0, 2.0]
    with pytest.raises(AttributeError):
        S.load_scorer(str(f), "other")
    with pytest.raises(FileNotFoundError):
        S.load_scorer(str(tmp_path / "none.py"), "grade")


def test_unknown_strategy(spark):
    with pytest.raises(ValueError):
        S.apply_strategy(spark.range(1), "nope", "id", "id", "id")


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_list_edit_distance(spark):
    import random

    from tarnlake.functions.answers import list_edit_distance

    rnd = random.Random(5)
    pairs = [([rnd.choice("abcdef") * rnd.randrange(1, 3) for _ in range(rnd.randrange(12))], [rnd.choice("abcdeg") for _ in range(rnd.randrange(12))]) for _ in range(200)]
    pairs += [([], []), (["x"], []), (["a", "b"], ["a", "b"]), (["p", "a", "q"], ["p", "q"]), (list("ab") * 60, list("ba") * 60)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)] + [(-1, None, ["a"])], "id long, a array<string>, b array<string>")
    got = {r.id: r.d for r in df.select("id", list_edit_distance(F.col("a"), F.col("b")).alias("d")).collect()}
    assert got == {-1: None} | {i: plain_distance(a, b) for i, (a, b) in enumerate(pairs)}


def test_edit_distance_of_long_lists(spark):
    from tarnlake.functions.answers import list_edit_distance
    from tarnlake.session import durable

    items = F.transform(F.sequence(F.lit(0), F.col("id").cast("int") + 99_999), lambda i: F.concat(F.lit("item "), i.cast("string")))
    # the first item replaced, one taken out near the middle, one put in near the end
    changed = F.concat(
        F.array(F.lit("new")), F.slice(items, 2, 49_999), F.slice(items, 50_002, 49_900), F.array(F.lit("more")), F.slice(items, 99_902, 99))
    df = durable(spark.range(1).select(items.alias("a"), changed.alias("b")))
    other = F.transform(F.slice("a", 1, 1000), lambda x: F.concat(x, F.lit("?")))
    row = df.select(list_edit_distance(F.col("a"), F.col("b")).alias("near"), list_edit_distance(F.slice("a", 1, 1000), other).alias("far")).first()
    assert (row.near, row.far) == (3, 1000)
