"""One scoring job: explode responses, strip reasoning, dispatch by source, grade, aggregate."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.functions import answers as A
from tarnlake.functions import benchmarks as B
from tarnlake.functions import instructions as I
from tarnlake.functions.text import let

# fixed values: dispatch rules, first match wins; (kind, value, metric override, scorer)
DISPATCH = [
    ("prefix", "math", "prime_math", "math_boxed_numeric"),
    ("prefix", "math", "math_llm_judge", "judge"),
    ("prefix", "math", None, "math_default"),
    ("prefix", "codegen", None, "code_outputs"),
    ("prefix", "simulation__codeio", None, "json_answer"),
    ("prefix", "simulation__cruxeval", None, "code_outputs"),
    ("prefix", "simulation__arcagi", None, "grid"),
    ("prefix", "simulation__barc", None, "grid"),
    ("prefix", "logic__zebra_puzzle", None, "grid_table"),
    ("prefix", "logic__ordering_puzzle", None, "ordering"),
    ("prefix", "logic__graph", None, "next_node"),
    ("prefix", "table", None, "table"),
    ("no_box", "stem__gpqa", None, "choice"),
    ("prefix", "stem__gpqa", None, "ten_way"),
    ("prefix", "stem__supergpqa", None, "ten_way"),
    ("prefix", "stem_web", None, "judge"),
    ("equal", "ood__ifeval", None, "instructions"),
    ("equal", "ood__livebench", None, "benchmark_task"),
    ("equal", "ood__ifbench", None, "instructions_extended"),
    ("equal", "openai/gsm8k", None, "hash_number"),
    ("equal", "lighteval/MATH", None, "boxed_equivalence"),
    ("equal", "DigitalLearningGmbH/MATH-lighteval", None, "boxed_equivalence"),
    ("equal", "math_dapo", None, "answer_line"),
    ("prefix", "aime", None, "answer_line"),
    ("equal", "numina_aops_forum", None, "math_boxed_numeric"),
    ("equal", "numina_synthetic_math", None, "math_boxed_numeric"),
    ("equal", "numina_amc_aime", None, "math_boxed_numeric"),
    ("equal", "numina_synthetic_amc", None, "math_boxed_numeric"),
    ("equal", "numina_cn_k12", None, "math_boxed_numeric"),
    ("equal", "numina_olympiads", None, "math_boxed_numeric"),
    ("equal", "codecontests", None, "code_outputs"),
    ("equal", "apps", None, "code_outputs"),
    ("equal", "codeforces", None, "code_outputs"),
    ("equal", "taco", None, "code_outputs"),
    ("equal", "hiyouga/geometry3k", None, "format_and_accuracy"),
    ("equal", "searchR1_nq", None, "open_answer"),
    ("equal", "searchR1_triviaqa", None, "open_answer"),
    ("equal", "searchR1_popqa", None, "open_answer"),
    ("equal", "searchR1_hotpotqa", None, "open_answer"),
    ("equal", "searchR1_2wikimultihopqa", None, "open_answer"),
    ("equal", "searchR1_musique", None, "open_answer"),
    ("equal", "searchR1_bamboogle", None, "open_answer"),
]


def scorer_name(source: Column, metric: Column, rules=DISPATCH) -> Column:
    """Name of the scorer for a source: the rules as one first-match chain, null when none fits."""
    out = F
    for kind, value, override, name in rules:
        hit = source == value if kind == "equal" else F.startswith(source, F.lit(value))
        if kind == "no_box":
            hit = hit & F.contains(source, F.lit("no_box"))
        if override is not None:
            hit = hit & metric.eqNullSafe(F.lit(override))
        out = out.when(hit, name)
    return out.otherwise(F.lit(None).cast("string"))


def explode_responses(df: DataFrame, responses: str) -> DataFrame:
    """One row per response with its position; the reasoning part is cut off."""
    rest = [c for c in df.columns if c != responses]
    out = df.select(*rest, F.posexplode(responses).alias("resp_idx", "response"))
    return out.withColumn("answer", A.after_first_think(F.col("response")))


Scorer = Callable[[Column, Column], "Column | dict[str, Column]"]

SCORERS: dict[str, Scorer] = {
    "math_default": A.math_grade,
    "math_boxed_numeric": A.math_grade,
    "boxed_equivalence": A.boxed_equivalence,
    "answer_line": A.answer_line,
    "strict_box": A.strict_box,
    "hash_number": lambda r, t: A.grade_equal(A.hash_number(r), t),
    "last_number": lambda r, t: A.grade_equal(A.last_number(r), t),
    "choice": lambda r, t: A.grade_equal(A.choice_strict(r), t),
    "choice_flexible": lambda r, t: A.grade_equal(A.choice_flexible(r), t),
    "ten_way": lambda r, t: A.grade_equal(A.ten_way_choice(r), t),
    "table": A.table_answer,
    "grid_table": A.grid_share,
    "grid": lambda r, t: A.grid_match(A.answer_grid(r), F.from_json(t, A.GRID)).getField("exact"),
    "ordering": lambda r, t: A.order_match(r, F.from_json(t, "array<string>")),
    "next_node": A.next_node,
    "open_answer": lambda r, t: A.open_answer(r, F.coalesce(F.from_json(t, "array<string>"), F.array(t))),
    "format_and_accuracy": A.format_and_accuracy,
    "code_outputs": lambda r, t: A.output_match(r, t).cast("double"),
}


# scorers that run in Python workers; they get a branch of their own
PYTHON_SCORERS: set[str] = {"json_answer", "sentence_order"}
SCORERS["json_answer"] = lambda r, t: A.json_match()(r, t).cast("double")
SCORERS["sentence_order"] = lambda r, t: B.sentence_order()(t, r)


def register_scorer(name: str, fn: Scorer) -> None:
    """Add a scorer: a function (response, truth) -> Column, dict of Columns, or a pandas UDF."""
    if not callable(fn):
        raise TypeError("a scorer must be callable")
    SCORERS[name] = fn
    (PYTHON_SCORERS.add if hasattr(fn, "evalType") else PYTHON_SCORERS.discard)(name)


def load_scorer(path: str, function: str, **bound) -> Scorer:
    """Scorer from a Python file: a row function (source, response, truth, extra) run over Arrow batches.

    Arguments in ``bound`` are fixed; the function returns a number or a dict with 'score'.
    """
    import importlib.util
    import os

    import pandas as pd

    if not os.path.exists(path):
        raise FileNotFoundError(path)
    with open(path) as f:
        code = f.read()
    spec = importlib.util.spec_from_loader("custom_scorer", loader=None)
    probe = importlib.util.module_from_spec(spec)
    exec(compile(code, path, "exec"), probe.__dict__)
    if not hasattr(probe, function):
        raise AttributeError(f"{function} is not defined in {path}")

    cached: dict = {}  # per worker, filled by the first batch

    def scored(responses, truths):
        if not cached:
            cached["__name__"] = "custom_scorer"
            exec(compile(code, path, "exec"), cached)
        space = cached
        rows = (space[function]("", r, t, {}, **bound) for r, t in zip(responses, truths))
        return pd.Series([float(x["score"]) if isinstance(x, dict) else float(x) for x in rows], dtype="float64")

    scored.__annotations__ = {"responses": pd.Series, "truths": pd.Series, "return": pd.Series}
    return F.pandas_udf(scored, "double")


def as_result(out) -> Column:
    """struct<score, acc, pred> from a number, a boolean, a list (first element), a struct or a dict of columns."""
    if isinstance(out, dict):
        return A.result(out["score"], out.get("acc", out["score"]), out.get("pred", F.lit(None)))
    return A.result(out, out, F.lit(None))


# fixed values: scorers that return struct<score, acc, pred> themselves
STRUCT_SCORERS = {"math_default", "math_boxed_numeric", "answer_line", "strict_box"}


def failing(what: str, value: Column, kind: str = "struct<score:double,acc:double,pred:string>") -> Column:
    """Stops the job with the offending value, so that no row is scored over fewer rows or with a made-up 0."""
    return F.raise_error(F.concat(F.lit(what + " "), F.coalesce(value.cast("string"), F.lit("null")))).cast(kind)


def graded(name: str, response: Column, truth: Column) -> Column:
    raw = SCORERS[name](response, truth)
    return raw if name in STRUCT_SCORERS else as_result(raw)


def score_responses(df: DataFrame, response: str, truth: str, scorer: str, names: list[str], verdict: str | None = None) -> DataFrame:
    """Grade every row by the scorer that its column names; adds score, acc, pred and failed.

    A row whose scorer is null, unknown or not among ``names`` is an error, never left out.  Rows of the
    scorer ``judge`` take the outside verdict of the column ``verdict``; a missing verdict is an error too.
    A grader that gives no result scores 0 and sets ``failed``.

    Column scorers share one pass and one first-match expression, which evaluates only the grader of
    the row.  Python scorers do not stop early inside such an expression, so each gets a filtered branch.
    """
    python = [n for n in names if n in PYTHON_SCORERS]
    res = F
    for n in names:
        if n not in PYTHON_SCORERS and n != "judge":
            res = res.when(F.col(scorer) == n, graded(n, F.col(response), F.col(truth)))
    if "judge" in names:
        if verdict is None:
            raise ValueError("the scorer judge needs a column of verdicts")
        told = F.when(F.col(verdict).isNotNull(), as_result(F.col(verdict))).otherwise(failing("no verdict for truth", F.col(truth)))
        res = res.when(F.col(scorer) == "judge", told)
    res = res.when(F.lit(True), failing("no scorer for a row of", F.col(scorer)))
    rest = df.filter(F.col(scorer).isNull() | ~F.col(scorer).isin(python)) if python else df
    out = rest.withColumn("_res", res)
    for n in python:
        out = out.unionByName(df.filter(F.col(scorer) == n).withColumn("_res", graded(n, F.col(response), F.col(truth))))
    return with_result(out)


def with_result(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "score": F.coalesce("_res.score", F.lit(0.0)), "acc": F.coalesce("_res.acc", F.lit(0.0)), "pred": F.col("_res.pred"),
        "failed": F.col("_res.score").isNull(),
    }).drop("_res")


INSTRUCTION_SCORERS = ["instructions", "instructions_extended"]


def follows_all(response: Column, ids: Column, kwargs: Column, lang: Column, names=None) -> Column:
    """1.0 if the response is not blank and follows every instruction of its row (also if there is none), else 0.0."""
    def check(instruction, arguments):
        parsed = F.from_json(F.coalesce(arguments, F.lit("{}")), I.ARGUMENT_SCHEMA)
        return let(parsed, lambda a: I.follows(instruction, response, {n: a[n] for n in I.ARGUMENTS if n != "lang"} | {"lang": lang}, names))

    checks = F.zip_with(F.coalesce(ids, F.array().cast("array<string>")), F.coalesce(kwargs, F.array().cast("array<string>")), check)
    ok = (A.strip(F.coalesce(response, F.lit(""))) != "") & F.forall(checks, lambda c: c)
    return F.coalesce(ok, F.lit(False)).cast("double")


def score_mixed(
    df: DataFrame, source: Column, metric: Column, response: str, truth: str, verdict: str, task: str, ids: str, kwargs: str, lang: Column,
) -> DataFrame:
    """One job over responses of all sources: the dispatch rules name each row's scorer, and every row gets a score.

    Besides response and truth a row may bring an outside verdict (for judged sources), a benchmark task, or
    instruction ids with their JSON arguments.  An unknown source or task and a missing verdict are errors.
    All of it is one expression over the row, so the table is read once and needs no key.  A Python scorer
    inside it sees nulls for the rows of others.
    """
    named = scorer_name(source, metric)
    tagged = df.withColumn("scorer", F.when(named.isNotNull(), named).otherwise(failing("no scorer for source", source, "string")))
    kind, said, wanted = F.col("scorer"), F.col(response), F.col(truth)
    res = F
    names = list(dict.fromkeys(r[3] for r in DISPATCH))
    same: dict = {}  # scorers that are one function share its expression
    for n in names:
        same.setdefault(SCORERS.get(n, n), []).append(n)
    for n in [g[0] for g in same.values()]:
        if n == INSTRUCTION_SCORERS[0]:
            res = res.when(kind.isin(INSTRUCTION_SCORERS), as_result(follows_all(said, F.col(ids), F.col(kwargs), lang)))
        elif n in INSTRUCTION_SCORERS:
            continue
        elif n == "benchmark_task":
            res = res.when(kind == n, as_result(task_score(F.col(task), wanted, said, F.col(verdict))))
        elif n == "judge":
            told = F.when(F.col(verdict).isNotNull(), as_result(F.col(verdict))).otherwise(failing("no verdict for truth", wanted))
            res = res.when(kind == n, told)
        elif n in PYTHON_SCORERS:
            res = res.when(kind == n, graded(n, F.when(kind == n, said), F.when(kind == n, wanted)))
        else:
            res = res.when(kind.isin(same[SCORERS[n]]), graded(n, said, wanted))
    return with_result(tagged.withColumn("_res", res.otherwise(failing("no scorer for a row of", kind))))


@dataclass(frozen=True)
class Strategy:
    """Scoring strategies share one job and differ in what they add to the rule score."""

    precomputed: bool = True
    overlong: tuple[int, int, float] | None = None


STRATEGIES = {
    "naive": Strategy(), "parallel": Strategy(), "batch": Strategy(precomputed=True),
    "overlong": Strategy(overlong=(64, 16, 1.0)),
}


def apply_strategy(df: DataFrame, name: str, rule: str, precomputed: str, length: str) -> DataFrame:
    """Final reward: a precomputed score wins; the overlong strategy adds the length penalty."""
    if name not in STRATEGIES:
        raise ValueError(f"unknown scoring strategy {name}")
    s = STRATEGIES[name]
    score = F.coalesce(F.col(precomputed), F.col(rule)) if s.precomputed else F.col(rule)
    if s.overlong:
        from tarnlake.functions.policy import overlong_penalty

        score = score + overlong_penalty(F.col(length), *s.overlong)
    return df.withColumn("final_score", score)


def unscored(df: DataFrame, scored: DataFrame, keys: list[str], force: bool = False) -> DataFrame:
    """Rows that still need a score; all rows when recalculation is forced."""
    return df if force else df.join(scored.select(*keys), keys, "left_anti")


def instruction_scores(df: DataFrame, keys: list[str], response: str, ids: str, kwargs: str, lang: Column, names=None) -> DataFrame:
    """All instructions of a row must hold and the response must not be empty.

    ``ids`` is an array of instruction ids, ``kwargs`` an array of JSON argument objects.
    """
    pairs = F.posexplode(F.arrays_zip(F.col(ids).alias("id"), F.col(kwargs).alias("kw"))).alias("pos", "z")
    rows = df.select(*keys, response, lang.alias("_lang"), pairs)
    args_json = F.from_json(F.coalesce(F.col("z.kw"), F.lit("{}")), I.ARGUMENT_SCHEMA)
    rows = rows.withColumn("_a", args_json)
    args = {n: F.col(f"_a.`{n}`") for n in I.ARGUMENTS if n != "lang"} | {"lang": F.col("_lang")}
    ok = (A.strip(F.col(response)) != "") & I.follows(F.col("z.id"), F.col(response), args, names)
    return rows.groupBy(*keys).agg(F.bool_and(ok).cast("double").alias("score"), F.count("*").alias("instructions"),
                                   F.count_if(ok).alias("followed"))


TASKS: dict[str, Scorer] = {
    "cta": B.column_type_match,
    "typos": B.typo_match,
    "connections": B.word_groups,
    "house_traversal": B.traversal,
    "spatial": B.spatial,
    "web_of_lies_v2": B.verdicts,
    "web_of_lies_v3": lambda t, r: B.positional_credit(t, B.verdict_text(r)),
    "zebra_puzzle": B.last_emphasised,
    "tablejoin": lambda t, r: B.join_map_f1(F.from_json(t, "map<string,string>"), F.from_json(r, "map<string,string>")),
}


def task_score(task: Column, truth: Column, response: Column, verdict: Column | None = None) -> Column:
    """Benchmark tasks: one first-match expression over the task name.

    A task without a grader here takes the verdict; without one it is an error.
    """
    out = F
    for name, fn in TASKS.items():
        out = out.when(task == name, F.coalesce(fn(truth, response).cast("double"), F.lit(0.0)))
    unknown = failing("no grader and no verdict for task", task, "double")
    if verdict is not None:
        unknown = F.when(verdict.isNotNull(), verdict.cast("double")).otherwise(unknown)
    return out.otherwise(unknown)


def task_scores(df: DataFrame, task: str, truth: str, response: str, verdict: str | None = None) -> DataFrame:
    return df.withColumn("score", task_score(F.col(task), F.col(truth), F.col(response), F.col(verdict) if verdict else None))


def table_equality(cand: DataFrame, truth: DataFrame, table: str, row: str, column: str, value: str, tolerance: float = 1e-6) -> DataFrame:
    """1 when two long tables (table, row, column, value) hold the same cells; the index column is ignored."""
    def side(df, name):
        return df.filter(F.trim(F.col(column)) != "index").select(
            table, row, F.trim(F.col(column)).alias(column), F.trim(F.col(value)).alias(name), F.lit(True).alias(f"_{name}")
        )

    j = side(cand, "a").join(side(truth, "b"), [table, row, column], "full")
    x, y = F.col("a").try_cast("double"), F.col("b").try_cast("double")
    close = F.when(x.isNotNull() & y.isNotNull(), (F.isnan(x) & F.isnan(y)) | (F.abs(x - y) < tolerance)).otherwise(
        F.col("a").eqNullSafe(F.col("b"))
    )
    ok = F.col("_a").isNotNull() & F.col("_b").isNotNull() & F.coalesce(close, F.lit(False))
    return j.groupBy(table).agg((F.count_if(~ok) == 0).cast("double").alias("score"), F.count_if(~ok).alias("mismatches"))
