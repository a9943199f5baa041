"""Scoring queries over synthesised responses: every table row becomes a response whose score is known."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnlake.functions import answers as A
from tarnlake.functions import benchmarks as B
from tarnlake.functions import instructions as I
from tarnlake.operators import scoring as S
from tarnlake.operators.pass_rates import pass_rate
from tarnlake.operators.ranks import gather
from tarnlake.plans.registry import query
from tarnlake.plans.token_metrics import rnd
from tarnlake.plans.views import answers, documents, responses, with_views

c = F.concat
lit = F.lit


def size():
    return F.col("p_size").cast("string")


def K(m):
    return F.col("uid") % m


def case(key, *values):
    """values[i] when key = i; the last one otherwise."""
    out = F
    for i, v in enumerate(values[:-1]):
        out = out.when(key == i, v if not isinstance(v, str) else lit(v))
    last = values[-1]
    return out.otherwise(last if not isinstance(last, str) else lit(last))


def scored(df, *cols):
    return rnd(df.select("uid", *cols))


@query("j0_explode_and_strip", with_views("responses", """
SELECT uid, resp_idx, concat('flag ', pred) AS answer FROM responses"""))
def j0(spark, d):
    r = responses(spark, d, source=False)
    text = c(lit("<think>step "), F.col("resp_len").cast("string"), lit("</think>flag "), F.col("pred"))
    # prompts with their response arrays, as a generation run leaves them
    prompts = gather(r, ["uid"], "resp_idx", {"responses": text})
    out = S.explode_responses(prompts, "responses")
    return out.select("uid", F.col("resp_idx").cast("long").alias("resp_idx"), "answer")


@query("j1_last_boxed", with_views("answers", """
SELECT uid, CASE uid % 5 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN concat('\\frac{', p_size, '}{2}') WHEN 2 THEN concat('a{b{c{', p_size, '}}}')
  WHEN 3 THEN p_brand ELSE NULL END AS boxed, CASE uid % 5 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN concat('\\frac{', p_size, '}{2}') ELSE NULL END AS boxed_3 FROM answers"""))
def j1(spark, d):
    text = case(
        K(5), c(lit("first \\boxed{0}, then \\boxed{"), size(), lit("} end")), c(lit("\\boxed{\\frac{"), size(), lit("}{2}}.")),
        c(lit("\\boxed{a{b{c{"), size(), lit("}}}} x}")), c(lit("\\fbox{"), F.col("p_brand"), lit("}")), c(lit("\\boxed{open "), size()),
    )
    return answers(spark, d).select("uid", A.last_boxed(text).alias("boxed"), A.last_boxed_three_levels(text).alias("boxed_3"))


@query("j2_boxed_equivalence", with_views("answers", "SELECT uid, CASE WHEN uid % 6 < 5 THEN 1.0::DOUBLE ELSE 0.0 END AS score FROM answers"))
def j2(spark, d):
    resp = case(
        K(6), c(lit("so \\boxed{\\dfrac"), lit("{"), size(), lit("}{7}}")), c(lit("\\boxed{x = "), size(), lit("}")),
        c(lit("\\boxed{"), size(), lit("^\\circ}")), c(lit("\\boxed{\\sqrt"), F.left(size(), lit(1)), lit("}")),
        c(lit("\\boxed{"), size(), lit("/7}")), c(lit("\\boxed{"), size(), lit("1}")),
    )
    truth = case(
        K(6), c(lit("\\frac{"), size(), lit("}{7}")), size(), size(), c(lit("\\sqrt{"), F.left(size(), lit(1)), lit("}")),
        c(lit("\\frac{"), size(), lit("}{7}")), size(),
    )
    return scored(answers(spark, d), A.boxed_equivalence(resp, truth).alias("score"))


@query("j3_answer_line", with_views("answers", """
SELECT uid, CASE WHEN uid % 4 < 3 THEN 1.0::DOUBLE ELSE -1.0 END AS score, CASE WHEN uid % 4 < 3 THEN 1.0::DOUBLE ELSE 0.0 END AS acc,
  CASE uid % 4 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN concat(p_size, '000') WHEN 2 THEN concat('frac{', p_size % 10, '}{7}') ELSE '[INVALID]' END AS pred FROM answers"""))
def j3(spark, d):
    digit = (F.col("p_size") % 10).cast("string")
    resp = case(
        K(4), c(lit("Answer: 1\nthe Answer: $"), size(), lit("$ dollars")), c(lit("answer : "), size(), lit(",000 meters")),
        c(lit("Answer: x = frac"), digit, lit("7")), c(lit("no mark "), size()),
    )
    truth = case(K(4), size(), c(size(), lit("000")), c(lit("frac{"), digit, lit("}{7}")), size())
    a = answers(spark, d).select("uid", A.answer_line(resp, truth).alias("r"))
    return scored(a, "r.score", "r.acc", "r.pred")


@query("j3_strict_box", with_views("answers", """
SELECT uid, CASE WHEN uid % 3 = 0 THEN 1.0::DOUBLE ELSE -1.0 END AS score FROM answers"""))
def j3_strict(spark, d):
    resp = case(K(3), c(lit("\\boxed{"), size(), lit("}")), c(lit("\\boxed{"), size(), lit("} "), F.repeat(lit("x"), lit(120))), c(lit("\\boxed{ "), size(), lit("}")))
    return scored(answers(spark, d), A.strict_box(resp, size()).getField("score").alias("score"))


@query("j4_default_math_grade", with_views("answers", "SELECT uid, CASE WHEN uid % 9 < 7 THEN 1.0::DOUBLE ELSE 0.0 END AS score FROM answers"))
def j4(spark, d):
    resp = case(
        K(9), c(lit("<think>x</think> so \\boxed{"), size(), lit("}")), c(lit("\\boxed{"), size(), lit(" cm}")), c(lit("\\boxed{1,0"), size(), lit("}")),
        c(lit("\\boxed{("), size(), lit(", 3)}")), c(lit("\\boxed{"), size(), lit(".00001}")), c(lit("\\boxed{\\text{Blue}}")),
        c(lit("\\boxed{$"), size(), lit("}")), c(lit("\\boxed{2/4}")), c(lit("\\boxed{"), size(), lit("5}")),
    )
    truth = case(
        K(9), size(), size(), c(lit("10"), size()), c(lit("("), size(), lit(",3)")), c(size(), lit(".00002")), "blue", size(), "1/2", size(),
    )
    # a three-digit tail is needed for a thousands comma, so short sizes are padded on both sides
    two = F.lpad(size(), 2, "0")
    resp = F.when(K(9) == 2, c(lit("\\boxed{1,0"), two, lit("}"))).otherwise(resp)
    truth = F.when(K(9) == 2, c(lit("10"), two)).otherwise(truth)
    truth = F.when(K(9) == 7, lit("7/2")).otherwise(truth)
    return scored(answers(spark, d), A.math_grade(resp, truth).getField("score").alias("score"))


@query("j5_hash_number", with_views("answers", """
SELECT uid, CASE WHEN uid % 3 < 2 THEN 1.0::DOUBLE ELSE 0.0 END AS strict, CASE WHEN uid % 3 <> 1 THEN 1.0::DOUBLE ELSE 0.0 END AS flexible FROM answers"""))
def j5(spark, d):
    resp = case(K(3), c(lit("#### "), size()), c(lit("#### "), size(), lit("\nor 99999.5")), c(lit("it is "), size(), lit(" .")))
    return scored(answers(spark, d), A.grade_equal(A.hash_number(resp), size()).alias("strict"), A.grade_equal(A.last_number(resp), size()).alias("flexible"))


@query("j6_multiple_choice", with_views("answers", """
SELECT uid, CASE uid % 4 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 1.0 ELSE 0.0 END AS strict, CASE uid % 4 WHEN 3 THEN 1.0::DOUBLE ELSE 0.0 END AS flexible FROM answers"""))
def j6(spark, d):
    letter = F.substring(lit("ABCD"), (F.col("p_size") % 4 + 1).cast("int"), lit(1))
    resp = case(K(4), c(lit("Answer: "), letter), c(lit("answer : $"), letter, lit("$")), c(lit("Answer: "), F.lower(letter)), c(lit("(A) or ("), letter, lit(")")))
    return scored(answers(spark, d), A.grade_equal(A.choice_strict(resp), letter).alias("strict"), A.grade_equal(A.choice_flexible(resp), letter).alias("flexible"))


@query("j7_ten_way_choice", with_views("answers", """
SELECT uid, CASE uid % 4 WHEN 3 THEN NULL ELSE substr('ABCDEFGHIJ', CAST(p_size % 10 + 1 AS INTEGER), 1) END AS letter,
  substr('ABCDEFGHIJ', CAST(CAST(concat('0x', substr(md5(CAST(uid AS VARCHAR)), 1, 7)) AS BIGINT) % 10 + 1 AS INTEGER), 1) AS guess FROM answers"""))
def j7(spark, d):
    letter = F.substring(lit("ABCDEFGHIJ"), (F.col("p_size") % 10 + 1).cast("int"), lit(1))
    resp = case(
        K(4), c(lit("<|im_start|>user \\boxed{A}<|im_start|>assistant x \\boxed{"), letter, lit("}</s> \\boxed{C}")),
        c(lit("Assistant: Final Answer: "), letter, lit("\nend")), c(lit("the answer\nThe answer is: ("), letter, lit(")\n")), lit("unsure"),
    )
    return answers(spark, d).select("uid", A.ten_way_choice(resp).alias("letter"), A.hashed_guess(F.col("uid").cast("string")).alias("guess"))


@query("j8_table_answer", with_views("answers", "SELECT uid, CASE WHEN uid % 6 < 4 THEN 1.0::DOUBLE ELSE 0.0 END AS score FROM answers"))
def j8(spark, d):
    resp = case(
        K(6), c(lit("<think>3</think> \\boxed{"), size(), lit(" | "), F.col("p_brand"), lit("|x}")), c(lit("\\boxed{"), size(), lit("%}")),
        c(lit("\\boxed{"), F.upper("p_type"), lit("}")), c(lit("\\boxed{$"), size(), lit(",000}")), c(lit("\\boxed{"), size(), lit("|x}")), lit("\\boxed{none}"),
    )
    truth = case(K(6), c(lit("x|"), F.col("p_brand"), lit("|"), size()), (F.col("p_size") / 100).cast("string"), F.col("p_type"), c(size(), lit("000")), c(size(), lit("|x|y")), size())
    return scored(answers(spark, d), A.table_answer(resp, truth).alias("score"))


@query("j9_grid_table_share", with_views("answers", "SELECT uid, CASE uid % 4 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.75 ELSE 0.0 END AS score FROM answers"))
def j9(spark, d):
    cells = lambda b: c(lit("<answer>{'header': ['no', 'name'], 'rows': [['1', '"), F.col("p_brand"), lit("'], ['2', '"), b, lit("']]}</answer>"))
    resp = case(K(4), cells(F.col("p_type")), cells(lit("other")), lit("<answer>{'header': ['no'], 'rows': [['1']]}</answer>"), lit("no tag"))
    truth = c(lit('{"header":["no","name"],"rows":[["1","'), F.col("p_brand"), lit('"],["2","'), F.col("p_type"), lit('"]]}'))
    return scored(answers(spark, d), A.grid_share(resp, truth).alias("score"))


@query("j10_ordering_list", with_views("answers", "SELECT uid, CASE WHEN uid % 4 < 2 THEN 1.0::DOUBLE ELSE 0.0 END AS score FROM answers"))
def j10(spark, d):
    truth = F.array(F.lower("p_type"), lit("blue jay"))
    resp = case(
        K(4), c(lit("<answer>['"), F.col("p_type"), lit("', 'Blue Jay']</answer>")), c(lit("<answer>x</answer><answer>["), F.col("p_type"), lit(", blue jay]</answer>")),
        c(lit("<answer>['blue jay', '"), F.col("p_type"), lit("']</answer>")), lit("[a, b]"),
    )
    return scored(answers(spark, d), A.order_match(resp, truth).alias("score"))


@query("j11_list_edit_distance", """
SELECT doc_id, CAST(CASE WHEN n = 0 THEN 1 ELSE 2 END AS INTEGER) AS distance FROM (SELECT doc_id, len(string_split(text, chr(10))) - 1 AS n FROM documents)""")
def j11(spark, d):
    words = F.col("words")
    # first line replaced and one line added; a one-line text only gets the addition
    changed = F.concat(F.when(F.size(words) > 1, F.array(lit("@@"))).otherwise(F.slice(words, 1, 1)), F.slice(words, lit(2), F.size(words)), F.array(lit("##")))
    docs = documents(spark, d).select("doc_id", F.split("text", "\n").alias("words")).withColumn("changed", changed)
    return docs.select("doc_id", A.list_edit_distance(F.col("words"), F.col("changed")).alias("distance"))


@query("j12_next_node", with_views("answers", "SELECT uid, CASE WHEN uid % 3 = 0 THEN 1.0::DOUBLE ELSE 0.0 END AS score FROM answers"))
def j12(spark, d):
    node = F.substring(lit("ABCDEFGHIJ"), (F.col("p_size") % 10 + 1).cast("int"), lit(1))
    resp = case(K(3), c(lit("<answer>Z</answer> <answer> "), F.lower(node), lit(" </answer>")), c(lit("<answer>"), node, lit("1</answer>")), node)
    return scored(answers(spark, d), A.next_node(resp, node).alias("score"))


@query("j13_grid_match", with_views("answers", """
SELECT uid, CASE uid % 4 WHEN 0 THEN 1.0::DOUBLE ELSE 0.0 END AS exact, CASE uid % 4 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.5 WHEN 2 THEN 0.5 ELSE 0.0 END AS share FROM answers"""))
def j13(spark, d):
    truth = F.array(F.array(F.col("p_size"), lit(2)), F.array(lit(3), lit(4)))
    s = size()
    resp = case(
        K(4), c(lit("<answer>[["), s, lit(", 2],\n [3, 4]]</answer>")), c(lit("<answer>grid [["), s, lit(", 2], [-9, ...]]</answer>")),
        c(lit("<answer>[["), s, lit(", 2]]</answer>")), lit("<answer>none</answer>"),
    )
    a = answers(spark, d).select("uid", A.grid_match(A.answer_grid(resp), truth).alias("r"))
    return scored(a, "r.exact", "r.share")


@query("j14_json_answer", with_views("answers", "SELECT uid, uid % 5 < 3 AS correct FROM answers"))
def j14(spark, d):
    resp = case(
        K(5), c(lit('so "output": ```json\n{"output": {"n": '), size(), lit(', "ok": "True"}}\n```')), c(lit('text {"a": 1} then {"input": "['), size(), lit(', 2]"}')),
        c(lit('{"output": '), size(), lit("}")), c(lit('{"output": '), size(), lit("0}")), lit("nothing"),
    )
    truth = case(
        K(5), c(lit('"output": {"ok": true, "n": '), size(), lit("}")), c(lit('{"input": ['), size(), lit(", 2]}")), c(lit('"output": '), size()), c(lit('"output": '), size()), lit('"output": 1'),
    )
    return answers(spark, d).select("uid", A.json_match()(resp, truth).alias("correct"))


@query("j15_open_answer", with_views("answers", """
SELECT uid, CASE uid % 4 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.25 ELSE 0.0 END AS score, CASE WHEN uid % 4 < 3 THEN 1.0::DOUBLE ELSE 0.0 END AS contained FROM answers"""))
def j15(spark, d):
    name = F.col("p_name")
    resp = case(
        K(4), c(lit("<answer> The "), F.upper(name), lit("! </answer>")), c(F.repeat(lit("<answer>no</answer>"), lit(11)), lit("<answer>"), name, lit("</answer>")),
        c(lit("<answer>a "), name, lit(" or so</answer>")), name,
    )
    gold = F.array(lit("zzz"), c(lit("a "), name))
    return scored(answers(spark, d), A.open_answer(resp, gold).alias("score"), A.open_answer(resp, gold, contained=True).alias("contained"))


@query("j16_format_and_accuracy", with_views("answers", """
SELECT uid, CASE uid % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.9 ELSE 0.1 END AS score FROM answers"""))
def j16(spark, d):
    resp = case(K(3), c(lit("<think>x</think> \\boxed{"), size(), lit("}")), c(lit("\\boxed{"), size(), lit("}")), c(lit("<think>x</think> \\boxed{"), size(), lit("1}")))
    return scored(answers(spark, d), A.format_and_accuracy(resp, size()).alias("score"))


@query("j17_output_match", with_views("answers", "SELECT uid, uid % 6 < 4 AS same FROM answers"))
def j17(spark, d):
    got = case(
        K(6), c(size(), lit("\r\nyes\n")), c(size(), lit(".0000001 YES")), c(lit("  "), size()), c(size(), lit("\na  b")), c(size(), lit(" no")), c(size(), lit("\n\n1")),
    )
    want = case(K(6), c(size(), lit("\nyes")), c(size(), lit(" yes")), c(size(), lit(" ")), c(size(), lit("\na b")), c(size(), lit(" yes")), c(size(), lit("\n1")))
    return answers(spark, d).select("uid", A.output_match(got, want).alias("same"))


@query("j18_code_blocks", with_views("answers", "SELECT uid, concat('x = ', p_size, chr(10), 'print(x)') AS code FROM answers"))
def j18(spark, d):
    resp = c(lit("<think>```\nno\n```</think> try ```python\nx = "), size(), lit("\n``` and\n```\nprint(x)\n```"))
    return answers(spark, d).select("uid", A.code_blocks(resp).alias("code"))


def check_counts(df, key, response, checks, lang):
    """(check, followed, checked) over a whole table of texts."""
    rows = df.select(response.alias("v"), lang.alias("_lang"))
    counts = rows.agg(
        F.count("*").alias("checked"),
        *[F.count_if(F.coalesce(I.CHECKS[name](F.col("v"), {**{k: arg(x) for k, x in args.items()}, "lang": F.col("_lang")}), lit(False))).alias(f"c{i}")
          for i, (name, args) in enumerate(checks)],
    )
    e = F.explode(F.array(*[F.struct(lit(f"{i}:{n}").alias("check"), F.col(f"c{i}").alias("followed")) for i, (n, _) in enumerate(checks)]))
    return counts.select("checked", e.alias("e")).select("e.check", "e.followed", "checked")


def arg(x):
    """Literal of the type a check expects: text, int or text list."""
    if isinstance(x, list):
        return F.array(*[lit(v) for v in x])
    return lit(x).cast("int") if isinstance(x, int) else lit(x)


AL, LT = I.AT_LEAST, I.LESS_THAN
BASE_CHECKS = [
    ("keywords:existence", {"keywords": ["the", "and"]}, "regexp_matches(text, '(?i)the') AND regexp_matches(text, '(?i)and')"),
    ("keywords:frequency", {"keyword": "the", "relation": AL, "n": 5}, "len(regexp_extract_all(text, '(?i)the')) >= 5"),
    ("keywords:forbidden_words", {"keywords": ["the", "que"]}, "NOT regexp_matches(text, '(?i)(^|[^\\p{L}\\p{N}_])(the|que)($|[^\\p{L}\\p{N}_])')"),
    ("keywords:letter_frequency", {"letter": "e", "relation": LT, "n": 200}, "length(lower(text)) - length(replace(lower(text), 'e', '')) < 200"),
    ("language:response_language", {"wanted_lang": "fr"}, "lang = 'fr'"),
    ("length_constraints:number_paragraphs", {"n": 1}, "len(regexp_split_to_array(text, '\\s?\\*\\*\\*\\s?')) = 1"),
    ("length_constraints:number_words", {"relation": AL, "n": 100}, "len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) >= 100"),
    ("detectable_content:number_placeholders", {"n": 1}, "len(regexp_extract_all(text, '\\[.*?\\]')) >= 1"),
    ("detectable_content:postscript", {"marker": "P.S."}, "regexp_matches(lower(text), 'p\\.\\s?s\\.')"),
    ("detectable_format:number_bullet_lists", {"n": 0}, "NOT regexp_matches(text, '(?m)^\\s*\\*[^\\*]') AND NOT regexp_matches(text, '(?m)^\\s*-')"),
    ("detectable_format:constrained_response", {"options": ["the ", "le "]}, "contains(text, 'the ') OR contains(text, 'le ')"),
    ("detectable_format:number_highlighted_sections", {"n": 1}, "regexp_matches(text, '\\*[^\\n\\*]*[^\\s\\*][^\\n\\*]*\\*')"),
    ("detectable_format:multiple_sections", {"splitter": "the", "n": 1}, "regexp_matches(text, 'the\\s?\\d')"),
    ("detectable_format:title", {}, "regexp_matches(text, '<<[^\\n]*[^\\s<>][^\\n]*>>')"),
    ("combination:repeat_prompt", {"prompt": "The"}, "starts_with(lower(trim(text)), 'the')"),
    ("startend:end_checker", {"phrase": "n."}, "ends_with(lower(rtrim(text)), 'n.')"),
    ("startend:quotation", {}, "false"),
    ("change_case:english_capital", {}, "text = upper(text) AND text <> lower(text) AND lang = 'en'"),
    ("change_case:english_lowercase", {}, "text = lower(text) AND text <> upper(text) AND lang = 'en'"),
    ("punctuation:no_comma", {}, "NOT contains(text, ',')"),
]
MORE_CHECKS = [
    ("keywords:word_once", {"keyword": "the"}, "len(regexp_extract_all(text, '(?i)the')) = 1"),
    ("keywords:exclude_word_harder", {"keyword": "the"}, "NOT contains(text, ' the ')"),
    ("copy:copy", {"prompt": "x"}, "false"),
    ("detectable_format:sentence_hyphens", {}, "false"),
    ("detectable_format:square_brackets", {}, "false"),
    ("first_word:first_word_answer", {"word": "the"}, "lower(regexp_extract(text, '^\\s*(\\S+)', 1)) = 'the'"),
    ("last_word:last_word_answer", {"word": "hand"}, "lower(regexp_replace(regexp_extract(text, '(\\S+)\\s*$', 1), '[^\\p{L}\\p{N}_]', '', 'g')) = 'hand'"),
    ("punctuation:punctuation_dot", {}, "NOT contains(text, '.')"),
    ("punctuation:punctuation_exclamation", {}, "NOT contains(text, '!')"),
    ("letters:letter_counting", {"relation": AL, "n": 500}, "len(regexp_extract_all(text, '[a-zA-Z]')) >= 500"),
    ("count:count_increment_word", {"keyword": "the", "keyword2": "and"}, "len(regexp_extract_all(text, '(?i)the')) = 1 AND len(regexp_extract_all(text, '(?i)and')) = 2"),
    ("keywords:palindrome", {}, "len(list_filter(regexp_extract_all(text, '\\S+'), lambda w: w = reverse(w))) > 0"),
]


def checks_sql(checks):
    return "\nUNION ALL ".join(
        f"SELECT '{i}:{n}' AS \"check\", count(*) FILTER ({sql}) AS followed, count(*) AS checked FROM documents"
        for i, (n, _, sql) in enumerate(checks)
    )


@query("j19_instruction_checks", checks_sql(BASE_CHECKS))
def j19(spark, d):
    return check_counts(documents(spark, d), "doc_id", F.col("text"), [(n, a) for n, a, _ in BASE_CHECKS], F.col("lang"))


@query("j20_extended_checks", checks_sql(MORE_CHECKS))
def j20(spark, d):
    return check_counts(documents(spark, d), "doc_id", F.col("text"), [(n, a) for n, a, _ in MORE_CHECKS], F.col("lang"))


BATTERY = ["punctuation:no_comma", "length_constraints:number_words", "keywords:letter_frequency"]


@query("j19_instruction_battery", """
SELECT doc_id, CAST(NOT contains(text, ',') AND len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) < 300 AND length(lower(text)) - length(replace(lower(text), 'e', '')) >= doc_id % 50 AS DOUBLE) AS score,
  3 AS instructions, CAST(NOT contains(text, ',') AS BIGINT) + CAST(len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) < 300 AS BIGINT)
  + CAST(length(lower(text)) - length(replace(lower(text), 'e', '')) >= doc_id % 50 AS BIGINT) AS followed FROM documents""".replace("3 AS instructions", "CAST(3 AS BIGINT) AS instructions"))
def j19_battery(spark, d):
    docs = documents(spark, d).select(
        "doc_id", "text", "lang", F.array(*[lit(n) for n in BATTERY]).alias("ids"),
        F.array(lit("{}"), lit('{"relation":"less than","n":300}'),
                c(lit('{"letter":"e","relation":"at least","n":'), (F.col("doc_id") % 50).cast("string"), lit("}"))).alias("kw"),
    )
    return S.instruction_scores(docs, ["doc_id"], "text", "ids", "kw", F.col("lang"), BATTERY)


@query("j19_two_responses", with_views("answers", """
SELECT uid, uid % 5 = 0 AS two_responses, uid % 5 IN (0, 4) AS starts_named, uid % 5 = 3 AS json_ok FROM answers"""))
def j19_shapes(spark, d):
    name = F.col("p_name")
    v = case(
        K(5), c(name, lit("******"), F.col("p_brand")), c(lit("x"), name, lit("******x"), name), c(lit("a******b******"), name),
        c(lit('```json\n{"a": '), size(), lit("}\n```")), c(name, lit(" {broken")),
    )
    a = {"prompt": F.upper(name)}
    return answers(spark, d).select(
        "uid", I.CHECKS["combination:two_responses"](v, a).alias("two_responses"),
        I.CHECKS["combination:repeat_prompt"](v, a).alias("starts_named"), I.CHECKS["detectable_format:json_format"](v, a).alias("json_ok"),
    )


@query("j21_join_map_f1", with_views("answers", """
SELECT uid, CASE uid % 4 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.5 WHEN 2 THEN 0.67 ELSE 0.0 END AS score FROM answers"""))
def j21(spark, d):
    truth = F.create_map(lit("a"), F.col("p_brand"), lit("b"), F.col("p_type"))
    answer = case(K(4), truth, F.create_map(lit("a"), F.col("p_brand"), lit("b"), lit("?")), F.create_map(lit("a"), F.col("p_brand")), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    return scored(answers(spark, d), B.join_map_f1(truth, answer).alias("score"))


@query("j22_column_type_match", with_views("answers", "SELECT uid, CASE WHEN uid % 3 < 2 THEN 1.0::DOUBLE ELSE 0.0 END AS score FROM answers"))
def j22(spark, d):
    resp = case(K(3), c(lit("The column is **"), F.upper("p_type"), lit("**.")), c(lit("so \\boxed{\\text{"), F.col("p_type"), lit("}}")), c(F.col("p_type"), lit(" or not")))
    return scored(answers(spark, d), B.column_type_match(F.col("p_type"), resp).alias("score"))


@query("j23_sentence_order", with_views("answers", """
SELECT uid, CASE uid % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.0 ELSE 0.5 END AS score FROM answers"""))
def j23(spark, d):
    s1, s2 = c(lit("alpha one "), F.col("p_name")), c(lit("zulu two "), F.col("p_brand"))
    resp = case(K(3), c(lit("<PLOT_SUMMARY>"), s1, lit(". "), s2, lit(".</PLOT_SUMMARY>")), c(s2, lit(". "), s1, lit(".")), c(s1, lit(".")))
    # with one sentence left, both truth sentences fall on it
    return scored(answers(spark, d), B.sentence_order()(c(s1, lit(". "), s2, lit(".")), resp).alias("score"))


@query("j24_typo_match", with_views("answers", "SELECT uid, CASE WHEN uid % 4 < 3 THEN 1.0::DOUBLE ELSE 0.0 END AS score FROM answers"))
def j24(spark, d):
    name = F.col("p_name")
    resp = case(K(4), c(lit("<solution>no</solution> <solution>it is "), name, lit("!</solution>")), c(lit("text --- "), name, lit(" --- end")), c(F.lit("so\n"), name), c(lit("<solution>none</solution> "), name))
    return scored(answers(spark, d), B.typo_match(name, resp).alias("score"))


@query("j25_word_groups", with_views("answers", """
SELECT uid, CASE uid % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.5 ELSE 0.0 END AS score, CASE uid % 3 WHEN 0 THEN 1.0::DOUBLE ELSE 0.0 END AS tagged FROM answers"""))
def j25(spark, d):
    first = c(F.col("p_brand"), lit(",b,c,d"))
    truth = c(first, lit(",e,f,g,h"))
    resp = case(
        K(3), c(lit("**d, c, b, "), F.upper("p_brand"), lit(",h,g,f,e** <solution>h,e,f,g,d,c,b,"), F.col("p_brand"), lit("</solution>")), c(lit("**x** **"), first, lit(",e,f,g,z**")), lit("plain"),
    )
    return scored(answers(spark, d), B.word_groups(truth, resp).alias("score"), B.word_groups_tagged(truth, resp).alias("tagged"))


@query("j26_reasoning_tasks", with_views("answers", """
SELECT uid, CASE WHEN uid % 3 < 2 THEN 1.0::DOUBLE ELSE 0.0 END AS traversal, CASE WHEN uid % 3 < 2 THEN 1.0::DOUBLE ELSE 0.0 END AS spatial,
  CASE WHEN uid % 3 < 2 THEN 1.0::DOUBLE ELSE 0.0 END AS verdicts, CASE uid % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.333333 ELSE 0.0 END AS positional,
  CASE WHEN uid % 3 < 2 THEN 1.0::DOUBLE ELSE 0.0 END AS emphasised FROM answers"""))
def j26(spark, d):
    brand = F.lower("p_brand")
    t1 = c(brand, lit(" zoe max"))
    r1 = case(K(3), c(lit("**x** then **"), brand, lit(", Zoe, Max**")), c(lit("**"), brand, lit("** **zoe** **max**")), c(lit("**max zoe "), brand, lit("**")))
    t2 = case(K(3), lit("3"), lit("triangle"), size())
    r2 = case(K(3), lit("**three** and **x**"), lit("**equilateral triangle**"), lit("**a circle square thing**"))
    t3 = lit("yes, no, unknown")
    r3 = case(K(3), lit("<solution>yes, no, unknown</solution>"), lit("**Yes**, **no** and **unknown**."), lit("they say no, no, yes"))
    r4 = case(K(3), lit("yes, no, unknown"), lit("yes, yes"), lit("no"))
    t4 = lit("yes, no, unknown")
    credit = B.positional_credit(t4, r4)
    r5 = case(K(3), c(lit("***no*** ***"), F.col("p_type"), lit("***")), c(lit("it is "), F.col("p_type")), c(F.col("p_type"), lit(" or other")))
    return scored(
        answers(spark, d), B.traversal(t1, r1).alias("traversal"), B.spatial(t2, r2).alias("spatial"), B.verdicts(t3, r3).alias("verdicts"),
        (credit * 2 - (credit == 1.0).cast("double")).alias("positional"), B.last_emphasised(F.col("p_type"), r5).alias("emphasised"),
    )


@query("j27_task_dispatch", with_views("answers", """
SELECT CASE uid % 3 WHEN 0 THEN 'cta' WHEN 1 THEN 'typos' ELSE 'zebra_puzzle' END AS task, count(*) AS n, round(avg(CAST(p_size % 2 = 0 AS INTEGER)), 6) AS mean_score FROM answers GROUP BY 1"""))
def j27(spark, d):
    a = answers(spark, d).withColumns({
        "task": case(K(3), "cta", "typos", "zebra_puzzle"),
        "resp": F.when(F.col("p_size") % 2 == 0, case(K(3), F.col("p_type"), c(lit("<solution>"), F.col("p_type"), lit("</solution>")), c(lit("***"), F.col("p_type"), lit("***")))).otherwise(lit("none at all")),
    })
    out = S.task_scores(a, "task", "p_type", "resp").groupBy("task").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"))
    return rnd(out)


@query("d7_scorer_dispatch", with_views("answers", """
SELECT CASE uid % 7 WHEN 0 THEN 'math_default' WHEN 1 THEN 'grid' WHEN 2 THEN 'choice' WHEN 3 THEN 'ten_way' WHEN 4 THEN 'math_boxed_numeric' WHEN 5 THEN 'open_answer' ELSE NULL END AS scorer, count(*) AS n FROM answers GROUP BY 1"""))
def d7(spark, d):
    source = case(K(7), c(lit("math__"), F.col("p_type")), "simulation__arcagi1", "stem__gpqa_no_box", "stem__gpqa_diamond", "math__x", "searchR1_nq", "other")
    metric = F.when(K(7) == 4, "prime_math")
    a = answers(spark, d).select(S.scorer_name(source, metric).alias("scorer"))
    return a.groupBy("scorer").agg(F.count("*").alias("n"))


# a source for each dispatch rule (with its metric), and a right and a wrong response with its truth
BOX = ("12", "<think>t</think>\\boxed{12}", "<think>t</think>\\boxed{13}")
CODE = ("7\n8", "7\r\n8\n", "7\n9")
GRID_PAIR = ("[[1, 2]]", "<answer>[[1, 2]]</answer>", "<answer>[[1, 3]]</answer>")
EXAMPLES = {
    "math_boxed_numeric": BOX, "math_default": BOX, "judge": ("x", "right", "wrong"), "code_outputs": CODE,
    "json_answer": ('"output": 3', '{"output": 3}', '{"output": 4}'), "grid": GRID_PAIR,
    "grid_table": (
        '{"header":["no"],"rows":[["1"]]}', "<answer>{'header': ['no'], 'rows': [['1']]}</answer>", "no tag"),
    "ordering": ('["red","blue"]', "<answer>['Red', 'blue']</answer>", "<answer>['blue', 'red']</answer>"),
    "next_node": ("B", "<answer>b</answer>", "<answer>c</answer>"), "table": BOX, "choice": ("C", "Answer: C", "Answer: D"),
    "ten_way": ("C", "\\boxed{C}", "\\boxed{D}"), "instructions": ("", "no mark", "one, two"), "benchmark_task": ("red", "***red***", "***blue***"),
    "instructions_extended": ("", "no mark", "a mark!"), "hash_number": ("12", "#### 12", "#### 13"), "boxed_equivalence": BOX,
    "answer_line": ("12", "Answer: 12", "Answer: 13"), "open_answer": ('["red"]', "<answer>red</answer>", "<answer>blue</answer>"),
    "format_and_accuracy": BOX,
}


def first_rule(source, metric):
    """Scorer of the first rule that fits: a general prefix hides a later rule for one of its sources."""
    for kind, value, override, name in S.DISPATCH:
        hit = source == value if kind == "equal" else source.startswith(value) and (kind != "no_box" or "no_box" in source)
        if hit and override in (None, metric):
            return name


RULES = [(f"rule{i:02d}", f"{v}_no_box" if kind == "no_box" else v, override) for i, (kind, v, override, _) in enumerate(S.DISPATCH)]


@query("j_scored_pass_rates", with_views("answers", f"""
SELECT concat('rule', lpad(CAST(uid % {len(RULES)} AS VARCHAR), 2, '0')) AS rule, count(*) AS n_responses,
  round(avg(CAST(p_size % 2 = 0 AS INTEGER)), 6) AS pass_rate FROM answers GROUP BY 1"""))
def j_all(spark, d):
    """All dispatch rules in one mixed table; each row is right or wrong by its size."""
    rule = spark.createDataFrame(
        [(i, n, src, metric, *EXAMPLES[first_rule(src, metric)]) for i, (n, src, metric) in enumerate(RULES)],
        "no int, rule string, source string, metric string, truth string, right string, wrong string",
    )
    good = F.col("p_size") % 2 == 0
    a = answers(spark, d).select("uid", "p_size", K(len(RULES)).cast("int").alias("no")).join(F.broadcast(rule), "no").select(
        "uid", "rule", "source", "metric", "truth", F.when(good, F.col("right")).otherwise(F.col("wrong")).alias("response"),
        good.cast("double").alias("verdict"), lit("zebra_puzzle").alias("task"),
        F.array(F.when(F.col("source") == "ood__ifbench", lit("punctuation:punctuation_exclamation")).otherwise(lit("punctuation:no_comma"))).alias("ids"),
        F.array(lit("{}")).alias("kwargs"),
    )
    out = S.score_mixed(a, F.col("source"), F.col("metric"), "response", "truth", "verdict", "task", "ids", "kwargs", lit("en"))
    return rnd(pass_rate(out, ["rule"], F.col("score")))


@query("j28_repetition_score")
def j28(spark, d):
    return documents(spark, d).select("doc_id", A.repetitive()(F.col("text")).alias("share")).withColumn(
        "repetitive", F.col("share") > A.REPETITION_LIMIT
    )


@query("j29_batched_scoring", with_views("answers", "SELECT uid, CAST(length(p_name) % 3 = 0 AS DOUBLE) AS score FROM answers"))
def j29(spark, d):
    import pandas as pd

    def batch(responses, truths):
        return (responses.str.len() % 3 == 0).astype("float64")

    batch.__annotations__ = {"responses": pd.Series, "truths": pd.Series, "return": pd.Series}
    S.register_scorer("batched_length", F.pandas_udf(batch, "double"))
    a = answers(spark, d).withColumn("scorer", lit("batched_length"))
    return S.score_responses(a, "p_name", "p_brand", "scorer", ["batched_length"]).select("uid", "score")


@query("j30_precomputed_scores", with_views("responses", """
SELECT uid, resp_idx, CASE WHEN pred = 'A' THEN reward ELSE score END AS final_score FROM responses"""))
def j30(spark, d):
    r = responses(spark, d, source=False).withColumn("rm_score", F.when(F.col("pred") == "A", F.col("reward")))
    return S.apply_strategy(r, "batch", "score", "rm_score", "resp_len").select("uid", "resp_idx", "final_score")


@query("j31_skip_scored", with_views("responses", "SELECT uid, resp_idx FROM responses WHERE pred <> 'R'"))
def j31(spark, d):
    r = responses(spark, d, source=False)
    return S.unscored(r, r.filter(F.col("pred") == "R"), ["uid", "resp_idx"]).select("uid", "resp_idx")


@query("j32_table_equality", with_views("responses", """
SELECT uid, CAST(count(*) FILTER (uid % 5 = 0 AND pred = 'A') = 0 AS DOUBLE) AS score, count(*) FILTER (uid % 5 = 0 AND pred = 'A') AS mismatches FROM responses GROUP BY uid"""))
def j32(spark, d):
    r = responses(spark, d, source=False)
    long = r.select("uid", F.col("resp_idx").alias("row_no"), F.explode(F.array(
        F.struct(lit("index").alias("column"), F.col("resp_idx").cast("string").alias("value")),
        F.struct(lit(" reward ").alias("column"), F.col("reward").cast("string").alias("value")),
        F.struct(lit("flag").alias("column"), F.col("pred").alias("value")),
    )).alias("e")).select("uid", "row_no", "e.column", "e.value")
    other = long.withColumn("value", F.when((F.col("uid") % 5 == 0) & (F.col("value") == "A"), lit("Z"))
                            .when(F.trim("column") == "reward", (F.col("value").cast("double") + 1e-8).cast("string")).otherwise(F.col("value")))
    return S.table_equality(other, long, "uid", "row_no", "column", "value")


@query("u1_custom_scorer", with_views("answers", "SELECT uid, CAST(p_size > 25 AS DOUBLE) AS score FROM answers"))
def u1(spark, d):
    S.register_scorer("size_over", lambda r, t: (t.cast("int") > 25))
    a = answers(spark, d).withColumn("scorer", lit("size_over"))
    return S.score_responses(a, "response", "ground_truth", "scorer", ["size_over"]).select("uid", "score")


@query("u2_scoring_strategies", with_views("responses", """
SELECT uid, resp_idx, score AS naive, round(score + least(-(resp_len - 48) / 16.0, 0), 6) AS overlong FROM responses""".replace("resp_len - 48", "resp_len - (64 - 16)")))
def u2(spark, d):
    r = responses(spark, d, source=False).withColumn("rm", F.lit(None).cast("double"))
    out = S.apply_strategy(r, "naive", "score", "rm", "resp_len").withColumnRenamed("final_score", "naive")
    out = S.apply_strategy(out, "overlong", "score", "rm", "resp_len").withColumnRenamed("final_score", "overlong")
    return rnd(out.select("uid", "resp_idx", "naive", "overlong"))


@query("u3_result_normalisation", with_views("answers", """
SELECT uid, CASE uid % 3 WHEN 0 THEN CAST(p_size > 25 AS DOUBLE) WHEN 1 THEN CAST(p_size AS DOUBLE) ELSE -1.0 END AS score FROM answers"""))
def u3(spark, d):
    flag = S.as_result(F.col("p_size") > 25).getField("score")
    number = S.as_result(F.col("p_size")).getField("score")
    record = S.as_result({"score": lit(-1.0), "acc": lit(False)}).getField("score")
    return answers(spark, d).select("uid", case(K(3), flag, number, record).alias("score"))


@query("u5_filter_factory", "SELECT doc_id FROM documents WHERE n_chars BETWEEN 200 AND 3000 AND lang <> 'de'")
def u5(spark, d):
    rules = [lambda r: r["n_chars"].between(200, 3000), lambda r: r["lang"] != "de"]
    docs = documents(spark, d)
    cols = {n: F.col(n) for n in docs.columns}
    for rule in rules:
        docs = docs.filter(rule(cols))
    return docs.select("doc_id")


@query("u6_row_expansion", with_views("answers", "SELECT uid, 'chosen' AS side, p_name AS response FROM answers UNION ALL SELECT uid, 'rejected', p_brand FROM answers"))
def u6(spark, d):
    return answers(spark, d).select("uid", F.stack(lit(2), lit("chosen"), F.col("p_name"), lit("rejected"), F.col("p_brand")).alias("side", "response"))


