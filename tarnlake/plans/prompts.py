"""Prompt building, predicates and quality gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnlake.functions import predicates as C
from tarnlake.functions import prompts as B
from tarnlake.functions.text import token_count
from tarnlake.operators import prompts as P
from tarnlake.operators.batches import positional_split
from tarnlake.operators.ranks import gather, row_index
from tarnlake.operators.sets import concat_strict
from tarnlake.plans.registry import query
from tarnlake.plans.token_metrics import rnd
from tarnlake.plans.views import answers, documents, responses, table, with_views
from tarnlake.session import scratch_path
from tarnlake.sources.files import read_table, write_tables

TOK = "len(regexp_extract_all({0}, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]'))"


def tok(x):
    return TOK.format(x)


def q(text):
    return "'" + text.replace("'", "''") + "'"


def messages(spark, d):
    """Message array of each conversation."""
    c = row_index(table(spark, d, "conversations"), [F.col("turn")], ["conv_id"], "pos")
    out = gather(c, ["conv_id"], "pos", {"role": F.col("role"), "content": F.col("text")})
    zipped = F.transform(F.arrays_zip("role", "content"), lambda z: F.struct(z["role"].alias("role"), z["content"].alias("content")))
    return out.select("conv_id", zipped.alias("messages"))


MSG = """
WITH c AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations)
"""


@query("b1_row_index", "SELECT doc_id, row_number() OVER (PARTITION BY 1 ORDER BY doc_id) - 1 AS index FROM documents")
def b1(spark, d):
    return row_index(documents(spark, d).select("doc_id"), [F.col("doc_id")], name="index")


@query("b2_instruction_suffix", f"SELECT doc_id, md5(concat(text, {q(B.BOXED_SUFFIX)})) AS prompt_hash, 'user' AS role FROM documents")
def b2(spark, d):
    p = B.user_prompt(F.concat("text", F.lit(B.BOXED_SUFFIX)))
    return documents(spark, d).select("doc_id", F.md5(p[0]["content"]).alias("prompt_hash"), p[0]["role"].alias("role"))


@query("b3_first_of_list_answer", "SELECT doc_id, string_split(text, ' ')[1] AS answer FROM documents")
def b3(spark, d):
    return documents(spark, d).select("doc_id", B.first_or_self(F.split("text", " ")).alias("answer"))


T_IN = "Given the {{given_type}}: {{given}}\nPredict the input.\n{{refcode}}"
T_OUT = "Given the {{given_type}}: {{given}}\nPredict the output.\n{{refcode}}"


@query("b4_template_substitution", with_views("answers", f"""
, x AS (SELECT uid, p_name, p_brand, p_type, CASE WHEN p_size % 2 = 0 THEN 'input' ELSE 'output' END AS given_type FROM answers)
SELECT uid, replace(replace(replace(CASE WHEN given_type = 'output' THEN {q(T_IN)} ELSE {q(T_OUT)} END, '{{{{given_type}}}}', given_type),
  '{{{{given}}}}', CASE WHEN given_type = 'input' THEN p_name ELSE p_brand END), '{{{{refcode}}}}', p_type) AS prompt FROM x"""))
def b4(spark, d):
    a = answers(spark, d).withColumn("given_type", F.when(F.col("p_size") % 2 == 0, "input").otherwise("output"))
    t = F.when(F.col("given_type") == "output", T_IN).otherwise(T_OUT)
    given = F.when(F.col("given_type") == "input", F.col("p_name")).otherwise(F.col("p_brand"))
    return a.select("uid", B.fill(t, {"given_type": F.col("given_type"), "given": given, "refcode": F.col("p_type")}).alias("prompt"))


@query("b5_zero_style_prompt", f"""
SELECT doc_id, md5(concat('<|im_start|>system', chr(10), {q(B.ZERO_SYSTEM)}, '<|im_end|>', chr(10), '<|im_start|>user', chr(10), text, chr(10),
  'Answer briefly.', '<|im_end|>', chr(10), '<|im_start|>assistant', chr(10), '<think>')) AS prompt_hash FROM documents""")
def b5(spark, d):
    return documents(spark, d).select("doc_id", F.md5(B.zero_style(F.col("text"), "Answer briefly.")).alias("prompt_hash"))


@query("b6_chat_template", MSG + """
SELECT conv_id, md5(concat(string_agg(concat('<|im_start|>', role, chr(10), text, '<|im_end|>', chr(10)), '' ORDER BY pos), '<|im_start|>assistant', chr(10))) AS prompt_hash FROM c GROUP BY 1""")
def b6(spark, d):
    return messages(spark, d).select("conv_id", F.md5(B.render_chat(F.col("messages"), True)).alias("prompt_hash"))


@query("b7_question_extraction", """
SELECT conv_id, coalesce(arg_min(text, turn) FILTER (role = 'user'), 'No question found') AS question FROM conversations GROUP BY conv_id""")
def b7(spark, d):
    c = table(spark, d, "conversations")
    on = F.when(F.col("role") == "user", F.col("turn"))
    return c.groupBy("conv_id").agg(F.coalesce(F.min_by("text", on), F.lit(B.NO_QUESTION)).alias("question"))


@query("b8_message_concatenation", MSG + """
SELECT conv_id, md5(string_agg(text, '' ORDER BY pos)) AS text_hash FROM c GROUP BY 1""")
def b8(spark, d):
    return messages(spark, d).select("conv_id", F.md5(B.joined_contents(F.col("messages"))).alias("text_hash"))


@query("b9_lettered_options", """
SELECT doc_id, concat('Options are:', chr(10), coalesce((SELECT string_agg(concat('(', chr(CAST(64 + i AS INTEGER)), '): ', w, chr(10)), '' ORDER BY i) FROM (
  SELECT unnest(string_split(text, chr(10))) AS w, generate_subscripts(string_split(text, chr(10)), 1) AS i) WHERE i <= 10), '')) AS options FROM documents""")
def b9(spark, d):
    return documents(spark, d).select("doc_id", B.lettered_options(F.split("text", "\n")).alias("options"))


@query("b10_shuffled_choices", with_views("answers", """
, x AS (SELECT uid, unnest([p_name, p_brand, p_type, CAST(p_size AS VARCHAR)]) AS c, generate_subscripts([1, 2, 3, 4], 1) - 1 AS i, CAST(p_size AS VARCHAR) AS correct FROM answers),
r AS (SELECT uid, c, correct, row_number() OVER (PARTITION BY uid ORDER BY md5(concat(uid, '42-', i))) AS pos FROM x)
SELECT uid, string_agg(concat(chr(CAST(64 + pos AS INTEGER)), ') ', c, chr(10)), '' ORDER BY pos) AS choices,
       chr(CAST(64 + min(pos) FILTER (c = correct) AS INTEGER)) AS gold FROM r GROUP BY uid"""))
def b10(spark, d):
    a = answers(spark, d)
    ch = B.shuffled_choices(F.array("p_name", "p_brand", "p_type", F.col("p_size").cast("string")), F.col("uid"), "42")
    a = a.select("uid", "p_size", ch.alias("c"))
    return a.select("uid", B.choice_lines(F.col("c")).alias("choices"), B.gold_letter(F.col("c"), F.col("p_size").cast("string")).alias("gold"))


@query("b11_choice_cleaning", """
SELECT doc_id, md5(replace(regexp_replace(replace(regexp_replace(concat('  [', source, '] a [title]', text, ' [note] '), '^[ \\t\\n\\r\\f\\x0b]+|[ \\t\\n\\r\\f\\x0b]+$', '', 'g'), ' [title]', '. '), '\\[.*?\\]', '', 'g'), '  ', ' ')) AS choice_hash FROM documents""")
def b11(spark, d):
    raw = F.concat(F.lit("  ["), F.col("source"), F.lit("] a [title]"), F.col("text"), F.lit(" [note] "))
    return documents(spark, d).select("doc_id", F.md5(B.clean_choice(raw)).alias("choice_hash"))


MATRIX = with_views("responses", """
, cells AS (SELECT uid, resp_idx, concat('| ', resp_idx, ' | ', pred, ' | ', resp_len, ' |') AS line FROM responses)
""")


def matrices(spark, d):
    r = responses(spark, d, source=False)
    row = F.array(F.col("resp_idx").cast("string"), F.col("pred"), F.col("resp_len").cast("string"))
    m = gather(r, ["uid"], "resp_idx", {"rows": row})
    head = F.array(F.array(F.lit("no"), F.lit("flag"), F.lit("size")))
    return m.withColumn("rows", F.concat(head, F.col("rows")))


@query("b12_matrix_to_markdown", MATRIX + """
SELECT uid, concat('| no | flag | size |', chr(10), '|---|---|---|', chr(10), string_agg(line, chr(10) ORDER BY resp_idx)) AS md FROM cells GROUP BY 1""")
def b12(spark, d):
    return matrices(spark, d).select("uid", B.markdown_table(F.col("rows")).alias("md"))


@query("b13_html_table_to_markdown", MATRIX + """
SELECT uid, concat('| lines &  | of ', uid, ' |  |', chr(10), '| --- | --- | --- |', chr(10), string_agg(line, chr(10) ORDER BY resp_idx)) AS md FROM cells GROUP BY 1""".replace("lines &  | of ', uid, ' |  |", "lines & | order ', uid, ' |  |"))
def b13(spark, d):
    r = responses(spark, d, source=False)
    tr = F.concat(
        F.lit("<tr><td> "), F.col("resp_idx").cast("string"), F.lit("</td><td><b>"), F.col("pred"), F.lit("</b></td><td>"),
        F.col("resp_len").cast("string"), F.lit("</td></tr>\n"),
    )
    m = gather(r, ["uid"], "resp_idx", {"rows": tr})
    html = F.concat(
        F.lit("<table><tr><th>lines &amp;</th><th colspan=\"2\">order "), F.col("uid").cast("string"), F.lit("</th></tr>\n"),
        F.array_join("rows", ""), F.lit("</table>"),
    )
    return m.select("uid", B.html_to_markdown()(html).alias("md"))


@query("b14_context_assembly", MATRIX + """
SELECT uid, concat('before', chr(10), 'the table', chr(10), '| no | flag | size |', chr(10), '| --- | --- | --- |', chr(10), string_agg(line, chr(10) ORDER BY resp_idx), chr(10), 'after') AS context FROM cells GROUP BY 1""")
def b14(spark, d):
    ctx = B.assembled_context(
        F.array(F.lit("before"), F.lit("the table")), B.markdown_table(F.col("rows"), spaced=True), F.array(F.lit("after"))
    )
    return matrices(spark, d).select("uid", ctx.alias("context"))


@query("b15_answer_list_join", "SELECT doc_id, replace(text, ' ', '|') AS answer FROM documents")
def b15(spark, d):
    return documents(spark, d).select("doc_id", F.array_join(F.split("text", " "), "|").alias("answer"))


@query("b16_numeric_answer", with_views("answers", """
, x AS (SELECT uid, p_size AS s, uid % 6 AS k FROM answers)
SELECT uid, round(CASE k WHEN 0 THEN 1000.0 * s + 234 WHEN 1 THEN s WHEN 2 THEN s / 100.0 WHEN 3 THEN s / 4.0 WHEN 4 THEN NULL ELSE -s / 8.0 / 100 END, 6) AS value FROM x"""))
def b16(spark, d):
    a = answers(spark, d)
    s, k = F.col("p_size").cast("string"), F.col("uid") % 6
    text = (
        F.when(k == 0, F.concat(s, F.lit(",234"))).when(k == 1, F.concat(F.lit("$"), s)).when(k == 2, F.concat(s, F.lit("%")))
        .when(k == 3, F.concat(s, F.lit(":4"))).when(k == 4, F.concat(s, F.lit(" units"))).otherwise(F.concat(F.lit("(-"), s, F.lit(" / 8%)")))
    )
    text = F.when(k == 5, F.concat(F.lit("-"), s, F.lit(" / 8%"))).otherwise(text)
    return rnd(a.select("uid", B.numeric_answer(text).alias("value")))


@query("b17_few_shot_grids", with_views("responses", """
, g AS (SELECT uid, resp_idx, concat('[[', resp_idx, ', ', resp_len, ']]') AS i, concat('[[', resp_len, ', ', resp_idx, ']]') AS o, count(*) OVER (PARTITION BY uid) AS n FROM responses),
k AS (SELECT *, least(n - 1, 6) AS shown FROM g)
SELECT uid, coalesce(string_agg(concat('Example ', resp_idx + 1, chr(10), 'Input: ', i, chr(10), 'Output: ', o, chr(10), chr(10)), '' ORDER BY resp_idx) FILTER (resp_idx < shown), '') AS examples,
  max(i) FILTER (resp_idx = shown) AS test_input, max(o) FILTER (resp_idx = shown) AS truth FROM k GROUP BY uid"""))
def b17(spark, d):
    r = responses(spark, d, source=False)
    n = r.groupBy("uid").agg(F.count("*").alias("n"))
    # only the six shown pairs and the one after them are ever gathered
    first = r.filter(F.col("resp_idx") <= 6)
    pair = F.struct(F.array(F.array("resp_idx", "resp_len")).alias("input"), F.array(F.array("resp_len", "resp_idx")).alias("output"))
    g = gather(first, ["uid"], "resp_idx", {"pairs": pair}).join(n, "uid")
    shown = F.least(F.col("n") - 1, F.lit(6)).cast("int")
    g = g.withColumns({"shown": F.slice("pairs", F.lit(1), shown), "test": F.get("pairs", shown)})
    return g.select("uid", B.few_shot_grids(F.col("shown")).alias("examples"),
                    B.grid_text(F.col("test.input")).alias("test_input"), B.grid_text(F.col("test.output")).alias("truth"))


SUITE = with_views("answers", """
, suites AS (SELECT uid, p_name, [p_brand, p_type] AS a, p_size FROM answers)
""")


def suites(spark, d):
    """Raw code rows: two tests per part, the kind and function name vary by size."""
    a = answers(spark, d)
    test = lambda i, o: F.struct(i.alias("input"), o.alias("output"), F.when(F.col("p_size") % 2 == 0, "functional").otherwise("stdin").alias("testtype"))
    tests = F.when(F.col("p_size") % 10 == 0, F.lit("[]")).otherwise(F.to_json(F.array(
        test(F.concat("p_name", F.lit("\n"), "p_brand"), F.col("p_size").cast("string")),
        test(F.col("p_type"), F.concat("p_brand", F.lit("\r\n"), "p_type")),
    )))
    fn = F.when(F.col("p_size") % 4 == 0, F.replace(F.col("p_name"), F.lit(" "), F.lit("_")))
    return a.select("uid", "p_name", "p_size", tests.alias("tests"), fn.alias("func_name"))


@query("b18_test_suite_folding", SUITE + """
SELECT uid, concat('{"inputs":["', p_name, '\\n', a[1], '","', a[2], '"],"outputs":["', p_size, '","', a[1], '\\n', a[2], '"]}') AS suite FROM suites WHERE p_size % 10 <> 0""")
def b18(spark, d):
    s = suites(spark, d).withColumn("t", B.parsed_tests(F.col("tests")))
    return s.filter(F.size("t") > 0).select("uid", B.folded_tests(F.col("t")).alias("suite"))


@query("b19_assertion_synthesis", SUITE + """
SELECT uid, concat('def check_', f, '():', chr(10), '    assert Solution().', f, '(', p_name, ', ', a[1], ') == ', p_size, chr(10),
  '    assert Solution().', f, '(', a[2], ') == ', a[1], chr(13), chr(10), a[2], chr(10), chr(10), 'check_', f, '()', chr(10)) AS code
FROM (SELECT *, replace(p_name, ' ', '_') AS f FROM suites) WHERE p_size % 4 = 0 AND p_size % 10 <> 0""")
def b19(spark, d):
    s = suites(spark, d).withColumn("t", B.parsed_tests(F.col("tests"))).filter((F.size("t") > 0) & F.col("func_name").isNotNull())
    return s.select("uid", B.assertions(F.col("t"), F.col("func_name")).alias("code"))


@query("b20_starter_code_pieces", f"""
SELECT doc_id, md5(CASE WHEN lang = 'en' THEN concat({q(B.TASK_HINT)}, chr(10), trim(text), chr(10), {q(B.STARTER_HINT)}, chr(10), '```python', chr(10), source, chr(10), '```')
  ELSE concat({q(B.TASK_HINT)}, chr(10), trim(text), chr(10), {q(B.STDIN_HINT)}) END) AS prompt_hash FROM documents""")
def b20(spark, d):
    starter = F.when(F.col("lang") == "en", F.col("source")).otherwise(F.lit("  "))
    return documents(spark, d).select("doc_id", F.md5(B.code_task(F.col("text"), starter)).alias("prompt_hash"))


@query("b21_literal_scrubbing", MSG + """
SELECT conv_id, md5(string_agg(replace(replace(text, 'the', 'THE'), ' and ', ' & '), '' ORDER BY pos)) AS text_hash FROM c GROUP BY 1""")
def b21(spark, d):
    m = messages(spark, d).withColumn("messages", B.rewritten_prompt(F.col("messages"), "the", "THE"))
    m = m.withColumn("messages", F.transform("messages", lambda x: x.withField("content", B.scrubbed(x["content"], {" and ": " & "}))))
    return m.select("conv_id", F.md5(B.joined_contents(F.col("messages"))).alias("text_hash"))


@query("b22_tool_arguments", with_views("answers", """
SELECT uid, concat('{"search":{"create_kwargs":{"ground_truth":"', ground_truth, '","question":"', p_name, '","data_source":"searchR1_', data_source, '"}}}') AS tools_kwargs FROM answers"""))
def b22(spark, d):
    kw = B.tool_args("search", ground_truth=F.col("ground_truth"), question=F.col("p_name"),
                     data_source=F.concat(F.lit("searchR1_"), F.col("data_source")))
    return answers(spark, d).select("uid", F.to_json(kw).alias("tools_kwargs"))


@query("b23_ground_truth_fallback", """
SELECT d.doc_id, coalesce(CAST(quality AS VARCHAR), lang) AS ground_truth, concat('searchR1_', source) AS data_source
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def b23(spark, d):
    j = documents(spark, d).join(table(spark, d, "labels"), "doc_id", "left")
    return j.select("doc_id", F.coalesce(F.col("quality").cast("string"), "lang").alias("ground_truth"),
                    F.concat(F.lit("searchR1_"), "source").alias("data_source"))


@query("b24_hash_answer", with_views("answers", """
SELECT uid, CASE WHEN p_size % 3 = 0 THEN NULL ELSE concat('-', p_size, '000.5') END AS answer FROM answers"""))
def b24(spark, d):
    s = F.col("p_size").cast("string")
    text = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("no mark "), s)).otherwise(F.concat(F.lit("so\n#### -"), s, F.lit(",000.5 apples")))
    return answers(spark, d).select("uid", B.hash_answer(text).alias("answer"))


@query("b25_first_boxed", with_views("answers", "SELECT uid, regexp_extract(response, '\\\\boxed\\{(.*?)\\}', 1) AS answer FROM answers"))
def b25(spark, d):
    return answers(spark, d).select("uid", B.first_boxed(F.col("response")).alias("answer"))


@query("b26_random_direction", with_views("responses", """
, f AS (SELECT uid, resp_len, pred FROM responses WHERE resp_idx = 0)
SELECT uid, resp_len AS input, pred AS output, CASE WHEN substr(md5(concat(uid, 'dir')), 1, 1) < '8' THEN 'input' ELSE 'output' END AS given_type FROM f"""))
def b26(spark, d):
    r = responses(spark, d, source=False).filter(F.col("resp_idx") == 0)
    return r.select("uid", F.col("resp_len").alias("input"), F.col("pred").alias("output"), B.coin(F.col("uid"), "dir", "input", "output").alias("given_type"))


@query("b27_first_turn", """
SELECT conv_id, arg_min(text, turn) AS prompt, count(*) AS turns, count(*) <> 1 AS more_turns FROM conversations WHERE role = 'user' GROUP BY conv_id""")
def b27(spark, d):
    c = table(spark, d, "conversations").filter(F.col("role") == "user")
    return c.groupBy("conv_id").agg(
        F.min_by("text", "turn").alias("prompt"), F.count("*").alias("turns"), (F.count("*") != 1).alias("more_turns")
    )


@query("b28_domain_patches", """
SELECT doc_id, concat('logic__', source) AS data_source, md5(substr(text, 1, 20480)) AS prompt_hash, md5(text) AS question_hash FROM documents""")
def b28(spark, d):
    docs = documents(spark, d)
    extra = F.map_concat(F.create_map(F.lit("split"), F.lit("train")), F.create_map(F.lit("question"), F.col("text")))
    return docs.select(
        "doc_id", B.domain_source(F.col("source"), "zebra_puzzle").alias("data_source"),
        F.md5(F.left(F.col("text"), F.lit(4096 * 5))).alias("prompt_hash"), F.md5(extra["question"]).alias("question_hash"),
    )


@query("b29_unit_test_sampling", """
WITH t AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) - 1 AS i FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY md5(concat(doc_id, '42-', i))) AS rn FROM t)
SELECT doc_id, string_agg(w, '|' ORDER BY rn) AS inputs, string_agg(CAST(length(w) AS VARCHAR), '|' ORDER BY rn) AS outputs, any_value(n) AS complete
FROM r JOIN (SELECT doc_id AS dd, count(*) AS n FROM t GROUP BY 1) ON doc_id = dd WHERE rn <= 8 GROUP BY doc_id""")
def b29(spark, d):
    pairs = F.transform(F.split("text", " "), lambda w: F.struct(w.alias("i"), F.length(w).cast("string").alias("o")))
    docs = documents(spark, d).select("doc_id", pairs.alias("all"))
    docs = docs.withColumn("kept", B.sampled_tests(F.col("all"), F.col("doc_id"), "42"))
    return docs.select("doc_id", F.array_join("kept.i", "|").alias("inputs"), F.array_join("kept.o", "|").alias("outputs"),
                       F.size("all").cast("long").alias("complete"))


PREF = """
WITH p AS (SELECT d.doc_id, md5(d.text) AS chosen, md5(concat(d.text, 'x')) AS rejected, source AS prompt FROM documents d)
"""


def pref(spark, d):
    return documents(spark, d).select(
        "doc_id", F.col("source").alias("prompt"), F.md5("text").alias("chosen"), F.md5(F.concat("text", F.lit("x"))).alias("rejected")
    )


@query("b30_pair_to_rows", PREF + """
SELECT doc_id, prompt, 'chosen' AS side, chosen AS response FROM p UNION ALL SELECT doc_id, prompt, 'rejected', rejected FROM p""")
def b30(spark, d):
    return P.pair_rows(pref(spark, d), "prompt", "chosen", "rejected").select("doc_id", "prompt", "side", "response")


@query("b31_pair_rows_with_split", PREF + """
SELECT doc_id, prompt, chosen, rejected, CASE WHEN row_number() OVER (ORDER BY doc_id) - 1 < floor(count(*) OVER () * 0.75) THEN 'train' ELSE 'test' END AS split FROM p""")
def b31(spark, d):
    return positional_split(pref(spark, d), [F.col("doc_id")], 0.75).select("doc_id", "prompt", "chosen", "rejected", "split")


# predicates

@query("c1_length_filter", f"SELECT doc_id FROM documents WHERE {tok('text')} BETWEEN 20 AND 2048 - 100")
def c1(spark, d):
    # a document without text has no tokens, too few as in the SQL: it is left out and does not end the job
    text = C.prompt_text(F.col("text"), F.lit(None).cast("string"), required=False)
    return documents(spark, d).filter(C.within_length(token_count(text), 20, 2048)).select("doc_id")


SKIP_SQL = """CASE WHEN source IN ('geeksforgeeks', 'leetcode', 'src_01') THEN 'source' WHEN length(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')) < 100 THEN 'short'
  WHEN contains(lower(text), 'image') THEN 'image' ELSE 'kept' END"""


@query("c2_skip_reasons", f"SELECT {SKIP_SQL} AS reason, count(*) AS n FROM documents GROUP BY 1")
def c2(spark, d):
    t = F.col("text")
    return P.skip_counts(documents(spark, d), {
        "source": C.blocked_source(F.col("source")) | (F.col("source") == "src_01"),
        "short": C.alphanumeric_count(t) < 100, "image": C.mentions_image(t),
    })


@query("c3_min_alphanumerics", "SELECT doc_id FROM documents WHERE length(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')) >= 100")
def c3(spark, d):
    return documents(spark, d).filter(C.alphanumeric_count(F.col("text")) >= 100).select("doc_id")


@query("c4_image_mention", """
SELECT page_id, contains(lower(html), 'image') OR contains(html, concat(chr(10), '![')) AS mention, contains(lower(html), '<image>') OR contains(lower(html), '[image]') AS tag FROM pages""")
def c4(spark, d):
    return table(spark, d, "pages").select("page_id", C.mentions_image(F.col("html")).alias("mention"), C.mentions_image_tag(F.col("html")).alias("tag"))


@query("c5_source_block_list", """
SELECT doc_id FROM documents WHERE CASE WHEN doc_id % 5 = 0 THEN 'leetcode' ELSE source END NOT IN ('geeksforgeeks', 'leetcode')""")
def c5(spark, d):
    src = F.when(F.col("doc_id") % 5 == 0, "leetcode").otherwise(F.col("source"))
    return documents(spark, d).filter(~C.blocked_source(src)).select("doc_id")


@query("c6_unwanted_start", """
SELECT doc_id, lang = 'en' OR lower(text) LIKE 'example%' OR lower(text) LIKE 'input%' AS bad FROM documents""")
def c6(spark, d):
    lead = F.concat(F.lit(C.COMMON_LEAD + " \n Input: "), F.col("text"))
    text = F.when(F.col("lang") == "en", lead).otherwise(F.col("text"))
    return documents(spark, d).select("doc_id", C.unwanted_start(text).alias("bad"))


STEM = """
, s AS (SELECT uid, CASE WHEN p_size % 7 = 0 THEN 'x' ELSE p_name END AS answer, CASE WHEN p_size % 5 = 0 THEN 'Mathematics' ELSE 'Physics' END AS category,
  CASE p_size % 3 WHEN 0 THEN 'PhD' WHEN 1 THEN 'University' ELSE 'Primary School' END AS difficulty, CASE WHEN p_size % 4 = 0 THEN 'Boolean' ELSE 'Float' END AS kind FROM answers)
"""


@query("c7_stem_predicate", with_views("answers", STEM + """
SELECT uid FROM s WHERE length(answer) > 1 AND category <> 'Mathematics' AND difficulty IN ('University', 'PhD') AND kind NOT IN ('Boolean', 'Multiple Choice')"""))
def c7(spark, d):
    n = F.col("p_size")
    keep = C.stem_question(
        F.when(n % 7 == 0, "x").otherwise(F.col("p_name")), F.when(n % 5 == 0, "Mathematics").otherwise("Physics"),
        F.when(n % 3 == 0, "PhD").when(n % 3 == 1, "University").otherwise("Primary School"),
        F.when(n % 4 == 0, "Boolean").otherwise("Float"),
    )
    return answers(spark, d).filter(keep).select("uid")


@query("c8_decimal_places", """
SELECT event_id FROM events WHERE regexp_matches(concat(CAST(CAST(value * 100 AS BIGINT) AS VARCHAR), '.', CAST(event_id AS VARCHAR)), '\\d+\\.\\d{4,}')""")
def c8(spark, d):
    e = table(spark, d, "events")
    text = F.concat((F.col("value") * 100).cast("long").cast("string"), F.lit("."), F.col("event_id").cast("string"))
    return e.filter(C.too_many_decimals(text)).select("event_id")


@query("c9_answer_token_cap", f"SELECT conv_id, turn FROM conversations WHERE {tok('text')} <= 30")
def c9(spark, d):
    return table(spark, d, "conversations").filter(token_count(F.col("text")) <= 30).select("conv_id", "turn")


@query("c10_evidence_predicate", "SELECT doc_id FROM documents WHERE len(regexp_extract_all(text, '[0-9]+')) = 0")
def c10(spark, d):
    evidence = F.regexp_extract_all("text", F.lit("([0-9]+)"))
    return documents(spark, d).filter(F.size(evidence) == 0).select("doc_id")


@query("c11_bad_test_suites", with_views("answers", """
SELECT uid, p_size % 10 = 0 OR (p_size % 2 = 0 AND p_size % 4 <> 0) AS bad FROM answers"""))
def c11(spark, d):
    return suites(spark, d).select("uid", C.bad_tests(B.parsed_tests(F.col("tests")), F.col("func_name")).alias("bad"))


@query("c12_overlong_prompt", f"""
SELECT doc_id FROM documents WHERE CASE WHEN lang = 'en' THEN {tok("concat('<|im_start|>user ', text, '<|im_end|>')")} ELSE {tok('text')} END <= 256""")
def c12(spark, d):
    chat = F.concat(F.lit("<|im_start|>user "), F.col("text"), F.lit("<|im_end|>"))
    text = F.when(F.col("lang") == "en", chat).otherwise(F.col("text"))
    return documents(spark, d).filter(token_count(text) <= 256).select("doc_id")


@query("c14_long_answer_removal", with_views("answers", "SELECT uid FROM answers WHERE length(concat(response, ' ', p_type)) <= 75"))
def c14(spark, d):
    return answers(spark, d).filter(F.length(F.concat("response", F.lit(" "), "p_type")) <= 75).select("uid")


@query("c16_date_range", """
SELECT o_orderkey FROM orders WHERE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') >= '1996-08-00T00:00:00' AND strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') < '1998-01-00T00:00:00'""")
def c16(spark, d):
    day = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    return table(spark, d, "orders").filter(C.between_dates(day, "1996-08-00T00:00:00", "1998-01-00T00:00:00")).select("o_orderkey")


@query("d3_dimension_lookup", """
SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def d3(spark, d):
    c = table(spark, d, "customer")
    n = table(spark, d, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    r = table(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    return P.lookup(P.lookup(c, n, "c_nationkey"), r, "n_regionkey").select("c_custkey", "n_name", "r_name")


# recipes: the same job with different expressions

def recipe_sql(source, ability, truth, content, where="true", table_="answers", key="uid"):
    return f"""
SELECT {key} AS uid, {source} AS data_source, '{ability}' AS ability, 'rule' AS style, CAST({truth} AS VARCHAR) AS ground_truth,
  CAST(row_number() OVER (ORDER BY {key}) - 1 AS VARCHAR) AS index, {content} AS content FROM {table_} WHERE {where}"""


@query("recipe_math", with_views("answers", recipe_sql("'math__parts'", "math", "p_size", f"concat(p_name, {q(B.BOXED_SUFFIX)})")))
def recipe_math(spark, d):
    return P.flat(P.build_prompts(answers(spark, d), P.Recipe(
        data_source=F.lit("math__parts"), ability="math", key="uid",
        prompt=B.user_prompt(F.concat("p_name", F.lit(B.BOXED_SUFFIX))),
        ground_truth=B.first_or_self(F.array(F.col("p_size").cast("string"))),
    )))


@query("recipe_table", with_views("answers", recipe_sql(
    "'table__parts'", "table", "concat(p_size, '|', p_type)",
    f"concat('| brand | type |', chr(10), '|---|---|', chr(10), '| ', p_brand, ' | ', p_type, ' |', chr(10), p_name, chr(10), {q(B.TABLE_INSTRUCTION_OLD)})",
)))
def recipe_table(spark, d):
    rows = F.array(F.array(F.lit("brand"), F.lit("type")), F.array("p_brand", "p_type"))
    content = F.concat_ws("\n", B.markdown_table(rows), F.col("p_name"), F.lit(B.TABLE_INSTRUCTION_OLD))
    return P.flat(P.build_prompts(answers(spark, d), P.Recipe(
        data_source=F.lit("table__parts"), ability="table", key="uid", prompt=B.user_prompt(content),
        ground_truth=F.array_join(F.array(F.col("p_size").cast("string"), F.col("p_type")), "|"),
    )))


@query("recipe_code", with_views("answers", recipe_sql(
    "'codegen__parts'", "codegen",
    """concat('{"inputs":["', p_name, '\\n', p_brand, '","', p_type, '"],"outputs":["', p_size, '","', p_brand, '\\n', p_type, '"]}')""",
    f"concat({q(B.TASK_HINT)}, chr(10), p_name, chr(10), {q(B.STDIN_HINT)})", "p_size % 2 = 1")))
def recipe_code(spark, d):
    s = suites(spark, d).withColumn("t", B.parsed_tests(F.col("tests")))
    return P.flat(P.build_prompts(s, P.Recipe(
        data_source=F.lit("codegen__parts"), ability="codegen", key="uid",
        prompt=B.user_prompt(B.code_task(F.col("p_name"), F.lit(""))), ground_truth=B.folded_tests(F.col("t")),
        skip={"tests": C.bad_tests(F.col("t"), F.col("func_name")), "kind": F.col("t")[0]["testtype"] != "stdin"},
    )))


@query("recipe_stem_choice", with_views("answers", recipe_sql(
    "'stem__parts'", "stem", "'D'",
    "concat('Options are:', chr(10), '(A): ', p_brand, chr(10), '(B): ', p_type, chr(10), '(C): ', p_name, chr(10), '(D): ', p_size, chr(10))",
)))
def recipe_stem(spark, d):
    options = F.array("p_brand", "p_type", "p_name", F.col("p_size").cast("string"))
    return P.flat(P.build_prompts(answers(spark, d), P.Recipe(
        data_source=F.lit("stem__parts"), ability="stem", key="uid", prompt=B.user_prompt(B.lettered_options(options)),
        ground_truth=B.gold_letter(options, F.col("p_size").cast("string")),
    )))


@query("recipe_first_turn", """
WITH f AS (SELECT conv_id, arg_min(text, turn) AS text, count(*) AS turns FROM conversations WHERE role = 'user' GROUP BY conv_id)
""" + recipe_sql("'ood__turns'", "ood", "turns", "text", table_="f", key="conv_id"))
def recipe_first_turn(spark, d):
    c = table(spark, d, "conversations").filter(F.col("role") == "user")
    f = c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"), F.count("*").alias("turns"))
    return P.flat(P.build_prompts(f, P.Recipe(
        data_source=F.lit("ood__turns"), ability="ood", key="conv_id", prompt=B.user_prompt(F.col("text")), ground_truth=F.col("turns"),
    )))


@query("recipe_documents_sampled", f"""
WITH k AS (SELECT doc_id, source, lang, text, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS VARCHAR) AS index FROM documents
  WHERE length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]', '', 'g')) >= 100)
SELECT doc_id AS uid, concat('text__', source) AS data_source, 'text' AS ability, 'rule' AS style, lang AS ground_truth, index, text AS content
FROM k WHERE {tok('text')} <= 1024 - 100 ORDER BY md5(concat(CAST(doc_id AS VARCHAR), '42')), doc_id LIMIT 100""")
def recipe_docs(spark, d):
    return P.flat(P.build_prompts(documents(spark, d), P.Recipe(
        data_source=F.concat(F.lit("text__"), F.col("source")), ability="text", key="doc_id", prompt=B.user_prompt(F.col("text")),
        ground_truth=F.col("lang"), skip={"short": C.alphanumeric_count(F.col("text")) < 100}, max_tokens=1024, sample=100,
    )))


SEARCH_SYSTEM = "You can search before you answer."


@query("recipe_search_tool", with_views("answers", """
SELECT uid, 'searchR1_parts' AS data_source, concat('You can search before you answer.', p_name) AS content, ground_truth,
  concat('{"search":{"create_kwargs":{"ground_truth":"', ground_truth, '","question":"', p_name, '","data_source":"searchR1_parts"}}}') AS tools FROM answers"""))
def recipe_search(spark, d):
    source = F.concat(F.lit("searchR1_"), F.lit("parts"))
    tools = B.tool_args("search", ground_truth=F.col("ground_truth"), question=F.col("p_name"), data_source=source)
    out = P.build_prompts(answers(spark, d), P.Recipe(
        data_source=source, ability="search", key="uid",
        prompt=F.array(B.message("system", F.lit(SEARCH_SYSTEM)), B.message("user", F.col("p_name"))),
        ground_truth=F.coalesce(F.col("ground_truth"), F.col("p_brand")),
        extra={"question": F.col("p_name"), "need_tools_kwargs": F.lit(True), "tools_kwargs": F.to_json(tools)},
    ))
    return out.select("uid", "data_source", B.joined_contents(F.col("prompt")).alias("content"), "reward_model.ground_truth",
                      F.col("extra_info")["tools_kwargs"].alias("tools"))


@query("recipe_code_io", with_views("answers", f"""
, x AS (SELECT uid, p_name, p_brand, p_type, CASE WHEN substr(md5(concat(uid, 'dir')), 1, 1) < '8' THEN 'input' ELSE 'output' END AS given_type FROM answers)
SELECT uid, replace(replace(replace(CASE WHEN given_type = 'output' THEN {q(T_IN)} ELSE {q(T_OUT)} END, '{{{{given_type}}}}', given_type),
  '{{{{given}}}}', CASE WHEN given_type = 'input' THEN p_name ELSE p_brand END), '{{{{refcode}}}}', p_type) AS content,
  CASE WHEN given_type = 'input' THEN concat('"output": ', p_brand) ELSE concat('"input": ', p_name) END AS ground_truth FROM x"""))
def recipe_code_io(spark, d):
    a = answers(spark, d).withColumn("given_type", B.coin(F.col("uid"), "dir", "input", "output"))
    given_input = F.col("given_type") == "input"
    template = F.when(given_input, T_OUT).otherwise(T_IN)
    content = B.fill(template, {
        "given_type": F.col("given_type"), "given": F.when(given_input, F.col("p_name")).otherwise(F.col("p_brand")), "refcode": F.col("p_type"),
    })
    truth = B.fill('"{{predict_type}}": {{sol}}', {
        "predict_type": F.when(given_input, "output").otherwise("input"), "sol": F.when(given_input, F.col("p_brand")).otherwise(F.col("p_name")),
    })
    return P.flat(P.build_prompts(a, P.Recipe(
        data_source=F.lit("simulation__codeio"), ability="coding-inference", key="uid", prompt=B.user_prompt(content), ground_truth=truth,
    ))).select("uid", "content", "ground_truth")


@query("recipe_grid_puzzle", with_views("answers", """
SELECT uid, concat('Rows: ', p_name, ' Fill the grid.') AS content, concat('[["', p_brand, '","', p_type, '"]]') AS ground_truth,
  concat(p_size % 5 + 1, 'x', p_size % 3 + 1) AS grid_size, 'logic__zebra_puzzle_dataset' AS data_source FROM answers"""))
def recipe_puzzle(spark, d):
    size = F.concat((F.col("p_size") % 5 + 1).cast("string"), F.lit("x"), (F.col("p_size") % 3 + 1).cast("string"))
    out = P.build_prompts(answers(spark, d), P.Recipe(
        data_source=B.domain_source(F.lit("zebra_puzzle_dataset"), "zebra_puzzle"), ability="logical_reasoning", key="uid",
        prompt=B.user_prompt(F.concat(F.lit("Rows: "), F.col("p_name"), F.lit(" Fill the grid."))),
        ground_truth=F.to_json(F.array(F.array("p_brand", "p_type"))), extra={"grid_size": size},
    ))
    return out.select("uid", F.col("prompt")[0]["content"].alias("content"), "reward_model.ground_truth",
                      F.col("extra_info")["grid_size"].alias("grid_size"), "data_source")


@query("recipe_hash_answer_math", with_views("answers", """
SELECT uid, concat(p_name, ' Let''s think step by step and output the final answer after `####`.') AS content, concat(p_size, '000') AS ground_truth FROM answers WHERE p_size % 3 <> 0"""))
def recipe_hash(spark, d):
    s = F.col("p_size").cast("string")
    raw = F.when(F.col("p_size") % 3 == 0, F.lit("no mark")).otherwise(F.concat(F.lit("steps\n#### "), s, F.lit(",000")))
    a = answers(spark, d).withColumn("solution", B.hash_answer(raw))
    return P.flat(P.build_prompts(a, P.Recipe(
        data_source=F.lit("math__hash"), ability="math", key="uid", skip={"no_answer": F.col("solution").isNull()},
        prompt=B.user_prompt(F.concat("p_name", F.lit(" Let's think step by step and output the final answer after `####`."))),
        ground_truth=F.col("solution"),
    ))).select("uid", "content", "ground_truth")


@query("recipe_preference", """
WITH p AS (SELECT row_number() OVER (ORDER BY u.conv_id, u.turn) - 1 AS pos, count(*) OVER () AS total, u.text AS prompt, a.text AS chosen, concat('No. ', u.text) AS rejected
           FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')
SELECT 'sft' AS "table", 'train' AS split, 2 * pos AS row_no, prompt AS content, chosen AS answer, NULL AS other FROM p
UNION ALL SELECT 'sft', 'train', 2 * pos + 1, prompt, rejected, NULL FROM p
UNION ALL SELECT 'rm', CASE WHEN pos < round_even(total * 0.75, 0) THEN 'train' ELSE 'test' END, pos, prompt, chosen, rejected FROM p
UNION ALL SELECT 'rl', 'train', pos, prompt, chosen, concat('turns/alignment/model/train/', pos) FROM p""")
def recipe_preference(spark, d):
    c = table(spark, d, "conversations")
    user = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("asked"))
    reply = c.filter(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("said"))
    rows = P.preference_tables(
        user.join(reply, ["conv_id", "turn"]), [F.col("conv_id"), F.col("turn")], F.col("asked"), F.col("said"),
        F.concat(F.lit("No. "), "asked"), F.col("said"), F.lit("turns"),
    )
    path = scratch_path(spark, "preference")
    write_tables(rows, path)
    part = {n: read_table(spark, path, n, cols) for n, cols in P.PREFERENCE_TABLES.items()}
    nothing = F.lit(None).cast("string")
    rl = F.concat_ws("/", "data_source", "ability", "reward_model.style", "extra_info.split", F.col("extra_info.index").cast("string"))
    shown = [
        ("sft", F.col("prompt"), F.col("response"), nothing), ("rm", F.col("prompt"), F.col("chosen"), F.col("rejected")),
        ("rl", F.col("messages")[0]["content"], F.col("reward_model.ground_truth"), rl),
    ]
    return concat_strict(*[
        part[n].select(F.lit(n).alias("table"), F.col("split").cast("string").alias("split"), "row_no", x.alias("content"), y.alias("answer"), z.alias("other"))
        for n, x, y, z in shown
    ])


@query("recipe_evaluation_set", with_views("answers", """
SELECT 'problems' AS data_source, uid, p_name AS content, ground_truth FROM answers
UNION ALL SELECT 'dated', o_orderkey, o_orderpriority, o_orderstatus FROM orders
  WHERE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') >= '1996-08-00T00:00:00' AND strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') < '1998-01-00T00:00:00'
UNION ALL SELECT 'turns', conv_id * 100000 + turn, text, role FROM conversations"""))
def recipe_evaluation(spark, d):
    day = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    dated = table(spark, d, "orders").filter(C.between_dates(day, "1996-08-00T00:00:00", "1998-01-00T00:00:00"))
    turns = table(spark, d, "conversations").withColumn("key", F.col("conv_id") * 100000 + F.col("turn"))
    sets = [
        (answers(spark, d), "problems", "uid", "p_name", "ground_truth"),
        (dated, "dated", "o_orderkey", "o_orderpriority", "o_orderstatus"), (turns, "turns", "key", "text", "role"),
    ]
    parts = [P.flat(P.build_prompts(df, P.Recipe(
        data_source=F.lit(name), ability="mixed", key=key, prompt=B.user_prompt(F.col(text)), ground_truth=F.col(truth), split="test",
    ))) for df, name, key, text, truth in sets]
    return concat_strict(*parts).select("data_source", "uid", "content", "ground_truth")


# gates

@query("q1_q4_prompt_gates", f"""
WITH p AS (SELECT text, concat('text__', source) AS ds, source, concat('<|im_start|>user', chr(10), text, '<|im_end|><think>') AS raw FROM documents)
SELECT 'token_length' AS rule, count(*) FILTER (NOT ({tok('text')} BETWEEN 20 AND 900)) AS violations, count(*) AS checked FROM p
UNION ALL SELECT 'source_format', count(*) FILTER (NOT (ds = concat('text__', source))), count(*) FROM p
UNION ALL SELECT 'instruction', count(*) FILTER (NOT contains(raw, 'the')), count(*) FROM p
UNION ALL SELECT 'special_tokens', count(*) FILTER (NOT (contains(raw, '<|im_start|>') AND contains(raw, '<|im_end|>') AND contains(raw, '<think>'))), count(*) FROM p""")
def q1_q4(spark, d):
    raw = F.concat(F.lit("<|im_start|>user\n"), F.col("text"), F.lit("<|im_end|><think>"))
    return P.gate(documents(spark, d), {
        "token_length": C.within_length(token_count(F.col("text")), 20, 1000),
        "source_format": C.source_format(F.concat(F.lit("text__"), F.col("source")), F.lit("text"), F.col("source")),
        "instruction": F.contains(raw, F.lit("the")),
        "special_tokens": C.special_tokens_present(raw),
    })


@query("q5_extra_info_lengths", with_views("responses", """
SELECT 'acc' AS name, count(score) AS filled, count(*) AS n, count(score) IN (0, count(*)) AS consistent FROM responses
UNION ALL SELECT 'partial', count(*) FILTER (pred = 'A'), count(*), count(*) FILTER (pred = 'A') IN (0, count(*)) FROM responses"""))
def q5(spark, d):
    r = responses(spark, d, index=False).select(F.col("score").alias("acc"), F.when(F.col("pred") == "A", 1).alias("partial"))
    n = r.agg(F.count("*").alias("n"), F.count("acc").alias("acc"), F.count("partial").alias("partial"))
    e = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("filled")) for c in ("acc", "partial")]))
    return n.select("n", e.alias("e")).select("e.name", "e.filled", "n", F.col("e.filled").isin(0) | (F.col("e.filled") == F.col("n"))).toDF(
        "name", "filled", "n", "consistent")


@query("q6_duplicate_keys", """
SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def q6(spark, d):
    li = table(spark, d, "lineitem")
    return li.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).filter("n > 1")
