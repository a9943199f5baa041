"""Expressions that turn raw question columns into prompts and ground truths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: instruction sentences and chat markers
BOXED_SUFFIX = " Please output the final answer within \\boxed{}."
TABLE_INSTRUCTION_OLD = "Please output the final answer within \\boxed{}. If there are multiple answers, please output them separated by |."
TABLE_INSTRUCTION_NEW = "Please output the final answer in \\boxed{}. If there are multiple answers, include them in a single box, separated by |."
NUMERIC_INSTRUCTION = "Please output the final numeric answer within \\boxed{}."
ZERO_SYSTEM = (
    "A conversation between a user and an assistant. The assistant first thinks through the problem step-by-step "
    "inside <think>...</think>, then provides the final response to user."
)
START_TOKEN = "<|im_start|>"
END_TOKEN = "<|im_end|>"
NO_QUESTION = "No question found"
LETTERS = "ABCDEFGHIJ"
STARTER_HINT = (
    "You will use the following starter code to write the solution to the problem and enclose your code within ```python delimiters."
)
STDIN_HINT = (
    "Read the inputs from stdin solve the problem and write the answer to stdout (do not directly test on the sample inputs). "
    "Enclose your code within ```python delimiters."
)
TASK_HINT = "Solve the programming task below in a Python markdown code block."


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def user_prompt(content: Column) -> Column:
    return F.array(message("user", content))


def fill(template: str | Column, values: dict[str, Column]) -> Column:
    """Replace {{name}} marks one after the other, in the given order."""
    out = F.lit(template) if isinstance(template, str) else template
    for name, value in values.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), value.cast("string"))
    return out


def zero_style(prompt: Column, extra: str = "") -> Column:
    """System, user and extra instruction between chat markers; the answer opens with <think>."""
    tail = "\n" + extra if extra else ""
    return F.concat(
        F.lit(f"{START_TOKEN}system\n{ZERO_SYSTEM}{END_TOKEN}\n{START_TOKEN}user\n"), prompt,
        F.lit(f"{tail}{END_TOKEN}\n{START_TOKEN}assistant\n<think>"),
    )


def render_chat(messages: Column, generation_prompt: bool = False) -> Column:
    """Messages with role markers, one per line."""
    lines = F.transform(
        messages, lambda m: F.concat(F.lit(START_TOKEN), m["role"], F.lit("\n"), m["content"], F.lit(END_TOKEN + "\n"))
    )
    out = F.array_join(lines, "")
    return F.concat(out, F.lit(START_TOKEN + "assistant\n")) if generation_prompt else out


def question_of(messages: Column) -> Column:
    users = F.filter(messages, lambda m: m["role"] == "user")
    return F.coalesce(F.try_element_at(users, F.lit(1))["content"], F.lit(NO_QUESTION))


def joined_contents(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: m["content"]), "")


def first_or_self(answer: Column) -> Column:
    return F.try_element_at(answer, F.lit(1))


def lettered_options(options: Column, heading: str = "Options are:\n") -> Column:
    """(A): x, one per line, up to J."""
    lines = F.transform(
        F.slice(options, 1, len(LETTERS)),
        lambda o, i: F.concat(F.lit("("), F.substring(F.lit(LETTERS), i + 1, F.lit(1)), F.lit("): "), o, F.lit("\n")),
    )
    return F.concat(F.lit(heading), F.array_join(lines, ""))


def clean_choice(text: Column) -> Column:
    """Null to a blank, trimmed, ' [title]' to '. ', bracketed notes dropped, double blanks to one."""
    out = F.replace(F.regexp_replace(text, r"^\s+|\s+$", ""), F.lit(" [title]"), F.lit(". "))
    out = F.regexp_replace(out, r"\[.*?\]", "")
    return F.coalesce(F.replace(out, F.lit("  "), F.lit(" ")), F.lit(" "))


def shuffled_choices(choices: Column, key: Column, seed: str) -> Column:
    tagged = F.transform(
        choices,
        lambda c, i: F.struct(
            F.md5(F.concat(key.cast("string"), F.lit(f"{seed}-"), i.cast("string"))).alias("h"), c.alias("c")
        ),
    )
    return F.transform(F.array_sort(tagged), lambda s: s["c"])


def gold_letter(choices: Column, correct: Column) -> Column:
    """Letter of the first choice equal to the correct one."""
    return F.substring(F.lit(LETTERS), F.array_position(choices, correct).cast("int"), F.lit(1))


def choice_lines(choices: Column) -> Column:
    return F.array_join(
        F.transform(choices, lambda c, i: F.concat(F.substring(F.lit(LETTERS), i + 1, F.lit(1)), F.lit(") "), c, F.lit("\n"))), ""
    )


def markdown_row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: c.cast("string")), " | "), F.lit(" |"))


def markdown_table(rows: Column, spaced: bool = False) -> Column:
    """Array of rows to a markdown table: header, separator, rows; empty input gives an empty text."""
    head = F.try_element_at(rows, F.lit(1))
    dashes = F.transform(head, lambda _: F.lit("---"))
    rule = (
        F.concat(F.lit("| "), F.array_join(dashes, " | "), F.lit(" |"))
        if spaced else F.concat(F.lit("|"), F.array_join(dashes, "|"), F.lit("|"))
    )
    body = F.transform(F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1))), markdown_row)
    lines = F.concat(F.array(markdown_row(head), rule), body)
    return F.when((F.size(rows) > 0) & (F.size(head) > 0), F.array_join(lines, "\n")).otherwise("")


def assembled_context(pre: Column, table: Column, post: Column) -> Column:
    return F.concat(F.array_join(pre, "\n"), F.lit("\n"), table, F.lit("\n"), F.array_join(post, "\n"))


def numeric_answer(answer: Column) -> Column:
    """Number behind '1,200', '$5', '12%', '3:4' or '6 / 8'; null when there is none."""
    plain = F.regexp_replace(answer, "[,$]", "")
    plain = F.replace(F.replace(plain, F.lit("%"), F.lit(" / 100")), F.lit(":"), F.lit("/"))
    plain = F.regexp_replace(F.trim(plain), r"^\((.*)\)$", "$1")
    parts = F.transform(F.split(plain, "/"), lambda p: F.trim(p).try_cast("double"))
    ok = F.forall(parts, lambda p: p.isNotNull())
    folded = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.try_element_at(parts, F.lit(1)),
                         lambda a, p: F.try_divide(a, p))
    return F.when(ok, folded)


def grid_text(grid: Column) -> Column:
    """[[1, 2], [3, 4]] with blanks after the commas."""
    rows = F.transform(grid, lambda r: F.concat(F.lit("["), F.array_join(F.transform(r, lambda c: c.cast("string")), ", "), F.lit("]")))
    return F.concat(F.lit("["), F.array_join(rows, ", "), F.lit("]"))


def few_shot_grids(pairs: Column, most: int = 6) -> Column:
    shown = F.slice(pairs, 1, most)
    return F.array_join(F.transform(shown, lambda p, i: F.concat(
        F.lit("Example "), (i + 1).cast("string"), F.lit("\nInput: "), grid_text(p["input"]),
        F.lit("\nOutput: "), grid_text(p["output"]), F.lit("\n\n"),
    )), "")


TESTS_SCHEMA = "array<struct<input:string,output:string,testtype:string>>"


def parsed_tests(tests: Column) -> Column:
    return F.from_json(tests, TESTS_SCHEMA)


def folded_tests(tests: Column) -> Column:
    """[{input, output}] to {"inputs": [...], "outputs": [...]}; CRLF in outputs becomes LF."""
    return F.to_json(F.struct(
        F.transform(tests, lambda t: t["input"]).alias("inputs"),
        F.transform(tests, lambda t: F.replace(t["output"], F.lit("\r\n"), F.lit("\n"))).alias("outputs"),
    ))


def assertions(tests: Column, function: Column) -> Column:
    """One assert per test; the lines of the input are the arguments."""
    lines = F.transform(tests, lambda t: F.concat(
        F.lit("    assert Solution()."), function, F.lit("("), F.array_join(F.split(t["input"], "\n"), ", "),
        F.lit(") == "), t["output"], F.lit("\n"),
    ))
    return F.concat(
        F.lit("def check_"), function, F.lit("():\n"), F.array_join(lines, ""), F.lit("\ncheck_"), function, F.lit("()\n")
    )


def code_task(question: Column, starter: Column) -> Column:
    """Task pieces joined by line breaks, with or without starter code."""
    code = F.concat(F.lit("```python\n"), F.trim(starter), F.lit("\n```"))
    with_code = F.concat_ws("\n", F.lit(TASK_HINT), F.trim(question), F.lit(STARTER_HINT), code)
    plain = F.concat_ws("\n", F.lit(TASK_HINT), F.trim(question), F.lit(STDIN_HINT))
    return F.when(F.trim(F.coalesce(starter, F.lit(""))) != "", with_code).otherwise(plain)


def scrubbed(text: Column, phrases: dict[str, str]) -> Column:
    for old, new in phrases.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def rewritten_prompt(messages: Column, old: str, new: str) -> Column:
    return F.transform(messages, lambda m: m.withField("content", F.replace(m["content"], F.lit(old), F.lit(new))))


def tool_args(tool: str, **args: Column) -> Column:
    inner = F.struct(F.struct(*[c.alias(n) for n, c in args.items()]).alias("create_kwargs"))
    return F.struct(inner.alias(tool))


def hash_answer(text: Column) -> Column:
    """Number after '#### ', commas removed; null when missing."""
    got = F.regexp_extract(text, r"#### (-?[0-9.,]+)", 1)
    return F.when(got != "", F.replace(got, F.lit(","), F.lit("")))


def first_boxed(text: Column) -> Column:
    return F.when(text.rlike(r"(?s)\\boxed\{(.*?)\}"), F.regexp_extract(text, r"(?s)\\boxed\{(.*?)\}", 1))


def coin(key: Column, seed: str, heads: str, tails: str) -> Column:
    """A reproducible 50/50 label."""
    nibble = F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(seed))), 1, 1), 16, 10).cast("int")
    return F.when(nibble < 8, heads).otherwise(tails)


def domain_source(source: Column, dataset: str) -> Column:
    """Logic puzzle sources get their domain prefix."""
    puzzle = any(k in dataset for k in ("zebra_puzzle", "ordering_puzzle", "graph"))
    return F.concat(F.lit("logic__"), source) if puzzle else source


def sampled_tests(tests: Column, key: Column, seed: str, most: int = 8) -> Column:
    """At most ``most`` tests, inputs and outputs kept together, in hash order."""
    tagged = F.transform(tests, lambda t, i: F.struct(
        F.md5(F.concat(key.cast("string"), F.lit(f"{seed}-"), i.cast("string"))).alias("h"), t.alias("t")
    ))
    return F.transform(F.slice(F.array_sort(tagged), 1, most), lambda s: s["t"])


def html_to_markdown():
    """Pandas UDF: first-class HTML tables to markdown; a spanning cell keeps its text in its first column."""
    import pandas as pd

    def convert(html):
        import re
        from html import unescape
        from html.parser import HTMLParser

        # plain tags, as the parser reads them; whatever else holds a '<' is left to the parser
        plain = re.compile(r"""<(/?)([A-Za-z][A-Za-z0-9]*)((?: [A-Za-z]+="[^"<>&]*")*)>""")
        raw = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "plaintext", "noscript"}

        class Cells(HTMLParser):
            def __init__(self):
                super().__init__()
                self.rows, self.cell, self.span = [], None, 1

            def close_cell(self):
                if self.cell is not None:
                    if not self.rows:
                        self.rows.append([])
                    self.rows[-1] += ["".join(self.cell).strip()] + [""] * (self.span - 1)
                    self.cell = None

            def handle_starttag(self, tag, attrs):
                if tag == "tr":
                    self.close_cell()
                    self.rows.append([])
                elif tag in ("td", "th"):
                    self.close_cell()
                    span = dict(attrs).get("colspan") or "1"
                    self.cell, self.span = [], int(span) if span.isdigit() else 1

            def handle_endtag(self, tag):
                if tag in ("td", "th", "tr", "table"):
                    self.close_cell()

            def handle_data(self, data):
                if self.cell is not None:
                    self.cell.append(data)

        def one(text):
            if text is None:
                return None
            p = Cells()
            parts = plain.split(text)
            if any("<" in data for data in parts[::4]) or not raw.isdisjoint(map(str.lower, parts[2::4])) or any(a and e for e, a in zip(parts[1::4], parts[3::4])):
                p.feed(text)
                p.close()
            else:
                for at in range(0, len(parts), 4):
                    if p.cell is not None and parts[at]:
                        p.cell.append(unescape(parts[at]) if "&" in parts[at] else parts[at])
                    if at + 1 < len(parts):
                        end, tag, attrs = parts[at + 1], parts[at + 2].lower(), parts[at + 3]
                        if end:
                            p.handle_endtag(tag)
                        else:
                            p.handle_starttag(tag, [(n.lower(), v) for n, v in re.findall(r'([A-Za-z]+)="([^"]*)"', attrs)] if attrs else ())
            p.close_cell()
            width = max((len(r) for r in p.rows), default=0)
            if not p.rows:
                return ""
            lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in p.rows]
            lines.insert(1, "| " + " | ".join(["---"] * width) + " |")
            return "\n".join(lines)

        return html.map(one)

    convert.__annotations__ = {"html": pd.Series, "return": pd.Series}
    return F.pandas_udf(convert, "string")
