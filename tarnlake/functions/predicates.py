"""Row predicates used when prompts are built, and gates that count violations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
BLOCKED_SOURCES = ["geeksforgeeks", "leetcode"]
COMMON_LEAD = "Solve the following coding problem using the programming language python:"
UNWANTED_STARTS = ["example", "input", "-----input-----"]
UNLIMITED_TOKENS = 128000


def within_length(tokens: Column, low: int = 0, high: int = 2048, tolerance: int = 100) -> Column:
    return (tokens >= low) & (tokens <= high - tolerance)


def prompt_text(rendered: Column, raw: Column, required: bool = True) -> Column:
    """Rendered prompt, else the raw one; both empty is an error, or null where rows need not have a prompt."""
    text = F.coalesce(F.nullif(rendered, F.lit("")), F.nullif(raw, F.lit("")))
    if not required:
        return text
    return F.coalesce(text, F.raise_error(F.lit("no prompt found in row")).cast("string"))


def alphanumeric_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))


def mentions_image(text: Column) -> Column:
    return F.contains(F.lower(text), F.lit("image")) | F.contains(text, F.lit("\n!["))


def mentions_image_tag(text: Column) -> Column:
    return F.contains(F.lower(text), F.lit("<image>")) | F.contains(F.lower(text), F.lit("[image]"))


def blocked_source(source: Column) -> Column:
    return source.isin(BLOCKED_SOURCES)


def unwanted_start(text: Column) -> Column:
    """Starts like a bare example, once the common lead-in is gone."""
    after = F.when(
        F.contains(text, F.lit(COMMON_LEAD)), F.regexp_replace(F.try_element_at(F.split(text, COMMON_LEAD), F.lit(2)), r"^\s+", "")
    ).otherwise(text)
    low = F.lower(after)
    bad = F.lit(False)
    for s in UNWANTED_STARTS:
        bad = bad | F.startswith(low, F.lit(s))
    return bad


def stem_question(answer: Column, category: Column, difficulty: Column, kind: Column) -> Column:
    one_letter = (F.length(answer) == 1) & answer.rlike(r"^\p{L}$")
    return (
        ~one_letter & (category != "Mathematics") & difficulty.isin("University", "PhD")
        & ~kind.isin("Boolean", "Multiple Choice") & answer.rlike(r"\S")
    )


def too_many_decimals(text: Column, most: int = 3) -> Column:
    return text.rlike(r"\d+\.\d{%d,}" % (most + 1))


def bad_tests(tests: Column, function: Column) -> Column:
    """Empty suite, unknown kind, or a functional suite without a function name."""
    kind = F.try_element_at(tests, F.lit(1))["testtype"]
    return (
        (F.coalesce(F.size(tests), F.lit(0)) <= 0) | F.coalesce(~kind.isin("functional", "stdin"), F.lit(True))
        | ((kind == "functional") & (F.coalesce(function, F.lit("")) == ""))
    )


def between_dates(date: Column, low: str, high: str) -> Column:
    """Half-open range by string comparison."""
    return (date >= low) & (date < high)


def source_format(source: Column, domain: Column, name: Column) -> Column:
    parts = F.split(source, "__")
    return (F.size(parts) == 2) & (parts[0] == domain) & (F.try_element_at(parts, F.lit(2)) == name)


def special_tokens_present(text: Column) -> Column:
    return (
        F.contains(text, F.lit("<|im_start|>")) & F.contains(text, F.lit("<|im_end|>")) & F.contains(text, F.lit("<think>"))
    )
