"""Instruction checks as boolean expressions over a response and its arguments.

Each check takes the response and a dict of argument columns.  Sentences are split with a pattern
(see ``sentences``), which approximates the trained splitter of the published benchmark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnlake.functions.answers import strip
from tarnlake.functions.benchmarks import found
from tarnlake.functions.text import shared

CHECKS: dict[str, Callable[[Column, dict[str, Column]], Column]] = {}

# fixed values: comparison names
LESS_THAN, AT_LEAST = "less than", "at least"

# a word character and the edge of a word as Python's patterns (and the SQL twins) have them: combining marks are neither
LETTER = r"[\p{L}\p{N}_]"
WORD = LETTER + "+"
EDGE = rf"(?:(?<={LETTER})(?!{LETTER})|(?<!{LETTER})(?={LETTER}))"
TOKEN = r"(?U)\w+(?:[-']\w+)*|[^\w\s]"


def check(*names: str):
    def add(fn):
        for n in names:
            CHECKS[n] = fn
        return fn

    return add


def compared(n: Column, relation: Column, limit: Column) -> Column:
    return F.when(relation == LESS_THAN, n < limit).otherwise(n >= limit)


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


@shared
def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


@shared
def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


@shared
def sentences(text: Column) -> Column:
    """Runs up to . ? or ! that are followed by blank space or the end."""
    flat = F.replace(text, F.lit("\n"), F.lit(" "))
    return F.filter(F.transform(F.split(flat, r"(?<=[.?!])[\"”]?\s+"), strip), lambda s: s != "")


@shared
def blank(text: Column) -> Column:
    return strip(text) == ""


def outer_blanks_only(parts: Column) -> Column:
    """Blank parts are allowed at both ends only."""
    return F.forall(
        F.transform(parts, lambda p, i: ~blank(p) | (i == 0) | (i == F.size(parts) - 1)), lambda ok: ok
    )


@shared
def filled(parts: Column) -> Column:
    return F.filter(parts, lambda p: ~blank(p))


def paragraphs_equal(text: Column, splitter: str, n: Column) -> Column:
    parts = F.split(text, splitter)
    return outer_blanks_only(parts) & (F.size(filled(parts)) == n)


@check("keywords:existence")
def keywords_exist(v, a):
    return F.forall(a["keywords"], lambda k: F.regexp_like(v, F.concat(F.lit("(?i)"), k)))


@check("keywords:frequency", "keywords:word_count_different_numbers")
def keyword_frequency(v, a):
    return compared(F.regexp_count(v, F.concat(F.lit("(?i)"), a["keyword"])), a["relation"], a["n"])


@check("keywords:forbidden_words")
def forbidden_words(v, a):
    return ~F.exists(a["keywords"], lambda k: F.regexp_like(v, F.concat(F.lit("(?iu)" + EDGE), k, F.lit(EDGE))))


@check("keywords:letter_frequency", "letters:letter_counting2")
def letter_frequency(v, a):
    low = F.lower(v)
    return compared(F.length(low) - F.length(F.replace(low, F.lower(a["letter"]), F.lit(""))), a["relation"], a["n"])


@check("language:response_language")
def response_language(v, a):
    """Compared with a language column; an unknown language counts as followed."""
    return F.coalesce(a["lang"] == a["wanted_lang"], F.lit(True))


@check("length_constraints:number_sentences")
def number_sentences(v, a):
    return compared(F.size(sentences(v)), a["relation"], a["n"])


@check("length_constraints:number_paragraphs")
def number_paragraphs(v, a):
    return paragraphs_equal(v, r"\s?\*\*\*\s?", a["n"])


@check("length_constraints:number_words")
def number_words(v, a):
    return compared(count(v, WORD), a["relation"], a["n"])


@check("length_constraints:nth_paragraph_first_word")
def nth_paragraph_first_word(v, a):
    parts = F.split(v, "\n\n")
    n = F.size(filled(parts))
    para = strip(F.try_element_at(parts, a["nth"]))
    first = F.regexp_replace(F.try_element_at(words(para), F.lit(1)), "^'*\"*", "")
    lead = F.lower(F.regexp_extract(first, r"^([^.,?!'\"]*)", 1))
    return (a["nth"] <= n) & F.coalesce(para != "", F.lit(False)) & (n == a["n"]) & (lead == a["word"])


@check("detectable_content:number_placeholders")
def number_placeholders(v, a):
    return count(v, r"\[.*?\]") >= a["n"]


@check("detectable_content:postscript")
def postscript(v, a):
    low = F.lower(v)
    own = F.regexp_like(low, F.concat(F.lit("(?m)\\s*"), F.lower(a["marker"]), F.lit(".*$")))
    return (
        F.when(a["marker"] == "P.P.S", low.rlike(r"(?m)\s*p\.\s?p\.\s?s.*$"))
        .when(a["marker"] == "P.S.", low.rlike(r"(?m)\s*p\.\s?s\..*$")).otherwise(own)
    )


@check("detectable_format:number_bullet_lists")
def number_bullet_lists(v, a):
    return count(v, r"(?m)^\s*\*[^\*].*$") + count(v, r"(?m)^\s*-.*$") == a["n"]


@check("detectable_format:constrained_response")
def constrained_response(v, a):
    return F.exists(a["options"], lambda o: F.contains(v, o))


@check("detectable_format:number_highlighted_sections")
def number_highlighted_sections(v, a):
    single = F.filter(found(v, r"\*[^\n\*]*\*", 0), lambda h: ~blank(F.regexp_replace(h, r"^\*+|\*+$", "")))
    double = F.filter(found(v, r"\*\*[^\n\*]*\*\*", 0), lambda h: ~blank(F.regexp_replace(h, r"^\*\*|\*\*$", "")))
    return F.size(single) + F.size(double) >= a["n"]


@check("detectable_format:multiple_sections")
def multiple_sections(v, a):
    return F.regexp_count(v, F.concat(F.lit(r"\s?"), a["splitter"], F.lit(r"\s?\d+\s?"))) >= a["n"]


@check("detectable_format:json_format")
def json_format(v, a):
    body = F.regexp_replace(strip(v), r"^```(?:json|Json|JSON)?|```$", "")
    return F.try_parse_json(strip(body)).isNotNull()


@check("detectable_format:title")
def title(v, a):
    return F.exists(found(v, r"<<[^\n]+>>", 0), lambda t: ~blank(F.regexp_replace(t, r"^<+|>+$", "")))


@check("combination:two_responses")
def two_responses(v, a):
    parts = F.split(v, r"\*\*\*\*\*\*")
    kept = filled(parts)
    return outer_blanks_only(parts) & (F.size(kept) == 2) & (
        strip(F.get(kept, F.lit(0))) != F.coalesce(strip(F.get(kept, F.lit(1))), F.lit(""))
    )


@check("combination:repeat_prompt")
def repeat_prompt(v, a):
    return F.startswith(F.lower(strip(v)), F.lower(strip(a["prompt"])))


@check("startend:end_checker")
def end_checker(v, a):
    return F.endswith(F.lower(F.regexp_replace(strip(v), '^"+|"+$', "")), F.lower(strip(a["phrase"])))


@check("startend:quotation")
def quotation(v, a):
    s = strip(v)
    return (F.length(s) > 1) & F.startswith(s, F.lit('"')) & F.endswith(s, F.lit('"'))


@check("change_case:english_capital")
def english_capital(v, a):
    return (v == F.upper(v)) & (v != F.lower(v)) & F.coalesce(a["lang"] == "en", F.lit(True))


@check("change_case:english_lowercase")
def english_lowercase(v, a):
    return (v == F.lower(v)) & (v != F.upper(v)) & F.coalesce(a["lang"] == "en", F.lit(True))


@check("change_case:capital_word_frequency")
def capital_word_frequency(v, a):
    caps = F.filter(tokens(v), lambda w: (w == F.upper(w)) & (w != F.lower(w)))
    return compared(F.size(caps), a["relation"], a["n"])


@check("punctuation:no_comma")
def no_comma(v, a):
    return ~F.contains(v, F.lit(","))


# the extended set


@check("copy:repeat_phrase")
def repeat_phrase(v, a):
    """n copies of the phrase, each with the same length; the last one differs in exactly one word."""
    ref = words(a["phrase"])
    pattern = F.concat(F.get(ref, F.lit(0)), F.lit(" .*? "), F.try_element_at(ref, F.lit(-1)))
    hits = F.regexp_extract_all(v, pattern, F.lit(0))
    diff = lambda h: F.aggregate(F.zip_with(words(h), ref, lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, d: s + F.coalesce(d, F.lit(1)))
    fits = F.forall(hits, lambda h: (F.size(words(h)) == F.size(ref)) & (diff(h) <= 1))
    return (F.size(hits) == a["n"]) & fits & (diff(F.try_element_at(hits, F.lit(-1))) == 1)


@check("copy:copy", "copy:copying_simple")
def copies_prompt(v, a):
    return F.lower(strip(v)) == F.lower(strip(a["prompt"]))


@check("new:copy_span_idx")
def copy_span(v, a):
    return F.lower(strip(v)) == F.lower(strip(F.substring(a["prompt"], a["start"] + 1, a["end"] - a["start"])))


@check("copy:copying_multiple")
def copying_multiple(v, a):
    parts = F.split(v, r"\*\*\*\*\*\*")
    return (F.size(parts) == a["n"]) & F.forall(parts, lambda p: F.lower(strip(p)) == F.lower(strip(a["prompt"])))


@check("detectable_format:sentence_hyphens")
def sentence_hyphens(v, a):
    return F.contains(v, F.lit("-")) & F.forall(F.split(v, "-"), lambda w: (strip(w) == w) & ~F.contains(w, F.lit(" ")))


@check("keywords:no_adjacent_consecutive")
def no_adjacent_consecutive(v, a):
    initials = F.transform(words(v), lambda w: F.ascii(F.lower(F.left(w, F.lit(1)))))
    shifted = F.slice(initials, F.lit(2), F.greatest(F.size(initials) - 1, F.lit(0)))
    return F.forall(F.zip_with(initials, shifted, lambda x, y: y - x), lambda g: F.coalesce(g != 1, F.lit(True)))


@check("detectable_format:square_brackets")
def square_brackets(v, a):
    return F.forall(words(v), lambda w: F.startswith(w, F.lit("[")) & F.endswith(w, F.lit("]")))


@check("keywords:word_once")
def word_once(v, a):
    return F.regexp_count(v, F.concat(F.lit("(?i)"), a["keyword"])) == 1


@check("keywords:exclude_word_harder")
def exclude_word(v, a):
    return ~F.contains(v, F.concat(F.lit(" "), a["keyword"], F.lit(" ")))


@check("paragraphs:paragraphs")
def two_paragraphs_marked(v, a):
    return paragraphs_equal(v, r"\s?\*\*\*\s?", F.lit(2))


@check("paragraphs:paragraphs2")
def two_paragraphs_blank(v, a):
    return paragraphs_equal(v, "\n\n", F.lit(2))


@check("first_word:first_word_sent")
def first_word_sentences(v, a):
    return F.forall(sentences(v), lambda s: F.lower(F.get(words(s), F.lit(0))) == F.lower(a["word"]))


@check("first_word:first_word_answer")
def first_word_answer(v, a):
    return F.coalesce(F.lower(F.get(words(v), F.lit(0))) == F.lower(a["word"]), F.lit(False))


def last_plain_word(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.try_element_at(words(text), F.lit(-1)), r"(?U)[^\w\s]", ""))


@check("last_word:last_word_sent")
def last_word_sentences(v, a):
    return F.forall(sentences(v), lambda s: last_plain_word(s) == F.lower(a["word"]))


@check("last_word:last_word_answer")
def last_word_answer(v, a):
    return F.coalesce(last_plain_word(v) == F.lower(a["word"]), F.lit(False))


@check("detectable_format:bigram_wrapping")
def bigram_wrapping(v, a):
    w = words(v)
    return F.forall(
        F.transform(w, lambda x, i: (i % 2 == 1) | (i + 1 >= F.size(w)) | (
            F.startswith(x, F.lit("<<")) & F.endswith(F.coalesce(F.get(w, i + 1), F.lit("")), F.lit(">>"))
        )), lambda ok: ok,
    )


@check("punctuation:punctuation_dot")
def no_dot(v, a):
    return ~F.contains(v, F.lit("."))


@check("punctuation:punctuation_exclamation")
def no_exclamation(v, a):
    return ~F.contains(v, F.lit("!"))


@check("count:lowercase_counting")
def lowercase_counting(v, a):
    return count(v, r"(?U)\b[a-z]+\b") <= a["n"]


@check("letters:letter_counting")
def letter_counting(v, a):
    return compared(count(v, "[a-zA-Z]"), a["relation"], a["n"])


@check("count:counting_composition")
def counting_composition(v, a):
    parts = F.split(v, r"\s?\*\*\*\s?")
    inner = F.forall(filled(parts), lambda p: (F.size(sentences(p)) == a["n_sent"]) & F.forall(
        sentences(p), lambda s: F.size(tokens(s)) == a["n_words"]))
    return outer_blanks_only(parts) & (F.size(filled(parts)) == 3) & inner


@check("count:count_unique")
def count_unique(v, a):
    t = tokens(v)
    return F.size(t) == F.size(F.array_distinct(t))


@check("count:count_increment_word")
def count_increment_word(v, a):
    n = lambda k: F.regexp_count(v, F.concat(F.lit("(?i)"), k))
    return (n(a["keyword"]) == 1) & (n(a["keyword2"]) == 2)


@check("keywords:palindrome")
def palindrome(v, a):
    return F.exists(words(v), lambda w: w == F.reverse(w))


@check("keywords:keyword_specific_position")
def keyword_position(v, a):
    s = F.try_element_at(sentences(v), a["n"])
    return F.coalesce(F.try_element_at(tokens(s), a["m"]) == a["keyword"], F.lit(False))


@check("keywords:start_end")
def start_end(v, a):
    w = F.when(F.contains(v, F.lit("-")), F.split(v, "-")).otherwise(tokens(v))
    return (F.size(w) >= 2) & (F.lower(F.get(w, F.lit(0))) == F.lower(F.try_element_at(w, F.lit(-1))))


ARGUMENTS = {
    "keywords": "array<string>", "options": "array<string>", "keyword": "string", "keyword2": "string", "relation": "string",
    "letter": "string", "n": "int", "nth": "int", "m": "int", "n_sent": "int", "n_words": "int", "start": "int", "end": "int",
    "word": "string", "marker": "string", "splitter": "string", "phrase": "string", "prompt": "string", "wanted_lang": "string",
    "lang": "string",
}
ARGUMENT_SCHEMA = "struct<" + ",".join(f"`{n}`:{t}" for n, t in ARGUMENTS.items() if n != "lang") + ">"


def follows(instruction: Column, value: Column, args: dict[str, Column], names: list[str] | None = None) -> Column:
    """Result of the named check; an unknown instruction id is an error."""
    out = F
    for name in names or list(CHECKS):
        out = out.when(instruction == name, F.coalesce(CHECKS[name](value, args), F.lit(False)))
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown instruction "), instruction)).cast("boolean"))
