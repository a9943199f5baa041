"""One job for every dataset recipe: index, skip, length filter, sample, canonical record."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.functions.predicates import prompt_text, within_length
from tarnlake.functions.prompts import joined_contents, user_prompt
from tarnlake.functions.text import token_count
from tarnlake.operators.batches import sample_n
from tarnlake.operators.ranks import row_index
from tarnlake.session import durable


@dataclass
class Recipe:
    """What differs between datasets: the expressions over the raw columns."""

    data_source: Column
    ability: str
    key: str
    prompt: Column
    ground_truth: Column
    style: str = "rule"
    split: str = "train"
    apply_chat_template: bool = True
    raw_prompt: Column | None = None
    skip: dict[str, Column] = field(default_factory=dict)
    extra: dict[str, Column] = field(default_factory=dict)
    max_tokens: int | None = None
    sample: int | None = None
    seed: str = "42"


def skip_reason(skip: dict[str, Column]) -> Column:
    """Name of the first rule that drops the row, null when it stays."""
    return F.coalesce(*[F.when(cond, F.lit(name)) for name, cond in skip.items()], F.lit(None).cast("string"))


def skip_counts(df: DataFrame, skip: dict[str, Column]) -> DataFrame:
    return df.groupBy(F.coalesce(skip_reason(skip), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def build_prompts(df: DataFrame, r: Recipe) -> DataFrame:
    """Canonical prompt table; cheap row rules run before the index and the token count."""
    kept = df.filter(skip_reason(r.skip).isNull()) if r.skip else df
    indexed = row_index(kept, [F.col(r.key)], name="_index")
    raw = r.raw_prompt if r.raw_prompt is not None else F.lit(None).cast("string")
    extra = {"split": F.lit(r.split), "index": F.col("_index").cast("string"), **r.extra}
    pairs = [x for n, c in extra.items() for x in (F.lit(n), c.cast("string"))]
    out = indexed.select(
        F.col(r.key).alias("uid"),
        r.data_source.alias("data_source"), F.lit(r.ability).alias("ability"), r.prompt.alias("prompt"),
        raw.alias("raw_prompt"), F.lit(r.apply_chat_template).alias("apply_chat_template"),
        F.struct(F.lit(r.style).alias("style"), r.ground_truth.cast("string").alias("ground_truth")).alias("reward_model"),
        F.create_map(*pairs).alias("extra_info"),
    )
    if r.max_tokens is not None:
        tokens = token_count(prompt_text(joined_contents(F.col("prompt")), F.col("raw_prompt")))
        out = out.filter(within_length(tokens, 0, r.max_tokens))
    return sample_n(out, "uid", r.seed, r.sample)


def flat(prompts: DataFrame) -> DataFrame:
    """Readable columns of a canonical table."""
    return prompts.select(
        "uid", "data_source", "ability", "reward_model.style", "reward_model.ground_truth",
        F.col("extra_info")["index"].alias("index"), joined_contents(F.col("prompt")).alias("content"),
    )


def pair_rows(df: DataFrame, prompt: str, chosen: str, rejected: str) -> DataFrame:
    """Chosen and rejected answers each become one training row."""
    rest = [c for c in df.columns if c not in (chosen, rejected)]
    sides = F.array(
        F.struct(F.lit("chosen").alias("side"), F.col(chosen).alias("response")),
        F.struct(F.lit("rejected").alias("side"), F.col(rejected).alias("response")),
    )
    return df.select(*rest, F.explode(sides).alias("s")).select(*rest, "s.side", "s.response")


# fixed values: columns of each table that a preference set turns into
PREFERENCE_TABLES = {
    "sft": ["row_no", "prompt", "response"],
    "rm": ["row_no", "prompt", "chosen", "rejected"],
    "rl": ["row_no", "data_source", "messages", "ability", "reward_model", "extra_info"],
}


def preference_tables(
    df: DataFrame, order: list[Column], prompt: Column, chosen: Column, rejected: Column, response: Column, data_source: Column, train: float = 0.75,
) -> DataFrame:
    """Rows of a preference set as rows of three canonical tables, tagged with ``table`` and ``split``.

    sft: prompt with the chosen, then with the rejected answer, all train.  rm: prompt with both, the
    first share of the positions train (a half rounded to even), the others test.  rl: one canonical row,
    all train.  The columns that a table lacks are null.  The input is evaluated once: its rows are stored
    with their positions and become all tables in one reading.  ``order`` must identify a row.
    """
    picked = df.select(
        *[c.alias(f"_o{i}") for i, c in enumerate(order)], prompt.alias("prompt"), chosen.alias("chosen"), rejected.alias("rejected"),
        response.cast("string").alias("response"), data_source.alias("data_source"),
    )
    placed = durable(row_index(picked, [F.col(f"_o{i}") for i in range(len(order))], name="_at"), "preference")
    cut = round(placed.count() * train)
    at = F.col("_at")
    fields = {
        "row_no": at, "prompt": F.col("prompt"), "response": F.col("response"), "chosen": F.col("chosen"), "rejected": F.col("rejected"),
        "data_source": F.col("data_source"), "messages": user_prompt(F.col("prompt")), "ability": F.lit("alignment"),
        "reward_model": F.struct(F.lit("model").alias("style"), F.col("response").alias("ground_truth")),
        "extra_info": F.struct(F.lit("train").alias("split"), at.alias("index")),
    }
    types = placed.select(*[c.alias(n) for n, c in fields.items()]).schema

    def row(name: str, split: Column, **own: Column) -> Column:
        cols = {**fields, **own}
        value = lambda n: cols[n] if n in PREFERENCE_TABLES[name] else F.lit(None)
        return F.struct(F.lit(name).alias("table"), split.alias("split"), *[value(n).cast(types[n].dataType).alias(n) for n in fields])

    rows = F.array(
        row("sft", F.lit("train"), row_no=2 * at, response=F.col("chosen")), row("sft", F.lit("train"), row_no=2 * at + 1, response=F.col("rejected")),
        row("rm", F.when(at < cut, "train").otherwise("test")), row("rl", F.lit("train")),
    )
    return placed.select(F.inline(rows))


def lookup(df: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Inner lookup by key where a missing entry is an error."""
    j = df.join(dim.withColumn("_hit", F.lit(True)), key, "left")
    lost = F.raise_error(F.concat(F.lit("no entry for "), F.col(key).cast("string"))).cast("boolean")
    return j.filter(F.when(F.col("_hit").isNull(), lost).otherwise(True)).drop("_hit")


def gate(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations, checked) for rules that must hold on every row, in one pass."""
    counts = df.agg(F.count("*").alias("_n"), *[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()])
    entries = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules])
    return counts.select(F.explode(entries).alias("e"), F.col("_n").alias("checked")).select("e.rule", "e.violations", "checked")
