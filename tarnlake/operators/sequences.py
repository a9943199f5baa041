"""Training sequences from token arrays: padding, loss masks, preference tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.operators.ranks import row_index, running_totals, with_table_stats


def truncate(arr: Column, size: int, side: str) -> Column:
    n = F.size(arr)
    if side == "right":
        return F.slice(arr, 1, size)
    if side == "left":
        return F.slice(arr, F.greatest(n - size, F.lit(0)) + 1, F.lit(size))
    if side == "middle":
        head = size // 2
        cut = F.concat(F.slice(arr, 1, head), F.slice(arr, F.greatest(n - (size - head), F.lit(0)) + 1, F.lit(size - head)))
        return F.when(n > size, cut).otherwise(arr)
    if side == "error":
        return F.when(n > size, F.raise_error(F.lit("sequence is longer than the maximum")).cast("array<int>")).otherwise(arr)
    raise ValueError(f"unknown truncation {side}")


def pad(arr: Column, size: int, value: Column, left: bool) -> Column:
    fill = F.array_repeat(value, F.greatest(F.lit(size) - F.size(arr), F.lit(0)))
    return F.concat(fill, arr) if left else F.concat(arr, fill)


def pad_or_cut(arr: Column, size: int, pad_id: int, left: bool, side: str) -> tuple[Column, Column]:
    """(ids, mask) of exactly ``size`` positions."""
    kept = truncate(arr, size, side)
    ids = pad(kept, size, F.lit(pad_id).cast("int"), left)
    mask = pad(F.transform(kept, lambda _: F.lit(1)), size, F.lit(0), left)
    return ids, mask


def tuned_sequence(prompt: Column, response: Column, eos: int, size: int, pad_id: int, side: str = "right") -> tuple[Column, Column]:
    """(ids, loss mask): prompt + response + end token; no loss on the first prompt_len - 1
    positions nor on the last position of the response."""
    answer = F.concat(response, F.array(F.lit(eos).cast("int")))
    ids, mask = pad_or_cut(F.concat(prompt, answer), size, pad_id, False, side)
    p, n = F.size(prompt), F.size(prompt) + F.size(answer)
    head, last = F.least(p, F.lit(size)) - 1, F.least(n, F.lit(size)) - 1
    loss = F.transform(mask, lambda m, i: F.when((i < head) | (i == last), 0).otherwise(m))
    return ids, loss


def turn_spans(df: DataFrame, conv: str, turn: str, tokens: Column) -> DataFrame:
    """Token offsets per turn; the loss covers the tokens of assistant turns."""
    sized = df.withColumn("n_tokens", tokens)
    out = running_totals(sized, [conv], [F.col(turn)], {"end": F.col("n_tokens")})
    return out.withColumns({
        "start": F.col("end") - F.col("n_tokens"),
        "loss": (F.col("role") == "assistant").cast("int"),
    })


def preference_sequences(prompt: Column, chosen: Column, rejected: Column, size: int) -> dict[str, Column]:
    """Prompt + chosen and prompt + rejected, right-padded with 0 and cut to size."""
    out = {}
    for name, answer in (("chosen", chosen), ("rejected", rejected)):
        ids, mask = pad_or_cut(F.concat(prompt, answer), size, 0, False, "right")
        out[f"{name}_ids"], out[f"{name}_mask"] = ids, mask
    return out


def unpad(arr: Column, mask: Column) -> Column:
    """Drop left padding: the last sum(mask) positions."""
    n = F.aggregate(mask, F.lit(0), lambda a, m: a + m.cast("int"))
    return F.when(n > 0, F.slice(arr, F.size(arr) - n + 1, n)).otherwise(F.slice(arr, 1, 0))


def rectangular(df: DataFrame, col: str, pad_id: int, at_least: int = 0) -> DataFrame:
    """Pad every list to the longest of the table."""
    j = with_table_stats(df, _top=F.greatest(F.max(F.size(col)), F.lit(at_least)))
    fill = F.array_repeat(F.lit(pad_id).cast("int"), F.col("_top") - F.size(col))
    return j.withColumn(col, F.concat(F.col(col), fill)).drop("_top")


def split_lengths(mask: Column, response_length: int) -> tuple[Column, Column]:
    """(prompt length, response length) by mask sums; the last positions are the response."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, m: s + m.cast("int"))
    cut = F.greatest(F.size(mask) - response_length, F.lit(0))
    return total(F.slice(mask, F.lit(1), cut)), total(F.slice(mask, cut + 1, F.lit(response_length)))


def assemble_conversations(df: DataFrame, conv: str, turn: str) -> DataFrame:
    """Dense message positions per conversation, ready to gather."""
    return row_index(df, [F.col(turn)], [conv], "pos")


def preference_table(df: DataFrame, pair: list[str], chosen: str, ids: str, prompt_len: int, ref_logp: str) -> DataFrame:
    """One row per pair: ids and labels of both sides (prompt positions -100) and reference log-probs."""
    labels = F.transform(F.col(ids), lambda x, i: F.when(i < prompt_len, -100).otherwise(x))
    marked = df.withColumn("_labels", labels)
    aggs = []
    for side, flag in (("chosen", F.col(chosen)), ("rejected", ~F.col(chosen))):
        for name, c in (("ids", ids), ("labels", "_labels"), ("ref_logp", ref_logp)):
            aggs.append(F.max(F.when(flag, F.col(c))).alias(f"{side}_{name}"))
    return marked.groupBy(*pair).agg(*aggs)
