"""Text expressions: token counts, extraction of marked answers, chat rendering."""

from __future__ import annotations

from collections import OrderedDict
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed value: a word, or one non-blank character that is not part of a word
TOKEN_PATTERN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"


def token_count(text: Column, method: str = "regex") -> Column:
    """Number of tokens; pass a pandas UDF through ``custom_tokens`` for a model tokenizer."""
    if method == "regex":
        return F.regexp_count(text, F.lit(TOKEN_PATTERN)).cast("long")
    if method == "chars4":
        return F.floor(F.length(text) / 4).cast("long")
    raise ValueError(f"unknown token count method {method}")


def custom_tokens(count_fn):
    """Token count with a user function over a batch: Series of str -> Series of int."""
    import pandas as pd

    def counted(texts):
        return count_fn(texts.fillna("")).astype("int64")

    counted.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(counted, "long")


def shared(fn):
    """The function's expression is built once for the same column objects; building costs more than analysing it."""
    held: OrderedDict = OrderedDict()

    @wraps(fn)
    def call(*args):
        key = tuple(map(id, args))
        if key not in held:
            # the arguments are held too, so that their ids stay theirs
            held[key] = (fn(*args), args)
            if len(held) > 64:
                held.popitem(last=False)
        return held[key][0]

    return call


def let(value: Column, fn) -> Column:
    """Name an intermediate value, so that an expression that uses it twice computes it once."""
    return F.get(F.transform(F.array(value), lambda v: fn(v)), F.lit(0))
