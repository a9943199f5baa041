"""Quality rules: a learned decision list over text statistics, applied as one ordered Spark expression.

Sequential covering: a rule is a conjunction of thresholds, grown condition by condition by information
gain on one part of the labelled rows and pruned on the other.  It joins the list if it is precise on the
pruning part; the rows that it covers are set aside and the next rule is grown on the rest.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.common import training_rows
from tarnlake.llm.statistics import RATES, with_statistics

FEATURES = ["n_words", *RATES]
TRAIN_ROWS = 20_000  # bound of the labelled rows that reach the driver, as statistics only
REASON = "__rule"


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    value: float

    def column(self) -> Column:
        c = F.col(self.feature)
        return c >= self.value if self.above else c <= self.value

    def mask(self, x):
        v = x[self.feature]
        return v >= self.value if self.above else v <= self.value

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<='} {self.value:.6g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x, n: int):
    import numpy as np

    m = np.ones(n, bool)
    for c in rule:
        m &= c.mask(x)
    return m


def _cuts(values, limit: int = 48):
    import numpy as np

    u = np.unique(values)
    if len(u) > limit:
        u = np.unique(np.quantile(values, np.linspace(0, 1, limit), method="nearest"))
    return (u[1:] + u[:-1]) / 2


def _grow(x, bad, max_conditions: int) -> Rule:
    import numpy as np

    rule: Rule = ()
    inside = np.ones(len(bad), bool)
    while len(rule) < max_conditions:
        p0, n0 = int((inside & bad).sum()), int((inside & ~bad).sum())
        if p0 == 0 or n0 == 0:
            break
        base, best = math.log2(p0 / (p0 + n0)), (0.0, None)
        for f, values in x.items():
            v, b = values[inside], bad[inside]
            order = np.argsort(v, kind="stable")
            v, cum = v[order], np.concatenate([[0], np.cumsum(b[order])])
            cuts = _cuts(v)
            at = np.searchsorted(v, cuts, side="right")
            for above, p, n in ((False, cum[at], at - cum[at]), (True, p0 - cum[at], n0 - (at - cum[at]))):
                gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1e-9) / np.maximum(p + n, 1)) - base), 0.0)
                if len(gain) and gain.max() > best[0] + 1e-9:
                    k = int(gain.argmax())
                    best = (float(gain[k]), Condition(f, above, float(cuts[k])))
        if best[1] is None:
            break
        rule = (*rule, best[1])
        inside &= best[1].mask(x)
    return rule


def _prune(rule: Rule, x, bad) -> Rule:
    """The leading conditions with the best surplus of bad over good rows among those covered."""
    def worth(r: Rule) -> float:
        m = _covers(r, x, len(bad))
        p, n = int((m & bad).sum()), int((m & ~bad).sum())
        return (p - n) / (p + n) if p + n else -1.0

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (round(worth(r), 3), -len(r)), default=())


def learn_decision_list(
    rows: list, features: list[str] = FEATURES, label: str = "_label", min_precision: float = 0.9, min_covered: int = 5,
    max_rules: int = 12, max_conditions: int = 4,
) -> list[Rule]:
    """Ordered rules for rejecting, from rows with statistics and a label (1: good, 0: bad).

    Rows without a label are left out; without bad rows the list is empty and nothing is rejected.
    """
    import numpy as np

    rows = [r for r in rows if r[label] is not None]
    if not rows:
        return []
    bad = np.array([r[label] == 0 for r in rows])
    x = {f: np.array([float(r[f]) for r in rows]) for f in features}
    prune = np.arange(len(rows)) % 3 == 2
    left = np.ones(len(rows), bool)
    out: list[Rule] = []
    part = lambda m: ({f: v[m] for f, v in x.items()}, bad[m])
    while len(out) < max_rules:
        grow_x, grow_bad = part(left & ~prune)
        prune_x, prune_bad = part(left & prune)
        if grow_bad.sum() < min_covered:
            break
        rule = _grow(grow_x, grow_bad, max_conditions)
        rule = _prune(rule, prune_x, prune_bad) if len(prune_bad) else rule
        if not rule:
            break
        hit_p, hit_g = _covers(rule, prune_x, len(prune_bad)), _covers(rule, grow_x, len(grow_bad))
        covered = int(hit_p.sum() + hit_g.sum())
        right = int((hit_p & prune_bad).sum() + (hit_g & grow_bad).sum())
        precise = hit_p.sum() == 0 or (hit_p & prune_bad).sum() >= min_precision * hit_p.sum()
        if covered < min_covered or right < min_precision * covered or not precise:
            break
        out.append(rule)
        left &= ~_covers(rule, x, len(rows))
    return out


def decision(rules: list[Rule]) -> Column:
    """Text of the first rule that holds, null if none does."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        test = rule[0].column()
        for c in rule[1:]:
            test = test & c.column()
        out = F.when(test, F.lit(" and ".join(map(str, rule)))).otherwise(out)
    return out


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def learn_from(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS, **options) -> list[Rule]:
    sample = training_rows(docs.select("doc_id", "text"), labels, "quality", max_rows)
    rows = with_statistics(sample, F.col("text")).select("doc_id", "_label", *FEATURES).collect()
    return learn_decision_list(sorted(rows, key=lambda r: (str(r["doc_id"]), r[1:])), **options)


def judge(docs: DataFrame, rules: list[Rule], text: Column) -> DataFrame:
    """Add the statistics, ``base_failed``, ``kept`` and the reason (``__rule``).

    Null and empty texts have no words and fail the base.  An empty rule list keeps what passes the base.
    Each row is judged on its own; repeated rows get the same verdict, an empty table stays empty.
    """
    d = with_statistics(docs, text)
    return d.withColumns({"base_failed": base_failed(), REASON: decision(rules)}).withColumn("kept", ~F.col("base_failed") & F.col(REASON).isNull())
