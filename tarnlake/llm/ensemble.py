"""Quality classifier: a sparse ensemble of rules from boosted trees, as one Spark column expression.

Shallow regression trees are boosted on binned statistics of labelled rows.  Every path from the root to a
node is a conjunction of thresholds, a rule.  A logistic model over the rules with a lasso penalty keeps
few of them; the penalty is chosen on rows set aside.  The model is compiled into a column.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.common import training_rows
from tarnlake.llm.rules import FEATURES, Condition, Rule
from tarnlake.llm.statistics import with_statistics

TRAIN_ROWS = 20_000  # bound of the labelled rows that reach the driver, as statistics only
PENALTIES = (0.03, 0.01, 0.003, 0.001, 0.0003)


@dataclass
class RuleModel:
    intercept: float = 0.0
    weights: list[tuple[Rule, float]] = field(default_factory=list)

    def score(self) -> Column:
        """Probability of the label 1."""
        logit = F.lit(self.intercept)
        for rule, w in self.weights:
            test = rule[0].column()
            for c in rule[1:]:
                test = test & c.column()
            logit = logit + F.when(test, F.lit(w)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-logit))


def _tree(codes, cuts, names, gradient, depth: int, min_rows: int):
    """Paths of one regression tree on binned features, and its prediction for each row."""
    import numpy as np

    paths, pred = [], np.zeros(len(gradient))

    def split(rows, path: Rule, left: int) -> None:
        total, n, best = gradient[rows].sum(), len(rows), (1e-9, None)
        if left and n >= 2 * min_rows:
            for j in range(codes.shape[1]):
                k = len(cuts[j]) + 1
                sums = np.cumsum(np.bincount(codes[rows, j], gradient[rows], k))[:-1]
                counts = np.cumsum(np.bincount(codes[rows, j], minlength=k))[:-1]
                ok = (counts >= min_rows) & (n - counts >= min_rows)
                if not ok.any():
                    continue
                gain = np.where(ok, sums**2 / np.maximum(counts, 1) + (total - sums) ** 2 / np.maximum(n - counts, 1) - total**2 / n, 0)
                b = int(gain.argmax())
                if gain[b] > best[0]:
                    best = (gain[b], (j, b))
        if best[1] is None:
            pred[rows] = total / max(n, 1)
            return
        j, b = best[1]
        low = codes[rows, j] <= b
        for above, part in ((False, rows[low]), (True, rows[~low])):
            longer = (*path, Condition(names[j], above, float(cuts[j][b])))
            paths.append(longer)
            split(part, longer, left - 1)

    split(np.arange(len(gradient)), (), depth)
    return paths, pred


def _lasso(z, y, penalty: float, rounds: int = 400):
    """Logistic regression with an L1 penalty on all but the intercept, by accelerated proximal gradient."""
    import numpy as np

    n, k = z.shape
    step = 4.0 / (np.linalg.norm(z, 2) ** 2 / n + 1)
    w, b = np.zeros(k), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    vw, vb, t = w, b, 1.0
    for _ in range(rounds):
        r = 1 / (1 + np.exp(-np.clip(z @ vw + vb, -30, 30))) - y
        nw = vw - step * (z.T @ r) / n
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0)
        nb = vb - step * r.mean()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb, w, b, t = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b), nw, nb, nt
    return w, b


def fit_rules(rows: list, features: list[str] = FEATURES, label: str = "_label", trees: int = 24, depth: int = 3, rate: float = 0.3) -> RuleModel:
    """Fit on rows with statistics and a 0/1 label; with one class only, the model is its share."""
    import numpy as np

    rows = [r for r in rows if r[label] is not None]
    if not rows:
        return RuleModel()
    y = np.array([float(r[label] > 0) for r in rows])
    prior = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    if y.min() == y.max():
        return RuleModel(prior)
    x = np.array([[float(r[f]) for f in features] for r in rows])
    cuts = []
    for j in range(x.shape[1]):
        u = np.unique(np.quantile(x[:, j], np.linspace(0, 1, 65), method="nearest"))
        cuts.append((u[1:] + u[:-1]) / 2)
    codes = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    held = np.arange(len(y)) % 5 == 4
    margin, found = np.full(len(y), prior), {}
    for _ in range(trees):
        gradient = y - 1 / (1 + np.exp(-margin))
        paths, pred = _tree(codes, cuts, features, gradient, depth, max(3, len(y) // 1000))
        margin = margin + rate * 4 * pred
        found.update(dict.fromkeys(paths))
    cols, kept, seen = [], [], set()
    named = {f: x[:, j] for j, f in enumerate(features)}
    for rule in found:
        m = np.ones(len(y), bool)
        for c in rule:
            m &= c.mask(named)
        key = m.tobytes()
        if 0 < m.sum() < len(y) and key not in seen:
            seen.add(key)
            cols.append(m)
            kept.append(rule)
    if not cols:
        return RuleModel(prior)
    z = np.stack(cols, axis=1).astype(float)

    def loss(penalty: float) -> float:
        w, b = _lasso(z[~held], y[~held], penalty)
        p = np.clip(1 / (1 + np.exp(-(z[held] @ w + b))), 1e-6, 1 - 1e-6)
        return float(-(y[held] * np.log(p) + (1 - y[held]) * np.log(1 - p)).mean())

    best = min(PENALTIES, key=loss) if held.any() and 0 < y[~held].mean() < 1 else PENALTIES[1]
    w, b = _lasso(z, y, best)
    return RuleModel(float(b), [(r, float(v)) for r, v in zip(kept, w) if abs(v) > 1e-4])


def learn_from(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS) -> RuleModel:
    sample = training_rows(docs.select("doc_id", "text"), labels, "quality", max_rows)
    rows = with_statistics(sample, F.col("text")).select("doc_id", "_label", *FEATURES).collect()
    return fit_rules(sorted(rows, key=lambda r: (str(r["doc_id"]), r[1:])))


def score_quality(docs: DataFrame, model: RuleModel, text: Column) -> DataFrame:
    """Add the statistics and ``__quality`` (0 to 1).

    Null and empty texts have statistics of 0 and get the score of such a row.  Each row is scored on its own.
    """
    return with_statistics(docs, text).withColumn("__quality", model.score())
