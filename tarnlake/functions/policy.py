"""Token-level expressions on logged log-probabilities, rewards and values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8  # fixed value: added to masked denominators and variances


def clip(x: Column, lo, hi) -> Column:
    lo = lo if isinstance(lo, Column) else F.lit(float(lo))
    hi = hi if isinstance(hi, Column) else F.lit(float(hi))
    return F.least(F.greatest(x, lo), hi)


def masked_sum(x: Column, mask: Column) -> Column:
    return F.sum(x * mask)


def masked_mean(x: Column, mask: Column) -> Column:
    return F.sum(x * mask) / (F.sum(mask) + EPS)


def masked_var(x: Column, mask: Column, mean: Column, unbiased: bool = True) -> Column:
    """Variance over the mask (or weights) about a mean found before; the Bessel factor needs a mask total above one.

    Squares are taken of centred values, so values far from zero lose no digits.
    """
    n = F.sum(mask)
    biased = F.sum(mask * (x - mean) * (x - mean)) / (n + EPS)
    if not unbiased:
        return biased
    guard = F.when(n <= 1, F.raise_error(F.lit("masked variance needs a mask total above one")).cast("double"))
    return F.coalesce(guard, biased * n / (n - 1))


def kl_estimate(logp: Column, ref: Column, kind: str) -> Column:
    d = logp - ref
    if kind == "k1":
        return d
    if kind == "abs":
        return F.abs(d)
    if kind == "k2":
        return 0.5 * d * d
    if kind == "k3":
        return clip(F.exp(-d) + d - 1, -10.0, 10.0)
    raise ValueError(f"unknown KL estimator {kind}")


def log_sigmoid(x: Column) -> Column:
    """ln(1 / (1 + exp(-x))) without overflow on either side."""
    return -(F.greatest(-x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x))))


def policy_terms(adv: Column, logp: Column, old: Column, low: float, high: float, dual: float) -> dict[str, Column]:
    """Dual-clipped loss and its diagnostics for one token."""
    ratio = F.exp(logp - old)
    plain = -adv * ratio
    clipped = -adv * clip(ratio, 1 - low, 1 + high)
    upper = F.greatest(plain, clipped)
    floor = -adv * dual
    loss = F.when(adv < 0, F.least(floor, upper)).otherwise(upper)
    return {
        "loss": loss,
        "clipped_high": (clipped > plain).cast("double"),
        "clipped_low": ((upper > floor) & (adv < 0)).cast("double"),
        "approx_kl": old - logp,
        "ratio": ratio,
    }


def value_terms(pred: Column, value: Column, ret: Column, width: float) -> dict[str, Column]:
    plain = F.pow(pred - ret, F.lit(2.0))
    bounded = F.pow(clip(pred, value - width, value + width) - ret, F.lit(2.0))
    return {"loss": 0.5 * F.greatest(plain, bounded), "clipped": (bounded > plain).cast("double")}


def overlong_penalty(length: Column, max_len: int, buffer: int, factor: float) -> Column:
    """Linear penalty once a response runs into the buffer before the maximum length."""
    return F.least(-(length - (max_len - buffer)) / float(buffer) * factor, F.lit(0.0))


def preference_loss(margin: Column, beta: float, smoothing: float = 0.0, kind: str = "sigmoid") -> Column:
    if kind == "sigmoid":
        return -log_sigmoid(beta * margin) * (1 - smoothing) - log_sigmoid(-beta * margin) * smoothing
    if kind == "ipo":
        return F.pow(margin - 1 / (2 * beta), F.lit(2.0))
    raise ValueError(f"unknown preference loss {kind}")
