"""Registered queries over the shared tables."""

from tarnlake.plans.registry import REGISTRY, Query, query  # noqa: F401
from tarnlake.plans import (  # noqa: F401
    advantages,
    batches,
    evaluation,
    pass_rates,
    preference,
    prompts,
    retrieval,
    scoring,
    sequences,
    sources,
    token_metrics,
)
