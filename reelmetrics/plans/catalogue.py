"""All registered queries. Importing a plan module registers its entries."""

from reelmetrics.plans import (  # noqa: F401
    customers,
    films,
    gaps,
    layouts,
    periods,
    rankings,
    running,
    staff,
)
from reelmetrics.plans.registry import CATALOGUE, oracle_text, runner

__all__ = ["CATALOGUE", "oracle_text", "runner"]
