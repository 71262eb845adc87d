"""All registered queries of the reference's own operators, with their SQL twins."""

from __future__ import annotations

from furrow.plans import kernels, models, relational, scalar, splits, statistics  # noqa: F401
from furrow.plans.registry import QUERIES, SQL

__all__ = ["FLAGSHIP", "QUERIES", "SQL"]

FLAGSHIP = "c19_final_summary"
