"""All registered queries."""

from __future__ import annotations

from glosswork.plans import checks, cleaning, coding_plans, explaining, modelling  # noqa: F401
from glosswork.plans.registry import QUERIES, Query, oracle_sql  # noqa: F401


def queries() -> dict[str, Query]:
    return dict(QUERIES)
