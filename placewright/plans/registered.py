"""All registered queries."""

from __future__ import annotations

from placewright.plans import queries_alias, queries_core, queries_final, queries_rank, queries_report, queries_route  # noqa: F401  (they register themselves)
from placewright.plans.queries import QUERIES  # noqa: F401
