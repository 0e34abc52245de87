"""All registered queries."""

from __future__ import annotations

from gavel.workload import (  # noqa: F401  (importing registers)
    catalog_queries,
    contest_queries,
    judging_queries,
    transport_queries,
)
from gavel.workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
