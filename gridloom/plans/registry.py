"""All queries of the core library."""

from __future__ import annotations

from gridloom.plans import brownfield_queries, check_queries, graph_queries, network_queries, overlay_queries, relational_queries, spatial_queries
from gridloom.plans.base import ORACLES, QUERIES, Query

MODULES = (relational_queries, spatial_queries, graph_queries, network_queries, brownfield_queries, overlay_queries, check_queries)


def queries() -> dict[str, Query]:
    """Queries by name."""
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """SQL for the same rows, by name."""
    return dict(ORACLES)
