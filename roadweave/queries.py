"""The library's queries over the driver's tables, each with its DuckDB equivalent."""

from __future__ import annotations

from .plans import layer_queries, method_queries, network_queries, polygon_queries, report_queries, route_queries, series_queries, spatial_queries  # noqa: F401  they register themselves
from .plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
