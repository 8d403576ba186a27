"""Imports every query module so that the registry is complete."""

from trackloom.workload import (  # noqa: F401
    flow_queries,
    metric_queries,
    scalar_queries,
    selection_queries,
    source_queries,
    synthetic_queries,
    window_queries,
)
from trackloom.workload.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
