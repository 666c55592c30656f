"""All registered queries of the process-log engine."""

from tracemill.plans import evaluation_queries, grid_queries, log_queries, model_queries, space_queries, trace_queries  # noqa: F401
from tracemill.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
