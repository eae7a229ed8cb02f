"""All registered queries and their oracle SQL."""

from tillscope.plans import queries_clean, queries_load, queries_metrics, queries_more, queries_report, queries_trend  # noqa: F401
from tillscope.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
