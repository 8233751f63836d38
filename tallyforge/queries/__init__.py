"""Registered queries over the driver tables, each with its SQL oracle."""

from tallyforge.queries.base import REGISTRY
from tallyforge.queries import profile_queries, measure_queries, usage_queries, model_queries, multivariate_queries, insight_queries  # noqa: F401

__all__ = ["REGISTRY"]
