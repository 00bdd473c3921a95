"""Registered queries over the test tables."""

from labelsieve.catalog import (  # noqa: F401
    flow_queries,
    metric_queries,
    rating_queries,
    score_queries,
    text_queries,
)
from labelsieve.catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
