"""Scalar and aggregate functions with PostgreSQL semantics, as Spark column expressions."""

from . import aggregates, intervals, numbers, predicates, temporal, text

__all__ = ["aggregates", "intervals", "numbers", "predicates", "temporal", "text"]
