"""Relational operators on plain DataFrames, with PostgreSQL's bag semantics."""

from . import grouping, joins, ordering, setops, subqueries, windows

__all__ = ["grouping", "joins", "ordering", "setops", "subqueries", "windows"]
