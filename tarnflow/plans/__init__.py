"""Queries by name, each as a function of (spark, sf_dir), with the DuckDB SQL that gives the same rows."""

from . import incremental, maintained, nexmark, relational, scalars

_MODULES = (scalars, relational, nexmark, incremental, maintained)


def queries() -> dict:
    return {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
