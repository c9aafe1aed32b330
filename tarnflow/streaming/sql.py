"""Maintained views from SQL text: Spark parses and binds the statement, and its bound plan tells how to maintain it.

* Plans that map, filter, expand or add up rows one by one (UNION ALL included) over their sources are linear: they run over the
  inserted rows and over the deleted ones of a change.
* Plans over one source whose grouping and partitioning all share columns of that source are keyed by them: the rows of touched keys are
  recomputed.
* Anything else is recomputed as a whole, each tick that changes it; `how` says which way was taken.

A statement is refused before anything is written if it isn't one SELECT over the declared sources, doesn't bind, or isn't deterministic.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.changes import WEIGHT
from . import zset
from .graph import Keyed, Linear, Node, Source

#: Operators of bound plans that treat each row for itself, and those that only name things.
_ROWWISE = {"Project", "Filter", "SubqueryAlias", "View", "WithCTE", "CTERelationDef", "CTERelationRef", "Generate", "Union"}
_LEAVES = {"LogicalRDD", "LocalRelation", "LogicalRelation"}


def _walk(plan):
    yield plan
    children = plan.children()
    for k in range(children.size()):
        yield from _walk(children.apply(k))


def _name(plan) -> str:
    return plan.getClass().getSimpleName()


def _seq(x) -> list:
    return [x.apply(k) for k in range(x.size())]


def run(sql: str, tables: dict[str, DataFrame]) -> DataFrame:
    """The statement over the given tables, which hide all others of their names."""
    tag = uuid.uuid4().hex
    for name, df in tables.items():
        df.createOrReplaceTempView(f"__{name}_{tag}")
    own = ", ".join(f"`{n}` AS (SELECT * FROM `__{n}_{tag}`)" for n in tables)
    text = sql.strip().rstrip(";")
    spark = next(iter(tables.values())).sparkSession
    head = re.match(r"(?i)with\s+(?!recursive\b)", text)
    try:
        return spark.sql(f"WITH {own}, {text[head.end() :]}" if head else f"WITH {own} {text}")
    finally:
        for name in tables:
            spark.catalog.dropTempView(f"__{name}_{tag}")


def columns_read(spark: SparkSession, make, schemas: dict[str, str]) -> dict[str, list[str]]:
    """The columns of each table that the result of `make(tables)` depends on, by Spark's optimized plan; all of them where it can't tell."""
    tables = {n: spark.createDataFrame(spark.sparkContext.emptyRDD(), s) for n, s in schemas.items()}
    plan = make(tables)._jdf.queryExecution().optimizedPlan()
    nodes = list(_walk(plan))
    leaves = [p for p in nodes if _name(p) == "LogicalRDD"]
    used = {a.exprId().id() for p in nodes if p not in leaves for a in _seq(p.references().toSeq())} | {a.exprId().id() for a in _seq(plan.output())}
    read: dict[str, set] = {n: set() for n in tables}
    for p in leaves:
        own = [(a.name(), a.exprId().id()) for a in _seq(p.output())]
        table = next((n for n, df in tables.items() if df.columns == [c for c, _ in own]), None)
        if table is None:
            return {n: df.columns for n, df in tables.items()}
        read[table] |= {c for c, k in own if k in used}
    return {n: [c for c in df.columns if c in read[n]] if read[n] else df.columns for n, df in tables.items()}


def restored(df: DataFrame, schema: str) -> DataFrame:
    """All columns of a schema (of `df` first the weight, if it has one); null where the plan was found not to read them."""
    whole = StructType.fromDDL(schema)
    return df.select(*[F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in whole], *[c for c in df.columns if c == WEIGHT])


def _keys(nodes: list, columns: list[str]) -> list[str]:
    """Columns of the only source that every grouping and partitioning goes by."""
    leaves = [p for p in nodes if _name(p) in _LEAVES]
    if len(leaves) != 1 or any(_name(p) not in _ROWWISE | _LEAVES | {"Aggregate", "Window", "Distinct", "Union"} for p in nodes) or any(_name(p) == "Union" for p in nodes):
        return []
    of = {a.exprId().id(): n for a, n in zip(_seq(leaves[0].output()), columns, strict=True)}
    shared = None
    for p in nodes:
        kind = _name(p)
        if kind in ("Aggregate", "Window", "Distinct"):
            by = _seq({"Aggregate": lambda: p.groupingExpressions(), "Window": lambda: p.partitionSpec(), "Distinct": lambda: p.output()}[kind]())
            own = {of[e.exprId().id()] for e in by if e.getClass().getSimpleName() == "AttributeReference" and e.exprId().id() in of}
            shared = own if shared is None else shared & own
    return sorted(shared or ())


def compile_sql(spark: SparkSession, sql: str, sources: list[Source]) -> tuple[Node, str]:
    """The graph of a statement and how it is maintained: linear, keyed or whole."""
    if not re.match(r"(?is)\s*(select|with|values|\()", sql):
        raise ValueError("a view is one SELECT")
    names = [s.name for s in sources]
    used = [s for s in sources if re.search(rf"(?i)\b{re.escape(s.name)}\b", sql)]
    if not used:
        raise ValueError(f"the statement reads none of {names}")
    empty = {s.name: spark.createDataFrame([], s.schema) for s in used}
    bound = run(sql, empty)._jdf.queryExecution().analyzed()
    nodes = list(_walk(bound))
    if not all(p.deterministic() for p in nodes):
        raise ValueError("a view must be deterministic")
    known = {_name(p) for p in nodes}
    if unknown := {n for n in known if n in ("UnresolvedRelation", "Sample", "StreamingRelation", "InsertIntoStatement")}:
        raise ValueError(f"not supported in a view: {sorted(unknown)}")
    plain = bound.subqueriesAll().isEmpty()
    read = [s.name for s in used]
    if plain and known <= _ROWWISE | _LEAVES and len(used) == 1:

        def both(df: DataFrame) -> DataFrame:
            if WEIGHT not in df.columns:
                return run(sql, {read[0]: df})
            side = lambda w: zset.of(run(sql, {read[0]: zset.bag(df.where(F.col(WEIGHT) * w > 0).withColumn(WEIGHT, F.col(WEIGHT) * w))}), w)
            return side(1).unionByName(side(-1))

        return Linear(used[0], both), "linear"
    columns = empty[read[0]].columns
    keys = _keys(nodes, columns) if plain and len(used) == 1 else []
    kept = columns_read(spark, lambda tables: run(sql, tables), {s.name: s.schema for s in used})
    narrow = [Linear(s, lambda df, s=s: df.select(*dict.fromkeys([*keys, *kept[s.name]]), *[c for c in df.columns if c == WEIGHT])) for s in used]
    return Keyed(narrow, keys, lambda *dfs: run(sql, {s.name: restored(df, s.schema) for s, df in zip(used, dfs, strict=True)})), "keyed" if keys else "whole"
