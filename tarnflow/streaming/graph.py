"""Views as graphs of operators, evaluated over snapshots or by change.

`View.batch` builds the plain DataFrame. `View.step` takes one weighted change for each source and returns the view's
change: linear operators map it, joins take three terms, additive aggregates merge sums, and everything else
recomputes the groups that the change touches, before and after. State is a list of Parquet runs, one more each
tick; runs of like size are merged, so a tick writes about as much as it changes. State that outgrows a bucket is kept in
buckets of its keys, and a tick reads those that its change touches; as Spark knows the buckets, joins and groups by these keys
move a change once and the state never. Every kept part of a change is written as soon as it is made and read from there
by what comes after, so nothing is computed twice. A tick's manifest commits all of it at once, so a step that is
run again after a failure has no second effect.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.changes import WEIGHT
from ..sources.sinks import Versions
from . import zset

#: Runs of a node's state before some are merged, bytes of a bucket, and bytes of input for each task of an exchange.
RUNS, BUCKET_BYTES, MOST_BUCKETS, TASK_BYTES = 8, 4_000_000, 4096, 16_000_000
_ids = count()


def _col(c: Column | str) -> Column:
    return F.expr(c) if isinstance(c, str) else c


@contextmanager
def _tasks_for(spark: SparkSession, deltas: list[DataFrame]):
    """Exchanges have a task for each TASK_BYTES of files that the changes are read from, if that is more than the session has."""
    name = "spark.sql.shuffle.partitions"
    usual = spark.conf.get(name)
    need = min(MOST_BUCKETS, sum(zset.file_bytes(d) for d in deltas) // TASK_BYTES)
    if need <= int(usual):
        yield
        return
    spark.conf.set(name, str(need))
    try:
        yield
    finally:
        spark.conf.set(name, usual)


@dataclass(eq=False)
class Node:
    """An operator; `inputs` are evaluated before it."""

    id: int = field(init=False, default_factory=lambda: next(_ids))

    @property
    def inputs(self) -> list["Node"]:
        return []


@dataclass(eq=False)
class Source(Node):
    """A relation that changes."""

    name: str
    schema: str


@dataclass(eq=False)
class Constant(Node):
    """A fixed bag; its change is the whole of it in the first tick and nothing later."""

    make: Callable[[SparkSession], DataFrame]


@dataclass(eq=False)
class Linear(Node):
    """Projection, filter or expansion: a function of single rows that keeps the weight column if there is one."""

    child: Node
    fn: Callable[[DataFrame], DataFrame]

    @property
    def inputs(self):
        return [self.child]


@dataclass(eq=False)
class Union(Node):
    """UNION ALL."""

    left: Node
    right: Node

    @property
    def inputs(self):
        return [self.left, self.right]


@dataclass(eq=False)
class Join(Node):
    """Inner equi-join on common columns (none: cross join)."""

    left: Node
    right: Node
    keys: list[str]

    @property
    def inputs(self):
        return [self.left, self.right]


@dataclass(eq=False)
class Aggregate(Node):
    """GROUP BY with additive measures: counts and sums of expressions over a row.

    Expressions are Columns or SQL text. `sums` maps names to expressions whose sums are kept; `finish` maps output names to expressions over the sums, `n` (rows of the
    group) and the keys. A group whose rows are gone goes.
    """

    child: Node
    keys: list[str]
    sums: dict[str, Column | str]
    finish: dict[str, Column | str]

    @property
    def inputs(self):
        return [self.child]


@dataclass(eq=False)
class Keyed(Node):
    """Any function of bags whose result splits by key: outer joins, windows, distinct, top-k, set operations, MIN and MAX.

    `fn` takes a plain DataFrame for each child; `keys` name the columns that all children share. Without keys the whole is
    recomputed.
    """

    children: list[Node]
    keys: list[str]
    fn: Callable[..., DataFrame]

    @property
    def inputs(self):
        return self.children


class View:
    """A view over a graph's last node, with its state below `root`."""

    def __init__(self, spark: SparkSession, out: Node, root: str | None = None):
        self.spark, self.out = spark, out
        self.nodes: list[Node] = []
        self._order(out)
        self.versions = Versions(spark, root) if root else None

    def _order(self, node: Node) -> None:
        if node in self.nodes:
            return
        for n in node.inputs:
            self._order(n)
        self.nodes.append(node)

    def batch(self, tables: dict[str, DataFrame]) -> DataFrame:
        """The view over a snapshot, as one logical plan."""
        got: dict[int, DataFrame] = {}
        for n in self.nodes:
            ins = [got[i.id] for i in n.inputs]
            if isinstance(n, Source):
                got[n.id] = tables[n.name]
            elif isinstance(n, Constant):
                got[n.id] = n.make(self.spark)
            elif isinstance(n, Linear):
                got[n.id] = n.fn(ins[0])
            elif isinstance(n, Union):
                got[n.id] = ins[0].unionByName(ins[1])
            elif isinstance(n, Join):
                got[n.id] = ins[0].join(ins[1], n.keys) if n.keys else ins[0].crossJoin(ins[1])
            elif isinstance(n, Aggregate):
                got[n.id] = ins[0].groupBy(*n.keys).agg(F.count(F.lit(1)).alias("n"), *[F.sum(_col(c)).alias(s) for s, c in n.sums.items()]).select(*n.keys, *[_col(c).alias(o) for o, c in n.finish.items()])
            else:
                got[n.id] = n.fn(*ins)
        return got[self.out.id]

    def _position(self, n: Node) -> int:
        return self.nodes.index(n)

    def step(self, tick: int, deltas: dict[str, DataFrame]) -> DataFrame:
        """Applies one tick's changes and returns the view's change; a tick that is already committed returns the stored one.

        Sources without an entry don't change. All state of the tick is committed at once.
        """
        v = self.versions
        if v is None:
            raise ValueError("a view without a root has no state")
        if tick <= v.tick:
            return v.read("delta")
        with _tasks_for(self.spark, list(deltas.values())):
            return self._step(tick, deltas)

    def _step(self, tick: int, deltas: dict[str, DataFrame]) -> DataFrame:
        v, work = self.versions, _Tick(self, tick)
        change: dict[int, DataFrame] = {}
        for n in self.nodes:
            ins = [change[i.id] for i in n.inputs]
            if isinstance(n, Source):
                d = deltas.get(n.name)
                change[n.id] = self.spark.createDataFrame([], f"{n.schema}, {WEIGHT} bigint") if d is None else d
            elif isinstance(n, Constant):
                made = zset.of(n.make(self.spark))
                change[n.id] = made if work.first else made.limit(0)
            elif isinstance(n, Linear):
                change[n.id] = n.fn(ins[0])
            elif isinstance(n, Union):
                change[n.id] = zset.add(*ins)
            elif isinstance(n, Join):
                (l, dl), (r, dr) = work.arranged(n.inputs, change, n.keys)
                change[n.id] = zset.join_delta(work.before(l, work.touched([r], l, n.keys)), dl, work.after(r, work.touched([l], r, n.keys)), dr, n.keys)
            elif isinstance(n, Aggregate):
                change[n.id] = self._aggregate(n, ins[0], work)
            else:
                change[n.id] = self._keyed(n, work.arranged(n.children, change, n.keys), work)
        # an aggregate's change has no rows that cancel but for equal outputs of one group, which reading takes out
        tidy = (lambda x: x) if isinstance(self.out, Aggregate) else zset.consolidate
        delta = work.keep("view", change[self.out.id], [], tidy, zset.consolidate)
        v.commit(tick, work.parts | {"delta": work.own["view"] | {"of": "view"}})
        return delta

    def _aggregate(self, n: Aggregate, d: DataFrame, work: "_Tick") -> DataFrame:
        sums = [F.sum(_col(c) * F.col(WEIGHT)).alias(s) for s, c in n.sums.items()]
        filled = [F.sum(F.when(_col(c).isNotNull(), F.col(WEIGHT)).otherwise(0)).alias(f"__c_{s}") for s, c in n.sums.items()]
        fresh = d.groupBy(*n.keys).agg(F.sum(WEIGHT).alias("n"), *sums, *filled)
        types = dict(fresh.dtypes)

        def add(state: DataFrame) -> DataFrame:
            return state.groupBy(*n.keys).agg(*[F.sum(c).cast(types[c]).alias(c) for c in fresh.columns if c not in n.keys])

        name = f"s{self._position(n)}"
        fresh = work.keep(name, fresh, n.keys, lambda x: x, add)
        old = work.before(name, work.touched([name], name, n.keys))
        values = [c for c in fresh.columns if c not in n.keys]
        if old is None:
            both = fresh.select(*n.keys, F.struct(*[F.lit(0 if c == "n" else None).cast(types[c]).alias(c) for c in values]).alias("old"), F.struct(*values).alias("new"))
        else:
            # sums before and after the change, in one pass
            old = zset.restrict(old, fresh.select(*n.keys), work.dealt(name)).withColumn("__o", F.lit(True)).unionByName(fresh.withColumn("__o", F.lit(False)))
            had = lambda c: F.sum(F.when(F.col("__o"), F.col(c))).cast(types[c]).alias(c)
            both = old.groupBy(*n.keys).agg(F.struct(*[had(c) for c in values]).alias("old"), F.struct(*[F.sum(c).cast(types[c]).alias(c) for c in values]).alias("new"))

        def shown(side: str) -> Column:
            """A group's output row; null if the group has no rows."""
            own = {c: F.col(f"{side}.{c}") for c in values}
            own |= {s: F.when(own[f"__c_{s}"] > 0, own[s]) for s in n.sums}
            return F.when(own["n"] != 0, F.struct(*[own[c].alias(c) for c in values]))

        sides = both.select(*n.keys, F.explode(F.array(F.struct(shown("old").alias("row"), F.lit(-1).cast("long").alias(WEIGHT)), F.struct(shown("new").alias("row"), F.lit(1).cast("long").alias(WEIGHT)))).alias("__x"), (shown("old").eqNullSafe(shown("new"))).alias("__same"))
        rows = sides.where("NOT __same AND __x.row IS NOT NULL").select(*n.keys, "__x.row.*", f"__x.{WEIGHT}")
        return rows.select(*n.keys, *[_col(c).alias(o) for o, c in n.finish.items()], WEIGHT)

    def _keyed(self, n: Keyed, ins: list[tuple[str, DataFrame]], work: "_Tick") -> DataFrame:
        """`ins` are the state's name and the change of each child."""
        names = [name for name, _ in ins]
        touched = None
        if n.keys:
            touched = zset.add(*[d.select(*n.keys) for _, d in ins])
            if (most := max(work.parts[name]["buckets"] for name in names)) > 1:  # the keys go to the state, or else Spark moves the state to them
                touched = touched.repartition(most, *[F.col(f"`{k}`") for k in n.keys])
            touched = touched.distinct()
        null = bool(n.keys) and any(work.dealt(name) for name in names) and not touched.where(reduce(lambda a, b: a | b, [F.col(f"`{k}`").isNull() for k in n.keys])).isEmpty()

        def side(opened: Callable[[str, set[int] | None], DataFrame | None]) -> DataFrame:
            got = []
            for name, d in ins:
                s = opened(name, work.touched(names, name, n.keys))
                s = d.limit(0) if s is None else s
                got.append(zset.bag(zset.consolidate(zset.restrict(s, touched, work.dealt(name), null) if n.keys else s)))
            return n.fn(*got)

        after = side(work.after)
        if work.first:  # the view was nothing yet, not the result over empty inputs
            return zset.of(after)
        return zset.add(zset.of(side(work.before), -1), zset.of(after, 1))

    def read(self) -> DataFrame:
        """The view's rows after the last committed tick."""
        return zset.bag(zset.consolidate(zset.spread(self.versions.read("view"), TASK_BYTES)))


class _Tick:
    """The state that one tick of a view reads and writes."""

    def __init__(self, view: View, tick: int):
        self.view, self.v, self.tick = view, view.versions, tick
        self.first = self.v.tick < 0
        self.old = dict((self.v.manifest(False) or {"parts": {}})["parts"])
        self.parts: dict[str, dict] = {}
        self.own: dict[str, dict] = {}

    def keep(self, name: str, d: DataFrame, keys: list[str], tidy: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame], DataFrame], buckets: int = 1) -> DataFrame:
        """Adds a change to a part as its next run and returns it as written; `buckets` are those of a part that is new.

        Where runs become many, the newest ones are merged, back to one that is larger than all of them together.
        """
        old = self.v.part(name)
        buckets = old["buckets"] if old["runs"] else buckets
        own = self._write(name, f"{self.tick:09d}-0", d, tidy, keys, buckets)
        whole = own | {"runs": [*old["runs"], *own["runs"]]}
        size = sum(r["bytes"] for r in whole["runs"])
        grown = _buckets(size) if keys else 1
        if grown >= 2 * buckets and (grown >= 4 * buckets or buckets == 1):  # all runs, in more buckets
            whole = self._write(name, f"{self.tick:09d}-1", self.v.open(name, whole), merge, keys, grown)
        elif len(whole["runs"]) >= RUNS:
            at, held = len(whole["runs"]) - 1, whole["runs"][-1]["bytes"]
            while at and (whole["runs"][at - 1]["bytes"] <= held or len(whole["runs"]) - at < 2):
                at -= 1
                held += whole["runs"][at]["bytes"]
            merged = self._write(name, f"{self.tick:09d}-1", self.v.open(name, whole | {"runs": whole["runs"][at:]}), merge, keys, buckets)
            whole = whole | {"runs": [*whole["runs"][:at], *merged["runs"]]}
        self.parts[name], self.own[name] = whole, own
        return self.v.open(name, own)

    def _write(self, name: str, run: str, d: DataFrame, tidy: Callable[[DataFrame], DataFrame], keys: list[str], buckets: int) -> dict:
        if buckets > 1:
            # rows are dealt by their keys once, and `tidy` groups them where they are; rows that are all key are few once they are tidy
            deal = lambda x: x.repartition(buckets, *[F.col(f"`{k}`") for k in keys])
            d = tidy(deal(d)) if set(zset.columns(d)) > set(keys) else deal(tidy(d))
        else:
            d = tidy(d)
        return self.v.write(name, run, d, keys, buckets)

    def arranged(self, nodes: list[Node], change: dict[int, DataFrame], keys: list[str]) -> list[tuple[str, DataFrame]]:
        """The names of nodes' states, which get their changes as one more run, and these changes; states aren't consolidated."""
        names = [f"a{self.view._position(n)}" for n in nodes]
        # all in as many buckets, or else one of them is dealt anew for each join
        buckets = _buckets(max(zset.file_bytes(change[n.id], True) for n in nodes)) if keys and self.first else 1
        for n, name in zip(nodes, names, strict=True):
            if name not in self.parts:
                change[n.id] = self.keep(name, change[n.id], keys, zset.consolidate, zset.consolidate, buckets)
        return [(name, change[n.id]) for n, name in zip(nodes, names, strict=True)]

    def dealt(self, name: str) -> bool:
        """Whether a part lies in several buckets."""
        return self.parts[name]["buckets"] > 1

    def touched(self, of: list[str], name: str, keys: list[str]) -> set[int] | None:
        """The buckets of a part that the tick's runs of the parts `of` have rows in; None: all."""
        part, out = self.old.get(name) or self.parts[name], set()
        for x in of:
            own = self.own[x]
            if not keys or own["buckets"] == 1 or own["keys"] != keys or part["keys"] != keys:
                return None
            held = {int(b) for r in own["runs"] for b in r["files"]}
            step = own["buckets"]
            # numbers of buckets are powers of two
            out |= {b % part["buckets"] for b in held} if part["buckets"] <= step else {b + step * k for b in held for k in range(part["buckets"] // step)}
        return out

    def before(self, name: str, buckets: set[int] | None = None) -> DataFrame | None:
        """A part as it was before the tick."""
        part = self.old.get(name)
        return None if part is None else self.v.open(name, part, buckets)

    def after(self, name: str, buckets: set[int] | None = None) -> DataFrame | None:
        """A part with the tick's change."""
        part = self.parts[name]
        return self.v.open(name, part, buckets if part["buckets"] == (self.old.get(name) or part)["buckets"] else None)


def _buckets(size: int) -> int:
    return min(MOST_BUCKETS, 1 << (size // BUCKET_BYTES).bit_length())
