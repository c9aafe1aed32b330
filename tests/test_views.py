"""Weighted rows, maintained views, sinks and change logs."""

import pytest
from pyspark.sql import functions as F

from tarnflow.operators import grouping, joins, ordering, setops, subqueries
from tarnflow.sources import BagSink, KeyedSink, Relation, as_updates, generate_series, print_changes
from tarnflow.streaming import graph
from tarnflow.streaming import Aggregate, Constant, Join, Keyed, Linear, Source, Union, View, append, decode_log, encode_log, start, zset

A, B = Source("a", "k int, v string"), Source("b", "k int, x int")


def z(spark, rows, schema):
    return spark.createDataFrame(rows, f"{schema}, __w long")


def bag(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def weights(df):
    return {tuple(r)[:-1]: r["__w"] for r in df.collect()}


def test_zset(spark):
    d = z(spark, [(1, "a", 2), (1, "a", -1), (2, None, 1), (2, None, 1), (3, "c", 1), (3, "c", -1)], "k int, v string")
    assert weights(zset.consolidate(d)) == {(1, "a"): 1, (2, None): 2}
    assert bag(zset.bag(zset.consolidate(d))) == [(1, "a"), (2, None), (2, None)]
    with pytest.raises(Exception, match="negative"):
        zset.bag(z(spark, [(1, "a", -1)], "k int, v string")).collect()
    keys = spark.createDataFrame([(None,), (1,)], "k int")
    assert bag(zset.restrict(z(spark, [(None, "n", 1), (1, "o", 1), (2, "t", 1)], "k int, v string"), keys)) == [(1, "o", 1), (None, "n", 1)]


#: Bootstrap, mixed change with null keys and duplicates, key move, empty tick, delete to empty, refill.
HISTORY = [
    ([(1, "a", 1), (1, "a", 1), (None, "n", 1), (2, "b", 1)], [(1, 10, 1), (2, 20, 1), (None, 5, 1)]),
    ([(1, "a", -1), (3, "c", 1)], [(1, 10, -1), (1, 11, 1), (3, 30, 2)]),
    ([(2, "b", -1), (3, "b", 1)], []),
    ([], []),
    ([(1, "a", -1), (None, "n", -1), (3, "c", -1), (3, "b", -1)], [(1, 11, -1), (2, 20, -1), (None, 5, -1), (3, 30, -2)]),
    ([(1, None, 1), (4, "d", 3)], [(4, 40, 1), (4, None, 1), (1, None, 1)]),
]

GRAPHS = {
    "linear": Linear(A, lambda d: d.where("v <> 'b'").withColumn("u", F.upper("v"))),
    "union": Union(Linear(A, lambda d: d.select("k", *[c for c in d.columns if c == "__w"])), Linear(B, lambda d: d.select("k", *[c for c in d.columns if c == "__w"]))),
    "join": Join(A, B, ["k"]),
    "cross": Join(A, Linear(B, lambda d: d.withColumnRenamed("k", "j")), []),
    "aggregate": Aggregate(B, ["k"], {"s": "x"}, {"n": "n", "s": "s"}),
    "left": Keyed([A, B], ["k"], lambda a, b: a.join(b, "k", "left")),
    "full": Keyed([A, B], ["k"], lambda a, b: a.join(b, "k", "full")),
    "max": Keyed([B], ["k"], lambda b: b.groupBy("k").agg(F.max("x").alias("m"))),
    "global": Keyed([A], [], lambda a: a.agg(F.count("*").alias("n"), F.max("v").alias("m"))),
    "constant": Union(Linear(A, lambda d: d.select("k", *[c for c in d.columns if c == "__w"])), Constant(lambda s: s.createDataFrame([(7,), (7,)], "k int"))),
}


@pytest.mark.parametrize(("name", "small"), [*((n, False) for n in GRAPHS), *((n, True) for n in ("join", "aggregate", "left"))])
def test_history(spark, tmp_path, monkeypatch, name, small):
    if small:  # state in several buckets, and merges of runs
        monkeypatch.setattr(graph, "BUCKET_BYTES", 400)
        monkeypatch.setattr(graph, "RUNS", 2)
    view = View(spark, GRAPHS[name], f"file://{tmp_path}/v")
    own = [n.name for n in view.nodes if isinstance(n, Source)]
    schemas = {"a": A.schema, "b": B.schema}
    now = {n: [] for n in own}
    for tick, parts in enumerate(HISTORY):
        deltas = {}
        for n, rows in zip("ab", parts, strict=True):
            if n in own:
                deltas[n] = z(spark, rows, schemas[n])
                for *row, w in rows:
                    for _ in range(abs(w)):
                        (now[n].append if w > 0 else now[n].remove)(tuple(row))
        if tick == 3:
            view = View(spark, GRAPHS[name], f"file://{tmp_path}/v")  # a restart in between
        view.step(tick, deltas)
        tables = {n: spark.createDataFrame(now[n], schemas[n]) for n in own}
        assert bag(view.read()) == bag(view.batch(tables)), tick
    if small:
        assert any(p["buckets"] > 1 for p in view.versions.manifest()["parts"].values())
        assert all(len(p["runs"]) <= 4 for p in view.versions.manifest()["parts"].values())
    again = weights(view.step(len(HISTORY) - 1, deltas))
    assert again == weights(view.versions.read("delta")) and view.versions.tick == len(HISTORY) - 1


def test_a_damaged_manifest_does_not_count(spark, tmp_path):
    view = View(spark, GRAPHS["aggregate"], f"file://{tmp_path}/v")
    view.step(0, {"b": z(spark, [(1, 10, 1)], B.schema)})
    view.step(1, {"b": z(spark, [(1, 5, 1), (2, 7, 1)], B.schema)})
    whole = (tmp_path / "v" / "manifest-000000001").read_bytes()
    for part in (b"", whole[: len(whole) // 2]):
        for name in ("manifest-000000001", ".manifest-000000001.crc"):
            (tmp_path / "v" / name).unlink(missing_ok=True)
        (tmp_path / "v" / "manifest-000000001").write_bytes(part)
        again = View(spark, GRAPHS["aggregate"], f"file://{tmp_path}/v")
        assert again.versions.tick == 0 and bag(again.read()) == [(1, 1, 10)]
    again.step(1, {"b": z(spark, [(1, 5, 1), (2, 7, 1)], B.schema)})  # the tick is run again
    assert bag(again.read()) == [(1, 2, 15), (2, 1, 7)]


def test_a_sink_rewrites_touched_buckets_only(spark, tmp_path):
    sink = BagSink(spark, f"file://{tmp_path}/bag")
    sink.apply(0, z(spark, [(k, "a", 1) for k in range(200)], "k int, v string"))
    before = sink.versions.manifest()["parts"]["rows"]["at"]
    sink.apply(1, z(spark, [(7, "a", -1)], "k int, v string"))
    after = sink.versions.manifest()["parts"]["rows"]["at"]
    assert len(before) == 16 and sum(before[b] != after[b] for b in before) == 1
    assert len(sink.read().collect()) == 199
    sink.apply(2, z(spark, [(k, "a", -1) for k in range(200) if k != 7], "k int, v string"))
    assert sink.read().count() == 0


def test_a_key_must_be_known(spark, tmp_path):
    KeyedSink(spark, f"file://{tmp_path}/k", ["k", "v"], proven=[frozenset({"k"})])
    with pytest.raises(ValueError, match="not known"):
        KeyedSink(spark, f"file://{tmp_path}/k", ["v"], proven=[frozenset({"k"})])


def test_sinks(spark, tmp_path):
    sink = BagSink(spark, f"file://{tmp_path}/bag")
    sink.apply(0, z(spark, [(1, "a", 2), (2, None, 1)], "k int, v string"))
    sink.apply(1, z(spark, [(1, "a", -1), (3, "c", 1)], "k int, v string"))
    sink.apply(1, z(spark, [(1, "a", -1), (3, "c", 1)], "k int, v string"))  # a replay
    assert bag(sink.read()) == [(1, "a"), (2, None), (3, "c")]
    with pytest.raises(Exception, match="not in the result"):
        sink.apply(2, z(spark, [(9, "z", -1)], "k int, v string"))
    keyed = KeyedSink(spark, f"file://{tmp_path}/keyed", ["k"])
    keyed.apply(0, z(spark, [(1, "a", 1), (2, "b", 1)], "k int, v string"))
    delta = z(spark, [(1, "a", -1), (1, "x", 1), (2, "b", -1), (3, "c", 1)], "k int, v string")
    assert {r.k: r.op for r in keyed.classify(delta).collect()} == {1: "update", 2: "delete", 3: "insert"}
    keyed.apply(1, delta)
    assert bag(keyed.read()) == [(1, "x"), (3, "c")]
    with pytest.raises(Exception, match="not unique"):
        keyed.apply(2, z(spark, [(5, "a", 1), (5, "b", 1)], "k int, v string"))
    said = []
    print_changes(z(spark, [(1, "a", -2)], "k int, v string"), "t", said.append)
    assert said == ['{"table": "t", "op": "delete", "count": 2, "row": {"k": 1, "v": "a"}}']


def test_change_log(spark):
    row = "struct<k:int,v:string>"
    log = spark.createDataFrame([("insert", None, (1, "a")), ("update", (1, "a"), (1, "b")), ("delete", (2, "c"), None)], f"op string, old {row}, new {row}")
    assert sorted(bag(as_updates(log)), key=str) == sorted([(1, "a", 1), (1, "a", -1), (1, "b", 1), (2, "c", -1)], key=str)
    with pytest.raises(Exception, match="incomplete"):
        as_updates(spark.createDataFrame([("update", None, (1, "b"))], f"op string, old {row}, new {row}")).collect()
    d = z(spark, [(1, None, -1), (2, "x", 3)], "k int, v string")
    assert bag(decode_log(encode_log({"a": d}), [A])["a"]) == bag(d)


def test_contract(spark):
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    good = Relation("t", spark.createDataFrame([], "k int").schema, ("k",))
    assert good.check(df).columns == ["k"]
    with pytest.raises(ValueError, match="t.k"):
        Relation("t", spark.createDataFrame([], "k string").schema).check(df)


def test_series(spark):
    assert [r[0] for r in generate_series(spark, 1, 7, 3).orderBy(F.col("generate_series")).collect()] == [1, 4, 7]
    assert generate_series(spark, 1, None).count() == generate_series(spark, 5, 1).count() == 0
    with pytest.raises(ValueError, match="zero"):
        generate_series(spark, 1, 2, 0)


def test_empty_inputs(spark):
    df = spark.createDataFrame([], "k int, v int")
    got = bag(grouping.grouping_sets(df, grouping.rollup("k"), [F.count("*").alias("n"), F.sum("v").alias("s")], ("k",)))
    assert got == [(None, 0, None, 1)]
    assert ordering.with_ties(df, [("k",)], 3).count() == 0
    assert bag(setops.weighted(df, df, "union")) == []
    one = spark.createDataFrame([(1,), (None,)], "p int")
    assert bag(subqueries.mark_in(one, "p", df, "k", "m", negate=True)) == [(1, True), (None, True)]
    assert bag(subqueries.quantified(one, "p", "<", "all", df, "k", "m")) == [(1, True), (None, True)]


def test_scalar_subquery_of_two_rows_is_an_error(spark):
    two = spark.createDataFrame([(1,), (2,)], "v int")
    with pytest.raises(Exception, match="more than one row"):
        subqueries.scalar(two, two, "v", "s").collect()


def test_ties_with_nulls(spark):
    df = spark.createDataFrame([(1, 1), (2, 2), (3, 2), (4, None), (5, None)], "id int, k int")
    assert [r.id for r in ordering.with_ties(df, [("k", True)], 1).orderBy("id").collect()] == [4, 5]
    assert [r.id for r in ordering.with_ties(df, [("k",)], 2).orderBy("id").collect()] == [1, 2, 3]
    assert [r.id for r in ordering.with_ties(df, [("k",)], 2, 1).orderBy("id").collect()] == [2, 3]


def test_predecessor(spark):
    ts = lambda d, c: d.withColumn(c, F.col(c).cast("timestamp_ntz"))
    left = ts(spark.createDataFrame([(1, "k", "2024-01-05"), (2, "k", "2024-03-01"), (3, None, "2024-03-01"), (4, "k", None), (2, "k", "2024-03-01"), (5, "z", "2024-03-01")], "id int, key string, t string"), "t")
    right = ts(spark.createDataFrame([("k", "2024-01-05", 9), ("k", "2024-01-05", 7), ("k", "2024-01-01", 1), (None, "2024-01-01", 3), ("k", None, 4)], "key string, rt string, rid int"), "rt")
    got = joins.predecessor(left, right, ["key"], "t", "rt", ["rid"], {"rid": "r"})
    assert sorted((r.id, r.r) for r in got.where("id <> 3 and id <> 4 and id <> 5").collect()) == [(1, 7), (2, 7), (2, 7)]
    assert {(r.id, r.r) for r in got.where("id in (3, 4, 5)").collect()} == {(3, None), (4, None), (5, None)}
    strict = joins.predecessor(left, right, ["key"], "t", "rt", ["rid"], {"rid": "r"}, strict=True)
    assert {(r.id, r.r) for r in strict.where("id = 1").collect()} == {(1, 1)}


def test_statements(spark):
    from tarnflow.plans.maintained import SOURCES, STATEMENTS
    from tarnflow.streaming import compile_sql

    for name, (sql, how) in STATEMENTS.items():
        assert compile_sql(spark, sql, list(SOURCES.values()))[1] == how, name
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("__")]
    events = [SOURCES["events"]]
    for bad, why in (("DROP TABLE events", "one SELECT"), ("SELECT rand() AS r FROM events", "deterministic"), ("SELECT nothing FROM events", "nothing"), ("SELECT 1 AS one", "none of"), ("SELECT * FROM orders", "none of"), ("SELECT o_custkey FROM events JOIN orders ON true", "orders")):
        with pytest.raises(Exception, match=why):
            compile_sql(spark, bad, events)


def test_a_tick_leaves_state_where_it_lies(spark, tmp_path, monkeypatch):
    """State in buckets of its keys is joined and grouped without an exchange of it, and rows with null keys aren't lost."""
    monkeypatch.setattr(graph, "BUCKET_BYTES", 4000)
    monkeypatch.setattr(graph, "_buckets", lambda size: 4)
    a = [(k if k % 50 else None, f"v{k}", 1) for k in range(400)]
    view = View(spark, Keyed([A], ["k"], lambda d: d.groupBy("k").agg(F.max("v").alias("m"))), f"file://{tmp_path}/v")
    view.step(0, {"a": z(spark, a, A.schema)})
    view.step(1, {"a": z(spark, [(None, "z", 1), (7, "v7", -1)], A.schema)})
    assert view.versions.part("a0")["buckets"] == 4
    want = {}
    for k, v, _ in [*a, (None, "z", 1)]:
        if (k, v) != (7, "v7"):
            want[k] = max(v, want.get(k, ""))
    assert dict(bag(view.read())) == want
    state = view.versions.open("a0", view.versions.part("a0"))
    kept = zset.bag(zset.consolidate(zset.restrict(state, state.select("k").distinct(), dealt=True, null=False)))
    plan = kept.groupBy("k").agg(F.max("v"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_a_transaction_is_written_by_its_tasks(spark, tmp_path):
    """A transaction of any size is one tick, but not one file that one task writes and reads; plain log files still count."""
    log = f"file://{tmp_path}/log"
    rows = [(k, k % 5, 1) for k in range(400)]
    append(spark, log, encode_log({"b": z(spark, rows, B.schema).repartition(4)}))
    append(spark, log, encode_log({"b": z(spark, [(7, 2, -1)], B.schema)}))
    encode_log({"b": z(spark, [(900, 1, 1)], B.schema)}).coalesce(1).write.mode("append").parquet(log)
    assert max(len(list(d.glob("source=b/*.parquet"))) for d in (tmp_path / "log" / "_rows").iterdir()) == 4
    view = View(spark, B, f"file://{tmp_path}/v")
    start(spark, log, [view], f"file://{tmp_path}/cp", available_now=True).awaitTermination()
    assert view.versions.tick == 2
    assert bag(view.read()) == sorted([(k, x) for k, x, _ in rows if k != 7] + [(900, 1)], key=str)
