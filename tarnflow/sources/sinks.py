"""Result tables: versioned Parquet folders with an atomically replaced manifest."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .changes import WEIGHT

#: The folder column of a result table's buckets.
BUCKET = "__b"
#: The bucket in the name of a file that Spark writes in buckets.
_IN_BUCKET = re.compile(r"_(\d+)\.c\d+")


class _Files:
    """Hadoop file system calls on a folder, so that any store Spark can write works."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def read(self, name: str) -> str | None:
        p = self._path(f"{self.root}/{name}")
        if not self._fs.exists(p):
            return None
        stream = self._fs.open(p)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """Writes beside and renames, so that a reader finds a whole file or none."""
        p, beside = self._path(f"{self.root}/{name}"), self._path(f"{self.root}/.{name}-{uuid.uuid4().hex}")
        out = self._fs.create(beside, True)
        out.write(bytearray(text.encode()))
        out.close()
        if self._fs.exists(p):
            self._fs.delete(p, False)
        if not self._fs.rename(beside, p):
            raise OSError(f"{beside} can't be renamed")

    def size(self, path: str) -> int:
        """Bytes below a path, 0 if it is not there."""
        p = self._path(path)
        return self._fs.getContentSummary(p).getLength() if self._fs.exists(p) else 0

    def sizes(self, path: str) -> dict[str, int]:
        """The data files of a folder with their bytes."""
        found = {s.getPath().getName(): s.getLen() for s in self._fs.listStatus(self._path(path))}
        return {n: size for n, size in found.items() if not n.startswith(("_", "."))}

    def names(self) -> list[str]:
        p = self._path(self.root)
        return [s.getPath().getName() for s in self._fs.listStatus(p)] if self._fs.exists(p) else []

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{name}"), True)


class Versions:
    """Numbered versions of some parts, each a list of runs; the newest manifest that is whole counts.

    A run is a Parquet folder `part/run=<tick>-<n>`, in folders by bucket of its keys if the part has several buckets.
    Runs are written as a tick goes along and count when the tick's manifest is there, so a tick that is run again
    after a failure overwrites what it had left. One writer is assumed.
    """

    def __init__(self, spark: SparkSession, root: str, keep: int = 2):
        self.spark, self.files, self.keep = spark, _Files(spark, root), keep
        self._last: dict | None = None

    def _load(self, name: str) -> dict | None:
        try:
            m = json.loads(self.files.read(name) or "")
        except ValueError:
            return None
        return m if m.get("whole") else None

    def manifest(self, fresh: bool = True) -> dict | None:
        """The newest whole manifest; `fresh` looks at the folder again."""
        if fresh or self._last is None:
            done = sorted((n for n in self.files.names() if n.startswith("manifest-")), reverse=True)
            self._last = next((m for m in map(self._load, done) if m), None)
        return self._last

    @property
    def tick(self) -> int:
        m = self.manifest()
        return -1 if m is None else m["tick"]

    def part(self, name: str) -> dict:
        """What the manifest in hand says of a part: its runs with their sizes, its schema, keys and number of buckets."""
        return ((self._last or {}).get("parts") or {}).get(name) or {"runs": [], "schema": None, "keys": [], "buckets": 1}

    def open(self, name: str, part: dict, buckets: set[int] | None = None) -> DataFrame | None:
        """The runs of a part as one scan, of some buckets only if told.

        Spark knows that the scan lies in buckets of the part's keys, so what joins or groups by them moves none of it.
        """
        if not part["runs"]:
            return None
        schema, n = StructType.fromJson(part["schema"]), part["buckets"]
        paths = [r["path"] for r in part["runs"]]
        if n > 1 and buckets is not None and len(buckets) < n:
            paths = [f"{r['path']}/{f}" for r in part["runs"] for b in sorted(buckets) for f in r["files"].get(str(b), [])]
            if not paths:
                return self.spark.createDataFrame([], schema)
        out = self.spark.read.schema(schema).parquet(*paths)
        return _in_buckets(self.spark, out, part["keys"], n) if n > 1 else out

    def read(self, name: str) -> DataFrame | None:
        """All of a part as the newest manifest has it; `delta` is what its tick changed."""
        m = self.manifest()
        return None if m is None or name not in m["parts"] else self.open(m["parts"][name].get("of", name), m["parts"][name])

    def write(self, name: str, run: str, df: DataFrame, keys: list[str], buckets: int) -> dict:
        """Writes a run and returns the part that it makes alone. Rows dealt by `keys` to as many tasks as buckets make one file each."""
        path = f"{self.files.root}/{name}/run={run}"
        schema = df.schema
        part = {"schema": json.loads(schema.json()), "keys": keys, "buckets": buckets}
        if buckets == 1:
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
            return part | {"runs": [{"path": path, "bytes": self.files.size(path)}]}
        self.files.delete(f"{name}/run={run}")  # what a tick that failed has left
        table = f"tarnflow_{uuid.uuid4().hex}"  # Spark writes buckets of tables only; the files stay when it goes
        try:
            df.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(buckets, *keys).saveAsTable(table)
        finally:
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
        sizes, files = self.files.sizes(path), {}
        for f in sizes:
            files.setdefault(str(int(_IN_BUCKET.search(f)[1])), []).append(f)
        return part | {"runs": [{"path": path, "bytes": sum(sizes.values()), "files": files}]}

    def write_folders(self, name: str, run: str, df: DataFrame, keys: list[str], buckets: int) -> dict:
        """Writes a run with a folder for each bucket, for readers that take buckets out of several runs."""
        path = f"{self.files.root}/{name}/run={run}"
        schema = df.schema
        df.withColumn(BUCKET, bucket_of(keys, buckets)).repartition(BUCKET).write.mode("overwrite").option("compression", "zstd").partitionBy(BUCKET).parquet(path)
        return {"runs": [{"path": path, "bytes": self.files.size(path)}], "schema": json.loads(schema.json()), "keys": keys, "buckets": buckets}

    def commit(self, tick: int, parts: dict[str, dict]) -> None:
        """The manifest of a tick; from now on it counts."""
        m = {"tick": tick, "parts": parts, "whole": True}
        self.files.replace(f"manifest-{tick:09d}", json.dumps(m))
        self._last = m
        done = sorted(n for n in self.files.names() if n.startswith("manifest-"))
        held = [k for n in done[-self.keep :] if (k := self._load(n))]
        used = {r["path"] for k in [*held, m] for p in k["parts"].values() for r in p["runs"]}
        for n in done[: -self.keep]:
            old = self._load(n)
            for path in {r["path"] for p in (old or {"parts": {}})["parts"].values() for r in p["runs"]} - used:
                self.files.delete(path.removeprefix(f"{self.files.root}/"))
            self.files.delete(n)


def _in_buckets(spark: SparkSession, scan: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """A scan of files in buckets, as what it is; only tables can say so by Spark's Python interface."""
    jvm, seq = spark.sparkContext._jvm, spark.sparkContext._jvm.PythonUtils.toSeq
    r = scan._jdf.queryExecution().analyzed().relation()
    spec = jvm.org.apache.spark.sql.catalyst.catalog.BucketSpec(buckets, seq(keys), seq([]))
    relation = jvm.org.apache.spark.sql.execution.datasources.HadoopFsRelation(r.location(), r.partitionSchema(), r.dataSchema(), jvm.scala.Option.apply(spec), r.fileFormat(), r.options(), r.sparkSession())
    return DataFrame(spark._jsparkSession.baseRelationToDataFrame(relation), spark)


def bucket_of(keys: list[str], buckets: int):
    return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(buckets)).cast("int")


class _Table:
    """Rows in buckets of their keys; a tick rewrites the buckets that it touches, and the manifest tells which run holds a bucket."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16):
        self.versions, self.buckets = Versions(spark, root), buckets

    def _apply(self, tick: int, delta: DataFrame, keys: list[str], rebuild) -> None:
        v = self.versions
        if tick <= v.tick:
            return
        touched = [r[0] for r in delta.select(bucket_of(keys, self.buckets)).distinct().collect()]  # `buckets` at most
        old = v.part("rows")
        at = old.get("at", {})
        held = sorted({at[str(b)] for b in touched if str(b) in at})
        before = None
        if held:
            # a run also holds buckets that later ones have replaced
            now = F.create_map(*[F.lit(x) for b in touched if str(b) in at for x in (b, at[str(b)].rpartition("run=")[2])])
            part = v.spark.read.schema(StructType.fromJson(old["schema"]).add(BUCKET, "integer").add("run", "string")).option("basePath", f"{v.files.root}/rows").parquet(*held)
            before = part.where(F.col(BUCKET).isin(touched) & (F.col("run") == now[F.col(BUCKET)])).drop(BUCKET, "run")
        new = v.write_folders("rows", f"{tick:09d}-0", rebuild(before, delta), keys, self.buckets)
        path = new["runs"][0]["path"]
        at = {**at, **{str(b): path for b in touched}}
        v.commit(tick, {"rows": new | {"runs": [{"path": p} for p in sorted(set(at.values()))], "at": at}})

    def read(self) -> DataFrame | None:
        v = self.versions
        m = v.manifest()
        if m is None:
            return None
        part = m["parts"]["rows"]
        schema = StructType.fromJson(part["schema"])
        if not part["runs"]:
            return v.spark.createDataFrame([], schema)
        now = F.create_map(*[F.lit(x) for b, p in part["at"].items() for x in (int(b), p.rpartition("run=")[2])])
        rows = v.spark.read.schema(schema.add(BUCKET, "integer").add("run", "string")).option("basePath", f"{v.files.root}/rows").parquet(*[r["path"] for r in part["runs"]])
        return rows.where(F.col("run") == now[F.col(BUCKET)]).drop(BUCKET, "run")


class BagSink(_Table):
    """A result table with physical duplicates and no weights; a tick deletes exact occurrences and inserts new ones."""

    def apply(self, tick: int, delta: DataFrame) -> None:
        cols = [c for c in delta.columns if c != WEIGHT]

        def rebuild(old: DataFrame | None, delta: DataFrame) -> DataFrame:
            rows = delta if old is None else old.withColumn(WEIGHT, F.lit(1).cast("long")).unionByName(delta)
            n = rows.groupBy(*cols).agg(F.sum(WEIGHT).alias(WEIGHT)).where(F.col(WEIGHT) != 0)
            low = F.when(F.col(WEIGHT) < 0, F.raise_error(F.lit("a row to delete is not in the result")).cast("long")).otherwise(F.col(WEIGHT))
            return n.select(*cols, F.explode(F.sequence(F.lit(1).cast("long"), low)).alias("__n")).drop("__n")

        self._apply(tick, delta, cols, rebuild)


class KeyedSink(_Table):
    """A result with a unique key that is never null: a delta becomes inserts, updates and deletes.

    `proven` takes the keys that the view's plan is known to have (see `plans.properties`); a key that holds none of them is refused.
    """

    def __init__(self, spark: SparkSession, root: str, key: list[str], buckets: int = 16, proven: list[frozenset[str]] | None = None):
        super().__init__(spark, root, buckets)
        self.key = key
        if proven is not None and not any(k <= set(key) for k in proven):
            raise ValueError(f"{key} is not known to be a key")

    def classify(self, delta: DataFrame) -> DataFrame:
        """`(key..., op, new)`: the old row out and the new row in of one key are an update."""
        rest = F.struct(*[c for c in delta.columns if c not in self.key and c != WEIGHT])
        out, into = F.max(F.when(F.col(WEIGHT) < 0, rest)), F.max(F.when(F.col(WEIGHT) > 0, rest))
        return delta.groupBy(*self.key).agg(out.alias("old"), into.alias("new"), F.min(WEIGHT).alias("lo"), F.max(WEIGHT).alias("hi"), F.count_if(F.col(WEIGHT) > 0).alias("n")).select(
            *self.key, F.when(F.col("lo") > 0, "insert").when(F.col("hi") < 0, "delete").otherwise("update").alias("op"), F.when((F.col("n") > 1) | (F.col("hi") > 1), F.raise_error(F.lit("the key is not unique")).cast(delta.select(rest.alias("r")).schema["r"].dataType)).otherwise(F.col("new")).alias("new")
        )

    def apply(self, tick: int, delta: DataFrame) -> None:
        def rebuild(old: DataFrame | None, delta: DataFrame) -> DataFrame:
            ops = self.classify(delta)
            new = ops.where("new is not null").select(*self.key, "new.*")
            return new if old is None else old.join(ops.select(*self.key), self.key, "left_anti").unionByName(new)

        self._apply(tick, delta, self.key, rebuild)


def print_changes(delta: DataFrame, table: str, write=print) -> None:
    """The statements of a delta as JSON lines, one row at a time (for diagnosis)."""
    for r in delta.toLocalIterator():
        row = r.asDict()
        w = row.pop(WEIGHT)
        write(json.dumps({"table": table, "op": "insert" if w > 0 else "delete", "count": abs(w), "row": row}, default=str))
