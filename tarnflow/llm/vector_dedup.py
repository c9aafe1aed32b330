"""Near-duplicate vectors by an inverted multi-index: codebooks on vector halves form a grid of cells.

Every vector is put into the cell of its nearest codewords. As a query it visits cells in the order of the summed
distances of their two codewords (multi-sequence order), as many as a brute-force trial says the target recall needs, and is
compared in double precision with what they hold. Copies of a vector are one entry. Cells and the queries that
visit them are cut into pieces by hash, so a crowded cell is many tasks; a piece sends sums of links and a spanning
forest, never its pairs.
"""

from __future__ import annotations

import logging
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialize
from .forest import forest

#: Vectors that the codebooks are fitted on at most, and queries of the brute-force trial.
FIT_ROWS, TRIAL = 16_384, 2048
#: Codewords of a half at most, and cells up to which their loads, a row each, are broadcast.
CODEWORDS, FEW_CELLS = 2048, 65_536
#: Pairs of the trial at which it is trusted half as much again.
MARGIN = 100
#: Members and queries of a piece, about.
MEMBERS, PROBES = 1024, 4096

_log = logging.getLogger("tarnflow")


def fit_codebook(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """k-means in numpy; empty codewords take the farthest points."""
    k = max(1, min(k, len(x)))
    centre = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        d = (centre**2).sum(1) - 2 * x @ centre.T
        near = d.argmin(1)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        centre = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centre)
        if (n == 0).any():
            far = np.argsort(-(d[np.arange(len(x)), near] + (x**2).sum(1)))[: (n == 0).sum()]
            centre[n == 0] = x[far]
    return centre


class Grid:
    """The product of two codebooks."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.books = (first, second)
        self.k = len(second)

    def _distances(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = self.books[0].shape[1]
        return tuple(np.maximum(0, (v**2).sum(1)[:, None] - 2 * v @ b.T + (b**2).sum(1)) for v, b in zip((u[:, :h], u[:, h:]), self.books, strict=True))

    def cells(self, u: np.ndarray) -> np.ndarray:
        a, b = self._distances(u)
        return a.argmin(1) * self.k + b.argmin(1)

    def visits(self, u: np.ndarray, n: int) -> np.ndarray:
        """The n nearest cells of each vector, nearest first.

        The cell at ranks (i, j) of the two lists has at least (i + 1) (j + 1) - 1 cells no farther than it, so only pairs
        of ranks with a product up to n are looked at.
        """
        a, b = self._distances(u)
        pairs = np.array([(i, j) for i in range(min(n, a.shape[1])) for j in range(min(n // (i + 1), b.shape[1]))])
        oa, ob = np.argsort(a, axis=1, kind="stable")[:, : pairs[:, 0].max() + 1], np.argsort(b, axis=1, kind="stable")[:, : pairs[:, 1].max() + 1]
        row = np.arange(len(u))[:, None]
        ia, ib = oa[:, pairs[:, 0]], ob[:, pairs[:, 1]]
        best = np.argsort(a[row, ia] + b[row, ib], axis=1, kind="stable")[:, :n]
        return ia[row, best] * self.k + ib[row, best]

    def ranks(self, u: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """For each vector, how many cells come before a given one."""
        out = np.empty(len(u), dtype=np.int64)
        step = max(1, (1 << 24) // (len(self.books[0]) * self.k))
        for k in range(0, len(u), step):
            a, b = self._distances(u[k : k + step])
            row = np.arange(len(a))
            at = a[row, cells[k : k + step] // self.k] + b[row, cells[k : k + step] % self.k]
            out[k : k + step] = ((a[:, :, None] + b[:, None, :]) < at[:, None, None]).sum((1, 2))
        return out


def units(column: pa.Array) -> np.ndarray:
    """Rows of a list column as unit vectors in double precision."""
    x = np.stack([np.asarray(v, dtype=np.float64) for v in column.to_numpy(zero_copy_only=False)])
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x**2).sum(1, keepdims=True))


def near_vectors(vectors: DataFrame, least: float = 0.9, recall: float = 0.99, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """`(vec_id, n_links, component_id, kept)` for every row of `vectors`.

    Two vectors link if their cosine in double precision is at least `least` and the search finds them; none below it is
    linked. The number of visited cells is such that a brute-force trial of up to TRIAL queries against all rows finds the
    share `recall` of its pairs from the side of the query alone, and 16 at least; what it found is logged. Codebooks are fitted on the FIT_ROWS vectors of least hash; every row is indexed.

    Null or empty vectors, those with null or non-finite components, zero ones, and those
    of another dimension than most link with nothing; so do rows with a null id, whose component is null and kept false. Equal vectors,
    also of repeated rows, link with each other. Ties don't matter. Other columns are not read.
    """
    spark = vectors.sparkSession
    v, zero = F.col("v"), F.lit(0.0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.col("vec_id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != zero)
    rows = rows.withColumn("v", F.when(F.coalesce(fine, F.lit(False)), v))
    size = rows.where("v is not null").groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if size is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    rows = rows.withColumn("v", F.when(F.size("v") == size.d, F.col("v")))
    own = materialize(rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("gid"), F.count("*").alias("c")), "vectors")
    n = own.count()
    sample = units(pa.array([r.v for r in own.orderBy(F.xxhash64("v"), "v").limit(FIT_ROWS).select("v").collect()]))
    k = int(min(CODEWORDS, max(1, 2 ** round(math.log2(max(1.0, math.sqrt(n / 8)))))))
    h = max(1, size.d // 2)
    grid = Grid(fit_codebook(sample[:, :h], k), fit_codebook(sample[:, h:], k)) if size.d > 1 else Grid(fit_codebook(sample, k), np.zeros((1, 0)))
    cells = len(grid.books[0]) * grid.k
    trial = sample[:TRIAL]

    def measure(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            u = units(batch.column(0))
            q, m = np.nonzero(trial @ u.T >= least)
            other = (trial[q] != u[m]).any(1)
            q, m = q[other], m[other]
            # how many cells the trial vector visits before the other's; the other may find it earlier, which is not counted on
            pairs, n = np.unique(q * cells + (grid.cells(u[m]) if len(m) else 0), return_counts=True)
            value, where = np.unique(grid.ranks(trial[pairs // cells], pairs % cells), return_inverse=True)
            count = np.bincount(where, weights=n, minlength=len(value)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(value, pa.int64()), pa.array(count, pa.int64())], names=["rank", "n"])

    found = sorted((r["rank"], r["n"]) for r in own.select("v").mapInArrow(measure, "rank long, n long").groupBy("rank").agg(F.sum("n").alias("n")).collect())
    total, seen, visits = sum(x for _, x in found), 0, 16
    for rank, x in found:
        if seen >= recall * total:
            break
        seen, visits = seen + x, max(visits, rank + 1)
    # the fewer pairs the trial had, the wider the margin
    visits = min(math.ceil(visits * (1 + MARGIN / (total + MARGIN))), cells)
    _log.info("%d pairs in the trial, %d of %d cells visited, expected recall %s", total, visits, cells, round(seen / total, 4) if total else "not measured")

    def place(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                u = units(part.column("v"))
                yield pa.RecordBatch.from_arrays([part.column("gid"), part.column("c"), pa.array(grid.cells(u), pa.int32()), pa.array(list(grid.visits(u, visits).astype(np.int32)), pa.list_(pa.int32())), part.column("v")], names=["gid", "c", "cell", "visits", "v"])

    placed = materialize(own.select("gid", "c", "v").mapInArrow(place, "gid long, c long, cell int, visits array<int>, v array<double>"), "placed")
    few = F.broadcast if cells <= FEW_CELLS else (lambda df: df)  # rows of this table are cells
    held = placed.groupBy(F.col("cell").alias("to")).agg(F.count("*").alias("m"))
    asked = placed.select(F.explode("visits").alias("to")).groupBy("to").agg(F.count("*").alias("q"))
    load = few(held.join(asked, "to").select("to", F.ceil(F.col("m") / MEMBERS).alias("mi"), F.ceil(F.col("q") / PROBES).alias("qi")))
    salt = F.xxhash64("gid")
    members = placed.withColumn("to", F.col("cell")).join(load, "to").withColumn("i", F.pmod(salt, F.col("mi"))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("qi") - 1)))
    probes = placed.withColumn("to", F.explode("visits")).join(load, "to").withColumn("j", F.pmod(salt, F.col("qi"))).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("mi") - 1)))
    cols = ["to", "i", "j", "gid", "c", "cell", "v"]
    both = members.select(*cols, "visits", F.lit(True).alias("member")).unionByName(probes.select(*cols, F.lit(None).cast("array<int>").alias("visits"), F.lit(False).alias("member")))

    def compare(table: pa.Table) -> pa.Table:
        member = table.column("member").to_numpy()
        m, q = table.filter(pa.array(member)), table.filter(pa.array(~member))
        out: dict[int, int] = {}
        gids = np.concatenate([m.column("gid").to_numpy(), q.column("gid").to_numpy()])
        label = np.arange(len(gids))
        credit = np.zeros(len(gids), dtype=np.int64)
        if len(m) and len(q):
            x, mg, mc, mcell = units(m.column("v").combine_chunks()), m.column("gid").to_numpy(), m.column("c").to_numpy(), m.column("cell").to_numpy()
            sees = np.stack(m.column("visits").to_numpy())
            y, qg, qc, qcell = units(q.column("v").combine_chunks()), q.column("gid").to_numpy(), q.column("c").to_numpy(), q.column("cell").to_numpy()
            ones, twos = [], []
            for at in range(0, len(y), 1024):
                b, a = np.nonzero(y[at : at + 1024] @ x.T >= least)
                b = b + at
                keep = qg[b] != mg[a]
                a, b = a[keep], b[keep]
                np.add.at(credit, len(m) + b, mc[a])
                # the member gets its share here unless it visits the query's cell itself
                blind = ~(sees[a] == qcell[b][:, None]).any(1)
                np.add.at(credit, a[blind], qc[b[blind]])
                ones.append(a)
                twos.append(len(m) + b)
            label = forest(np.concatenate(ones), np.concatenate(twos), len(gids))
        use = (credit > 0) | (label != np.arange(len(gids)))
        return pa.table({"gid": pa.array(gids[use], pa.int64()), "to": pa.array(gids[label[use]], pa.int64()), "n": pa.array(credit[use], pa.int64())})

    links = materialize(both.groupBy("to", "i", "j").applyInArrow(compare, "gid long, to long, n long"), "links")
    counts = links.groupBy("gid").agg(F.sum("n").alias("n"))
    joined = components(links.select(F.col("gid").alias("a"), F.col("to").alias("b"))).withColumnRenamed("node", "gid")
    groups = own.join(counts, "gid", "left").join(joined, "gid", "left").select("v", (F.coalesce("n", F.lit(0)) + F.col("c") - 1).alias("n"), F.coalesce("component", "gid").alias("component"))
    out = rows.join(groups, "v", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
