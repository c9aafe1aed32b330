"""Asking which fingerprints other blocks hold too, with one packed exchange.

Every block sends its distinct 64-bit fingerprints, cut by value into ranges; each range sorts what it gets and answers
with one bit a fingerprint. A fingerprint is sent once for each block that holds it, not for
each document or position, so no key is hot, and a range holds its even share of all values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release
from .packed import pack_array, pack_ints, unpack_array, unpack_ints


#: Bytes of text whose fingerprints meet in one task, about; and blocks whose answers meet in one, as long as there are fewer than MOST tasks.
TASK, BLOCKS, MOST = 12_000_000, 2, 100_000


def _murmur(x: np.ndarray) -> np.ndarray:
    """The hash by which Spark deals 32-bit integers to partitions (Murmur3, seed 42)."""
    turn = lambda v, n: (v << np.uint32(n)) | (v >> np.uint32(32 - n))
    k = turn(x.astype(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
    h = turn(np.uint32(42) ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h = h ^ np.uint32(4)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return (h ^ (h >> np.uint32(16))).view(np.int32)


@lru_cache(maxsize=4)
def even_keys(n: int) -> np.ndarray:
    """n integers that Spark deals to n partitions one each: keys of equal work, so that no task gets several by chance."""
    out, at = np.full(n, -1, dtype=np.int64), 0
    while (out < 0).any():
        x = np.arange(at, at + 4 * n + 64, dtype=np.int64)
        to = _murmur(x).astype(np.int64) % n
        first, where = np.unique(to, return_index=True)
        out[first] = np.where(out[first] < 0, x[where], out[first])
        at += len(x)
    return out


def _pieces(values: np.ndarray, tasks: int) -> tuple[list[int], list[int]]:
    """The keys of the ranges that sorted values lie in, and the cuts between them."""
    r = (values // np.uint64(-(-(1 << 64) // tasks))).astype(np.int64)
    edges = np.flatnonzero(np.diff(r)) + 1
    return even_keys(tasks)[r[np.concatenate([[0], edges])]].tolist() if len(r) else [], [0, *edges.tolist(), len(r)]


def tasks_for(blocks: int, size: int) -> int:
    """How many tasks the exchange of that many blocks of `size` bytes of text takes."""
    return max(2, -(-blocks * size // TASK))


def dealt(df: DataFrame, blocks: int) -> DataFrame:
    """`df` by block, so that joins of such frames by block need no further exchange."""
    return df.repartition(min(MOST, max(2, blocks // BLOCKS)), "block")


def _answer(table: pa.Table) -> pa.Table:
    """What a range answers the blocks that its values came from. Arrays of all values go as soon as they aren't needed, and back to the system."""
    table = table.sort_by("block")
    sets = [unpack_ints(x.as_py()) for x in table.column("own")]
    sizes = [len(s) for s in sets]
    values = np.concatenate(sets)
    del sets
    n = np.concatenate([np.ones(k, np.uint32) if x.as_py() is None else unpack_array(x.as_py(), np.uint32) for k, x in zip(sizes, table.column("n"), strict=True)])
    order = np.argsort(values, kind="stable")  # of equal values the one of the first block comes first
    values = values[order]
    start = np.concatenate([[True], values[1:] != values[:-1]])
    del values
    at = np.flatnonzero(start)
    n = n[order]
    sums = np.minimum(np.add.reduceat(n, at, dtype=np.int64), 2**32 - 1).astype(np.uint32)
    del n
    total = np.empty(len(order), dtype=np.uint32)
    total[order] = np.repeat(sums, np.diff(np.append(at, len(order))))
    del at, sums
    first = np.empty(len(order), dtype=bool)
    first[order] = start
    del order, start
    more = total > 1
    ends = np.cumsum(sizes).tolist()
    spans = [(e - k, e) for k, e in zip(sizes, ends, strict=True)]
    bits = [[pack_array(np.packbits(x[a:e])) for a, e in spans] for x in (more, first)]
    totals = [pack_array(total[a:e][more[a:e]]) for a, e in spans]
    del total, more, first
    release()
    return pa.table({"r": table.column("r"), "block": table.column("block"), "more": pa.array(bits[0], pa.binary()), "first": pa.array(bits[1], pa.binary()), "totals": pa.array(totals, pa.binary())})


def ask(parts: DataFrame, fingerprints: Callable[[dict], tuple[np.ndarray, np.ndarray | None]], blocks: int, size: int) -> DataFrame:
    """`(block, answers)`, dealt by block, for `parts(block, ...)`.

    `fingerprints` gives a block's sorted distinct values from its row, and how often each occurs there (None: once
    each). An answer holds a bit for each value that occurs twice or more in all, the totals of those, and
    a bit for each value of which this block is the first holder. A range is a task's work in memory; there are so many
    that each takes about TASK bytes of the text, which is `blocks` of `size` bytes.
    """
    tasks = tasks_for(blocks, size)

    def send(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k].as_py() for n in batch.schema.names}
                values, n = fingerprints(row)
                at, cuts = _pieces(values, tasks)
                out = [(r, pack_ints(values[a:b]), None if n is None else pack_array(n[a:b].astype(np.uint32))) for r, a, b in zip(at, cuts[:-1], cuts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([row["block"]] * len(out), pa.string()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.binary())], names=["r", "block", "own", "n"])
        release()

    sent = parts.mapInArrow(send, "r int, block string, own binary, n binary")
    back = sent.repartition(tasks, "r").groupBy("r").applyInArrow(_answer, "r int, block string, more binary, first binary, totals binary")
    return dealt(back, blocks).groupBy("block").agg(F.collect_list(F.struct("r", "more", "first", "totals")).alias("answers"))


def read_answers(values: np.ndarray, answers: list[dict] | None, tasks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(occurs twice or more, this block is its first holder, how often in all) for a block's sorted distinct values."""
    more, first, total = np.zeros(len(values), dtype=bool), np.zeros(len(values), dtype=bool), np.ones(len(values), dtype=np.int64)
    at, cuts = _pieces(values, tasks)
    place = {r: (a, b) for r, a, b in zip(at, cuts[:-1], cuts[1:], strict=False)}
    for x in answers or []:
        a, b = place[x["r"]]
        for out, name in ((more, "more"), (first, "first")):
            out[a:b] = np.unpackbits(unpack_array(x[name], np.uint8), count=b - a)
        total[a:b][more[a:b]] = unpack_array(x["totals"], np.uint32)
    return more, first, total
