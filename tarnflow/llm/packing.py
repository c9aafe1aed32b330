"""Best-fit packing of tokenised documents into sequences, planned on the histogram of lengths."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .pretokens import encoded


def pieces(docs: DataFrame, capacity: int = 4096, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`(doc_id, piece, start, length, ids_crc32, row)`: each document's ids with `end_id`, cut only if longer than `capacity`.

    `row` numbers all rows, partition by partition.
    """
    end = int(end_id).to_bytes(4, "little")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "row"]

    def run(batches):
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            texts = (x.as_py() for x in batch.column(1))
            for i, ids in zip(batch.column(0).to_pylist(), encoded(texts, tokenizer), strict=True):
                ids += end
                for k in range(0, len(ids) // 4, capacity):
                    part = ids[4 * k : 4 * (k + capacity)]
                    for c, v in zip(cols, (i, k // capacity, k, len(part) // 4, zlib.crc32(part), row), strict=True):
                        c.append(v)
                    row += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "piece" else pa.int64()) for n, c in zip(names, cols, strict=True)], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, row long")


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Packs a histogram of lengths; `(length, from_rank, to_rank, per_bin, first_bin, offset)` rows.

    Items above a third of the capacity share a bin with at most one other such item: the
    longest left takes the longest that still fits. Then, longest first, smaller items
    go to the bin with the least sufficient gap, or open a bin. Bins of equal
    content are handled together, so the work depends on the capacity, not on the number of documents.
    The item of `length` with rank r in from..to-1 goes to bin first_bin + (r - from) // per_bin, at
    offset + (r - from) % per_bin * length.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    if any(n > capacity or n < 1 for n in left):
        raise ValueError("a length is outside 1..capacity")
    third = capacity / 3
    large = sorted(n for n in left if n > third)
    groups: list[tuple[int, tuple[tuple[int, int], ...]]] = []  # (bins, ((length, how many), ...))
    while large:
        a = large[-1]
        if not left[a]:
            large.pop()
            continue
        k = bisect_left(large, capacity - a + 1) - 1  # the longest that fits beside a
        while k >= 0 and (not left[large[k]] or (large[k] == a and left[a] < 2)):
            k -= 1
        if k < 0:
            groups.append((left[a], ((a, 1),)))
            left[a] = 0
        elif large[k] == a:
            groups.append((left[a] // 2, ((a, 2),)))
            left[a] %= 2
        else:
            b, m = large[k], min(left[a], left[large[k]])
            groups.append((m, ((a, 1), (b, 1))))
            left[a] -= m
            left[b] -= m
            if not left[b]:
                large.pop(k)
    by_gap: dict[int, list] = {}
    gaps: list[int] = []

    def put(bins, content, gap):
        if gap not in by_gap:
            by_gap[gap] = []
            insort(gaps, gap)
        by_gap[gap].append((bins, content))

    for bins, content in groups:
        put(bins, content, capacity - sum(n * k for n, k in content))
    for n in sorted((n for n in left if n <= third), reverse=True):
        todo = left[n]
        while todo:
            at = bisect_left(gaps, n)
            if at == len(gaps):
                per = capacity // n
                if bins := todo // per:
                    put(bins, ((n, per),), capacity - per * n)
                if rest := todo % per:
                    put(1, ((n, rest),), capacity - rest * n)
                break
            gap = gaps[at]
            bins, content = by_gap[gap].pop()
            if not by_gap[gap]:
                del by_gap[gap]
                gaps.pop(at)
            per = min(gap // n, todo)
            used = min(bins, todo // per)
            put(used, (*content, (n, per)), gap - per * n)
            if bins > used:
                put(bins - used, content, gap)
            todo -= used * per
    rows, rank, first = [], dict.fromkeys(histogram, 0), 0
    for gap in gaps:
        for bins, content in by_gap[gap]:
            offset = 0
            for n, per in content:
                rows.append((n, rank[n], rank[n] + bins * per, per, first, offset))
                rank[n] += bins * per
                offset += n * per
            first += bins
    return rows


def pack(docs: DataFrame, capacity: int = 4096, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`(doc_id, piece, start, length, ids_crc32, sequence_id, offset)` for every piece.

    The driver sees only the histogram of lengths (at most `capacity` rows) and plans on it; pieces
    find their places by their rank among those of equal length. A length may hold any share of all rows: ranks
    are made within (length, hash bucket) groups of about a thousand rows and shifted by the
    cumulative sizes of the buckets. Buckets go by the row's own number, which is written with it, so neither null ids
    nor repeated rows share one. The plan, at most a few rows for each length, is broadcast.

    A null or empty text is one piece of the end id alone. Null ids and repeated rows are packed like
    others, and very long texts are cut into pieces; an empty table gives no rows. Other columns of `docs` are not read.
    """
    spark = docs.sparkSession
    own = materialize(pieces(docs, capacity, tokenizer, end_id, id_col, text_col), "pieces")
    buckets = own.count() // 1000 + 1
    own = own.withColumn("b", F.pmod(F.xxhash64("row"), F.lit(buckets)))
    sizes = own.groupBy("length", "b").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = plan(histogram, capacity)
    by_length: dict[int, list] = {}
    for n, *rest in rows:
        by_length.setdefault(n, []).append(tuple(rest))
    places = spark.createDataFrame(list(by_length.items()), "length long, places array<struct<lo:long,hi:long,per:long,bin:long,at:long>>")
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("b")) - F.col("n")).select("length", "b", "before")
    ranked = own.withColumn("r", F.row_number().over(Window.partitionBy("length", "b").orderBy("row")) - 1)
    ranked = ranked.join(before, ["length", "b"]).withColumn("r", F.col("r") + F.col("before")).join(F.broadcast(places), "length")
    p = F.element_at(F.filter("places", lambda x: (x.lo <= F.col("r")) & (x.hi > F.col("r"))), 1)
    out = ranked.withColumn("p", p).withColumn("k", F.col("r") - F.col("p.lo"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("p.bin") + F.floor(F.col("k") / F.col("p.per"))).alias("sequence_id"), (F.col("p.at") + F.pmod("k", F.col("p.per")) * F.col("length")).alias("offset"))
