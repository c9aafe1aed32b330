"""Benchmark decontamination by q-gram lemma filtering.

Texts and benchmark items are compared as lower-cased bytes with runs of other than letters and digits as one space.
An item of n bytes that occurs in a text with up to k edits shares at least n - q + 1 - k q of its q-grams with it,
all on diagonals (text offset minus item offset) at most k apart. Shared q-grams are counted in diagonal bands of
twice k + 1 that overlap by half, so any such group of diagonals lies within a band; bands that meet the bound are
verified by a banded alignment of the item with that region.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filter_rows
from .shingles import blocks

#: Bytes of a q-gram: they fill a 64-bit integer.
Q = 8
#: Bytes of benchmark text in a part. Parts are broadcast, a worker holds about 20 bytes for each byte of one, and a larger benchmark takes a
#: pass for each part.
ITEM_BYTES = 4_000_000
#: Hits of q-grams that are looked at together; where a text has more, items are taken in turns.
HITS = 1_000_000
_PLAIN = bytes(x if x >= 128 or chr(x).isalnum() or not x else 32 for x in range(256))


def normalise(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts as one byte array, each ended by a zero byte, and the offsets of those zeros."""
    joined = "\0".join([*(t.replace("\0", " ").lower() for t in texts), ""])
    data = np.frombuffer(joined.encode("utf-8", "replace").translate(_PLAIN), dtype=np.uint8)
    blank = data == 32
    data = data[~(blank & np.concatenate([[False], blank[:-1]]))]
    return data, np.flatnonzero(data == 0)


def grams(data: np.ndarray) -> np.ndarray:
    """The Q bytes at every offset as an integer."""
    n = max(0, len(data) - Q + 1)
    out = np.empty(n, dtype=np.uint64)
    for r in range(min(Q, n)):
        m = (len(data) - r) // Q
        out[r::Q] = data[r : r + Q * m].view(np.uint64)[: len(out[r::Q])]
    return out


def banded_distance(item: np.ndarray, region: np.ndarray, low: int, high: int, most: int) -> tuple[int, int, int]:
    """(edits, start, end) of the best occurrence of `item` in `region` along diagonals low..high; edits > most if none.

    The band holds, for each item offset, the costs at region offsets item offset + low .. item offset + high; an
    occurrence may start and end on any diagonal of the band.
    """
    n, width = len(item), high - low + 1
    big = len(item) + len(region) + 1
    lane = np.arange(width)
    at = low + lane
    cost = np.where((at >= 0) & (at <= len(region)), 0, big)
    origin = np.clip(at, 0, len(region))
    padded = np.concatenate([np.zeros(n + width + 1, np.int16) - 1, region.astype(np.int16), np.zeros(n + width + 1, np.int16) - 1])
    base = n + width + 1
    for i in range(n):
        at = i + 1 + low + lane  # region offsets after this row
        here = padded[np.clip(base + at - 1, 0, len(padded) - 1)]
        step = cost + (here != item[i])
        gone = np.concatenate([cost[1:], [big]]) + 1  # an item byte that the region lacks
        take = gone < step
        step = np.where(take, gone, step)
        origin = np.where(take, np.concatenate([origin[1:], [0]]), origin)
        step = np.where((at >= 0) & (at <= len(region)), step, big)
        run = np.minimum.accumulate((step - lane) * (width + 1) + lane)  # a region byte that the item lacks
        source = run % (width + 1)
        cost = step[source] + lane - source
        origin = origin[source]
    at = n + low + lane
    cost = np.where((at >= 0) & (at <= len(region)), cost, big)
    best = int(cost.argmin())
    return int(cost[best]), int(origin[best]), int(at[best])


def within(item: np.ndarray, region: np.ndarray, low: int, high: int, most: int) -> bool:
    """Whether `banded_distance` is at most `most`: costs alone, given up as soon as a whole row is above it.

    Bytes beyond the region match nothing; to take one costs as much as to leave the item's byte out, so the bounds need no
    test.
    """
    n, width = len(item), high - low + 1
    lane = np.arange(width, dtype=np.int32)
    cost = np.zeros(width, dtype=np.int32)
    gone = np.full(width, len(item) + 1, dtype=np.int32)
    before, after = max(0, -low), max(0, n + high + 1 - len(region))
    padded = np.concatenate([np.full(before, -1, np.int16), region.astype(np.int16), np.full(after, -1, np.int16)])
    for i, byte in enumerate(item.tolist()):
        at = before + low + i
        np.add(cost[1:], 1, out=gone[:-1])
        step = np.minimum(cost + (padded[at : at + width] != byte), gone)
        cost = np.minimum.accumulate(step - lane) + lane
        if i & 7 == 7 and cost.min() > most:
            return False
    return int(cost.min()) <= most


class Items:
    """The benchmark's q-grams with the items and offsets where they stand."""

    def __init__(self, ids: list, texts: list[str], share: float):
        data, ends = normalise(texts)
        starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
        self.ids, self.data = [], []
        for i, a, b in zip(ids, starts.tolist(), ends.tolist(), strict=True):
            own = data[a:b]
            own = own[1:] if len(own) and own[0] == 32 else own
            own = own[:-1] if len(own) and own[-1] == 32 else own
            if len(own) >= Q:
                self.ids.append(i)
                self.data.append(own)
        self.n = np.array([len(x) for x in self.data], dtype=np.int64)
        # the budget never makes the bound fall below one shared q-gram
        self.budget = np.minimum((share * self.n).astype(np.int64), (self.n - Q) // Q)
        self.bound = self.n - Q + 1 - self.budget * Q
        g = [grams(x) for x in self.data]
        flat = np.concatenate(g) if g else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable").astype(np.int32)
        self.place = order  # where the q-grams stand, all items one after the other; of equal q-grams in order of items
        self.begin = np.concatenate([[0], np.cumsum([len(x) for x in g])]).astype(np.int64)
        self.grams, first = np.unique(flat[order], return_index=True)
        self.first = np.append(first, len(flat)).astype(np.int32)
        self.bits = np.zeros(1 << 20, dtype=bool)
        self.bits[self._slot(self.grams)] = True

    @staticmethod
    def _slot(g: np.ndarray) -> np.ndarray:
        return ((g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def search(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, edits, start, end) for every item that occurs in a text; the best occurrence of each pair."""
        if not self.ids:
            return []
        data, ends = normalise(texts)
        starts = np.concatenate([[0], ends[:-1] + 1])
        g = grams(data)
        at = np.flatnonzero(self.bits[self._slot(g)])
        if not len(at):
            return []
        k = np.searchsorted(self.grams, g[at])
        k[k == len(self.grams)] = 0
        real = self.grams[k] == g[at]
        at, k = at[real], k[real]
        doc = np.searchsorted(ends, at)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        # texts one after the other as long as their hits are few enough
        hits = np.concatenate([[0], np.cumsum((self.first[k + 1] - self.first[k]).astype(np.int64))])
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(doc)) + 1, [len(at)]]) if len(at) else np.zeros(1, np.int64)
        lo = 0
        while lo < len(cuts) - 1:
            hi = max(lo + 1, int(np.searchsorted(hits[cuts], hits[cuts[lo]] + HITS, "right")) - 1)
            part = slice(cuts[lo], cuts[hi])
            turns = -(-int(hits[cuts[hi]] - hits[cuts[lo]]) // HITS)
            for turn in range(turns):
                self._pairs(data, starts, ends, at[part], k[part], doc[part], turn, turns, best)
            lo = hi
        return [(d, i, *x) for (d, i), x in sorted(best.items())]

    def _expand(self, k: np.ndarray, turn: int, turns: int) -> tuple[np.ndarray, np.ndarray]:
        """For q-grams k: (index into k, place among the items' q-grams) of each hit; of several turns, those of every so many items."""
        if turns == 1:
            n = self.first[k + 1] - self.first[k]
            own = np.repeat(np.arange(len(k)), n)
            return own, self.place[np.repeat(self.first[k] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())].astype(np.int64)
        out = []
        step = max(1, HITS // max(1, int((self.first[k + 1] - self.first[k]).max())))
        for a in range(0, len(k), step):
            own, place = self._expand(k[a : a + step], 0, 1)
            use = (np.searchsorted(self.begin, place, "right") - 1) % turns == turn
            out.append((own[use] + a, place[use]))
        return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])

    def _pairs(self, data, starts, ends, at, k, doc, turn, turns, best) -> None:
        """Adds to `best` what the q-gram hits at offsets `at` lead to."""
        own, place = self._expand(k, turn, turns)
        if not len(own):
            return
        item = np.searchsorted(self.begin, place, "right") - 1
        offset, at, doc = place - self.begin[item], at[own], doc[own]
        diagonal = at - starts[doc] - offset + int(self.n.max())
        width = self.budget[item] + 1
        # pairs of a text and an item are numbered, so that a pair and its band fit one integer
        pairs, number = np.unique(doc * len(self.ids) + item, return_inverse=True)
        lane = diagonal // width
        lanes = int(lane.max()) + 2  # bands of two pairs are no neighbours
        key = number * lanes + lane
        band, hits = np.unique(key, return_counts=True)
        follows = np.concatenate([band[1:] == band[:-1] + 1, [False]])
        both = hits + np.where(follows, np.concatenate([hits[1:], [0]]), 0)
        pair = pairs[band // lanes]
        held = np.flatnonzero(both >= self.bound[pair % len(self.ids)])
        if not len(held):
            return
        # of those bands, count every q-gram of the item once
        place = np.searchsorted(band, key)
        near = np.zeros(len(band), dtype=bool)
        near[held] = near[np.minimum(held + follows[held], len(band) - 1)] = True
        use = near[place]
        code, offset = place[use], offset[use]
        twin = np.flatnonzero(follows[np.maximum(code - 1, 0)] & (code > 0))  # hits that the band before holds too
        code, offset = np.concatenate([code, code[twin] - 1]), np.concatenate([offset, offset[twin]])
        single = np.unique(code * (int(self.n.max()) + 1) + offset) // (int(self.n.max()) + 1)
        held = held[np.bincount(single, minlength=len(band))[held] >= self.bound[pair[held] % len(self.ids)]]
        for h in held.tolist():
            d, i = divmod(int(pair[h]), len(self.ids))
            most, w = int(self.budget[i]), int(self.budget[i]) + 1
            if best.get((d, i), (1,))[0] == 0:
                continue
            low = int(band[h] % lanes) * w - int(self.n.max()) - most
            high = low + 2 * w + 2 * most
            text = data[starts[d] : ends[d]]
            lo, hi = max(0, low), min(len(text), high + int(self.n[i]))
            whole = text[lo:hi].tobytes().find(self.data[i].tobytes())
            if whole >= 0:
                best[(d, i)] = (0, lo + whole, lo + whole + int(self.n[i]))
                continue
            if not within(self.data[i], text[lo:hi], low - lo, high - lo, most):
                continue
            edits, a, b = banded_distance(self.data[i], text[lo:hi], low - lo, high - lo, most)
            if edits <= most and ((d, i) not in best or edits < best[(d, i)][0]):
                best[(d, i)] = (edits, lo + a, lo + b)


def _items(benchmark: DataFrame, share: float, id_col: str, text_col: str):
    """The benchmark in parts of about ITEM_BYTES of text, broadcast; it is a query set, read row by row."""
    send = benchmark.sparkSession.sparkContext.broadcast
    ids, texts, held = [], [], 0
    for r in benchmark.select(F.col(id_col).cast("long"), F.col(text_col)).where(F.col(text_col).isNotNull()).toLocalIterator():
        ids.append(r[0])
        texts.append(r[1])
        held += len(r[1])
        if held >= ITEM_BYTES:
            yield send(Items(ids, texts, share))
            ids, texts, held = [], [], 0
    if ids:
        yield send(Items(ids, texts, share))


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = 0.1, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """`(doc_id, item_id, edits, similarity, start, end)`: a row for every item that a document holds.

    An item occurs if an edit distance of at most `share` of its length (less for very short ones, so that the filter stays
    sound) turns it into a part of the document, both normalised; start and end are offsets there, and
    similarity is 1 - edits / length. Whole texts are searched, of any length. Null and empty texts hold nothing, and an empty table on either side
    gives no rows; items that are null or shorter than
    Q normalised bytes are skipped; repeated rows are searched repeatedly; null ids are kept. Nothing is shuffled.
    """
    out = None
    for shared in _items(benchmark, share, item_id, item_text):

        def run(batches, shared=shared):
            items = shared.value
            for batch in batches:
                for ids, texts in blocks(batch.column(0).to_pylist(), batch.column(1)):
                    rows = [(ids[d], items.ids[i], e, 1 - e / int(items.n[i]), a, b) for d, i, e, a, b in items.search([t.decode("utf-8", "replace") for t in texts])]
                    types = (pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.int64())
                    cols = list(zip(*rows, strict=True)) or [[]] * 6
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "item_id", "edits", "similarity", "start", "end"])

        part = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "doc_id long, item_id long, edits int, similarity double, start long, end long")
        out = part if out is None else out.union(part)
    return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, edits int, similarity double, start long, end long") if out is None else out


def without_leaks(docs: DataFrame, benchmark: DataFrame, share: float = 0.1, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of `docs`, all columns as they are, whose text holds no benchmark item; nothing is shuffled.

    Null and empty texts stay, as do repeated rows, null ids, and all rows if the benchmark is empty.
    """
    for shared in _items(benchmark, share, item_id, item_text):

        def keep(batches, place, shared=shared):
            items = shared.value
            for batch in batches:
                for at, part in blocks(range(batch.num_rows), batch.column(place).cast(pa.binary())):
                    clean = np.ones(len(at), dtype=bool)
                    clean[[d for d, *_ in items.search([t.decode("utf-8", "replace") for t in part])]] = False
                    yield batch.slice(at[0], len(at)).filter(pa.array(clean))

        docs = filter_rows(docs, text_col, keep)
    return docs
