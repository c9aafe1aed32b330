"""Removal of byte strings that occur elsewhere, by bucket-pointer refinement of sampled suffixes.

Suffixes that agree in their first q bytes are in one q-bucket. A bucket of 2q bytes is a pair of bucket identifiers, that of
the suffix and that of the suffix q bytes later; so identifiers of 25 bytes give those of 50, 100, 200 and 400, each level
reusing the one before. Identifiers are 64-bit fingerprints instead of ranks, so no level has to number
all suffixes anew; they are sorted where they meet, in ranges of their values.

Only two levels cross the network. First, 200-byte identifiers of sampled suffixes: of every 400-byte string the
least of its 201 200-byte identifiers, so equal strings sample equally. Suffixes alone in their bucket are done.
Then, for strings whose sampled suffix isn't alone, the 400-byte identifiers. Copies of a whole document are settled in the first
exchange and take no part in the second, but for one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .exchange import ask, dealt, read_answers, tasks_for
from .jaccard_join import text_blocks
from .packed import unpack_texts
from .shingles import mix, powers, prefix_sums

#: Bytes of text in a block.
BLOCK = 1_500_000
_LATER = np.uint64(0x94D049BB133111EB)


def bucket_ids(data: np.ndarray, length: int) -> np.ndarray:
    """Identifiers of the `length`-byte strings at every offset of `data`, by doubling from an odd number of bytes."""
    q, levels = length, 0
    while q % 2 == 0 and q > 16:
        q, levels = q // 2, levels + 1
    if len(data) < length:
        return np.zeros(0, dtype=np.uint64)
    P = prefix_sums(data)
    ids = (P[q:] - P[:-q]) * powers(len(data) + 1, True)[: len(data) - q + 1]
    ids = mix(ids)
    for _ in range(levels):
        ids = refine(ids, q)
        q *= 2
    return ids


def refine(ids: np.ndarray, q: int) -> np.ndarray:
    """Identifiers of 2q bytes from those of q bytes and those at q bytes later."""
    out = ids[q:] * _LATER
    out += ids[:-q]
    out ^= out >> np.uint64(29)
    out *= _LATER
    out ^= out >> np.uint64(32)
    return out


def _sliding(x: np.ndarray, w: int, op) -> np.ndarray:
    """op (np.minimum or np.maximum) over every w neighbouring values."""
    n = len(x)
    pad = -n % w
    worst = np.iinfo(np.uint64).max if op is np.minimum else 0
    y = np.concatenate([x, np.full(pad, worst, dtype=np.uint64)]).reshape(-1, w)
    left = op.accumulate(y, axis=1).ravel()
    right = op.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(right[: n - w + 1], left[w - 1 : n])


class _Block:
    """A block's documents as one byte array, with the least identifiers of its strings."""

    def __init__(self, row: dict, length: int):
        self.texts = unpack_texts(row["texts"], row["sizes"])
        self.length, half = length, length // 2
        self.sizes = np.array([len(t) for t in self.texts], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])[:-1]
        data = np.frombuffer(b"".join(self.texts), dtype=np.uint8)
        self.marks = np.array([int.from_bytes(hashlib.blake2b(t, digest_size=8).digest(), "little") for t in self.texts], dtype=np.uint64)
        n = len(data) - length + 1
        self.inside = np.zeros(max(0, n), dtype=bool)  # offsets whose string lies within one document
        for s, k in zip(self.starts.tolist(), self.sizes.tolist(), strict=True):
            if k >= length:
                self.inside[s : s + k - length + 1] = True
        self.half = bucket_ids(data, half)
        w = length - half + 1
        if n > 0 and self.inside.any():
            least = _sliding(self.half, w, np.minimum)
            self.at = np.flatnonzero(self.inside)
            self.least = least[self.at]
            # the sampled suffixes: those that are the least of a string inside a document
            held = np.where(self.inside, least, np.uint64(0))
            top = _sliding(np.concatenate([np.zeros(w - 1, np.uint64), held, np.zeros(w - 1, np.uint64)]), w, np.maximum)
            self.sampled = self.half[top == self.half]
        else:
            self.at, self.least, self.sampled = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.values, self.n_values = np.unique(np.concatenate([self.sampled, self._marked()]), return_counts=True)

    def _marked(self) -> np.ndarray:
        return mix(self.marks ^ _LATER)

    def settle(self, answers, tasks: int) -> None:
        """Takes the first answers: which documents are whole copies, and which strings go on."""
        more, first, _ = read_answers(self.values, answers, tasks)
        again = more | (self.n_values > 1)
        at = np.searchsorted(self.values, self._marked())
        self.copy = again[at] & (self.sizes >= self.length)
        seen: set[int] = set()
        speaks = np.ones(len(self.texts), dtype=bool)  # one copy goes on, for those that share a part with it
        for k in np.flatnonzero(self.copy).tolist():
            speaks[k] = bool(first[at[k]] | ~more[at[k]]) and int(self.marks[k]) not in seen
            seen.add(int(self.marks[k]))
        doc = np.searchsorted(self.starts, self.at, "right") - 1 if len(self.at) else self.at
        if len(self.at):
            # empty documents share a start with the next one; strings belong to the one that is not empty
            filled = np.flatnonzero(self.sizes > 0)
            doc = filled[np.searchsorted(self.starts[filled], self.at, "right") - 1]
        on = again[np.searchsorted(self.values, self.least)] & speaks[doc] if len(self.at) else np.zeros(0, dtype=bool)
        self.at, doc = self.at[on], doc[on]
        half = self.length // 2
        pair = self.half[self.at + half] * _LATER
        pair += self.half[self.at]
        self.ids = mix(pair)
        self.whole, self.place, self.n_whole = np.unique(self.ids, return_inverse=True, return_counts=True)


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """`(doc_id, n_bytes, n_removed, n_spans, kept_sha256)` for every row of `docs`, and with `keep_text` the kept bytes as `kept`.

    Removed is every byte covered by a `length`-byte string that also starts at any other place of the corpus, the same
    document included, judged on the input; no string crosses documents. `length` is even and at least 32. Null texts count as
    empty; texts shorter than `length` stay whole; repeated rows are places of their own, so their texts go
    if long enough. Null ids are kept. Other columns are not read.
    """
    if length % 2 or length < 32:
        raise ValueError("length must be even and at least 32")
    written = text_blocks(docs, id_col, text_col, BLOCK).select("block", "ids", "texts", "sizes")
    blocks = written.count()
    tasks, parts = tasks_for(blocks, BLOCK), dealt(written, blocks)
    once = materialize(ask(written.select("block", "texts", "sizes"), lambda row: (_Block(row, length).values, None), blocks, BLOCK), "buckets")

    def second(row: dict) -> tuple[np.ndarray, None]:
        b = _Block(row, length)
        b.settle(row["answers"], tasks)
        return b.whole, None

    twice = ask(parts.select("block", "texts", "sizes").join(dealt(once, blocks), "block", "left"), second, blocks, BLOCK).withColumnRenamed("answers", "then")

    def cut(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k].as_py() for n in batch.schema.names}
                b = _Block(row, length)
                b.settle(row["answers"], tasks)
                more, _, _ = read_answers(b.whole, row["then"], tasks)
                again = (more | (b.n_whole > 1))[b.place] if len(b.at) else np.zeros(0, dtype=bool)
                step = np.zeros(int(b.sizes.sum()) + 1, dtype=np.int32)
                np.add.at(step, b.at[again], 1)
                np.add.at(step, b.at[again] + length, -1)
                gone = np.cumsum(step[:-1]) > 0
                cols: list[list] = [[], [], [], [], [], []]
                for i, text, s, whole in zip(row["ids"], b.texts, b.starts.tolist(), b.copy.tolist(), strict=True):
                    own = gone[s : s + len(text)]
                    if whole:
                        removed, spans, kept = len(text), 1, b""
                    elif own.any():
                        removed, spans = int(own.sum()), int(np.count_nonzero(np.diff(own.astype(np.int8), prepend=0) == 1))
                        kept = np.frombuffer(text, dtype=np.uint8)[~own].tobytes()
                    else:
                        removed, spans, kept = 0, 0, text
                    for c, v in zip(cols, (i, len(text), removed, spans, hashlib.sha256(kept).hexdigest(), kept if keep_text else None), strict=True):
                        c.append(v)
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    out = parts.join(dealt(once, blocks), "block", "left").join(twice, "block", "left").mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out if keep_text else out.drop("kept")
