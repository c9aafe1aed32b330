"""Token counts: pieces are counted once per distinct pre-token and joined to each document's pre-token frequencies.

1. Documents go into blocks: per document the frequencies of its pre-tokens, as numbers into the block's list of distinct ones.
2. Every block sends its distinct pre-tokens to ranges of their hash; there each is encoded once, whatever number of
   blocks holds it, and every block gets the numbers of pieces back. A frequent pre-token arrives once a block, so
   it is no hot key.
3. The numbers are joined to the frequencies and summed by document.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .exchange import dealt
from .packed import pack_array, pack_small, pack_texts, unpack_array, unpack_small, unpack_texts
from .pretokens import chunks_of, encoder

#: Bytes of text in a block, and bytes of distinct pre-tokens (of all blocks) in a range, about.
BLOCK, RANGE = 4_000_000, 16_000_000


def _frequencies(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row a block: its distinct pre-tokens in order of their hash, and the documents' frequencies of them."""

    def run(batches):
        count = 0
        for batch in batches:
            ids, freqs, sizes, held = [], [], [], 0

            def row():
                nonlocal count
                hashed = sorted((zlib.crc32(c), c) for c in set().union(*freqs))
                number = {c: k for k, (_, c) in enumerate(hashed)}
                total = sum(map(len, freqs))
                which = np.fromiter((number[c] for f in freqs for c in f), np.int64, total)
                often = np.fromiter((n for f in freqs for n in f.values()), np.int64, total)
                # ascending in each document, as differences
                distinct = np.array([len(f) for f in freqs], np.int64)
                order = np.argsort(np.repeat(np.arange(len(freqs)) << 32, distinct) + which)
                which, often = which[order], often[order]
                steps = np.diff(which, prepend=0)
                first = (np.cumsum(distinct) - distinct)[distinct > 0]
                steps[first] = which[first]
                tokens, lengths = pack_texts([c for _, c in hashed])
                out = {"block": f"{TaskContext.get().partitionId()}-{count}", "ids": ids, "sizes": sizes, "distinct": distinct.tolist(), "which": pack_small(steps), "often": pack_small(often)}
                out |= {"hashes": pack_array(np.array([h for h, _ in hashed], np.uint32)), "tokens": tokens, "lengths": lengths, "held": sum(len(c) for _, c in hashed)}
                count += 1
                return pa.RecordBatch.from_arrays([pa.array([out[n]], t) for n, t in _TYPES.items()], names=list(_TYPES))

            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or b""
                ids.append(i)
                freqs.append(Counter(chunks_of(text)))
                sizes.append(len(text))
                held += len(text)
                if held > BLOCK:
                    yield row()
                    ids, freqs, sizes, held = [], [], [], 0
            if ids:
                yield row()

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return own.mapInArrow(run, "block string, ids array<long>, sizes array<long>, distinct array<long>, which binary, often binary, hashes binary, tokens binary, lengths binary, held long")


_TYPES = {"block": pa.string(), "ids": pa.list_(pa.int64()), "sizes": pa.list_(pa.int64()), "distinct": pa.list_(pa.int64())}
_TYPES |= dict.fromkeys(("which", "often", "hashes", "tokens", "lengths"), pa.binary()) | {"held": pa.int64()}


def _rows(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            yield {n: batch.column(n)[k].as_py() for n in batch.schema.names}


def token_counts(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`(doc_id, n_bytes, n_tokens, over_limit)` for every row of `docs`.

    The blocks are written to the shared folder once. A null or empty text has 0 bytes and 0 tokens. Null ids and repeated rows are
    kept as they are, an empty table gives no rows, and a text of any length is one document of a block of its own at most.
    Other columns of `docs` are not read, whatever their names.
    """
    blocks = materialize(_frequencies(docs, id_col, text_col), "frequencies")
    held, n_blocks = blocks.agg(F.sum("held"), F.count("*")).first()
    ranges = max(1, (held or 0) // RANGE)

    def send(batches):
        for row in _rows(batches):
            tokens, at = unpack_texts(row["tokens"], row["lengths"]), unpack_array(row["hashes"], np.uint32).astype(np.uint64) * np.uint64(ranges) >> np.uint64(32)
            edges = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
            out = [(int(at[a]), row["block"], *pack_texts(tokens[a:b])) for a, b in zip(edges[:-1], edges[1:], strict=True) if a < b]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int32(), pa.string(), pa.binary(), pa.binary()))], names=["r", "block", "tokens", "lengths"])

    def count(table: pa.Table) -> pa.Table:
        own = encoder(tokenizer)
        pieces: dict[bytes, int] = {}
        out = []
        for tokens, lengths in zip(table.column("tokens"), table.column("lengths"), strict=True):
            here = unpack_texts(tokens.as_py(), lengths.as_py())
            new = {c for c in here if c not in pieces}
            if new:
                ids = own.learn(new)
                pieces.update((c, len(ids[c]) // 4) for c in new)
            out.append(pack_small(np.fromiter(map(pieces.__getitem__, here), np.uint32, len(here))))
        return pa.table({"r": table.column("r"), "block": table.column("block"), "pieces": pa.array(out, pa.binary())})

    def add(batches):
        for row in _rows(batches):
            n = len(row["ids"])
            pieces = [unpack_small(x["pieces"]) for x in sorted(row["answers"] or [], key=lambda x: x["r"])]
            distinct = np.array(row["distinct"], np.int64)
            ends = np.cumsum(distinct)
            steps = unpack_small(row["which"]).astype(np.int64)
            sums = np.concatenate([[0], np.cumsum(steps)])
            which = sums[1:] - np.repeat(sums[ends - distinct], distinct)
            each = np.concatenate([*pieces, np.zeros(0, np.uint32)]).astype(np.int64)[which] * unpack_small(row["often"])
            total = np.concatenate([[0], np.cumsum(each)])
            tokens = total[ends] - total[ends - distinct]
            yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(row["sizes"], pa.int64()), pa.array(tokens, pa.int64()), pa.array(tokens > limit, pa.bool_(), size=n)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    sent = blocks.select("block", "hashes", "tokens", "lengths").mapInArrow(send, "r int, block string, tokens binary, lengths binary")
    counted = sent.repartition(ranges, "r").groupBy("r").applyInArrow(count, "r int, block string, pieces binary")
    answers = dealt(counted, n_blocks).groupBy("block").agg(F.collect_list(F.struct("r", "pieces")).alias("answers"))
    return dealt(blocks.select("block", "ids", "sizes", "distinct", "which", "often"), n_blocks).join(answers, "block", "left").mapInArrow(add, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
