"""Self-join by Jaccard similarity of word shingles: token-combination prefixes, then verification.

1. Documents go into blocks of a few megabytes (a row each, compressed), written once.
2. Document frequencies: every block sends its distinct tokens, packed, to the token ranges;
   each range answers every block with the tokens that also occur elsewhere, and their frequencies. A token
   reaches a range once for each block, not for each document, so a frequent token is no hot key.
3. Tokens are ordered by frequency, rarest first. Of a set of n tokens, every partner shares one of its first
   n - ceil(t n) + 1, and k of its first n - ceil(t n) + k. Tokens that occur in one document only index nothing, so
   most documents end here. Rare tokens index singly, frequent ones (above `frequent`) in combinations of two
   from the prefix that is longer by one. Sets of more than WIDE tokens would have too many combinations: they index all
   singly, and so do smaller sets that one of them may link with, besides their combinations.
4. Documents with equal sets are one candidate. Documents that share an index entry are compared pair by pair; in a
   large entry, first with a few of its members only, and then what is still in different
   components: a pair inside a component adds nothing to the result.
5. Pairs are verified on the whole sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, materialize, release
from .exchange import ask, dealt, read_answers, tasks_for
from .forest import forest
from .packed import pack_texts, unpack_texts
from .shingles import blocks, mix, shingle_sets

#: Bytes of text in a block.
BLOCK = 1_500_000
#: Bits of a token that frequencies are counted by; tokens that share them count as one, which only adds candidates.
BITS = 48
MASK = np.uint64((1 << 64) - (1 << (64 - BITS)))
#: Entries up to this size are compared pair by pair at once.
SMALL = 24
#: Tokens of a set up to which frequent ones index in combinations, at most (WIDE (100 - percent) / 100 + 2)^2 / 2 of them.
WIDE = 512
#: Members of a block where the rest of a large entry meets.
ODD, OTHER = 256, 1024


def text_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 1_500_000) -> DataFrame:
    """Rows `(block, ids, texts, sizes)` of about `size` bytes of text each, written to the shared folder."""

    def run(batches):
        n = 0
        for batch in batches:
            for ids, texts in blocks(batch.column(0).to_pylist(), batch.column(1), size):
                t, s = pack_texts(texts)
                yield pa.RecordBatch.from_arrays([pa.array([f"{TaskContext.get().partitionId()}-{n}"]), pa.array([ids], pa.list_(pa.int64())), pa.array([t], pa.binary()), pa.array([s], pa.binary())], names=["block", "ids", "texts", "sizes"])
                n += 1
        release()

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return materialize(own.mapInArrow(run, "block string, ids array<long>, texts binary, sizes binary"), "blocks")


def block_tokens(row: dict, words: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """A block's shingle sets, and its distinct tokens (cut to BITS) with the number of documents that hold each."""
    sets = shingle_sets(unpack_texts(row["texts"], row["sizes"]), words)
    return sets, *np.unique(np.concatenate(sets) & MASK, return_counts=True)


def _meet(table: pa.Table, percent: int) -> pa.Table:
    """A spanning forest of the links between an entry's block of odd members and one of its others.

    Pairs of one component, and those that share a smaller key, are left out.
    """
    odd = table.column("odd").to_numpy()
    x, y = table.filter(pa.array(odd)), table.filter(pa.array(~odd))
    ids = [t.column("doc_id").to_numpy() for t in (x, y)]
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(x) and len(y):
        key = table.column("key")[0].as_py()
        go = x.column("c").to_numpy()[:, None] != y.column("c").to_numpy()[None, :]
        lists = [[np.asarray(v) for v in t.column("keys").to_numpy()] for t in (x, y)]
        # pairs that share a smaller key meet there
        smaller = np.unique(np.concatenate([v[v < key] for side in lists for v in side]))
        if len(smaller):
            marks = []
            for side in lists:
                m = np.zeros((len(side), len(smaller)), np.float32)
                for k, v in enumerate(side):
                    m[k, np.searchsorted(smaller, v[v < key])] = 1
                marks.append(m)
            go &= marks[0] @ marks[1].T == 0
        sets = [[np.asarray(v) for v in t.column("tokens").to_numpy()] for t in (x, y)]
        tokens, n = np.unique(np.concatenate([v for side in sets for v in side]), return_counts=True)
        tokens = tokens[n > 1]
        both = np.zeros(go.shape, np.float32)
        for at in range(0, len(tokens), 4096):
            part = tokens[at : at + 4096]
            marks = []
            for side in sets:
                m = np.zeros((len(side), len(part)), np.float32)
                for k, v in enumerate(side):
                    m[k, np.flatnonzero(np.isin(part, v, assume_unique=True))] = 1
                marks.append(m)
            both += marks[0] @ marks[1].T
        both = both.astype(np.int64)
        total = np.array([len(v) for v in sets[0]])[:, None] + np.array([len(v) for v in sets[1]])[None, :] - both
        a, b = np.nonzero(go & (100 * both >= percent * total))
    label = forest(a, len(x) + b, len(x) + len(y))
    every = np.concatenate(ids)
    use = label != np.arange(len(label))
    return pa.table({"a": pa.array(every[use], pa.int64()), "b": pa.array(every[label[use]], pa.int64())})


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80, frequent: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`(doc_id, n_shingles, component_id)` for every row of `docs`.

    Two documents link when 100 * |intersection| >= percent * |union| of their distinct `words`-word shingles (a text of
    fewer words is one shingle). component_id is the smallest doc_id reachable by links, the document
    included. Null and empty texts, or texts without words, have 0 shingles and link with nothing; so do rows
    whose id is null (component null). Rows with the same id are one document of several texts. Ties don't matter:
    the result depends on the links alone. Other columns are not read.
    """
    parts = text_blocks(docs, id_col, text_col, BLOCK)
    count = parts.count()
    tasks = tasks_for(count, BLOCK)
    known = ask(parts.select("block", "texts", "sizes"), lambda row: block_tokens(row, words)[1:], count, BLOCK)

    def signatures(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = {n: batch.column(n)[at].as_py() for n in batch.schema.names}
                sets, tokens, _ = block_tokens(row, words)
                counts = read_answers(tokens, row["answers"], tasks)[2]
                cols: list[list] = [[], [], [], [], []]
                for i, s in zip(row["ids"], sets, strict=True):
                    n, keys, own, mark = len(s), None, None, None
                    if n and i is not None:
                        df = counts[np.searchsorted(tokens, s & MASK)]
                        p = n - -(-percent * n // 100) + 1
                        if (df > 1).sum() > n - p:  # else its prefix holds tokens of its own only
                            first = np.lexsort((s, df))[: p + 1]
                            short = first[:p]
                            keys = s[short[(df[short] > 1) & (df[short] <= frequent)]].view(np.int64).tolist()
                            often = s[first[df[first] > frequent]]
                            if 1 < n <= WIDE:
                                often = np.sort(often)
                                i_, j_ = np.triu_indices(len(often), 1)
                                keys += mix(often[i_] * np.uint64(3) + mix(often[j_])).view(np.int64).tolist()
                            if p == n or 100 * n >= percent * WIDE:  # a prefix of all tokens can't be extended
                                keys += s[short[df[short] > frequent]].view(np.int64).tolist()
                            own, mark = s.view(np.int64), xxhash.xxh3_128_hexdigest(s.tobytes())
                    for c, v in zip(cols, (i, n, keys, own, mark), strict=True):
                        c.append(v)
                types = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "n", "keys", "tokens", "mark"])
        release()

    signed = materialize(dealt(parts, count).join(known, "block", "left").mapInArrow(signatures, "doc_id long, n long, keys array<long>, tokens array<long>, mark string"), "signatures")
    near = signed.where("mark is not null")
    # one row for each distinct set, the candidates from here on
    reps = materialize(near.groupBy("mark").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("tokens").alias("tokens")), "sets")
    sets = reps.select("doc_id", "tokens")
    index = reps.select(F.explode("keys").alias("key"), "doc_id", "n").distinct()
    sizes = index.groupBy("key").agg(F.count("*").alias("m"), F.min("doc_id").alias("pivot")).where("m > 1")
    index = materialize(index.join(sizes, "key"), "index")

    def compare(few: DataFrame) -> DataFrame:
        """The pairs of few(a, b) that link."""
        x = sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("x"))
        y = sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("y"))
        both = F.size(F.array_intersect("x", "y"))
        return few.join(x, "a").join(y, "b").where(100 * both >= percent * (F.size("x") + F.size("y") - both)).select("a", "b")

    fits = lambda m, n: (100 * m >= percent * n) & (100 * n >= percent * m)
    small = index.where(F.col("m") <= SMALL)
    pairs = small.select("key", F.col("doc_id").alias("a"), F.col("n").alias("na")).join(small.select("key", F.col("doc_id").alias("b"), F.col("n").alias("nb")), "key").where((F.col("a") < F.col("b")) & fits(F.col("na"), F.col("nb"))).select("a", "b")
    # in a large entry each member meets its pivot and the member before it; entries are cut into
    # ranges of sizes first, so that no window spans a hot entry as a whole
    large = index.where(F.col("m") > SMALL).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.greatest(F.lit(1), F.floor(F.col("m") / 256))))
    before = F.lag("doc_id").over(Window.partitionBy("key", "salt").orderBy("n", "doc_id"))
    stars = large.withColumn("before", before).select(F.explode(F.array("pivot", "before")).alias("o"), "doc_id").where("o is not null and o <> doc_id").select(F.least("o", "doc_id").alias("a"), F.greatest("o", "doc_id").alias("b"))
    links = materialize(compare(pairs.union(stars).distinct()), "links")
    copies = near.select("mark", F.col("doc_id").alias("b")).join(reps.select("mark", F.col("doc_id").alias("a")), "mark").select("a", "b").where("a <> b")
    joined = components(links)
    # what large entries still hold in different components meets in blocks, and each pair in one entry only
    left = large.select("key", "doc_id", "n").join(joined, F.col("doc_id") == F.col("node"), "left").select("key", "doc_id", "n", F.coalesce("component", "doc_id").alias("c"))
    mixed = left.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key")
    left = materialize(left.join(mixed, "key", "left_semi"), "rest")
    if left.limit(1).count():
        per = left.groupBy("key", "c").agg(F.count("*").alias("k")).groupBy("key").agg(F.max_by("c", F.struct("k", "c")).alias("main"), F.sum("k").alias("m"), F.max("k").alias("most"))
        per = per.select("key", "main", F.ceil((F.col("m") - F.col("most")) / ODD).alias("oi"), F.ceil(F.col("m") / OTHER).alias("oj"))
        keys = left.groupBy("doc_id").agg(F.array_sort(F.collect_list("key")).alias("keys"))  # no more than a prefix has
        own = sets.join(keys, "doc_id").select("doc_id", "tokens", "keys")
        salt = F.xxhash64("doc_id")
        at = left.join(per, "key").join(own, "doc_id")
        upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
        odd = at.where("c <> main").withColumn("i", F.pmod(salt, F.col("oi"))).withColumn("j", upto("oj")).withColumn("odd", F.lit(True))
        other = at.withColumn("j", F.pmod(salt, F.col("oj"))).withColumn("i", upto("oi")).withColumn("odd", F.lit(False))
        held = odd.unionByName(other).select("key", "i", "j", "odd", "doc_id", "c", "tokens", "keys")
        links = links.union(materialize(held.groupBy("key", "i", "j").applyInArrow(lambda t: _meet(t, percent), "a long, b long"), "links"))
    whole = components(links.union(copies))
    return signed.select("doc_id", F.col("n").alias("n_shingles")).join(whole, F.col("doc_id") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
