"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs, in numpy.

A text is cut into overlapping windows of words; every window is scored and the text takes the highest score. Training
sees labels of texts only, so in each pass it takes from every text the window that scores highest now. A word's input is the
embedding of the word, if it is one of the vocabulary, and the mean of the embeddings of its character trigrams, so
spellings never seen are scored too. The gate inputs of a word don't depend on its neighbours: each worker makes them once per distinct word.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filter_rows, kept, release
from .shingles import blocks

#: Words of a window and between the starts of two windows.
WINDOW, STRIDE = 48, 32
#: Sizes: hidden units of a direction, word and trigram embeddings, vocabulary, trigram buckets.
HIDDEN, WORD, CHAR, VOCABULARY, TRIGRAMS = 8, 6, 6, 6000, 8192
#: Labelled texts that training reads at most, half of each label, and the bytes a text may have to be among them.
TRAIN_ROWS, TRAIN_BYTES = 4000, 12_000
#: Words a worker process remembers; beyond it the memory starts anew.
REMEMBERED = 150_000
#: Windows that training scores at once; the driver has little memory beside its JVM.
SLICE = 512
_PLAIN = bytes(x if x >= 128 or chr(x).isalnum() else 32 for x in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Runs of letters, digits and other than ASCII bytes, lower-cased."""
    return text.decode("utf-8", "replace").lower().encode().translate(_PLAIN).split()


def trigrams_of(word: bytes) -> list[int]:
    """Buckets of the character trigrams of `<word>`."""
    s = "<" + word.decode("utf-8", "replace") + ">"
    return [zlib.crc32(s[k : k + 3].encode()) % TRIGRAMS for k in range(max(1, len(s) - 2))]


def window_starts(n: int) -> list[int]:
    """Starts of the windows over n words; the last one ends with the text."""
    if n <= WINDOW:
        return [0]
    out = list(range(0, n - WINDOW, STRIDE))
    return [*out, n - WINDOW]


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Network:
    """Parameters and both passes. Arrays are (time, batch, units); `x` holds inputs, `mask` 1 for words and 0 for padding."""

    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        d, h = WORD + CHAR, HIDDEN
        s = lambda *n: (r.standard_normal(n) / np.sqrt(n[0])).astype(np.float32)
        self.p = {"word": 0.1 * s(VOCABULARY + 1, WORD) * np.sqrt(VOCABULARY), "tri": 0.1 * s(TRIGRAMS, CHAR) * np.sqrt(TRIGRAMS)}
        for way in ("f", "b"):
            self.p |= {f"W{way}": s(d, 3 * h), f"U{way}": s(h, 3 * h), f"c{way}": np.zeros(3 * h, np.float32)}
        self.p |= {"A": s(2 * h, h), "a": s(h), "o": s(2 * h), "z": np.zeros(1, np.float32)}
        self.p["word"][0] = 0
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def run(self, gates: dict[str, np.ndarray], mask: np.ndarray, keep: bool = False):
        """Scores (logits) of windows from the gate inputs of each direction."""
        T, B = mask.shape
        h = HIDDEN
        H = np.zeros((T, B, 2 * h), np.float32)
        trace = {}
        for way, order, at in (("f", range(T), 0), ("b", range(T - 1, -1, -1), h)):
            U, state, steps = self.p[f"U{way}"], np.zeros((B, h), np.float32), []
            Urz, Un = np.ascontiguousarray(U[:, : 2 * h]), np.ascontiguousarray(U[:, 2 * h :])
            whole = bool(mask.all())
            for t in order:
                g = gates[way][t]
                rz = _sigmoid(g[:, : 2 * h] + state @ Urz)
                q = rz[:, :h] * state
                n = np.tanh(g[:, 2 * h :] + q @ Un)
                z = rz[:, h:]
                new = n + z * (state - n)
                if not whole:
                    new *= mask[t][:, None]
                if keep:
                    steps.append((t, state, rz, q, n))
                state = new
                H[t, :, at : at + h] = state
            trace[way] = steps
        K = np.tanh(H @ self.p["A"])
        e = np.where(mask > 0, K @ self.p["a"], np.float32(-1e9))
        w = np.exp(e - e.max(0))
        w = w * mask
        w = w / np.maximum(w.sum(0), 1e-9)
        pooled = (w[:, :, None] * H).sum(0)
        logit = pooled @ self.p["o"] + self.p["z"][0]
        return (logit, (H, K, w, pooled, trace)) if keep else logit

    def inputs(self, words: np.ndarray, tri: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Word ids (n), trigram buckets (n, m) and their weights (n, m) to inputs (n, WORD + CHAR)."""
        out = np.empty((len(words), WORD + CHAR), self.p["word"].dtype)
        out[:, :WORD] = self.p["word"][words]
        for k in range(0, len(words), 4096):
            out[k : k + 4096, WORD:] = (self.p["tri"][tri[k : k + 4096]] * weight[k : k + 4096, :, None]).sum(1)
        return out

    def gates(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {way: x @ self.p[f"W{way}"] + self.p[f"c{way}"] for way in ("f", "b")}

    def gradients(self, ids: np.ndarray, table, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean logistic loss; ids (time, batch) index the rows of `table` = (words, tri, weight)."""
        h, (T, B) = HIDDEN, ids.shape
        used, inverse = np.unique(ids, return_inverse=True)
        inverse = inverse.reshape(ids.shape)
        word, tri, weight = (c[used] for c in table)
        xu = self.inputs(word, tri, weight)
        gu = self.gates(xu)
        logit, (H, K, w, pooled, trace) = self.run({k: v[inverse] for k, v in gu.items()}, mask, keep=True)
        d = (_sigmoid(logit) - y) / B
        g = {"o": pooled.T @ d, "z": np.array([d.sum()], np.float32)}
        dpool = d[:, None] * self.p["o"]
        dH = w[:, :, None] * dpool
        dw = (H * dpool).sum(2)
        de = w * (dw - (w * dw).sum(0))
        dK = de[:, :, None] * self.p["a"]
        g["a"] = np.einsum("tb,tbh->h", de, K)
        dpre = dK * (1 - K * K)
        g["A"] = np.einsum("tbi,tbj->ij", H, dpre)
        dH += dpre @ self.p["A"].T
        dxu = np.zeros_like(xu)
        for way, at in (("f", 0), ("b", h)):
            U = self.p[f"U{way}"]
            gU, dg, back = np.zeros_like(U), np.zeros((T, B, 3 * h), np.float32), np.zeros((B, h), np.float32)
            for t, state, rz, q, n in reversed(trace[way]):
                ds = (dH[t, :, at : at + h] + back) * mask[t][:, None]
                r, z = rz[:, :h], rz[:, h:]
                dn, dz = ds * (1 - z), ds * (state - n)
                dan = dn * (1 - n * n)
                dq = dan @ U[:, 2 * h :].T
                gU[:, 2 * h :] += q.T @ dan
                darz = np.concatenate([dq * state * r * (1 - r), dz * z * (1 - z)], 1)
                gU[:, : 2 * h] += state.T @ darz
                back = ds * z + dq * r + darz @ U[:, : 2 * h].T
                dg[t] = np.concatenate([darz, dan], 1)
            g[f"U{way}"], g[f"c{way}"] = gU, dg.sum((0, 1))
            per = np.zeros((len(used), 3 * h), np.float32)
            np.add.at(per, inverse.ravel(), dg.reshape(-1, 3 * h))
            g[f"W{way}"] = xu.T @ per
            dxu += per @ self.p[f"W{way}"].T
        g["word"], g["tri"] = np.zeros_like(self.p["word"]), np.zeros_like(self.p["tri"])
        np.add.at(g["word"], word, dxu[:, :WORD])
        np.add.at(g["tri"], tri.ravel(), (dxu[:, None, WORD:] * weight[:, :, None]).reshape(-1, CHAR))
        g["word"][0] = 0
        return g


class Toxicity:
    """The trained model with its vocabulary."""

    def __init__(self, net: Network, vocabulary: dict[bytes, int]):
        self.net, self.vocabulary = net, vocabulary
        self._forget()

    def _forget(self) -> None:
        self.rows: dict[bytes, int] = {b"": 0}
        self.gates = {way: np.zeros((4096, 3 * HIDDEN), np.float32) for way in ("f", "b")}

    def __getstate__(self):
        return {"net": self.net, "vocabulary": self.vocabulary}

    def __setstate__(self, state):
        self.net, self.vocabulary = state["net"], state["vocabulary"]
        self._forget()

    @staticmethod
    def table(words: list[bytes], vocabulary: dict[bytes, int]):
        """(word ids, trigram buckets, weights) of distinct words."""
        most = max([1, *(len(w.decode("utf-8", "replace")) for w in words)])  # a word has as many trigrams as characters
        at = np.zeros((len(words), most), np.int16)
        weight = np.zeros((len(words), most), np.float32)
        for k, w in enumerate(words):  # not all lists at once: they take more than the arrays
            t = trigrams_of(w)
            at[k, : len(t)] = t
            weight[k, : len(t)] = 1 / len(t)
        return np.array([vocabulary.get(w, 0) for w in words], np.int32), at, weight

    @classmethod
    def fit(cls, texts: list[bytes], labels: list[int], rounds: int = 4, batch: int = 128, rate: float = 0.01, seed: int = 5) -> "Toxicity":
        y = np.array(labels, dtype=np.float32)
        r = np.random.default_rng(seed)
        number: dict[bytes, int] = {}
        docs = [np.array([number.setdefault(w, len(number) + 1) for w in words_of(t)], dtype=np.int32) for t in texts]
        words = [b"", *number]
        seen = np.zeros(len(words), dtype=np.int64)
        for d in docs:
            seen[np.unique(d)] += 1
        often = np.argsort(-seen, kind="stable")[:VOCABULARY]
        vocabulary = {words[k]: at + 1 for at, k in enumerate(often[seen[often] > 2].tolist())}
        table = cls.table(words, vocabulary)
        net = Network()
        # a start near the answer: first embedding unit = log odds of the label given the word or trigram
        for name, keys in (("word", table[0][:, None]), ("tri", table[1])):
            n1, n0 = np.ones(len(net.p[name])), np.ones(len(net.p[name]))
            for d, t in zip(docs, y, strict=True):
                (n1 if t else n0)[np.unique(keys[np.unique(d)])] += 1
            odds = np.log(n1 / (y.sum() + 2)) - np.log(n0 / (len(y) - y.sum() + 2))
            net.p[name][:, 0] = np.clip(odds, -3, 3)
        net.p["word"][0] = 0
        x = net.inputs(*table)
        odds = x[:, 0] + x[:, WORD]
        odds[0] = 0
        starts = [window_starts(len(ids)) for ids in docs]
        owner = np.repeat(np.arange(len(docs)), [len(s) for s in starts])
        if not len(owner) or y.min() == y.max():  # nothing to learn from: every score is 0.5
            net.p["o"][:] = 0
            return cls(net, vocabulary)
        spans, score, at = np.zeros((len(owner), WINDOW), np.int32), np.empty(len(owner), np.float32), 0
        for ids, own in zip(docs, starts, strict=True):
            for s in own:
                part = ids[s : s + WINDOW]
                spans[at, : len(part)] = part
                at += 1
        del docs, number, words, starts, x
        for k in range(0, len(spans), SLICE):
            part = odds[spans[k : k + SLICE]]
            score[k : k + SLICE] = np.maximum(part, 0).max(1) + 0.1 * part.mean(1)
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
        step = 0
        # few texts take more rounds, so that the number of steps suffices
        rounds = max(rounds, min(40, -(-160 // -(-len(y) * 3 // (2 * batch)))))
        for turn in range(rounds):
            order = np.lexsort((-score, owner))
            top = order[np.concatenate([[True], owner[order][1:] != owner[order][:-1]])]  # each text's highest window
            clean = np.flatnonzero(y[owner] == 0)
            use = np.concatenate([top, r.choice(clean, min(len(clean), len(top) // 2), replace=False)]) if len(clean) else top
            r.shuffle(use)
            for k in range(0, len(use), batch):
                part = use[k : k + batch]
                ids = np.ascontiguousarray(spans[part].T)
                g = net.gradients(ids, table, (ids > 0).astype(np.float32), y[owner[part]])
                norm = np.sqrt(sum(float((v**2).sum()) for v in g.values()))
                step += 1
                for name, v in g.items():
                    v = v / max(1.0, norm)
                    m, s = moments[name]
                    m *= 0.9
                    m += 0.1 * v
                    s *= 0.999
                    s += 0.001 * v * v
                    net.p[name] -= (rate * (0.3 if turn == rounds - 1 else 1) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            if turn < rounds - 1:
                gates = net.gates(net.inputs(*table))
                for k in range(0, len(spans), SLICE):
                    ids = np.ascontiguousarray(spans[k : k + SLICE].T)
                    score[k : k + SLICE] = net.run({w: v[ids] for w, v in gates.items()}, (ids > 0).astype(np.float32))
        return cls(net, vocabulary)

    def _learn(self, words: set[bytes]) -> None:
        if len(self.rows) > REMEMBERED:
            self._forget()
        new = [w for w in words if w not in self.rows]
        for k in range(0, len(new), 5000):
            part = new[k : k + 5000]
            g = self.net.gates(self.net.inputs(*self.table(part, self.vocabulary)))
            n = len(self.rows)
            for way, own in g.items():
                if n + len(part) > len(self.gates[way]):
                    self.gates[way] = np.concatenate([self.gates[way], np.zeros((max(len(part), n // 2), 3 * HIDDEN), np.float32)])
                self.gates[way][n : n + len(part)] = own
            self.rows.update(zip(part, range(n, n + len(part)), strict=True))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """The highest window score of each text; a text without words is one empty window."""
        docs = [words_of(t) for t in texts]
        self._learn(set().union(*docs))
        get = self.rows.__getitem__
        ids = np.fromiter((i for d in docs for i in map(get, d)), dtype=np.int32, count=sum(map(len, docs)))
        ids = np.concatenate([ids, np.zeros(WINDOW, np.int32)])
        starts, limits, first, at = [], [], [], 0
        for d in docs:
            first.append(len(starts))
            own = window_starts(len(d))
            starts += [at + s for s in own]
            limits += [at + len(d)] * len(own)
            at += len(d)
        starts, limits = np.array(starts, np.int64), np.array(limits, np.int64)
        logits = np.empty(len(starts), np.float32)
        full = starts + WINDOW <= limits
        for group in (np.flatnonzero(full), np.flatnonzero(~full)):  # only windows of short texts need a mask
            for k in range(0, len(group), 1024):
                part = group[k : k + 1024]
                place = starts[part][None, :] + np.arange(WINDOW)[:, None]
                inside = place < limits[part][None, :]
                own = np.where(inside, ids[np.minimum(place, len(ids) - 1)], 0)
                logits[part] = self.net.run({w: v[own] for w, v in self.gates.items()}, inside.astype(np.float32))
        return _sigmoid(np.maximum.reduceat(logits.astype(np.float64), first)) if first else np.zeros(0)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Toxicity:
    """Fits the model on the driver from at most `rows` labelled texts of at most `most_bytes` bytes that are not held out.

    Of each label those of least hash of the id are taken, so the choice doesn't depend on partitions.
    """
    marked = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    # ids first: texts are fetched for the chosen rows only. Twice as many, as some texts are too long
    chosen = None
    for label in (0, 1):
        part = marked.where(F.col("y") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        chosen = part if chosen is None else chosen.union(part)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).where(F.octet_length(text_col) <= most_bytes)
    joined = texts.join(F.broadcast(chosen), "doc_id")
    got = []
    for label in (0, 1):
        got += joined.where(F.col("y") == label).orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(rows // 2).select("text", "y").collect()
    texts, y = [bytes(r.text) for r in got], [r.y for r in got]
    del got
    model = Toxicity.fit(texts, y)
    del texts
    release()
    return model


def held_out(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1


def _scored(docs: DataFrame, model: Toxicity):
    """A function of record batches and the place of their text column that yields parts of a megabyte of text with their scores."""
    shared, name = docs.sparkSession.sparkContext.broadcast(model), f"toxicity-{uuid.uuid4().hex}"

    def run(batches, place):
        own = kept(name, lambda: shared.value)
        for batch in batches:
            for at, part in blocks(range(batch.num_rows), batch.column(place).cast(pa.binary())):
                yield batch.slice(at[0], len(at)), own.scores(part)

    return run


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, model: Toxicity | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`(doc_id, held_out, score, predicted)` for every row of `docs`.

    Labels, language, source and id are no inputs of a score. Null texts count as empty, and texts without words have the
    score of an empty window. Null ids are scored, held_out false. Rows with equal texts have equal scores. Without
    labelled texts of both kinds every score is 0.5. An empty table gives no rows. Other columns are not read.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out(F.col(id_col).cast("long")), F.lit(False)).alias("held_out"), F.col(text_col).cast("binary").alias("text"))
    model = model or train(docs, labels, id_col=id_col, text_col=text_col)

    score = _scored(docs, model)

    def run(batches):
        for batch, own in score(batches, 2):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.float64()), pa.array((own >= threshold).astype(np.int32), pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return own.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, model: Toxicity, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns as they are whatever their names, that score below `threshold`; nulls score as empty texts."""
    score = _scored(docs, model)

    def keep(batches, place):
        for batch, own in score(batches, place):
            yield batch.filter(pa.array(own < threshold))

    return filter_rows(docs, text_col, keep)
