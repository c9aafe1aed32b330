"""The text operators against brute force, with nulls, empty and long texts, ties, repeated rows and empty tables."""

import gc
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import tarnflow.llm.decontaminate as decontaminate
import tarnflow.llm.jaccard_join as jaccard
from tarnflow.llm.common import components, tokenizer_path
from tarnflow.llm.decontaminate import Items, banded_distance, leaks, normalise, without_leaks
from tarnflow.llm.exchange import even_keys
from tarnflow.llm.packing import pack, plan
from tarnflow.llm.pretokens import ChunkEncoder, encoded
from tarnflow.llm.suffix_dedup import remove_repeats
from tarnflow.llm.token_counts import token_counts
from tarnflow.llm.token_files import TokenFileReader, open_token_file, token_file_roundtrip, write_token_files

SCHEMA = "doc_id long, text string, n_tokens string, component_id string, length string"


def frame(spark, rows):
    """Extra columns clash with names of results."""
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


ODD = [
    "It's we're DON'T a'b x's. <|endoftext|> <|STARTOFTEXT|>!", "\x1cabc\x1d d e f", "éá. ́abc ñ!!", "ΣΑΣ. Σ İİ ﬁ K ß", "a_b 12ab3 x²y ½ ١٢ ", "日本語。テスト、 한국어 각",
    "", "   \n\t", 'café... naïve!? "quoted" (x) [y]', "the<|endoftext|>end |> <|", "ªº ʰa a‍b ﻿x", "ǅ ǆ Ǆ. é.", "word " * 5000, None,
]


def test_encoding_is_the_librarys(library):
    got = list(encoded([None if t is None else t.encode() for t in ODD], "word_bpe_49k.json"))
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [library(t) for t in ODD]


def test_token_counts(spark, library):
    rows = [*enumerate(ODD), (None, "a b"), (3, ODD[3]), (3, ODD[3])]
    got = sorted((tuple(r) for r in token_counts(frame(spark, rows), limit=100).collect()), key=str)
    want = sorted(((i, len((t or "").encode()), n := len(library(t)), n > 100) for i, t in rows), key=str)
    assert got == want
    assert token_counts(frame(spark, rows).limit(0)).count() == 0


def test_plan_fills_bins():
    rng = random.Random(1)
    for _ in range(20):
        lengths = [rng.choice([rng.randint(1, 100), rng.randint(30, 60), 100, 34, 33, 1]) for _ in range(rng.randint(0, 300))]
        histogram = {n: lengths.count(n) for n in set(lengths)}
        held, seen = {}, {}
        for n, lo, hi, per, first, offset in plan(histogram, 100):
            for r in range(lo, hi):
                held.setdefault(first + (r - lo) // per, []).append((offset + (r - lo) % per * n, n))
                assert (n, r) not in seen
                seen[n, r] = True
        assert len(seen) == len(lengths)
        assert sorted(held) == list(range(len(held)))
        for items in held.values():
            end = 0
            for at, n in sorted(items):
                assert at == end
                end += n
            assert end <= 100 and sum(n > 100 / 3 for _, n in items) <= 2
        assert len(held) <= 1.25 * max(1, -(-sum(lengths) // 100), sum(n > 50 for n in lengths)) + 1


def test_pack(spark, library):
    rng = random.Random(2)
    rows = [(i, words(rng, rng.randint(0, 60))) for i in range(80)] + [(80, None), (81, ""), (82, words(rng, 500)), (5, "again"), (None, "no id")]
    got = pack(frame(spark, rows), capacity=64).collect()
    ids = {}
    for i, t in rows:
        ids.setdefault(i, []).append([*library(t), 1])
    pieces = sorted(((i, k // 64, k, len(x[k : k + 64]), zlib.crc32(np.array(x[k : k + 64], "<u4").tobytes())) for i, xs in ids.items() for x in xs for k in range(0, len(x), 64)), key=str)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == pieces
    held = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in held.values():
        end = 0
        for at, n in sorted(items):
            assert at == end
            end += n
        assert end <= 64
    assert len(held) <= 1.1 * sum(p[3] for p in pieces) / 64 + 2
    assert pack(frame(spark, rows).limit(0)).count() == 0


def test_token_files(spark, library, tmp_path):
    rng = random.Random(3)
    rows = [(i, words(rng, rng.randint(0, 40))) for i in rng.sample(range(1000), 120)] + [(2000, None), (2001, "long " * 400_000), (2002, ""), (7, "twice"), (7, "twice"), (None, "nothing")]
    got = sorted((tuple(r) for r in token_file_roundtrip(frame(spark, rows)).collect()), key=lambda r: r[1])
    key = lambda x: (x[0] is not None, x[0] or 0)
    assert [key(r) for r in got] == sorted(key(r) for r in rows)
    texts, at = {}, 0
    for i, t in rows:
        texts.setdefault(i, set()).add((len(ids := [*library(t), 2]), zlib.crc32(np.array(ids, "<u4").tobytes())))
    for i, start, n, crc in got:
        assert start == at and (n, crc) in texts[i]
        at += n
    manifest = write_token_files(frame(spark, rows), f"file://{tmp_path}/t", files=3).collect()
    assert sum(m.n_docs for m in manifest) == len(rows)
    reader = open_token_file([m for m in manifest if m.n_tokens > 400_000][0].path)
    ((ids,)) = reader.find(2001)
    assert np.frombuffer(ids, "<u4").tolist() == [*library("long " * 400_000), 2]
    assert reader.find(5000) == []
    raw = bytearray(open(manifest[0].path, "rb").read())
    raw[4] ^= 255
    (tmp_path / "bad").write_bytes(bytes(raw))
    with pytest.raises(Exception), open(tmp_path / "bad", "rb") as f:  # noqa: B017, PT012
        bad = TokenFileReader(f, len(raw))
        for n in range(len(bad.ids)):
            bad.document(n)
    assert token_file_roundtrip(frame(spark, rows).limit(0)).count() == 0


def repeats_by_hand(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = {}
    for b in texts:
        for k in range(len(b) - length + 1):
            seen[b[k : k + length]] = seen.get(b[k : k + length], 0) + 1
    out = []
    for (i, _), b in zip(rows, texts, strict=True):
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        gone = gone[: len(b)]
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((i, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_remove_repeats(spark):
    rng = random.Random(4)
    passage, other = words(rng, 40), words(rng, 30)
    rows = [(i, words(rng, rng.randint(0, 80))) for i in range(40)]
    rows += [(100, passage), (101, "x " + passage + " y"), (102, passage[5:120] + other), (103, other + other), (104, passage), (105, None), (106, ""), (107, "ab" * 300), (108, "a" * 500), (109, "a" * 64), (110, "é" * 100), (None, passage), (5, rows[5][1])]
    for length in (64, 40):
        got = sorted((tuple(r) for r in remove_repeats(frame(spark, rows), length).collect()), key=str)
        assert got == repeats_by_hand(rows, length)
    assert remove_repeats(frame(spark, rows).limit(0), 64).count() == 0
    kept = {r.doc_id: r.kept for r in remove_repeats(frame(spark, rows), 64, keep_text=True).collect()}
    assert kept[106] == b"" and kept[109] == b""


def test_repeats_across_blocks(spark, monkeypatch):
    """Many blocks, so that strings meet in the exchange and not in a block."""
    import tarnflow.llm.suffix_dedup as s

    rng = random.Random(5)
    passage = words(rng, 30)
    rows = [(i, words(rng, 10) + (passage if i % 3 == 0 else "") + words(rng, 10)) for i in range(30)] + [(90, passage), (91, passage)]
    whole = s.text_blocks
    monkeypatch.setattr(s, "text_blocks", lambda d, i, t, size: whole(d, i, t, 100))
    got = sorted((tuple(r) for r in remove_repeats(frame(spark, rows).repartition(5), 64).collect()), key=str)
    assert got == repeats_by_hand(rows, 64)


def jaccard_by_hand(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").translate({k: k + 32 for k in range(65, 91)})) if x]
        if i is not None:
            sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_encoding_of_any_characters(library):
    special = ["İ", "I\u0307", "J\u030c", "H\u0331", "ß", "Σ", "\u0301", "\u0345", "ﬁ", "ǅ", "K", "A\u030a", "é", "e\u0301", "٣", "字", "한", "\u1100\u1161", "\xa0", "\u2003", "\x85", "\x1c", "\x0b", "\u200b", "\u200d", "🙂", "<|", "|>", "<|endoftext|>", "<|STARTOFTEXT|>", "'s", "'RE", "ª", "Ⅷ", "²", "\0", "Ա", "ꭰ"]
    rng = random.Random(9)
    one = lambda: rng.choice("aAbBiItTsSzZ09 .,!?$'\"-_()<>|=\n\t ") if rng.random() < 0.6 else rng.choice(special) if rng.random() < 0.8 else chr(rng.choice([rng.randrange(32, 0x3000), rng.randrange(0xE000, 0x1FFFF)]))
    texts = ["aİ$", *("".join(one() for _ in range(rng.randrange(1, 30))) for _ in range(20_000))]
    got = encoded([t.encode() for t in texts], "word_bpe_49k.json")
    assert not [t for t, x in zip(texts, got, strict=True) if np.frombuffer(x, "<u4").tolist() != library(t)]


@pytest.mark.parametrize(("small", "frequent", "percent", "wide"), [(24, 4096, 80, 512), (2, 4096, 85, 512), (2, 3, 85, 512), (24, 2, 70, 512), (24, 2, 85, 20), (2, 2, 80, 8)])
def test_jaccard(spark, monkeypatch, small, frequent, percent, wide):
    monkeypatch.setattr(jaccard, "WIDE", wide)
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "ODD", 8)
    monkeypatch.setattr(jaccard, "OTHER", 16)
    rng = random.Random(6)
    base = [[f"w{rng.randrange(60)}" for _ in range(30)] for _ in range(5)]
    rows = []
    for i in range(140):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(900)}"
        rows.append((i, " ".join(w)))
    rows += [(260, None), (261, ""), (262, "one two"), (263, "One  TWO"), (264, " \n"), (265, "W1\u00a0w2 x"), (None, "a b c d e")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(frame(spark, rows), words=3, percent=percent, frequent=frequent).collect()}
    assert got.pop(None) == (3, None)
    assert got == jaccard_by_hand(rows, 3, percent)


def test_jaccard_empty_table(spark):
    assert jaccard.jaccard_components(frame(spark, [(1, "a")]).limit(0)).count() == 0
    assert [tuple(r) for r in jaccard.jaccard_components(frame(spark, [(1, None)])).collect()] == [(1, 0, 1)]


def test_components(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 180)] + [(500, k) for k in range(501, 540)] + [(3, 3), (None, 4)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in root}


def distance_by_hand(item, text):
    before = [0] * (len(text) + 1)
    for i in range(len(item)):
        now = [i + 1]
        for j in range(len(text)):
            now.append(min(before[j + 1] + 1, now[j] + 1, before[j] + (item[i] != text[j])))
        before = now
    return min(before)


@pytest.mark.parametrize("n", [2, 3, 7, 50])
def test_keys_are_dealt_one_to_a_partition(spark, n):
    keys = spark.createDataFrame([(int(k),) for k in even_keys(n)], "r int").repartition(n, "r")
    got = keys.select("r", F.spark_partition_id().alias("p")).collect()
    assert sorted(r.p for r in got) == list(range(n)) and [r.r for r in sorted(got, key=lambda r: r.p)] == even_keys(n).tolist()


def test_more_pairs_than_32_bits_count():
    rng = random.Random(2)
    items = ["".join(rng.choice("abcdefgh ") for _ in range(20)).strip() + " zz tail of all" for _ in range(60_000)]
    known = Items(list(range(len(items))), items, 0.1)
    texts = ["x"] * 40_000 + [items[k] for k in (0, 31_234, 59_999)] + ["y " * 300_000 + items[77]]
    assert len(texts) * len(items) > 1 << 31
    got = known.search(texts)
    assert {(40_000, 0), (40_001, 31_234), (40_002, 59_999), (40_003, 77)} <= {x[:2] for x in got if x[2] == 0}


@pytest.mark.parametrize("hits", [1_000_000, 40])
def test_leaks(spark, monkeypatch, hits):
    monkeypatch.setattr(decontaminate, "HITS", hits)
    rng = random.Random(8)
    some = lambda n: " ".join("".join(rng.choice("abcdefgh ") for _ in range(n)).split())
    items = [some(120) for _ in range(5)]
    docs = []
    for i in range(50):
        s = list(rng.choice(items))
        for _ in range(rng.randint(0, 16)):
            p, o = rng.randrange(len(s)), rng.random()
            if o < 0.34:
                s[p] = rng.choice("abcdefgh")
            elif o < 0.67:
                s.insert(p, rng.choice("abcdefgh"))
            else:
                del s[p]
        docs.append((i, some(rng.randint(0, 200)) + " " + "".join(s).upper() + ",\n " + some(rng.randint(0, 200))))
    docs += [(60, None), (61, ""), (62, items[0][: len(items[0]) // 2]), (63, items[0]), (63, items[0]), (None, items[1])]
    bench = spark.createDataFrame([*enumerate(items), (7, None), (8, ""), (9, "ab")], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id, r.edits) for r in leaks(frame(spark, docs), bench).collect()), key=str)
    known = Items(list(range(5)), items, 0.1)
    want = []
    for d, t in docs:
        text = normalise([t or ""])[0][:-1]
        for i, item in enumerate(known.data):
            e = distance_by_hand(item.tolist(), text.tolist())
            if e <= known.budget[i]:
                want.append((d, i, e))
    assert got == sorted(want, key=str)
    bad = {d for d, *_ in want}
    left = without_leaks(frame(spark, docs), bench)
    assert left.columns == frame(spark, docs).columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(d for d, _ in docs if d not in bad)
    assert leaks(frame(spark, docs), bench.limit(0)).count() == 0
    assert leaks(frame(spark, docs).limit(0), bench).count() == 0


def test_banded_distance_of_the_whole():
    a = np.frombuffer(b"abcdefghijkl", np.uint8)
    assert banded_distance(a, a, 0, 0, 0) == (0, 0, 12)
    assert banded_distance(a, np.frombuffer(b"xxabcdefXghijkl", np.uint8), 0, 4, 2)[0] == 1


def test_answers_of_a_range_take_little_memory():
    """Right totals and first holders, within 55 bytes a value: executors share their memory with two such workers."""
    import tracemalloc
    from collections import Counter

    import pyarrow as pa

    from tarnflow.llm import exchange
    from tarnflow.llm.packed import pack_array, pack_ints, unpack_array

    r = np.random.default_rng(1)
    sets = [np.unique(np.concatenate([r.integers(0, 1 << 63, 8000, dtype=np.uint64), np.arange(40, dtype=np.uint64)])) for _ in range(60)]
    counts = [None if k % 7 == 0 else r.integers(1, 4, len(s)).astype(np.uint32) for k, s in enumerate(sets)]
    counts[1][0] = 2**32 - 1  # with others the total is too large for 32 bits
    names = [f"{k:03}" for k in range(len(sets))]
    turn = r.permutation(len(sets))
    table = pa.table({"r": pa.array([3] * len(sets), pa.int32()), "block": [names[k] for k in turn], "own": pa.array([pack_ints(sets[k]) for k in turn], pa.binary()), "n": pa.array([None if counts[k] is None else pack_array(counts[k]) for k in turn], pa.binary())})
    tracemalloc.start()
    got = exchange._answer(table).sort_by("block").to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 55 * sum(map(len, sets))
    total, held = Counter(), set()
    for s, n in zip(sets, counts, strict=True):
        total.update(dict(zip(s.tolist(), [1] * len(s) if n is None else n.tolist(), strict=True)))
    for name, s, row in zip(names, sets, got, strict=True):
        values = s.tolist()
        bits = lambda c: np.unpackbits(unpack_array(row[c], np.uint8), count=len(values)).astype(bool).tolist()  # noqa: B023, E731
        assert row["block"] == name and bits("more") == [total[v] > 1 for v in values] and bits("first") == [v not in held for v in values]
        assert unpack_array(row["totals"], np.uint32).tolist() == [min(total[v], 2**32 - 1) for v in values if total[v] > 1]
        held.update(values)


def test_learning_leaves_the_collector_alone():
    own = ChunkEncoder("word_bpe_49k.json")
    words = ["".join(x) for x in itertools.product("abcdefgh", repeat=5)][:30_000]
    words[::100] = [f"{w}é" for w in words[::100]]
    chunks = {f"{w},".encode() for w in words}
    runs = []
    count = lambda phase, info: runs.append(phase)
    gc.collect()
    gc.callbacks.append(count)
    try:
        known = own.learn(chunks)
    finally:
        gc.callbacks.remove(count)
    assert runs.count("start") <= 3
    for c in sorted(chunks)[::500]:
        assert known[c] == np.asarray(own.library.encode(c.decode(), add_special_tokens=False).ids, dtype="<u4").tobytes()
