"""URL filter, pseudonyms, toxicity and vectors."""

import random
import re
import tracemalloc

import numpy as np
import pytest

import tarnflow.llm.vector_dedup as vectors
from tarnflow.llm.pii import DAYS, feistel, permute_days, permute_name, permute_ssn, pseudonymise, session_key
from tarnflow.llm.toxicity import Network, Toxicity, toxicity, window_starts, without_toxic
from tarnflow.llm.url_filter import RULES, BoostedTrees, judge
from pyspark.sql import functions as F


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate({k: k + 32 for k in range(65, 91)}), re.match(r"[^?#]*", rest[len(host) :])[0]


def rule_of(host, path):
    best = None
    for verdict, rule in RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = verdict, rule
    return best


URLS = [
    "http://a.example.org/es/1", "https://EXAMPLE.org/en/12", "http://example.org/en/2", "http://notexample.org", "http://x.org/", "ftp://y.com/fr/", "y.com/fr/1", None, "", "http://z.com/de/9?a=1&b=2#t", "http://z.com/en?x=/fr/",
    "http://com/fr/", "http://xcom/fr/", "a://b://c.org/", "http://ÄB.ORG/é", "http://spam-spam.net/1/2/3?u=1", "https://q.net", "http://example.org", "http://example.org?/es/", "x\n://h.org/\na",
]


def test_urls(spark):
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)] + [(None, URLS[0], "h"), (0, URLS[0], "h")], "page_id long, url string, host string")
    got = judge(df).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        if r.page_id is None:
            continue
        assert (r.host, r.path) == split(URLS[r.page_id])
        want = rule_of(r.host, r.path)
        assert r.rule == (want and want[1])
        assert r.verdict == (want[0] if want else ("block" if r.score >= 0.5 else "allow"))
    assert judge(df.limit(0)).count() == 0
    assert {r.score for r in judge(df.where("page_id = 6")).collect()} == {0.5}


def test_all_suffixes_count(spark):
    # 300 suffixes of one length and equal counts: only their statistics tell the blocked ones
    name = lambda k: "".join("abcdefghij"[int(c)] for c in f"{k:03d}")
    urls = [(f"http://h{j}.{name(k)}/", k * 7 % 10 < 5) for k in range(300) for j in range(4)]
    labelled = spark.createDataFrame(urls, "url string, blocked boolean")
    pages = spark.createDataFrame([(k, f"http://h9.{name(k)}/") for k in range(300)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in judge(pages, labelled=labelled).collect()}
    assert got == {k: "block" if k * 7 % 10 < 5 else "allow" for k in range(300)}


def test_trees_as_expression(spark):
    r = np.random.default_rng(0)
    x = r.random((300, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    m = BoostedTrees(20, 3).fit(x, y)
    p = m.predict(x)
    assert ((p >= 0.5) == (y == 1)).mean() > 0.97
    df = spark.createDataFrame([(k, *map(float, row)) for k, row in enumerate(x[:50])], "k int, a double, b double, c double")
    got = [r.s for r in df.select("k", m.expression([F.col("a"), F.col("b"), F.col("c")]).alias("s")).orderBy("k").collect()]
    assert np.allclose(got, p[:50])


def luhn(s):
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(s))) % 10 == 0


def test_feistel_is_a_permutation(spark):
    df = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    got = [(r.d, r.e, r.b) for r in df.select("d", feistel(F.col("d"), "k", "x").alias("e")).select("d", "e", feistel(F.col("e"), "k", "x", undo=True).alias("b")).collect()]
    assert sorted(e for _, e, _ in got) == sorted(d for d, *_ in got)
    assert all(d == b for d, _, b in got)


def test_pseudonyms(spark):
    card, bad = "4111 1111 1111 1111", "4111-1111-1111-1112"
    texts = [
        f"pay {card}, now", f"pay {bad} no", f"{card.replace(' ', '')}!!", "call +1 (917) 555-3424 or 10.0.0.256 and 10.1.2.3.", "born 1999-02-28, 31.12.2001, 1999-02-30", "a.b7@mail.example.com 219-09-9999 000-12-3456",
        "", None, "nothing here", "version 2.0 of 12 things @home", "x " * 20000 + card, f"{card} {card}",
    ]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_pii int")
    out = pseudonymise(df, "tarnflow")
    assert out.columns == df.columns
    got = {r.doc_id: (r.text, r.n_pii) for r in out.collect()}
    new = re.match(r"pay (.*), now", got[0][0])[1]
    assert re.fullmatch(r"\d{4} \d{4} \d{4} \d{4}", new) and new != card and luhn(new.replace(" ", ""))
    assert got[1] == (texts[1], 0)
    assert got[2] == (new.replace(" ", "") + "!!", 1)  # equal values stay linked
    assert got[3][1] == 2 and re.fullmatch(r"call \+1 \(\d{3}\) \d{3}-\d{4} or 10\.0\.0\.256 and \d+\.\d+\.\d+\.\d+\.", got[3][0]) and "555-3424" not in got[3][0]
    assert got[4][1] == 2 and got[4][0].endswith("1999-02-30") and re.match(r"born \d{4}-\d\d-\d\d, \d\d\.\d\d\.\d{4}, ", got[4][0])
    assert got[5][1] == 2 and re.fullmatch(r"[a-z]\.[a-z]\d@mail\.example\.com \d{3}-\d\d-\d{4} 000-12-3456", got[5][0])
    assert got[6] == ("", 0) and got[7] == (None, 0) and got[8] == (texts[8], 0) and got[9] == (texts[9], 0)
    assert got[10] == ("x " * 20000 + new, 1)
    assert got[11] == (f"{new} {new}", 2)
    assert {r.n_pii for r in pseudonymise(df, key="other").where("doc_id = 0").collect()} == {1}
    assert pseudonymise(df, key="other").where("doc_id = 0").first().text != got[0][0]
    assert pseudonymise(df.limit(0), "k").count() == 0


def test_numbers_and_names_can_be_undone(spark):
    rng = random.Random(5)
    ssns = [f"{a:03}{g:02}{n:04}" for a, g, n in [(1, 1, 1), (665, 99, 9999), (667, 1, 1), (899, 99, 9999), *((rng.choice([rng.randrange(1, 666), rng.randrange(667, 900)]), rng.randrange(1, 100), rng.randrange(1, 10000)) for _ in range(300))]]
    df = spark.createDataFrame([(x,) for x in ssns], "d string").withColumn("e", permute_ssn(F.col("d"), "k"))
    for r in df.withColumn("b", permute_ssn(F.col("e"), "k", undo=True)).collect():
        assert r.b == r.d and re.fullmatch(r"(?!000|666|9)\d{3}(?!00)\d\d(?!0000)\d{4}", r.e)
    names = ["a", "ab", "John.Doe_7", "john.doe_7", "x" * 64, "a-1+b.C", "99", "."]
    df = spark.createDataFrame([(x,) for x in names], "n string").withColumn("e", permute_name(F.col("n"), F.lit("@x.org"), "k"))
    got = {r.n: (r.e, r.b) for r in df.withColumn("b", permute_name(F.col("e"), F.lit("@X.org"), "k", undo=True)).collect()}
    shape = lambda x: re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub("[0-9]", "0", x)))
    assert all(b == n and shape(e) == shape(n) for n, (e, b) in got.items())
    assert got["John.Doe_7"][0].lower() == got["john.doe_7"][0] != "john.doe_7"
    pairs = [a + b for a in "abcdefghijklmnopqrstuvwxyz" for b in "0123456789"]
    out = spark.createDataFrame([(x,) for x in pairs], "n string").select(permute_name(F.col("n"), F.lit("@x"), "k").alias("e")).collect()
    assert sorted(r.e for r in out) == pairs


def test_the_key_is_a_setting(spark):
    with pytest.warns(UserWarning, match="open key"):
        assert session_key(spark) == "tarnflow"
    spark.conf.set("spark.tarnflow.pii.key", "secret")
    assert session_key(spark) == "secret"
    spark.conf.unset("spark.tarnflow.pii.key")


def test_telephone_numbers_end(spark):
    phones = ["+1 (826) 555-4081", "+1-826-555-4081", "+18265554081", "(826) 555-4081", "+44 20 7946 0958", "+45 32 12 34 56", "+4915112345678"]
    others = ["190.137.223.204", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111", "219-09-9999", "1999-02-28", "31.12.2001"]
    texts = [*phones, *others, *(f"{p} {x}" for p in phones for x in others), *(f"{p}{x}" for p in phones[:4] for x in (" 42", " 1234", " 42 100 people", ".5"))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {texts[r.doc_id]: (r.text, r.n_pii) for r in pseudonymise(df, "tarnflow").collect()}
    assert all(got[x][1] == 1 and got[x][0] != x for x in [*phones, *others])
    for p in phones:
        assert [got[f"{p} {x}"] for x in others] == [(f"{got[p][0]} {got[x][0]}", 2) for x in others]
    for t, new in got.items():
        p = next((p for p in phones[:4] if t.startswith(p)), None)
        if p and t.removeprefix(p) in (" 42", " 1234", " 42 100 people", ".5"):
            assert new == (got[p][0] + t.removeprefix(p), 1)


@pytest.mark.parametrize("key", ["tarnflow", "other"])
def test_every_date_has_a_pseudonym(spark, key):
    days = spark.range(0, DAYS, 1, 8).select("id", F.date_format(F.expr("date_add(date'1900-01-01', cast(id as int))"), "yyyy-MM-dd").alias("text"))
    rows = pseudonymise(days, key).select("id", "text", "n_pii").collect()
    own = {r.id: r.text for r in days.collect()}
    assert sorted(r.text for r in rows) == sorted(own.values())
    assert sum(r.text == own[r.id] for r in rows) == sum(r.n_pii == 0 for r in rows) <= 4  # a permutation may keep one
    lost = {"1956-01-19", "1966-10-04", "1978-10-05", "2058-08-07", "2065-01-28"}
    assert not any(own[r.id] in lost and r.text == own[r.id] for r in rows)
    some = days.where("id % 97 = 0").select("id", permute_days(F.col("id"), key).alias("p"))
    assert all(r.id == r.b for r in some.select("id", permute_days(F.col("p"), key, undo=True).alias("b")).collect())


def test_dates_month_first(spark):
    texts = ["1999-12-31", "31/12/1999", "12/31/1999", "12.31.1999", "02/30/1999", "13/13/1999", "02/29/2000", "29.02.2000"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [(r.text, r.n_pii) for r in pseudonymise(df, "tarnflow").orderBy("doc_id").collect()]
    y, m, d = got[0][0].split("-")
    assert int(d) > 12 and got[0][0] != texts[0]  # so month first is the only reading
    assert [t for t, _ in got[1:4]] == [f"{d}/{m}/{y}", f"{m}/{d}/{y}", f"{m}.{d}.{y}"] and [n for _, n in got[:4]] == [1] * 4
    assert got[4:6] == [(texts[4], 0), (texts[5], 0)]
    (a, _), (b, _) = got[6:]
    assert b == f"{a[3:5]}.{a[:2]}.{a[6:]}" and a != texts[6]


def test_gradients():
    r = np.random.default_rng(1)
    net = Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    table = (np.array([0, 1, 2, 3]), np.array([[0, 0], [1, 2], [3, 3], [4, 5]]), np.array([[0, 0], [0.5, 0.5], [1, 0], [0.5, 0.5]]))
    ids = r.integers(0, 4, (5, 3))
    mask = (ids > 0).astype(float)
    y = np.array([0.0, 1.0, 1.0])

    def loss():
        g = net.gates(net.inputs(*table))
        z = net.run({w: v[ids] for w, v in g.items()}, mask)
        return float(np.mean(np.log1p(np.exp(-z)) * y + np.log1p(np.exp(z)) * (1 - y)))

    grads = net.gradients(ids, table, mask, y)
    for name in ("Wf", "Ub", "cf", "A", "a", "o", "z", "tri", "word"):
        flat, g = net.p[name].reshape(-1), grads[name].reshape(-1)
        for k in (np.argsort(-np.abs(g))[:3]).tolist():
            old = flat[k]
            flat[k] = old + 1e-4
            up = loss()
            flat[k] = old - 1e-4
            down = loss()
            flat[k] = old
            assert abs((up - down) / 2e-4 - g[k]) < 1e-3 * max(1, abs(g[k])) + 2e-4, name


def corpus(rng, n):
    plain = [f"w{k}" for k in range(200)]
    rows = []
    for i in range(n):
        w = [rng.choice(plain) for _ in range(rng.choice([5, 30, 60, 150]))]
        y = int(rng.random() < 0.4)
        if y:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["scumx", "vilea", "vileo", "vileu"])
        rows.append((i, " ".join(w), y))
    return rows


def test_toxicity(spark):
    rows = corpus(random.Random(3), 500)
    docs = spark.createDataFrame([(i, t, "s") for i, t, _ in rows] + [(900, None, "s"), (901, "", "s"), (902, "w1 " * 3000 + "VILEA. " + "w2 " * 3000, "s"), (902, "w1", "s"), (None, "w1", "s")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = toxicity(docs, labels).collect()
    assert len(got) == 505
    by = {r.doc_id: r for r in got if r.doc_id is not None and r.doc_id < 900}
    held = [(by[i].score, y) for i, _, y in rows if by[i].held_out]
    assert 100 < len(held) < 250
    assert np.mean([(s >= 0.7) == y for s, y in held]) > 0.95
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.doc_id is not None or not r.held_out
    assert max(r.score for r in got if r.doc_id == 902) > 0.7  # one window of a long text is enough
    empty = [r.score for r in got if r.doc_id in (900, 901)]
    assert empty[0] == empty[1] < 0.7
    assert toxicity(docs.limit(0), labels).count() == 0
    assert toxicity(docs.limit(3), labels.limit(0)).count() == 3


def test_windows_cover_all():
    for n in (0, 1, 47, 48, 49, 80, 81, 1000):
        held = {k for s in window_starts(n) for k in range(s, min(n, s + 48))}
        assert held == set(range(n))


def test_filter_keeps_columns(spark):
    rows = corpus(random.Random(4), 300)
    model = Toxicity.fit([t.encode() for _, t, _ in rows], [y for *_, y in rows])
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(None, None, "x")], "doc_id long, text string, lang string")
    left = without_toxic(docs, model)
    assert left.columns == docs.columns
    kept = {r.doc_id for r in left.collect()}
    assert None in kept and np.mean([(i in kept) == (not y) for i, _, y in rows]) > 0.95


@pytest.mark.parametrize(("members", "probes"), [(1024, 4096), (4, 8)])
def test_vectors(spark, monkeypatch, members, probes):
    monkeypatch.setattr(vectors, "MEMBERS", members)
    monkeypatch.setattr(vectors, "PROBES", probes)
    r = np.random.default_rng(2)
    base = r.standard_normal((40, 8))
    rows = [(k, (base[k % 40] + 0.15 * (k % 3) * r.standard_normal(8)).astype(np.float32).tolist()) for k in range(200)]
    rows += [(300, rows[0][1]), (301, (np.array(rows[0][1]) * 7).tolist())]
    fine = list(rows)
    rows += [(400, None), (401, [0.0] * 8), (402, [float("nan")] * 8), (403, [1.0, None] + [0.0] * 6), (404, [float("inf")] * 8), (405, []), (406, [1.0, 2.0]), (None, rows[0][1])]
    df = spark.createDataFrame([(i, v, "l") for i, v in rows], "vec_id long, embedding array<float>, n_links string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(df).collect()}
    assert len(got) == len(rows)
    x = np.array([np.array(v, np.float32).astype(float) for _, v in fine])
    x /= np.linalg.norm(x, axis=1)[:, None]
    link = (x @ x.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    ids = [i for i, _ in fine]
    want, found = int(link.sum()), sum(got[i][0] for i in ids)
    assert found <= want and found >= 0.9 * want
    root = list(range(len(ids)))
    for a, b in zip(*np.nonzero(link), strict=True):
        lo, hi = sorted((root[a], root[b]))
        root = [lo if q == hi else q for q in root]
    assert np.mean([got[i][1] == ids[root[k]] for k, i in enumerate(ids)]) > 0.9
    for i in (400, 401, 402, 403, 404, 405, 406):
        assert got[i] == (0, i, True)
    assert got[None] == (0, None, False)
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_training_memory():
    r = random.Random(9)
    words = ["".join(r.choices("abcdefghijklmnop", k=r.randint(5, 12))) for _ in range(12_000)]
    texts = [" ".join(r.choices(words, k=900)).encode() for _ in range(90)]
    tracemalloc.start()
    Toxicity.fit(texts, [k % 2 for k in range(90)], rounds=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30_000_000
