"""The pipeline's stages on the smallest tables, and what each may not lose."""

import re

import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k == 4:
            break
        assert out.columns == docs.columns
        rows = out.collect()
        ids = [r.doc_id for r in rows]
        assert len(ids) == len(set(ids)) and set(ids) <= {r.doc_id for r in docs.select("doc_id").collect()}
        docs = spark.createDataFrame(rows, docs.schema)
    packed = out.collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}
    assert n * 0.5 < docs.count() < n
    assert not any(re.search(r"\+1 \(\d{3}\) 555-\d{4}", r.text) for r in docs.collect())


def test_repeated_and_null_rows(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet").limit(5)
    odd = base.selectExpr("cast(null as bigint) doc_id", "text", "lang", "source", "n_chars").union(base).union(base)
    odd = odd.union(base.limit(1).selectExpr("9999 doc_id", "cast(null as string) text", "lang", "source", "n_chars"))
    _, stage = corpus_pipeline.STAGES[1]
    got = [r.doc_id for r in stage(spark, odd, SF).collect()]
    assert got.count(None) == 5 and got.count(9999) == 1 and len([x for x in got if x not in (None, 9999)]) == len({x for x in got if x not in (None, 9999)})
    for name, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, base.limit(0), SF).count() == 0, name


def test_rows_that_share_an_id(spark):
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(1, words(1)), (1, words(2)), (1, words(2)), (2, words(3)), (3, words(3) + " more"), (None, words(4)), (None, words(4)), (None, words(4) + " more"), (None, words(5)), (4, words(2))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert out.columns == docs.columns
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert sorted(x for x in got if x[0] is not None) == [(1, words(1)), (2, words(3)), (4, words(2))]
    free = [t for i, t in got if i is None]
    assert len(free) == 2 and words(5) in free and any(t.startswith(words(4)) for t in free)


@pytest.mark.parametrize("stage", range(5))
def test_odd_rows_pass_every_stage(spark, tmp_path, stage):
    """Nulls, empty and long texts, repeated rows, empty tables, and columns whose names clash with results or have dots."""
    long = " ".join(f"v{k}" for k in range(30_000))
    rows = [(1, "plain words of no harm " * 3, {"a": 1}), (1, "plain words of no harm " * 3, {"a": 1}), (2, None, None), (3, "", {}), (4, long, {"b": 2}), (None, "some other text here, mail me: ann.lee@x.org", None), (None, None, None)]
    schema = "doc_id long, text string, n_chars long, n_pii int, component_id string, n_shingles string, key string, digest string, score string, __n string, __key string, `a.b` string, m map<string,int>"
    docs = spark.createDataFrame([(i, t, 0, 9, *"cskdsnka", m) for i, t, m in rows], schema)
    spark.createDataFrame([(1, 0, 0), (77, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "an item that stands in no text at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    name, run = corpus_pipeline.STAGES[stage]
    out = run(spark, docs, str(tmp_path))
    got = out.collect()
    assert run(spark, docs.limit(0), str(tmp_path)).count() == 0
    if name == "packing":
        assert sorted(r.doc_id is None for r in got if r.piece == 0).count(True) == 2 and len([r for r in got if r.piece == 0]) == 7
        return
    assert out.columns == docs.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in got)
    assert ids == ([(False, 1), (False, 2), (False, 3), (False, 4), (True, 0), (True, 0)] if name == "near copies" else [(False, 1), (False, 1), (False, 2), (False, 3), (False, 4), (True, 0), (True, 0)])
    assert all((r.n_pii, r.component_id, r["a.b"]) == (9, "c", "a") for r in got)
    assert next(r.text for r in got if r.doc_id == 4) == long and all(r.text is None for r in got if r.doc_id == 2)
    if name == "personal values":
        assert not any("ann.lee@" in (r.text or "") for r in got)
