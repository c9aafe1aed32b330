"""A corpus pipeline: toxic texts, near-duplicates and benchmark leaks go, personal values are replaced, and the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.llm.common import materialize
from tarnflow.llm.decontaminate import without_leaks
from tarnflow.llm.jaccard_join import jaccard_components
from tarnflow.llm.packing import pack
from tarnflow.llm.pii import pseudonymise, session_key
from tarnflow.llm.toxicity import train, without_toxic


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that score 0.7 or more go; the model learns from the labels of those texts that are not held out.

    Null and empty texts score as an empty window and stay; so do rows without an id that are not toxic. Rows with equal texts share their
    fate. A text of any length is scored window by window. An empty table gives no rows. All columns pass, whatever their names.
    """
    return without_toxic(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by a Jaccard similarity of 0.8 on five-word shingles the one of least id stays.

    Rows of one id with different values are rows of their own, and lose against other ids; of equal rows a single one stays.
    Rows without an id are compared among themselves. Null and empty texts link with nothing; very long ones are compared as a whole.
    An empty table gives no rows. All columns pass, whatever their names and types.
    """
    key, digest, shared = (_free(docs, x) for x in ("key", "digest", "shared"))
    own = docs.withColumn(digest, F.xxhash64(*[c for f in docs.schema for c in _hashable(f)]))
    named, nameless = own.where("doc_id is not null"), own.where("doc_id is null")
    # ids of several rows; most tables have none, and then texts need not move for them
    many = materialize(named.groupBy("doc_id").agg(F.min(digest).alias("a"), F.max(digest).alias("b"), F.count("*").alias("n")).where("n > 1").select("doc_id", (F.col("a") != F.col("b")).alias(shared)), "ids")
    # ids as keys where they tell rows apart; other rows get hashes above all usual ids
    hashed = F.col(digest).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    once = many.isEmpty()
    of_id = F.col("doc_id").cast("long")
    named = named.withColumn(key, of_id) if once else named.join(many, "doc_id", "left").withColumn(key, F.when(F.col(shared), hashed).otherwise(of_id))
    out = _least(named, key, docs.columns, once)
    return out if nameless.isEmpty() else out.unionByName(_least(nameless.withColumn(key, hashed), key, docs.columns, False))


def _free(docs: DataFrame, name: str) -> str:
    while name in docs.columns:
        name = f"_{name}"
    return name


def _hashable(field) -> list:
    """What tells values of a column apart, nulls included."""
    c = F.col(f"`{field.name}`")
    return [F.to_json(F.struct(c)) if "map<" in field.dataType.simpleString() or "variant" in field.dataType.simpleString() else c, c.isNull()]


def _least(rows: DataFrame, key: str, columns: list[str], once: bool) -> DataFrame:
    """Of rows linked by their texts those of least `key`, once each: rows of one key are equal, and `once` says that there are none."""
    kept = jaccard_components(rows, words=5, percent=80, id_col=key).where("doc_id = component_id").select(F.col("doc_id").alias(key)).distinct()
    left = rows.join(kept, key, "left_semi")
    return (left if once else left.dropDuplicates([key])).select(*[F.col(f"`{c}`") for c in columns])


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that hold a benchmark item go.

    Each row is judged for itself, so null ids and repeated rows need no care. Null and empty texts stay; very long ones are
    searched as a whole. An empty table gives no rows. All columns pass, whatever their names.
    """
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def replace_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values become pseudonyms; n_chars follows the text.

    Each row is treated for itself. A null text stays null with n_chars null, an empty one stays empty, a very long one is
    searched as a whole. An empty table gives no rows. Other columns pass, one called n_pii included.
    """
    aside = _free(docs, "aside")
    out = pseudonymise(docs.withColumnRenamed("n_pii", aside), session_key(spark))
    given = {"n_chars": F.length("text").cast("long"), "n_pii": F.col(aside) if "n_pii" in docs.columns else None}
    return out.select(*[given[c].alias(c) if c in given else F.col(f"`{c}`") for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is packed into sequences of 4096 tokens.

    A null or empty text is one piece of the end id; longer ones than a sequence are cut. Null ids and repeated rows are
    packed like others. An empty table gives no rows. Columns other than id and text are not read.
    """
    return pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("benchmark leaks", drop_leaks),
    ("personal values", replace_personal),
    ("packing", pack_sequences),
]
#: A trained network, a permutation's digests and a packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
