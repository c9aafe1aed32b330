"""Source relations with frozen schemas."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "pages": "page_id bigint, url string, html string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def load(spark: SparkSession, sf_dir: str | dict[str, DataFrame], name: str) -> DataFrame:
    """A table by its frozen schema, or as given by name; filters and columns are pushed into the Parquet scan."""
    if isinstance(sf_dir, dict):
        return sf_dir[name]
    path = f"{sf_dir}/{name}.parquet"
    return spark.read.schema(SCHEMAS[name]).parquet(path) if name in SCHEMAS else spark.read.parquet(path)


@dataclass(frozen=True)
class Relation:
    """A source contract: columns with types and nullability, and the primary key. Never inferred."""

    name: str
    schema: T.StructType
    primary_key: tuple[str, ...] = field(default=())

    def check(self, df: DataFrame) -> DataFrame:
        """`df` with exactly the contract's columns; a missing column or another type is an error."""
        have = {f.name: f.dataType for f in df.schema}
        for f in self.schema:
            if have.get(f.name) != f.dataType:
                raise ValueError(f"{self.name}.{f.name} is {have.get(f.name)}, not {f.dataType}")
        return df.select(*[f.name for f in self.schema])
