"""Plain table access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# Declared, so opening a table never starts a job that reads footers.
SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
    "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
    "l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
}


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    path = f"{directory.rstrip('/')}/{name}.parquet"
    return spark.read.schema(SCHEMAS[name]).parquet(path) if name in SCHEMAS else load(spark, path)


def customers_with_entity(spark: SparkSession, directory: str) -> DataFrame:
    """Customer keys with the entity (sales region) they belong to."""
    nation = table(spark, directory, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, directory, "region").select("r_regionkey", "r_name")
    return (
        table(spark, directory, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("r_name").alias("global_entity_id"),
            F.col("c_custkey").alias("analytical_customer_id"),
            "c_mktsegment",
        )
    )
