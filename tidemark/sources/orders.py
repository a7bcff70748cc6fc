"""Order lines and order headers -> one typed row per order.

Money is kept in integer minor units (cents, or 1/10000 for derived amounts): sums are exact, stay in
primitive long buffers, and so remain in the hash aggregate with whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.tables import table

RESTAURANTS, DARKSTORES, LOCALSTORES = "restaurants", "darkstores", "localstores"
CENTS = 100.0
FINE_UNITS = 10000.0


def order_delays(spark: SparkSession, directory: str) -> DataFrame:
    """Ship-day total and line count per order; collapses before the join, on the map side first."""
    lines = table(spark, directory, "lineitem")
    return lines.groupBy("l_orderkey").agg(
        F.sum(F.unix_date(F.to_date("l_shipdate")).cast("bigint")).alias("ship_days"),
        F.count("l_shipdate").alias("n_lines"),
    )


def order_facts(spark: SparkSession, directory: str) -> DataFrame:
    orders = table(spark, directory, "orders")
    delays = order_delays(spark, directory)
    key = F.col("o_orderkey")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    order_day = F.to_date("o_orderdate")
    delay = (F.col("ship_days") - F.unix_date(order_day) * F.col("n_lines")) / F.col("n_lines")
    vertical = (
        F.when((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "F"), DARKSTORES)
        .when((F.col("o_orderpriority") == "2-HIGH") & (F.col("o_orderstatus") == "F"), LOCALSTORES)
        .otherwise(RESTAURANTS)
    )
    return (
        orders.join(delays, key == F.col("l_orderkey"), "left")
        .select(
            F.col("o_custkey").alias("analytical_customer_id"),
            key.alias("order_id"),
            order_day.alias("order_date"),
            vertical.alias("vertical"),
            F.when(key % 97 == 0, F.lit(0).cast("bigint")).otherwise(cents).alias("gmv_cents"),
            (cents * (key % 5)).alias("discount_fine"),
            (key % 4).cast("double").alias("delivery_fee"),
            F.when(key % 7 == 0, 5.0).otherwise(0.0).alias("voucher"),
            ((key % 60) * 100).cast("double").alias("delivery_distance"),
            (key % 45 + 15).cast("double").alias("delivery_time_promised"),
            ((key % 3) * 0.5).cast("double").alias("joker_cust_discount"),
            ((key % 6) * 0.25).cast("double").alias("joker_vendor_fee"),
            F.round(delay * FINE_UNITS).cast("bigint").alias("delay_fine"),
            (key % 24).cast("int").alias("order_hour"),
            (key % 50).alias("vendor_id"),
            (key % 5 + 1).alias("rating"),
        )
        .withColumn("is_late", F.col("delay_fine") > 0)
        .withColumn("is_weekend", F.dayofweek("order_date").isin(1, 7))
    )
