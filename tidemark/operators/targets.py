"""Target columns. Names are fixed values that the export and the metrics table rely on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GENERAL = "target_acquisition_qc_general_0_1"
ORGANIC = "target_acquisition_qc_organic_0_1"
FREQUENCY = "target_order_freq_4w_vert_qc"
ORDER_VALUE = "target_gmv_avg_lifetime_vert_qc"
GENERAL_DARK = "target_acquisition_dmart_general_0_1"
ORDER_VALUE_DARK = "target_gmv_avg_lifetime_vert_dmart"


def general(count: Column | None = None) -> Column:
    """1 when the customer has ordered from a dark store, 0 otherwise (also when unknown)."""
    count = F.col("order_count_lifetime_vert_dmart") if count is None else count
    return F.when(count > 0, 1).otherwise(0)


def organic(count: Column | None = None, voucher: Column | None = None) -> Column:
    """Among acquired customers: 1 when the first order carried no voucher, 0 when it did."""
    count = F.col("order_count_lifetime_vert_qc") if count is None else count
    voucher = F.col("first_order_voucher_vert_qc") if voucher is None else voucher
    paid = F.coalesce(voucher, F.lit(0.0))
    return F.when((count > 0) & (paid == 0), 1).when((count > 0) & (paid > 0), 0)


def frequency() -> Column:
    return F.col("order_freq_4w_vert_qc")


def order_value() -> Column:
    return F.col("gmv_avg_lifetime_vert_qc")


def with_targets(df: DataFrame) -> DataFrame:
    return df.select(
        "*",
        general().alias(GENERAL),
        organic().alias(ORGANIC),
        frequency().alias(FREQUENCY),
        order_value().alias(ORDER_VALUE),
    )


def with_dark_store_targets(df: DataFrame) -> DataFrame:
    return df.select(
        "*",
        general().alias(GENERAL_DARK),
        F.col("gmv_avg_lifetime_vert_dmart").alias(ORDER_VALUE_DARK),
    )
