"""Nested snapshot -> flat feature columns, generated from small specs.

Output names are fixed values: downstream feature lists select columns by these name parts.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expressions import (
    day_of_week,
    days_since,
    earlier_vertical_value,
    least_strict,
    or_zero,
    safe_divide,
    share_of,
)

KEYS = ("global_entity_id", "analytical_customer_id")

WINDOWS = {"lifetime": "lifetime", "l04w": "last4w", "l16w": "last16w"}

# Output measure name -> field of the order window record (fixed values).
WINDOW_MEASURES = {
    "order_count": "order_count",
    "order_count_late": "late_orders",
    "gmv_sum": "gmv_sum",
    "gmv_avg": "gmv_avg",
    "delivery_fee_sum": "delivery_fee_sum",
    "delivery_fee_avg": "delivery_fee_avg",
    "discount_sum": "discount_sum",
    "discount_avg": "discount_avg",
    "voucher_sum": "voucher_sum",
    "voucher_avg": "voucher_avg",
    "joker_cust_discount_sum": "joker_cust_discount_sum",
    "joker_vendor_fee_sum": "joker_vendor_fee_sum",
    "deliv_dist_m_avg": "deliv_dist_m_avg",
    "deliv_time_promised_avg": "deliv_time_promised_avg",
    "delivery_delay_avg": "delivery_delay_avg",
}

# Snapshot fields the feature table reads.
FEATURE_PATHS = (
    "restaurants.*",
    "*.first_order.order_date",
    "*.first_order.voucher",
    "*.lifetime.order_count",
    "*.lifetime.late_orders",
    "*.lifetime.gmv_sum",
)
STAGE_PATHS = (*FEATURE_PATHS, "localstores.*.deliv_dist_m_avg")

COVERAGE = (
    "coverage_vendors_qc",
    "coverage_dmart",
    "coverage_localstore",
    "coverage_convenience",
    "coverage_groceries",
    "coverage_supermarket",
    "coverage_vendors_qc_in_2000m",
    "coverage_vendors_qc_in_4000m",
    "coverage_vendors_qc_in_6000m",
    "dist_nearest_vendor_qc",
    "dist_nearest_dmart",
    "dist_nearest_localstore",
)


def _record(vertical: str, record: str, field: str) -> Column:
    return F.col(f"orders.{vertical}.{record}.{field}")


def first_qc_date() -> Column:
    """First quick-commerce order date; NULL unless both verticals were used."""
    return least_strict(
        _record("darkstores", "first_order", "order_date"), _record("localstores", "first_order", "order_date")
    )


def qc_rollup_columns() -> dict[str, Column]:
    """Dark-store and local-store figures pooled; computed on the row itself, so no self-join is needed."""

    def both(field: str) -> Column:
        return or_zero(_record("darkstores", "lifetime", field)) + or_zero(
            _record("localstores", "lifetime", field)
        )

    return {
        "first_order_date_vert_qc": first_qc_date(),
        "order_count_lifetime_vert_qc": both("order_count"),
        "order_count_late_lifetime_vert_qc": both("late_orders"),
        "gmv_avg_lifetime_vert_qc": share_of(both("gmv_sum"), both("order_count")),
        "order_count_lifetime_vert_dmart": or_zero(_record("darkstores", "lifetime", "order_count")),
    }


def daypart_share_columns() -> dict[str, Column]:
    orders = _record("restaurants", "lifetime", "order_count")
    return {
        f"order_perc_{part}_vert_rs": safe_divide(_record("restaurants", "lifetime", f"{part}_order_count"), orders)
        for part in ("weekend", "morning", "afternoon", "night")
    }


def first_order_columns() -> dict[str, Column]:
    def first(field: str) -> Column:
        return _record("restaurants", "first_order", field)

    return {
        "first_order_dayofweek_vert_rs": day_of_week(first("order_date")),
        "first_order_amt_gmv_eur_vert_rs": first("gmv"),
        "first_order_delivery_fee_vert_rs": first("delivery_fee"),
        "first_order_delivery_fee_pct_vert_rs": share_of(first("delivery_fee"), first("gmv")),
        "first_order_delivery_dist_m_vert_rs": first("delivery_distance"),
        "first_order_delivery_time_promised_vert_rs": first("delivery_time_promised"),
        "first_order_delivery_delay_vert_rs": first("delivery_delay"),
        "first_order_discount_vert_rs": first("discount"),
        "first_order_discount_pct_vert_rs": share_of(first("discount"), first("gmv")),
        "first_order_voucher_vert_rs": first("voucher"),
        "first_order_voucher_pct_vert_rs": share_of(first("voucher"), first("gmv")),
    }


def first_qc_voucher() -> Column:
    return earlier_vertical_value(
        _record("darkstores", "first_order", "order_date"),
        _record("darkstores", "first_order", "voucher"),
        _record("localstores", "first_order", "order_date"),
        _record("localstores", "first_order", "voucher"),
    )


def recency_columns(as_of: dt.date) -> dict[str, Column]:
    return {
        "days_since_first_order_vert_rs": days_since(_record("restaurants", "first_order", "order_date"), as_of),
        "days_since_first_order_vert_qc": days_since(first_qc_date(), as_of),
        "days_since_last_order_vert_rs": days_since(_record("restaurants", "last_order", "order_date"), as_of),
    }


def window_columns(vertical: str, suffix: str, measures: dict[str, str]) -> dict[str, Column]:
    return {
        f"{name}_{short}_{suffix}": _record(vertical, record, field)
        for name, field in measures.items()
        for short, record in WINDOWS.items()
    }


def late_share_columns() -> dict[str, Column]:
    return {
        f"order_pct_late_{short}_vert_rs": F.round(
            safe_divide(
                _record("restaurants", WINDOWS[short], "late_orders"),
                _record("restaurants", WINDOWS[short], "order_count"),
            ),
            2,
        )
        for short in ("l16w", "lifetime")
    }


def location_columns(local_store_suffix: bool = False) -> dict[str, Column]:
    out = {
        "cust_lat": F.col("location.last_order_location.last_order_latitude"),
        "cust_long": F.col("location.last_order_location.last_order_longitude"),
    }
    for name in COVERAGE:
        renamed = f"{name}_vert_ls" if local_store_suffix and name == "dist_nearest_localstore" else name
        out[renamed] = F.col(f"location.coverage_metrics.{name}")
    return out


def dark_store_columns() -> dict[str, Column]:
    count = _record("darkstores", "lifetime", "order_count")
    return {
        "first_order_date_vert_dmart": _record("darkstores", "first_order", "order_date"),
        "gmv_avg_lifetime_vert_dmart": share_of(_record("darkstores", "lifetime", "gmv_sum"), count),
    }


def feature_columns(as_of: dt.date, local_stores: bool = False, dark_stores: bool = False) -> dict[str, Column]:
    """Every flat column; optional groups add local-store distances and dark-store-only figures."""
    out: dict[str, Column] = {
        "first_order_date_vert_rs": _record("restaurants", "first_order", "order_date"),
        "last_order_date_vert_rs": _record("restaurants", "last_order", "order_date"),
    }
    out.update(qc_rollup_columns())
    out.update(recency_columns(as_of))
    out.update(first_order_columns())
    out["first_order_voucher_vert_qc"] = first_qc_voucher()
    out.update(daypart_share_columns())
    out.update(window_columns("restaurants", "vert_rs", WINDOW_MEASURES))
    out.update(late_share_columns())
    out.update(location_columns(local_store_suffix=local_stores))
    if local_stores:
        out.update(window_columns("localstores", "vert_ls", {"deliv_dist_m_avg": "deliv_dist_m_avg"}))
    if dark_stores:
        out.update(dark_store_columns())
    return out


def flatten(snapshot: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return snapshot.select(*KEYS, *[value.alias(name) for name, value in columns.items()])


def flatten_features(snapshot: DataFrame, as_of: dt.date, local_stores: bool = False,
                     dark_stores: bool = False) -> DataFrame:
    return flatten(snapshot, feature_columns(as_of, local_stores, dark_stores))
