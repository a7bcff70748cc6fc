"""Row filters and populations. All predicates are plain columns, so they reach the scan when they can."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def active_cohort(first: Column, last: Column, as_of: dt.date, settle_days: int = 14,
                  active_days: int = 180) -> Column:
    """First order long enough ago to allow a conversion, last order recent enough to be active."""
    yesterday = as_of - dt.timedelta(days=1)
    return (first < F.lit(yesterday - dt.timedelta(days=settle_days))) & (
        last > F.lit(yesterday - dt.timedelta(days=active_days))
    )


def conversion_cohort(first: Column, last: Column, dark_first: Column, as_of: dt.date, settle_days: int = 90,
                      active_days: int = 270, strict: bool = False) -> Column:
    """Customers who moved on to dark stores, or have not (yet).

    By default customers without a dark-store order bypass the date window; `strict` applies the window
    to both groups.
    """
    window = active_cohort(first, last, as_of, settle_days, active_days)
    moved = (first < last) & (last < dark_first)
    open_ = dark_first.isNull()
    return window & (moved | open_) if strict else (window & moved) | open_


def in_entity(entity: str) -> Column:
    return F.col("global_entity_id") == entity


def _below_or_missing(c: Column, limit: float) -> Column:
    return (c < limit) | c.isNull()


def within_usual_range(max_frequency: float = 40, max_orders_16w: float = 100, require_coverage: bool = True) -> Column:
    """Outlier filter; rows whose measure is missing stay in."""
    keep = (
        (F.col("order_count_lifetime_vert_rs") > 0)
        & _below_or_missing(F.col("order_freq_4w_vert_qc"), max_frequency)
        & _below_or_missing(F.col("order_count_l16w_vert_rs"), max_orders_16w)
    )
    return keep & (F.col("coverage_vendors_qc") > 0) if require_coverage else keep


def with_coordinates(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["cust_lat", "cust_long"])


def geo_box(lat_from: float | None = None, lat_to: float | None = None, long_from: float | None = None,
            long_to: float | None = None) -> Column:
    """Open box on either axis; a missing bound does not restrict."""
    tests = [
        test
        for bound, test in (
            (lat_from, lambda b: F.col("cust_lat") > b),
            (lat_to, lambda b: F.col("cust_lat") < b),
            (long_from, lambda b: F.col("cust_long") > b),
            (long_to, lambda b: F.col("cust_long") < b),
        )
        if bound is not None
        for test in [test(bound)]
    ]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def value_band(c: Column, low: float, high: float) -> Column:
    return c.between(low, high)


def score_band(score: Column, above: float, below: float | None = None) -> Column:
    return score > above if below is None else (score > above) & (score < below)


def organic_population(target: Column) -> Column:
    """Train where the target is known, predict where it is not."""
    return F.when(target.isNotNull(), "train").otherwise("predict")


def value_population(orders: Column, first: Column, target: Column, until: dt.date, settle_days: int = 28) -> Column:
    """Train on settled repeat customers, predict for the rest; rows in neither group get NULL."""
    settled = first < F.lit(until - dt.timedelta(days=settle_days))
    return F.when((orders > 1) & settled & target.isNotNull(), "train").when(orders <= 1, "predict")


def missing_value_rows(df: DataFrame, count: str, value: str) -> DataFrame:
    """Rows that have orders but no average order value."""
    return df.filter((F.col(count) > 0) & F.col(value).isNull())


def require_values(df: DataFrame, count: str, value: str) -> DataFrame:
    """Pass rows through; the job fails on the first row that has orders but no value."""
    broken = (F.col(count) > 0) & F.col(value).isNull()
    message = F.lit(f"missing {value} for a customer with orders")
    return df.withColumn(value, F.when(broken, F.raise_error(message).cast("double")).otherwise(F.col(value)))
