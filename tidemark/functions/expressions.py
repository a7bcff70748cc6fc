"""Column -> Column building blocks. NULL stays NULL; nothing here produces NaN."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_divide(numerator: Column | str, denominator: Column | str) -> Column:
    """Floating division; NULL when either side is NULL or the divisor is zero."""
    return F.try_divide(_col(numerator).cast("double"), _col(denominator).cast("double"))


def or_zero(c: Column | str) -> Column:
    return F.coalesce(_col(c), F.lit(0))


def share_of(part: Column | str, whole: Column | str) -> Column:
    """Part of the whole, 0 when undefined."""
    return F.coalesce(safe_divide(part, whole), F.lit(0.0))


def _all_present(columns: Sequence[Column]) -> Column:
    present = F.lit(True)
    for c in columns:
        present = present & c.isNotNull()
    return present


def least_strict(*columns: Column | str) -> Column:
    """Smallest value, NULL as soon as one argument is NULL (Spark's `least` skips NULLs)."""
    cols = [_col(c) for c in columns]
    return F.when(_all_present(cols), F.least(*cols))


def greatest_strict(*columns: Column | str) -> Column:
    cols = [_col(c) for c in columns]
    return F.when(_all_present(cols), F.greatest(*cols))


def least_of_array(array: Column | str) -> Column:
    """Smallest non-NULL element."""
    return F.array_min(_col(array))


def greatest_of_array(array: Column | str) -> Column:
    return F.array_max(_col(array))


def gated(activity: Column | str, value: Column | str, otherwise: object = None) -> Column:
    """`value` only for rows with activity; NULL activity counts as none."""
    shown = F.when(or_zero(activity) != 0, _col(value))
    return shown if otherwise is None else shown.otherwise(F.lit(otherwise))


def days_since(day: Column | str, as_of: dt.date) -> Column:
    """Whole days from `day` up to and including yesterday (the day before `as_of`)."""
    yesterday = as_of - dt.timedelta(days=1)
    return F.datediff(F.lit(yesterday), _col(day)) + 1


def day_of_week(day: Column | str) -> Column:
    """1 = Sunday ... 7 = Saturday."""
    return F.dayofweek(_col(day))


def week_anchor(day: Column | str) -> Column:
    """Sunday before the Monday that starts the week of `day`."""
    return F.date_sub(F.date_trunc("week", _col(day)).cast("date"), 1)


def frequency_per_4_weeks(orders: Column | str, days: Column | str) -> Column:
    return safe_divide(orders, days) * 28


def clip(c: Column | str, low: Column | float | None = None, high: Column | float | None = None) -> Column:
    """Bound a value from either side; NULL stays NULL and a NULL bound is no bound."""
    source = _col(c)
    out = source
    if low is not None:
        out = F.greatest(out, low if isinstance(low, Column) else F.lit(low))
    if high is not None:
        out = F.least(out, high if isinstance(high, Column) else F.lit(high))
    return F.when(source.isNotNull(), out)


def earlier_vertical_value(first_a: Column | str, value_a: Column | str,
                           first_b: Column | str, value_b: Column | str) -> Column:
    """Value of whichever vertical came first; a tie goes to b; NULL unless both dates exist."""
    a, b = _col(first_a), _col(first_b)
    return F.when(a < b, _col(value_a)).when(a >= b, _col(value_b))


def clean_feature_name(name: Column | str) -> Column:
    """Drop the engineered-feature marker and any imputation suffix."""
    return F.substring_index(F.replace(_col(name), F.lit("ft_"), F.lit("")), "__fillna_", 1)


def orders_per_visit(orders: Column | str, visits: Column | str) -> Column:
    return clip(safe_divide(orders, visits), -1.0, 2.0)
