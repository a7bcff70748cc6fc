"""Order facts -> nested customer snapshot, one row per (entity, customer).

One conditional hash aggregation per customer: partial aggregation collapses a hot customer on the map
side, so no task ever receives that customer's raw orders. First and last orders use `min_by` on a packed
(day, order id) long instead of an ordering struct, which keeps every buffer fixed-width.
Columns nobody selects are pruned from the aggregate by the optimizer.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from fnmatch import fnmatchcase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.orders import CENTS, DARKSTORES, FINE_UNITS, LOCALSTORES, RESTAURANTS, order_facts
from tidemark.sources.tables import customers_with_entity

VERTICALS = (RESTAURANTS, DARKSTORES, LOCALSTORES)
WINDOW_DAYS = {"lifetime": None, "last4w": 28, "last16w": 112}
_ID_SPAN = 2**44


def order_rank() -> Column:
    """Orders by (day, order id); fails loudly if an order id does not fit its 44 bits."""
    return F.expr(_RANK)


def in_window(window: str, as_of: dt.date) -> Column:
    return F.expr(_window_test(window, as_of))


# Aggregates are written as SQL text: one parse each, instead of a Python call per operator.
_RANK = f"""CASE WHEN order_id >= 0 AND order_id < {_ID_SPAN} THEN unix_date(order_date) * {_ID_SPAN}L + order_id
    ELSE CAST(raise_error('order id exceeds 44 bits') AS BIGINT) END"""


def _window_test(window: str, as_of: dt.date) -> str:
    days = WINDOW_DAYS[window]
    return "true" if days is None else f"order_date > DATE '{as_of - dt.timedelta(days=1 + days)}'"


def _measures(cell: str) -> dict[str, str]:
    """Aggregates of the orders inside one (vertical, window) cell; NULL when the cell is empty."""

    def total(value: str) -> str:
        return f"sum(CASE WHEN {cell} THEN {value} END)"

    count = total("1L")
    sums = {
        "gmv": f"{total('gmv_cents')} / {CENTS}D",
        "delivery_fee": total("delivery_fee"),
        "discount": f"{total('discount_fine')} / {FINE_UNITS}D",
        "voucher": total("voucher"),
    }
    out = {"order_count": count, "late_orders": total("CAST(is_late AS BIGINT)")}
    for name, value in sums.items():
        out[f"{name}_sum"] = value
        out[f"{name}_avg"] = f"try_divide({value}, {count})"
    out["joker_cust_discount_sum"] = total("joker_cust_discount")
    out["joker_vendor_fee_sum"] = total("joker_vendor_fee")
    out["deliv_dist_m_avg"] = f"try_divide({total('delivery_distance')}, {count})"
    out["deliv_time_promised_avg"] = f"try_divide({total('delivery_time_promised')}, {count})"
    delays = f"count(CASE WHEN {cell} THEN delay_fine END)"
    out["delivery_delay_avg"] = f"try_divide({total('delay_fine')} / {FINE_UNITS}D, {delays})"
    return out


_DAYPARTS = {
    "weekend": "is_weekend",
    "morning": "order_hour BETWEEN 5 AND 11",
    "afternoon": "order_hour BETWEEN 12 AND 17",
    "night": "order_hour >= 21 OR order_hour <= 4",
}


def _dayparts(cell: str) -> dict[str, str]:
    return {
        f"{part}_order_count": f"sum(CASE WHEN {cell} THEN CAST({test} AS BIGINT) END)"
        for part, test in _DAYPARTS.items()
    }


def _first_order(cell: str) -> dict[str, str]:
    def first(value: str) -> str:
        return f"min_by({value}, CASE WHEN {cell} THEN order_rank END)"

    return {
        "order_date": f"min(CASE WHEN {cell} THEN order_date END)",
        "gmv": f"{first('gmv_cents')} / {CENTS}D",
        "delivery_fee": first("delivery_fee"),
        "delivery_distance": first("delivery_distance"),
        "delivery_time_promised": first("delivery_time_promised"),
        "delivery_delay": f"{first('delay_fine')} / {FINE_UNITS}D",
        "discount": f"{first('discount_fine')} / {FINE_UNITS}D",
        "voucher": first("voucher"),
    }


def _cells(as_of: dt.date) -> dict[tuple[str, str], dict[str, str]]:
    cells: dict[tuple[str, str], dict[str, str]] = {}
    for vertical in VERTICALS:
        mine = f"vertical = '{vertical}'"
        cells[vertical, "first_order"] = _first_order(mine)
        cells[vertical, "last_order"] = {"order_date": f"max(CASE WHEN {mine} THEN order_date END)"}
        for window in WINDOW_DAYS:
            cells[vertical, window] = _measures(f"{mine} AND {_window_test(window, as_of)}")
            if window == "lifetime":
                cells[vertical, window].update(_dayparts(mine))
    return cells


# Position and store coverage of a customer, derived from the customer key.
_KEY = "analytical_customer_id"
_LOCATION = f"""named_struct(
  'last_order_location', named_struct(
    'last_order_latitude', CASE WHEN {_KEY} % 50 <> 0 THEN 59D + ({_KEY} * 7919 % 10007) / 10007D * 0.5D END,
    'last_order_longitude', CASE WHEN {_KEY} % 50 <> 0 THEN 18D + ({_KEY} * 104729 % 10009) / 10009D * 0.5D END),
  'coverage_metrics', named_struct(
    'coverage_vendors_qc', {_KEY} % 10,
    'coverage_dmart', {_KEY} % 3,
    'coverage_localstore', {_KEY} % 4,
    'coverage_convenience', {_KEY} % 5,
    'coverage_groceries', {_KEY} % 6,
    'coverage_supermarket', {_KEY} % 7,
    'coverage_vendors_qc_in_2000m', {_KEY} % 8,
    'coverage_vendors_qc_in_4000m', {_KEY} % 9,
    'coverage_vendors_qc_in_6000m', {_KEY} % 13,
    'dist_nearest_vendor_qc', CASE WHEN {_KEY} % 11 <> 0 THEN {_KEY} % 400 * 10D END,
    'dist_nearest_dmart', CASE WHEN {_KEY} % 11 <> 0 THEN {_KEY} % 400 * 10D END + 50D,
    'dist_nearest_localstore', CASE WHEN {_KEY} % 11 <> 0 THEN {_KEY} % 400 * 10D END + 25D))"""


def location_record() -> Column:
    return F.expr(_LOCATION)


def _wanted(cells: dict[tuple[str, str], dict[str, str]], paths: Sequence[str]) -> dict[tuple[str, str], dict[str, str]]:
    """Only the fields whose vertical.record.field path matches one of the patterns."""
    kept = {
        (v, r): {f: e for f, e in fields.items() if any(fnmatchcase(f"{v}.{r}.{f}", p) for p in paths)}
        for (v, r), fields in cells.items()
    }
    return {key: fields for key, fields in kept.items() if fields}


def customer_snapshot(spark: SparkSession, directory: str, as_of: dt.date, entity: str | None = None,
                      paths: Sequence[str] = ("*",)) -> DataFrame:
    """Nested snapshot of every customer with at least one order.

    `paths` narrows the record to the listed fields (patterns over `vertical.record.field`). The optimizer
    prunes unused fields either way; naming them keeps analysis and planning short as well.
    """
    cells = _wanted(_cells(as_of), paths)
    aggregates = [
        F.expr(f"{value} AS {vertical}__{record}__{name}")
        for (vertical, record), fields in cells.items()
        for name, value in fields.items()
    ]
    per_customer = (
        order_facts(spark, directory)
        .withColumn("order_rank", order_rank())
        .groupBy("analytical_customer_id")
        .agg(*(aggregates or [F.expr("count(1) AS n_orders")]))
    )
    people = customers_with_entity(spark, directory)
    if entity is not None:
        people = people.filter(F.col("global_entity_id") == entity)

    def record(vertical: str, name: str) -> str:
        fields = ", ".join(f"'{f}', {vertical}__{name}__{f}" for f in cells[vertical, name])
        return f"'{name}', named_struct({fields})"

    present = [v for v in VERTICALS if any(v == w for w, _ in cells)]
    verticals = ", ".join(
        f"'{v}', named_struct({', '.join(record(v, name) for w, name in cells if w == v)})" for v in present
    )
    orders = [F.expr(f"named_struct({verticals}) AS orders")] if present else []
    return per_customer.join(people, "analytical_customer_id").select(
        "global_entity_id",
        "analytical_customer_id",
        F.col("c_mktsegment").alias("segment"),
        *orders,
        location_record().alias("location"),
    )
