"""Choosing columns by schema; nothing here reads data."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KINDS = {
    "number": (T.NumericType,),
    "int": (T.IntegralType,),
    "float": (T.FractionalType,),
    "string": (T.StringType,),
    "date": (T.DateType, T.TimestampType, T.TimestampNTZType),
}


def select_features(df: DataFrame, dtype: str | None = "number", contains: Iterable[str] = (),
                    not_contains: Iterable[str] = (), sort: bool = True) -> list[str]:
    """Column names of a kind that contain all of one list and none of the other."""
    kinds = None if dtype is None else _KINDS[dtype]
    names = [
        f.name
        for f in df.schema.fields
        if (kinds is None or isinstance(f.dataType, kinds))
        and all(part in f.name for part in contains)
        and not any(part in f.name for part in not_contains)
    ]
    return sorted(names) if sort else names


def name_prefixes(names: Iterable[str], markers: Sequence[str] = ("past", "nv_", "rs_")) -> list[str]:
    """Distinct name beginnings, cut at the first of the markers (the default ones are fixed values)."""
    out = set()
    for name in names:
        for marker in markers:
            name = name.split(marker)[0]
        out.add(name)
    return sorted(out)


def blend(weights: dict[str, float]) -> Column:
    """Weighted sum of prediction columns."""
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + F.col(name) * weight
    return total


# Feature groups of the final list (fixed values).
GEO_FEATURES = (
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
BEHAVIOUR_FEATURES = (
    "order_rate_online_payment_l04w",
    "visit_count_l12w",
    "visit_count_l04w_vs_l12w",
    "visit_session_dur_sum_l04w",
    "visit_session_dur_avg_l04w",
    "visit_interact_speed_avg_l04w",
    "visit_cart_abandon_rate_l04w",
    "visit_search_fail_rate_l04w",
    "visit_voucher_error_rate_l04w",
    "rating_avg_l04w",
    "aos_score_last",
    "aos_rating_last",
    "ccc_sessions_l04w",
)


def final_features(df: DataFrame, local_stores: bool = False, geo: bool = True,
                   extra: Sequence[str] = ()) -> list[str]:
    """Continuous restaurant columns, one-hot columns, geography, behaviour (and local-store columns)."""
    names = select_features(df, "number", contains=["vert_rs"], not_contains=["target"])
    names += select_features(df, None, contains=["one_hot"])
    names += [c for c in GEO_FEATURES if geo and c in df.columns]
    names += [c for c in BEHAVIOUR_FEATURES if c in df.columns]
    if local_stores:
        names += select_features(df, "number", contains=["vert_ls"])
    names += list(extra)
    return list(dict.fromkeys(names))
