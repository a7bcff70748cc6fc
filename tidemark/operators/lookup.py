"""Attach one row per key to many rows without letting a hot key pile up in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is hot when it holds at least 1/HOT_PARTS of all rows, so there are at most HOT_PARTS hot keys:
# the broadcast below is bounded by construction, whatever the data size.
HOT_PARTS = 1000


def quoted(name: str) -> str:
    """A column name that may hold dots."""
    return f"`{name}`"


def skew_safe_lookup(df: DataFrame, dim: DataFrame, on: Sequence[str], weight: str) -> DataFrame:
    """Left join `df` to `dim` (unique on `on`, `weight` = rows of `df` per key).

    Hot keys are answered from a broadcast of at most HOT_PARTS rows. All other rows meet `dim` in an
    ordinary equi-join; rows that are already answered, or have no key, carry a per-row salt and spread
    evenly instead of meeting in the NULL partition. Nothing is dropped and nothing is duplicated.
    """
    values = [c for c in dim.columns if c not in on and c != weight]
    total = dim.agg(F.sum(weight)).scalar()
    record = F.struct(*[F.col(quoted(c)) for c in values])
    hot = dim.filter(F.col(weight) * HOT_PARTS >= total).select(
        *[F.col(k).alias(f"__hot_{k}") for k in on], record.alias("__hot")
    )
    cold = dim.select(
        *[F.col(k).alias(f"__cold_{k}") for k in on], F.lit(0).cast("bigint").alias("__salt_0"), record.alias("__cold")
    )
    hot_match = [F.col(k) == F.col(f"__hot_{k}") for k in on]
    marked = df.join(F.broadcast(hot), hot_match, "left").drop(*[f"__hot_{k}" for k in on])
    open_ = F.col("__hot").isNull()
    for k in on:
        open_ = open_ & F.col(k).isNotNull()
    keyed = marked.select(
        "*",
        *[F.when(open_, F.col(k)).alias(f"__key_{k}") for k in on],
        F.when(open_, F.lit(0).cast("bigint")).otherwise(F.xxhash64(*[quoted(c) for c in df.columns]).bitwiseOR(F.lit(1).cast("bigint"))).alias("__salt"),
    )
    match = [F.col(f"__key_{k}") == F.col(f"__cold_{k}") for k in on] + [F.col("__salt") == F.col("__salt_0")]
    joined = keyed.join(cold, match, "left")
    found = F.coalesce("__hot", "__cold")
    return joined.select(*[quoted(c) for c in df.columns], *[found.getField(c).alias(c) for c in values])
