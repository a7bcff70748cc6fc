"""Category encoders. Value counts for all columns come from one aggregation and are kept durable, so the
wide input is read twice: once to count, once to encode."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.lookup import skew_safe_lookup
from tidemark.operators.ordering import RANGE, running_totals
from tidemark.session import durable

RARE = "OTHER_HIGH_CARDINALITY"


def _counted(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.inline(pairs)).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))


def value_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, value as text, rows) for every non-NULL value of every column."""
    return durable(_counted(df, columns).filter(F.col("value").isNotNull()))


def _of(values: DataFrame, column: str) -> DataFrame:
    return values.filter(F.col("feature") == column)


def _with_counts(df: DataFrame, values: DataFrame, column: str, output: str) -> DataFrame:
    key = "__value"
    dim = _of(values, column).select(F.col("value").alias(key), "n", F.col("n").alias(output))
    return skew_safe_lookup(df.withColumn(key, F.col(column).cast("string")), dim, [key], "n").drop(key)


def bin_rare(df: DataFrame, columns: Sequence[str], min_count: int = 20) -> tuple[DataFrame, list[str]]:
    """Values with fewer than `min_count` rows become one bin; NULL stays NULL."""
    values, names = value_table(df, columns), []
    for c in columns:
        name = f"{c}__min_count_{min_count}"
        counted = _with_counts(df, values, c, "__n")
        text = F.col(c).cast("string")
        df = counted.withColumn(name, F.when(F.col("__n") < min_count, F.lit(RARE)).otherwise(text)).drop("__n")
        names.append(name)
    return df, names


def _scaled(values: DataFrame, column: str, counts: Column, scaler: str) -> Column:
    """Scale the row-level counts with statistics taken from the value table (each value weighs n rows)."""
    n = F.col("n").cast("double")
    rows = _of(values, column)
    if scaler == "minmax":
        ends = rows.agg(F.struct(F.min(n).alias("lo"), F.max(n).alias("hi")).alias("s")).scalar()
        span = ends.getField("hi") - ends.getField("lo")
        return F.coalesce(F.try_divide(counts - ends.getField("lo"), span), F.when(counts.isNotNull(), 0.0))
    if scaler == "standard":
        stats = rows.agg(
            F.struct((F.sum(n * n) / F.sum(n)).alias("mean"), (F.sum(n * n * n) / F.sum(n)).alias("square")).alias("s")
        ).scalar()
        mean = stats.getField("mean")
        deviation = F.sqrt(stats.getField("square") - mean * mean)
        return F.coalesce(F.try_divide(counts - mean, deviation), F.when(counts.isNotNull(), 0.0))
    raise ValueError(f"unknown scaler {scaler!r}: use 'standard' or 'minmax'")


def count_encode(df: DataFrame, columns: Sequence[str], scaler: str | None = None,
                 drop: bool = False) -> tuple[DataFrame, list[str]]:
    """Rows per value as a number, optionally scaled; NULL stays NULL."""
    values, names = value_table(df, columns), []
    for c in columns:
        name = f"ft_{c}__count" + (f"_scaled_{scaler}" if scaler else "")
        df = _with_counts(df, values, c, name)
        if scaler:
            df = df.withColumn(name, _scaled(values, c, F.col(name).cast("double"), scaler))
        names.append(name)
    return (df.drop(*columns) if drop else df), names


def label_table(df: DataFrame, column: str) -> DataFrame:
    """(value, rows, 0-based position in sorted order), for any number of values.

    Distinct values are range-partitioned and stored with their partition number, so positions are a
    partition-local count plus the sizes of the partitions before.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    ranged = durable(
        counts.repartitionByRange(column).select(
            column, "n", F.spark_partition_id().cast("double").alias(RANGE), F.lit(1).cast("bigint").alias("one")
        )
    )
    return running_totals(ranged, column, ["one"]).select(column, "n", F.col("one_before").alias("label"))


def label_encode(df: DataFrame, columns: Sequence[str], drop: bool = False) -> tuple[DataFrame, list[str]]:
    """Position of the value among the sorted distinct values; NULL stays NULL."""
    names = []
    for c in columns:
        name = f"ft_{c}__label"
        df = skew_safe_lookup(df, label_table(df, c).withColumnRenamed("label", name), [c], "n")
        names.append(name)
    return (df.drop(*columns) if drop else df), names


def one_hot(df: DataFrame, columns: Sequence[str], min_share: float = 0.03) -> tuple[DataFrame, list[str]]:
    """0/1 columns for frequent values (share of *all* rows); NULL gives zeros everywhere.

    At most 1 / min_share values of a column are frequent, however many it has, so the driver sees a bounded list.
    Running it twice replaces the columns instead of adding them again.
    """
    if min_share <= 0:
        raise ValueError("min_share bounds the number of columns and must be positive")
    counted = durable(_counted(df, columns))
    frequent = counted.groupBy("feature").agg(F.sum("n").alias("total")).join(counted, "feature")
    frequent = frequent.filter(F.col("value").isNotNull() & (F.col("n") / F.col("total") >= min_share))
    kept = sorted((r["feature"], r["value"]) for r in frequent.collect())
    new = {
        f"ft_{c}__one_hot__{v}": F.coalesce((F.col(c).cast("string") == v).cast("int"), F.lit(0)) for c, v in kept
    }
    return df.drop(*new).select("*", *[e.alias(name) for name, e in new.items()]), list(new)
