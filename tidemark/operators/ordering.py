"""Exact order statistics without a global sort in one task.

Rows are first collapsed to distinct values with counts, then cut into value ranges. Running totals are
partition-local inside a range; the totals of the ranges before it come from a table with one row per
range. Range limits are approximate quantiles computed once and kept as constants: they only steer the
balance, every result is exact.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.hashing import HASH_RANGE
from tidemark.operators.lookup import quoted
from tidemark.operators.radix import order_statistics

RANGE = "__range"


ROWS_PER_RANGE = 1 << 20


def number_of_ranges(rows: int, least: int = 8) -> int:
    """As many ranges as hold about ROWS_PER_RANGE rows each, so a task stays the same size as the data grows."""
    return max(least, -(-rows // ROWS_PER_RANGE))


def range_limits(df: DataFrame, columns: Sequence[str], ranges: int | None = None) -> dict[str, list[float]]:
    """Inner limits per column, `ranges - 1` doubles each at most (one action for all columns)."""
    if ranges is None:
        ranges = number_of_ranges(df.count(), min(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))))
        ranges = max(8, ranges)
    steps = [i / ranges for i in range(1, ranges)]
    doubles = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    found = doubles.approxQuantile(list(columns), steps, 1 / (4 * ranges))
    return {c: sorted(set(v)) for c, v in zip(columns, found, strict=True)}


def with_range(df: DataFrame, column: str, limits: Sequence[float], output: str = RANGE) -> DataFrame:
    """Add the range number of a non-NULL column (binary search in the JVM)."""
    if not limits:
        return df.withColumn(output, F.lit(0.0))
    edges = [float("-inf"), *limits, float("inf")]
    probe = f"{output}_probe"
    prepared = df.withColumn(probe, F.col(column).cast("double"))
    return Bucketizer(splits=edges, inputCol=probe, outputCol=output).transform(prepared).drop(probe)


def hash_range(column: Column, ranges: int) -> Column:
    """Range number of a 32-bit hash: hashes are uniform, so equal widths are balanced."""
    return F.floor(column / F.lit(HASH_RANGE / ranges)).cast("double")


def running_totals(df: DataFrame, value: str | Sequence[str], weights: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """For every row: sum of each weight over all smaller values (`<w>_before`) and over the group (`<w>_total`).

    `df` is unique on (by, value) and carries RANGE. No task sees more than one range of one group.
    """
    order = [value] if isinstance(value, str) else list(value)
    cell = [*by, RANGE]
    per_cell = df.groupBy(*cell).agg(*[F.sum(w).alias(f"__{w}") for w in weights])
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = group.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_cell.select(
        *[F.col(c).alias(f"__o_{c}") for c in cell],
        *[F.coalesce(F.sum(f"__{w}").over(before), F.lit(0)).alias(f"__{w}_offset") for w in weights],
        *[F.sum(f"__{w}").over(group).alias(f"{w}_total") for w in weights],
    )
    match = [F.col(c).eqNullSafe(F.col(f"__o_{c}")) for c in cell]
    local = Window.partitionBy(*cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.join(offsets, match).select(
        *df.columns,
        *[
            (F.col(f"__{w}_offset") + F.coalesce(F.sum(w).over(local), F.lit(0))).alias(f"{w}_before")
            for w in weights
        ],
        *[F.col(f"{w}_total") for w in weights],
    )


def _interpolated(value: Column, probability: float) -> Column:
    """Linear interpolation between the two order statistics around position p * (n - 1)."""
    position = F.lit(float(probability)) * (F.col("n_total") - 1)
    low, high = F.floor(position), F.ceil(position)
    first, end = F.col("n_before"), F.col("n_before") + F.col("n")
    at_low = F.max(F.when((first <= low) & (low < end), value))
    at_high = F.max(F.when((first <= high) & (high < end), value))
    share = F.max(position - low)
    return at_low + (at_high - at_low) * share


def quantiles(df: DataFrame, column: str, probabilities: Mapping[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Exact interpolated quantiles, one row per group (one row in all without `by`); NULL values are skipped.

    Without groups by radix selection, which shuffles no values; with groups by value ranges.
    """
    if not by:
        found = order_statistics(df, {column: list(probabilities.values())})[column]
        return df.sparkSession.createDataFrame([tuple(found)], ", ".join(f"{quoted(name)} double" for name in probabilities))
    rows = df.select(*by, F.col(column).cast("double").alias("__v")).filter(F.col("__v").isNotNull())
    ranged = with_range(rows, "__v", range_limits(rows, ["__v"])["__v"])
    return quantiles_of_ranged(ranged, probabilities, by)


def quantiles_of_ranged(ranged: DataFrame, probabilities: Mapping[str, float], by: Sequence[str]) -> DataFrame:
    """Same, for rows (by, __v) that already carry RANGE."""
    distinct = ranged.groupBy(*by, RANGE, "__v").agg(F.count(F.lit(1)).alias("n"))
    totals = running_totals(distinct, "__v", ["n"], by)
    return totals.groupBy(*by).agg(*[_interpolated(F.col("__v"), p).alias(name) for name, p in probabilities.items()])


def dense_index(df: DataFrame, keys: Sequence[str], hashed: Column, output: str = "__index", ranges: int | None = None) -> DataFrame:
    """Number rows 0..n-1 in hash order; `keys` are unique and settle equal hashes."""
    if ranges is None:
        ranges = number_of_ranges(df.count())
    marked = df.select("*", hashed.alias("__hash"), F.lit(1).cast("bigint").alias("__one"))
    marked = marked.withColumn(RANGE, hash_range(F.col("__hash"), ranges))
    numbered = running_totals(marked, ["__hash", *keys], ["__one"])
    return numbered.select(*df.columns, F.col("__one_before").alias(output), F.col("__one_total").alias(f"{output}_n"))


def average_rank(df: DataFrame, column: str, output: str, descending: bool = True) -> DataFrame:
    """Average rank of ties, cut to an integer; NULL values get NULL."""
    from tidemark.operators.lookup import skew_safe_lookup

    sortable = -F.col(column).cast("double") if descending else F.col(column).cast("double")
    values = df.select(F.col(column).alias(column), sortable.alias("__v")).filter(F.col(column).isNotNull())
    ranged = with_range(values, "__v", range_limits(values, ["__v"])["__v"])
    distinct = ranged.groupBy(column, RANGE, "__v").agg(F.count(F.lit(1)).alias("n"))
    ranked = running_totals(distinct, "__v", ["n"]).select(
        column, "n", (F.col("n_before") + (F.col("n") + 1) / 2).cast("int").alias(output)
    )
    return skew_safe_lookup(df, ranked, [column], "n")
