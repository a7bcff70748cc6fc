"""Descriptive statistics. Every function is one or two aggregations over the whole input."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordering import quantiles
from tidemark.operators.radix import order_statistics
from tidemark.session import durable


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows and share per value (NULL included)."""
    counts = durable(df.groupBy(column).agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select(column, "n", (F.col("n") / total).alias("share"))


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact distinct non-NULL values per column, one row per column.

    (column, value) pairs are collapsed first, so the count itself runs on distinct pairs only.
    """
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in columns])
    )
    return (
        df.select(pairs.alias("p"))
        .select("p.*")
        .groupBy("feature", "value")
        .agg(F.lit(1).alias("one"))
        .groupBy("feature")
        .agg(F.count("value").alias("n_distinct"))
    )


def with_baseline(df: DataFrame, target: str, output: str, where: Column | None = None) -> DataFrame:
    """Mean of the target (over `where`) as a constant prediction on every row."""
    source = df if where is None else df.filter(where)
    return df.withColumn(output, source.agg(F.avg(target)).scalar())


def crosstab(df: DataFrame, actual: str, score: str, key: str) -> DataFrame:
    """Keys per actual class and half-even rounded score (0 or 1)."""
    rounded = F.bround(F.col(score)).cast("int")
    return (
        df.filter(F.col(actual).isNotNull())
        .groupBy(F.col(actual).alias("actual"))
        .agg(
            F.count(F.when(rounded == 0, F.col(key))).alias("predicted_0"),
            F.count(F.when(rounded == 1, F.col(key))).alias("predicted_1"),
        )
    )


DESCRIBE_PROBABILITIES = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99}


def describe(df: DataFrame, columns: Sequence[str], probabilities: Mapping[str, float] = DESCRIBE_PROBABILITIES,
             digits: int = 6) -> DataFrame:
    """count, mean, sample deviation, min, exact percentiles and max; one row per column."""
    numbers = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    cuts = order_statistics(numbers, {c: list(probabilities.values()) for c in columns})
    moments = numbers.agg(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("feature"),
                    F.count(c).alias("count"),
                    F.avg(c).alias("mean"),
                    F.stddev_samp(c).alias("std"),
                    F.min(c).alias("min"),
                    F.max(c).alias("max"),
                    *[F.lit(v).cast("double").alias(name) for name, v in zip(probabilities, cuts[c], strict=True)],
                )
                for c in columns
            ]
        ).alias("rows")
    ).select(F.inline("rows"))
    rounded = [F.round(c, digits).alias(c) for c in ("mean", "std", "min", *probabilities, "max")]
    return moments.select("feature", "count", *rounded)


def column_profile(df: DataFrame) -> DataFrame:
    """Type, row count and NULL share of every column in one pass."""
    fields = [
        F.struct(
            F.lit(f.name).alias("feature"),
            F.lit(f.dataType.simpleString()).alias("type"),
            F.count(F.lit(1)).alias("n_rows"),
            F.count(F.when(F.col(f.name).isNull(), 1)).alias("n_null"),
        )
        for f in df.schema.fields
    ]
    long = df.agg(F.array(*fields).alias("rows")).select(F.inline("rows"))
    return long.withColumn("isnull_pct", F.round(F.try_divide(F.col("n_null") * 100.0, F.col("n_rows")), 4))


def _span(low: float | None, high: float | None) -> tuple[float, float]:
    """Histogram limits; a single value gets a span of 1 around it."""
    if low is None or high is None:
        return 0.0, 1.0
    return (low - 0.5, high + 0.5) if low == high else (low, high)


def histogram(df: DataFrame, columns: Sequence[str], bins: int, by: str | None = None) -> DataFrame:
    """Equal-width bins shared by all columns and groups; the last bin includes the maximum.

    Bins without rows are listed with zero. `density` integrates to 1 within each column (and group).
    A constant input gets a width of 1 around the value.
    """
    keys = ["feature"] if by is None else ["feature", by]
    group = [] if by is None else [F.col(by)]
    long = df.select(
        *group,
        F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns])),
    ).filter(F.col("v").isNotNull())
    ends = long.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    lo, hi = _span(ends["lo"], ends["hi"])
    width = (hi - lo) / bins
    number = F.least(F.floor((F.col("v") - lo) / width), F.lit(bins - 1)).cast("int")
    counted = long.groupBy(*keys, number.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    # groups x bins rows: one small array per group, filled and unrolled again
    per_group = counted.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("found"), F.sum("n").alias("n_all")
    )
    full = per_group.select(*keys, "found", "n_all", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    n = F.coalesce(F.try_element_at("found", F.col("bin")), F.lit(0).cast("bigint"))
    return full.select(
        *keys,
        "bin",
        F.round(F.col("bin") * width + lo, 6).alias("bin_from"),
        n.alias("n"),
        F.round(n / (F.col("n_all") * width), 9).alias("density"),
    )


def clip_at_quantile(df: DataFrame, column: str, low: float, probability: float, output: str) -> DataFrame:
    """Clip to [low, quantile]; NULL stays NULL."""
    from tidemark.functions.expressions import clip

    high = quantiles(df, column, {"q": probability}).first()["q"]
    return df.withColumn(output, clip(column, low, high))


def group_summary(df: DataFrame, target: str, columns: Sequence[str]) -> DataFrame:
    """Mean, minimum and maximum of each column per target value: a quick look for leakage."""
    aggs = []
    for c in columns:
        aggs += [
            F.round(F.avg(c), 6).alias(f"{c}_mean"),
            F.min(c).alias(f"{c}_min"),
            F.max(c).alias(f"{c}_max"),
        ]
    return df.groupBy(target).agg(*aggs)


def joint_regression(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least squares of y on x over rows where both are present."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    both = df.filter(a.isNotNull() & b.isNotNull())
    return both.agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.regr_slope(b, a), 6).alias("slope"),
        F.round(F.regr_intercept(b, a), 4).alias("intercept"),
        F.round(F.regr_r2(b, a), 6).alias("r2"),
        F.round(F.corr(a, b), 6).alias("corr"),
    )


def confidence_interval(df: DataFrame, column: str, by: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """Mean plus and minus 1.96 population deviations over the root of n."""
    half = 1.96 * F.stddev_pop(column) / F.sqrt(F.count(column))
    return df.groupBy(*by).agg(
        F.count(column).alias("runs"),
        F.round(F.avg(column), digits).alias("mean"),
        F.round(F.avg(column) - half, digits).alias("ci_low"),
        F.round(F.avg(column) + half, digits).alias("ci_high"),
    )


BAND_EDGES = (0.0, 0.3, 0.6, 0.9, 1.0)


def quantile_band_histogram(df: DataFrame, band_column: str, columns: Sequence[str], bins: int = 30,
                            edges: Sequence[float] = BAND_EDGES) -> DataFrame:
    """Histograms of `columns` inside each open quantile band of `band_column` (band limits excluded)."""
    q = list(quantiles(df, band_column, {f"q{i}": p for i, p in enumerate(edges)}).first())
    v = F.col(band_column).cast("double")
    band = F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        band = F.when((v > F.lit(q[i])) & (v < F.lit(q[i + 1])), F.lit(i)).otherwise(band)
    long = df.select(
        band.alias("band"),
        F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns])),
    ).filter(F.col("band").isNotNull() & F.col("v").isNotNull())
    # one row per band, len(edges) - 1 at most
    number = F.lit(None).cast("int")
    for r in long.groupBy("band").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).collect():
        lo, hi = _span(r["lo"], r["hi"])
        place = F.least(F.floor((F.col("v") - lo) / ((hi - lo) / bins)), F.lit(bins - 1)).cast("int")
        number = F.when(F.col("band") == r["band"], place).otherwise(number)
    return long.groupBy("band", "feature", number.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def tercile_segments(df: DataFrame, score: str, target: str) -> DataFrame:
    """low / mid / high by the .333 and .666 score quantiles of the customers who did not convert."""
    open_ = df.filter(F.col(target) == 0)
    p33, p66 = (F.lit(v) for v in quantiles(open_, score, {"p33": 0.333, "p66": 0.666}).first())
    segment = F.when(F.col(score) <= p33, "low").when(F.col(score) <= p66, "mid").when(F.col(score).isNotNull(), "high")
    return df.select("*", F.round(p33, 9).alias("p33"), F.round(p66, 9).alias("p66"), segment.alias("segment"))
