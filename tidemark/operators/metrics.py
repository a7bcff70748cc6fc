"""Model metrics as distributed aggregations; all take an optional list of grouping columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordering import quantiles, range_limits, running_totals, with_range

DIGITS = 4
LOG_LOSS_EPS = 2.220446049250313e-16  # double precision epsilon


def _safe(num: Column, den: Column) -> Column:
    return F.try_divide(num.cast("double"), den.cast("double"))


def _join(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Attach one metrics frame to another on the (nullable) group columns."""
    if not by:
        row = right.select(F.struct(*[F.col(c) for c in right.columns]).alias("r")).scalar()
        return left.select("*", *[row.getField(c).alias(c) for c in right.columns])
    renamed = right.withColumnsRenamed({c: f"__{c}" for c in by})
    match = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    return left.join(renamed, match, "left").drop(*[f"__{c}" for c in by])


def regression_metrics(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = (),
                       sample_std: bool = False) -> DataFrame:
    """mse, rmse, median absolute error, r2, mape (only for strictly positive actuals), and prediction range."""
    y, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    pairs = df.select(*by, y.alias("y"), p.alias("p")).filter(F.col("y").isNotNull() & F.col("p").isNotNull())
    y, p = F.col("y"), F.col("p")
    sse = F.sum((y - p) * (y - p))
    sst = F.var_pop(y) * F.count(y)
    mse = F.avg((y - p) * (y - p))
    main = pairs.groupBy(*by).agg(
        F.round(mse, DIGITS).alias("mse"),
        F.round(F.sqrt(mse), DIGITS).alias("rmse"),
        F.round(1 - _safe(sse, sst), DIGITS).alias("r2"),
        F.round(F.when(F.min(y) > 0, F.avg(F.abs(_safe(y - p, y)))), DIGITS).alias("mape"),
        F.count(F.when(p <= 0, 1)).alias("y_pred_lower_equal_0"),
        F.round(F.max(p), 2).alias("y_pred_max"),
        F.round(F.stddev_samp(p) if sample_std else F.stddev_pop(p), DIGITS).alias("std"),
    )
    errors = pairs.select(*by, F.abs(y - p).alias("e"))
    median = quantiles(errors, "e", {"median_ae": 0.5}, by)
    median = median.withColumn("median_ae", F.round("median_ae", DIGITS)).withColumn("mae", F.col("median_ae"))
    return _join(main, median, by)


def roc_auc(df: DataFrame, actual: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve with ties counted half; NULL when a group holds a single class."""
    rows = df.select(*by, F.col(actual).alias("y"), F.col(score).cast("double").alias("s"))
    rows = rows.filter(F.col("y").isNotNull() & F.col("s").isNotNull())
    ranged = with_range(rows, "s", range_limits(rows, ["s"])["s"])
    distinct = ranged.groupBy(*by, "__range", "s").agg(
        F.count(F.when(F.col("y") == 1, 1)).alias("pos"), F.count(F.when(F.col("y") == 0, 1)).alias("neg")
    )
    totals = running_totals(distinct, "s", ["pos", "neg"], by)
    wins = F.sum(F.col("pos").cast("double") * (F.col("neg_before") + F.col("neg") / 2))
    pairs = F.max("pos_total").cast("double") * F.max("neg_total")
    return totals.groupBy(*by).agg(F.round(_safe(wins, pairs), DIGITS).alias("roc_auc"))


def binary_metrics(df: DataFrame, actual: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """roc auc, f1, precision, recall, accuracy at the half-even rounded score, and log loss."""
    rows = df.select(*by, F.col(actual).cast("int").alias("y"), F.col(score).cast("double").alias("s"))
    rows = rows.filter(F.col("y").isNotNull() & F.col("s").isNotNull())
    y, s = F.col("y"), F.col("s")
    hit = F.bround(s).cast("int")
    tp, fp = F.count(F.when((y == 1) & (hit == 1), 1)), F.count(F.when((y == 0) & (hit == 1), 1))
    fn = F.count(F.when((y == 1) & (hit == 0), 1))
    p = F.least(F.greatest(s, F.lit(LOG_LOSS_EPS)), F.lit(1 - LOG_LOSS_EPS))
    loss = -F.when(y == 1, F.log(p)).otherwise(F.log(1 - p))
    zero = F.lit(0.0)
    main = rows.groupBy(*by).agg(
        F.round(F.coalesce(_safe(2 * tp, 2 * tp + fp + fn), zero), DIGITS).alias("f1"),
        F.round(F.coalesce(_safe(tp, tp + fp), zero), DIGITS).alias("precision"),
        F.round(F.coalesce(_safe(tp, tp + fn), zero), DIGITS).alias("recall"),
        F.round(F.avg((y == hit).cast("int")), DIGITS).alias("accuracy"),
        F.round(F.avg(loss), DIGITS).alias("log_loss"),
    )
    return _join(main, roc_auc(rows, "y", "s", by), by)


def confusion_rates(df: DataFrame, actual: str, score: str, by: Sequence[str] = (), threshold: float = 0.5) -> DataFrame:
    """Confusion counts at score > threshold and the four rates read off them."""
    rows = df.filter(F.col(actual).isNotNull() & F.col(score).isNotNull())
    positive, hit = F.col(actual) == 1, F.col(score) > threshold
    counts = rows.groupBy(*by).agg(
        F.count(F.when(~positive & ~hit, 1)).alias("tn"),
        F.count(F.when(~positive & hit, 1)).alias("fp"),
        F.count(F.when(positive & ~hit, 1)).alias("fn"),
        F.count(F.when(positive & hit, 1)).alias("tp"),
    )
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return counts.select(
        "*",
        _safe(tp, tp + fp).alias("precision"),
        _safe(tp, tp + fn).alias("recall"),
        _safe(tn, tn + fp).alias("specificity"),
        _safe(tn, tn + fn).alias("npv"),
    )


# Metric label and column, in the order of the text line (fixed values).
BINARY_TEXT = {
    "roc auc": "roc_auc",
    "f1": "f1",
    "precision": "precision",
    "recall": "recall",
    "accuracy": "accuracy",
    "log loss": "log_loss",
}
REGRESSION_TEXT = {
    "mse": "mse",
    "rmse": "rmse",
    "mae": "mae",
    "r2": "r2",
    "mape": "mape",
    "y_pred_lower_equal_0": "y_pred_lower_equal_0",
    "y_pred_max": "y_pred_max",
    "std": "std",
}


def metrics_text(labels: dict[str, str], separator: str, stamp: Column | None = None) -> Column:
    """One line: "label: 0.1234<separator>..."; metrics without a value are left out."""
    parts = [
        F.when(F.col(c).isNotNull(), F.format_string(f"{label}: %.4f{separator}", F.col(c).cast("double")))
        for label, c in labels.items()
    ]
    return F.concat_ws("", *parts, *([stamp.cast("string")] if stamp is not None else []))


def binary_text(stamp: Column | None = None) -> Column:
    return metrics_text(BINARY_TEXT, " | ", stamp)


def regression_text(stamp: Column | None = None) -> Column:
    return metrics_text(REGRESSION_TEXT, "\t", stamp)


def metrics_table(per_target: dict[str, DataFrame]) -> DataFrame:
    """One row per target; columns a target does not have are NULL."""
    out: DataFrame | None = None
    for target, frame in per_target.items():
        row = frame.select(F.lit(target).alias("target"), "*")
        out = row if out is None else out.unionByName(row, allowMissingColumns=True)
    if out is None:
        raise ValueError("no metrics to stack")
    return out


def cluster_evaluation(df: DataFrame, cluster: str, actual: str, score: str) -> DataFrame:
    """Centre, mean score and recall per cluster; recall only where both classes occur."""
    y, hit = F.col(actual), F.bround(F.col(score)).cast("int")
    n_pos, n_neg = F.count(F.when(y == 1, 1)), F.count(F.when(y == 0, 1))
    recall = _safe(F.count(F.when((y == 1) & (hit == 1), 1)), n_pos)
    return df.groupBy(cluster).agg(
        F.round(F.avg("cust_lat"), 6).alias("cust_lat"),
        F.round(F.avg("cust_long"), 6).alias("cust_long"),
        F.round(F.avg(score), 6).alias("mean_score"),
        F.when((n_pos > 0) & (n_neg > 0), F.round(recall, DIGITS)).alias("recall"),
    )
