"""Weekly scoring run: targets, models, out-of-fold scores, metrics and the three published tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expressions import clean_feature_name
from tidemark.functions.hashing import portable_hash
from tidemark.operators import boosting, cohorts, columns, explain, metrics, models, sampling, targets
from tidemark.operators.flatten import KEYS
from tidemark.params import RunParams
from tidemark.operators.stats import with_baseline
from tidemark.session import durable, scratch_run
from tidemark.sources.writers import prediction_export, save_partitioned

ID = "analytical_customer_id"


@dataclass(frozen=True)
class Task:
    """One target: how its rows are split into training and prediction, and which model scores them."""

    target: str
    binary: bool
    params: models.TreeParams
    population: Column | None = None
    floor: float | None = None
    count: str | None = None  # customers with such orders must have a target value
    weights: tuple[float, ...] = (1.0,)  # of the models that make up the final score

    @property
    def short(self) -> str:
        return self.target.removeprefix("target_")

    @property
    def final(self) -> str:
        return f"preds_{self.short}_final"


def quick_commerce_tasks(run: RunParams, quick: models.TreeParams | None = None) -> list[Task]:
    count, first = F.col("order_count_lifetime_vert_qc"), F.col("first_order_date_vert_qc")

    def value_rows(target: str) -> Column:
        return cohorts.value_population(count, first, F.col(target), run.date_until)

    return [
        Task(targets.GENERAL, True, quick or models.GENERAL_OOF),
        Task(targets.ORGANIC, True, quick or models.ORGANIC_OOF, cohorts.organic_population(F.col(targets.ORGANIC))),
        Task(targets.FREQUENCY, False, quick or models.VALUE, value_rows(targets.FREQUENCY), floor=0.01),
        Task(targets.ORDER_VALUE, False, quick or models.VALUE, value_rows(targets.ORDER_VALUE), count="order_count_lifetime_vert_qc"),
    ]


def dark_store_tasks(run: RunParams, quick: models.TreeParams | None = None) -> list[Task]:
    """Variant with two of the four targets, on dark-store columns."""
    value_rows = cohorts.value_population(
        F.col("order_count_lifetime_vert_dmart"),
        F.col("first_order_date_vert_dmart"),
        F.col(targets.ORDER_VALUE_DARK),
        run.date_until,
    )
    return [
        Task(targets.GENERAL_DARK, True, quick or models.GENERAL_OOF),
        Task(targets.ORDER_VALUE_DARK, False, quick or models.VALUE, value_rows, count="order_count_lifetime_vert_dmart"),
    ]


def benchmark(rows: DataFrame, target: str, binary: bool) -> DataFrame:
    """One-row metrics of the mean as a prediction, over the rows that have the target."""
    known = durable(rows.filter(F.col(target).isNotNull()).select(target))
    constant = durable(with_baseline(known, target, "preds_benchmark"))
    return (metrics.binary_metrics if binary else metrics.regression_metrics)(constant, target, "preds_benchmark")


FOLDS = 5


def score_tasks(df: DataFrame, tasks: Sequence[Task], features: Sequence[str]) -> dict[str, tuple[DataFrame, DataFrame, DataFrame, DataFrame]]:
    """By target: (keys + final score, one-row metrics, one-row benchmark metrics, importance table).

    The models of all tasks (five folds of each classifier, one regressor with early stopping) are learned in the same
    jobs from one stored frame, then the refits of all regressors. Fails when a customer has orders but no value of a
    target.
    """
    for task in tasks:
        if task.count is not None:
            df = cohorts.require_values(df, task.count, task.target)
    keys = list(KEYS)
    roles = {t.target: f"__population_{i}" for i, t in enumerate(tasks)}
    for t in tasks:
        df = df.withColumn(roles[t.target], F.lit("train") if t.population is None else t.population)
    fold = (portable_hash(41, *keys) % FOLDS).cast("int").alias("fold")
    vectors, names = models.assemble(df, features, [*keys, *roles, *roles.values(), fold, (sampling.split_label(keys) == "valid").alias("is_valid")])
    vectors = durable(vectors)

    def trains(t: Task) -> Column:
        return (F.col(roles[t.target]) == "train") & F.col(t.target).isNotNull()

    fits, owner = [], []
    for t in tasks:
        role = F.when(F.col("is_valid"), boosting.STOPS).otherwise(boosting.TRAINS)
        each = models.fold_roles(trains(t), F.col("fold"), FOLDS) if t.binary else [F.when(trains(t), role)]
        fits += [boosting.Fit(F.col(t.target), r, t.binary, t.params) for r in each]
        owner += [t.target] * len(each)
    found = boosting.boost(vectors, fits, models.FEATURES)
    fitted = {t.target: [m for m, o in zip(found, owner, strict=True) if o == t.target] for t in tasks}
    values = [t for t in tasks if not t.binary]
    longer = [replace(t.params, n_estimators=fitted[t.target][0].getNumTrees + 10) for t in values]
    refits = boosting.boost(vectors, [boosting.Fit(F.col(t.target), F.when(trains(t), boosting.TRAINS), False, p) for t, p in zip(values, longer, strict=True)], models.FEATURES) if values else []
    refitted = dict(zip([t.target for t in values], refits, strict=True))
    out = {}
    for t in tasks:
        role = F.col(roles[t.target])
        if t.binary:
            name = f"preds_oof_{t.short}_gbt"
            rows = vectors.filter(role.isNotNull()).withColumn("__role", role)
            scored = models.out_of_fold_scores(rows, fitted[t.target], name, True, t.population is not None)
            scored = durable(scored.withColumn(t.final, columns.blend(dict(zip([name], t.weights, strict=True)))).drop(models.FEATURES))
            trained = scored.filter("__role = 'train'")
            quality = metrics.binary_metrics(trained, t.target, t.final)
        else:
            trained = vectors.filter(trains(t))
            valid = models.score_column(fitted[t.target][0], trained.filter("is_valid"), "predicted", False)
            predicted = F.col("predicted") if t.floor is None else F.greatest("predicted", F.lit(t.floor))
            quality = metrics.regression_metrics(durable(valid.select(t.target, predicted.alias("predicted"))), t.target, "predicted")
            only = F.when(role == "predict", F.col("__score"))
            scored = models.score_column(refitted[t.target], vectors, "__score", False).withColumn(t.final, only)
        importance = explain.feature_importance(df.sparkSession, fitted[t.target], names)
        importance = importance.withColumn("feature", clean_feature_name("feature"))
        out[t.target] = (durable(scored.select(*keys, t.final)), quality, benchmark(trained, t.target, t.binary), importance)
    return out


def scoring_run(feature_rows: DataFrame, tasks: Sequence[Task], run: RunParams, output: str,
                features: Sequence[str] | None = None) -> dict[str, str]:
    """Write predictions, metrics and importances below `output`; returns their paths.

    `feature_rows` is a feature table with target columns, unique per customer. Scores come back by
    equi-join on the customer key, which no hot value can skew. Metrics have a row for each target and one for its
    benchmark, the mean. Intermediates live in a folder of the run, which is dropped at its end.
    """
    with scratch_run(feature_rows.sparkSession):
        return _scoring_run(feature_rows, tasks, run, output, features)


def _scoring_run(feature_rows: DataFrame, tasks: Sequence[Task], run: RunParams, output: str,
                 features: Sequence[str] | None) -> dict[str, str]:
    df = durable(feature_rows)
    features = list(features) if features is not None else columns.final_features(df)
    date = F.lit(run.date_until).alias("date")
    entity = F.lit(run.entity or "all").alias("entity")
    paths = {name: f"{output}/{name}" for name in ("predictions", "metrics", "feat_imp")}
    published, quality = df, {}
    done = score_tasks(df, tasks, features)
    for task in tasks:
        scores, quality[task.target], quality[f"{task.target}__benchmark"], importance = done[task.target]
        published = published.join(scores, list(KEYS), "left")
        save_partitioned(
            importance.select(entity, F.lit(task.target).alias("target"), date, "*"), paths["feat_imp"],
            ("entity", "target", "date"),
        )
    partitions = [F.col("global_entity_id").alias("entity"), date]
    save_partitioned(prediction_export(published, ID, partitions), paths["predictions"], sort_by=ID)
    save_partitioned(metrics.metrics_table(quality).select(entity, date, "*"), paths["metrics"])
    return paths
