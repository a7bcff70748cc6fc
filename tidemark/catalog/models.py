"""Model training, out-of-fold scores and explanations.

Scores themselves have no SQL. Where a query tells which rows are trained, scored and left out, it returns that with
the targets, and whether each row's score is there and in its range; the SQL derives the same from the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import sql as q
from tidemark.catalog.base import query
from tidemark.functions.expressions import clean_feature_name
from tidemark.functions.hashing import portable_hash
from tidemark.operators import cohorts, columns, explain, metrics, models, sampling, targets
from tidemark.operators.flatten import KEYS
from tidemark.params import TEST_RUN as RUN
from tidemark.plans import features
from tidemark.session import durable

ID = "analytical_customer_id"
PLANTED = "target_planted_0_1"
PARAMS = models.STEADY


_FRAME = f"""WITH {q.WITH_PROFILE}, {q.FEATURES}, frame AS (
  SELECT *, CAST((coalesce(order_count_l16w_vert_rs, 0) > 0 OR coalesce(cust_lat, 0) > 59.4)
      <> ({q.score(7, ID)} % 10 = 0) AS INTEGER) AS {PLANTED},
    CAST(coalesce(order_count_lifetime_vert_dmart, 0) > 0 AS INTEGER) AS {targets.GENERAL},
    CASE WHEN order_count_lifetime_vert_qc > 0 AND coalesce(first_order_voucher_vert_qc, 0) = 0 THEN 1
      WHEN order_count_lifetime_vert_qc > 0 AND first_order_voucher_vert_qc > 0 THEN 0 END AS {targets.ORGANIC},
    order_freq_4w_vert_qc AS {targets.FREQUENCY}, gmv_avg_lifetime_vert_qc AS {targets.ORDER_VALUE}
  FROM features)"""
_SETTLED = f"first_order_date_vert_qc < DATE '{RUN.date_until}' - 28"
_FOLD = f"CAST({q.score(41, ID)} % 5 AS INTEGER) AS fold"


def _share(column: str):
    """Whether a probability is there and is one."""
    return F.coalesce(F.col(column).between(0, 1), F.lit(False))


def frame(spark: SparkSession, sf: str) -> DataFrame:
    """Feature table with targets and a target that follows from the features (one row in ten flipped)."""
    rows = targets.with_targets(features.feature_table(spark, sf, RUN))
    signal = (F.coalesce("order_count_l16w_vert_rs", F.lit(0)) > 0) | (F.coalesce("cust_lat", F.lit(0.0)) > 59.4)
    flipped = portable_hash(7, ID) % 10 == 0
    return durable(rows.withColumn(PLANTED, (signal != flipped).cast("int")))


def inputs(df: DataFrame) -> list[str]:
    return [*columns.final_features(df), "cust_lat", "cust_long"]


def fitted(spark: SparkSession, sf: str):
    df = frame(spark, sf)
    return models.fit_single(df, [ID], PLANTED, inputs(df), PARAMS, True, "score")


@query("gbt_classifier")
def _(spark, sf):
    valid, _model, _names = fitted(spark, sf)
    return metrics.binary_metrics(durable(valid.select(PLANTED, "score")), PLANTED, "score")


@query("gbt_regressor")
def _(spark, sf):
    df = frame(spark, sf).filter(F.col("order_count_lifetime_vert_qc") > 1)
    df = df.filter(F.col(targets.FREQUENCY).isNotNull())
    valid, _model, _names = models.fit_single(
        df, [ID], targets.FREQUENCY, inputs(df), PARAMS, False, "predicted", floor=0.01
    )
    return metrics.regression_metrics(durable(valid.select(targets.FREQUENCY, "predicted")), targets.FREQUENCY, "predicted")


@query(
    "score_unacquired",
    f"""{_FRAME} SELECT {ID}, {targets.ORDER_VALUE}, population, coalesce(population = 'predict', false) AS scored FROM (
      SELECT *, CASE WHEN order_count_lifetime_vert_qc > 1 AND {_SETTLED} AND {targets.ORDER_VALUE} IS NOT NULL THEN 'train'
        WHEN order_count_lifetime_vert_qc <= 1 THEN 'predict' END AS population FROM frame)""",
)
def _(spark, sf):
    population = cohorts.value_population(
        F.col("order_count_lifetime_vert_qc"), F.col("first_order_date_vert_qc"), targets.order_value(), RUN.date_until
    )
    df = frame(spark, sf).withColumn("population", population)
    train = df.filter(F.col("population") == "train")
    _valid, first, _names = models.fit_single(train, [ID], targets.ORDER_VALUE, inputs(df), PARAMS, False, "p")
    scored, _model, _names = models.refit_and_score(
        df, [ID], targets.ORDER_VALUE, "population", inputs(df), PARAMS, first.getNumTrees,
        "preds_gmv_avg_lifetime_vert_qc_final",
    )
    return scored.select(
        ID, targets.ORDER_VALUE, "population", F.col("preds_gmv_avg_lifetime_vert_qc_final").isNotNull().alias("scored")
    )


@query(
    "oof_predictions",
    f"""{_FRAME} SELECT {ID}, {targets.ORGANIC}, CASE WHEN {targets.ORGANIC} IS NULL THEN 'predict' ELSE 'train' END AS role,
      {_FOLD}, coalesce({targets.ORGANIC} >= 0, true) AS scored FROM frame""",
)
def _(spark, sf):
    df = frame(spark, sf).withColumn("population", cohorts.organic_population(F.col(targets.ORGANIC)))
    scored, _models, _names = models.out_of_fold(
        df, [ID], targets.ORGANIC, inputs(df), models.boosted_trees(PARAMS), population="population",
        suffix="acquisition_qc_organic_0_1_gbt", parallelism=4,
    )
    return scored.select(ID, targets.ORGANIC, "role", "fold", _share("preds_oof_acquisition_qc_organic_0_1_gbt").alias("scored"))


@query(
    "oof_selected",
    f"""{_FRAME} SELECT {ID}, {targets.ORGANIC}, CASE WHEN {targets.ORGANIC} IS NULL THEN 'predict' ELSE 'train' END AS role,
      {_FOLD}, coalesce({targets.ORGANIC} >= 0, true) AS scored FROM frame""",
)
def _(spark, sf):
    from tidemark.plans.selection import selected_out_of_fold

    df = frame(spark, sf)
    scored, _kept, _importance = selected_out_of_fold(
        df, [ID], targets.ORGANIC, inputs(df), PARAMS, population=cohorts.organic_population(F.col(targets.ORGANIC)),
        suffix="selected",
    )
    return scored.select(ID, targets.ORGANIC, "role", "fold", _share("preds_oof_selected").alias("scored"))


@query(
    "oof_logreg",
    f"{_FRAME} SELECT {ID}, {PLANTED}, 'train' AS role, {_FOLD}, {PLANTED} IS NOT NULL AS scored FROM frame",
)
def _(spark, sf):
    df = frame(spark, sf)
    scored, _models, _names = models.out_of_fold(
        df, [ID], PLANTED, inputs(df), models.logistic_regression(maxIter=20, regParam=0.01), suffix="planted_logreg",
        parallelism=4,
    )
    return scored.select(ID, PLANTED, "role", "fold", _share("preds_oof_planted_logreg").alias("scored"))


@query("feature_importance")
def _(spark, sf):
    _valid, model, names = fitted(spark, sf)
    table = explain.feature_importance(spark, [model], names)
    return table.withColumn("feature", clean_feature_name("feature"))


def _vectors(spark, sf):
    """Validation rows as vectors, with the model fitted on the rest."""
    valid, model, names = fitted(spark, sf)
    return valid.withColumn(models.LABEL, F.col(PLANTED).cast("double")), model, names


@query("permutation_importance")
def _(spark, sf):
    valid, model, names = _vectors(spark, sf)
    return explain.permutation_importance(model, valid, [ID], names, n_iter=2, rank=True)


DRAWN = 8  # backgrounds of each row; the summary takes all


@query("sampled_shapley")
def _(spark, sf):
    valid, model, names = _vectors(spark, sf)
    return explain.tree_shapley(model, valid, [ID], names, backgrounds=DRAWN)


@query("shapley_summary")
def _(spark, sf):
    valid, model, names = _vectors(spark, sf)
    return explain.shapley_summary(explain.tree_shapley(model, valid, [ID], names))


@query("row_forces")
def _(spark, sf):
    valid, model, names = _vectors(spark, sf)
    values = durable(explain.tree_shapley(model, valid, [ID], names, backgrounds=DRAWN))
    explained = values.agg(F.min(ID)).first()[0]
    return explain.row_forces(values.filter(F.col(ID) == F.lit(explained)), n=20)


@query(
    "simulate_recall",
    f"""{_FRAME}, placed AS (SELECT {PLANTED} AS y, row_number() OVER (PARTITION BY {PLANTED} ORDER BY {q.score("split42", ID)}, {ID}) AS k,
      count(*) OVER (PARTITION BY {PLANTED}) AS n FROM frame)
    SELECT CAST(seed AS INTEGER) AS seed, count(*) AS positives, count(*) > 0 AS recall_known
    FROM placed, range(30) s(seed) WHERE y = 1 AND k <= floor(n * 0.2e0 + 0.5e0) GROUP BY seed""",
)
def _(spark, sf):
    from tidemark.plans.experiment import simulate_recall

    df = frame(spark, sf)
    recalls = simulate_recall(df, [ID], PLANTED, inputs(df), PARAMS)
    return recalls.select("seed", (F.col("tp") + F.col("fn")).alias("positives"), _share("recall").alias("recall_known"))


_FINAL = {t: f"preds_{t.removeprefix('target_')}_final" for t in (targets.GENERAL, targets.ORGANIC, targets.FREQUENCY, targets.ORDER_VALUE)}


@query(
    "weekly_scoring",
    f"""{_FRAME} SELECT global_entity_id AS entity, '{RUN.date_until}' AS date, {ID}, {targets.GENERAL},
      CAST({targets.ORGANIC} AS FLOAT) AS {targets.ORGANIC}, CAST({targets.FREQUENCY} AS FLOAT) AS {targets.FREQUENCY},
      CAST({targets.ORDER_VALUE} AS FLOAT) AS {targets.ORDER_VALUE},
      {targets.GENERAL} >= 0 AS {_FINAL[targets.GENERAL]}, coalesce({targets.ORGANIC} >= 0, true) AS {_FINAL[targets.ORGANIC]},
      coalesce(order_count_lifetime_vert_qc <= 1, false) AS {_FINAL[targets.FREQUENCY]},
      coalesce(order_count_lifetime_vert_qc <= 1, false) AS {_FINAL[targets.ORDER_VALUE]}
    FROM frame""",
)
def _(spark, sf):
    from tidemark.plans import scoring
    from tidemark.session import scratch_path

    rows = targets.with_targets(features.feature_table(spark, sf, RUN))
    paths = scoring.scoring_run(
        rows, scoring.quick_commerce_tasks(RUN, PARAMS), RUN, scratch_path(spark, "weekly")
    )
    rows = spark.read.parquet(paths["predictions"])
    there = {n: _share(n) if t in (targets.GENERAL, targets.ORGANIC) else F.col(n).isNotNull() for t, n in _FINAL.items()}
    return rows.select("entity", F.col("date").cast("string").alias("date"), ID, *_FINAL, *[e.alias(n) for n, e in there.items()])


@query("dark_store_scoring")
def _(spark, sf):
    from tidemark.plans import scoring
    from tidemark.session import scratch_path

    rows = targets.with_dark_store_targets(features.feature_table(spark, sf, RUN, dark_stores=True))
    paths = scoring.scoring_run(
        rows, scoring.dark_store_tasks(RUN, PARAMS), RUN, scratch_path(spark, "dark")
    )
    return spark.read.parquet(paths["metrics"])


FRACTIONS = (0.01, 0.04, 0.07, 0.1)


@query("imbalance_recall")
def _(spark, sf):
    from tidemark.plans import experiment

    df = frame(spark, sf)
    scores = experiment.simulate_scores(df, [ID], PLANTED, inputs(df), PARAMS, seeds=7, fractions=FRACTIONS)
    return experiment.recall_interval(durable(experiment.recall_by_run(scores, PLANTED)))


@query("experiment_cluster_recall")
def _(spark, sf):
    from tidemark.plans import experiment

    df = frame(spark, sf)
    return experiment.run_experiment(df, [ID], PLANTED, inputs(df), PARAMS, seeds=5, sizes=(10, 20)).clusters
