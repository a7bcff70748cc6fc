"""Boosted trees and logistic regression: training with early stopping, out-of-fold scores, refits.

Boosted trees are those of `boosting`, which learns many models in the same jobs; Spark ML's own are there as another
trainer. Logistic regression is Spark ML's.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.hashing import portable_hash
from tidemark.operators import boosting as histogram
from tidemark.operators.lookup import quoted
from tidemark.operators.sampling import split_exact, split_label
from tidemark.session import durable

FEATURES = "features"
LABEL = "label"
MISSING = -1.0


@dataclass(frozen=True)
class TreeParams:
    """Names follow the usual boosting vocabulary; `spark()` maps them to Spark ML. Columns are drawn for each tree."""

    n_estimators: int = 2000
    learning_rate: float = 0.08
    max_depth: int = 7
    min_child_samples: int = 200
    min_split_gain: float = 0.0
    colsample: float = 0.8
    max_bins: int = 32
    seed: int = 42
    patience: int = 20
    l1: float = 0.5  # penalties on leaf values; Spark ML has none
    l2: float = 0.5
    extra: dict = field(default_factory=dict)

    def spark(self) -> dict:
        return {
            "maxIter": self.n_estimators,
            "stepSize": self.learning_rate,
            "maxDepth": self.max_depth,
            "minInstancesPerNode": self.min_child_samples,
            "minInfoGain": self.min_split_gain,
            "featureSubsetStrategy": str(self.colsample),
            "maxBins": self.max_bins,
            "seed": self.seed,
            **self.extra,
        }


# Parameters per task (fixed values).
GENERAL_SINGLE = TreeParams(2000, 0.08, 7, 200, 0.003)
GENERAL_OOF = TreeParams(2000, 0.10, 7, 200, 0.005)
ORGANIC_SINGLE = TreeParams(2000, 0.05, 7, 100)
ORGANIC_OOF = TreeParams(1000, 0.05, 7, 100)
VALUE = TreeParams(2000, 0.02, 7, 100)

# Enough rounds for the patience to act, each going further: for runs on a machine or a morning.
STEADY = TreeParams(n_estimators=128, learning_rate=0.2, max_depth=4, min_child_samples=20, l1=0.0)

# A setting with fewer rounds, each going further, for checks on little data.
QUICK = TreeParams(n_estimators=8, learning_rate=0.3, max_depth=4, min_child_samples=5)


FLAG = "__isnull"


def assemble(df: DataFrame, features: Sequence[str], keep: Sequence[str],
             names: Sequence[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Feature vector with missing values as -1 plus a missing flag for columns that have gaps.

    Spark ML trees reject NaN, so "missing" becomes an ordinary, separable value. Without `names` the columns with
    gaps in `df` get a flag; with the names of a fitted model its flags are used, so it scores other rows alike.
    """
    if names is None:
        nullable = [f.name for f in df.schema.fields if f.name in set(features) and f.nullable]
        gaps = df.agg(*[F.count(F.when(F.col(quoted(c)).isNull(), 1)) for c in nullable]).first() if nullable else ()
        flagged = [c for c, n in zip(nullable, gaps, strict=True) if n]
    else:
        flagged = [n.removesuffix(FLAG) for n in names if n.endswith(FLAG)]
    names = [*features, *[f"{c}{FLAG}" for c in flagged]]
    filled = [F.coalesce(F.col(quoted(c)).cast("double"), F.lit(MISSING)) for c in features]
    filled += [F.col(quoted(c)).isNull().cast("double") for c in flagged]
    inputs = [f"__f_{i}" for i in range(len(names))]
    rows = df.select(*keep, *[e.alias(n) for e, n in zip(filled, inputs, strict=True)])
    vectors = VectorAssembler(inputCols=inputs, outputCol=FEATURES).transform(rows)
    return vectors.select(*keep, FEATURES), names


def positive_probability(model_output: str = "probability") -> Column:
    return vector_to_array(F.col(model_output)).getItem(1)


FIRST_BLOCK = 32  # rounds of the first training; every further one doubles them


def boosting(params: TreeParams, binary: bool, rounds: int | None = None):
    """The estimator, for `rounds` rounds or all."""
    kind = GBTClassifier if binary else GBTRegressor
    settings = params.spark() if rounds is None else replace(params, n_estimators=rounds).spark()
    return kind(featuresCol=FEATURES, labelCol=LABEL, **settings)


def stopped_early(params: TreeParams, binary: bool, train: DataFrame, valid: DataFrame):
    """Boosting that ends `patience` rounds after the best round on `valid`, cut back to the best round.

    Spark ML stops at the first small step, so training runs in growing blocks from one seed (their trees are the
    same), the error of every round is read from the model, and the best number of rounds is trained in the end.
    """
    rounds = min(FIRST_BLOCK, params.n_estimators)
    while True:
        model = boosting(params, binary, rounds).fit(train)
        errors = model.evaluateEachIteration(valid) if binary else model.evaluateEachIteration(valid, "squared")
        best = min(range(len(errors)), key=lambda i: (errors[i], i)) + 1
        if best + params.patience <= rounds or rounds >= params.n_estimators:
            return model if best == rounds else boosting(params, binary, best).fit(train)
        rounds = min(2 * rounds, params.n_estimators)


def score_column(model, df: DataFrame, output: str, binary: bool) -> DataFrame:
    """Add the model's score and drop its working columns."""
    if isinstance(model, histogram.Boosted):
        return df.withColumn(output, model.scores(df.sparkSession, F.col(FEATURES)))
    scored = model.transform(df)
    value = positive_probability() if binary else F.col("prediction")
    return scored.withColumn(output, value).drop("rawPrediction", "probability", "prediction")


def train_valid(df: DataFrame, keys: Sequence[str], seed: int = 42, stratum: str | None = None) -> DataFrame:
    """80/20 by key hash; with `stratum` exactly so in each of its classes."""
    if stratum is None:
        return df.withColumn("is_valid", split_label(keys, seed) == "valid")
    return split_exact(df, keys, stratum, seed).withColumn("is_valid", F.col("split") == "valid").drop("split")


def fit_single(df: DataFrame, keys: Sequence[str], target: str, features: Sequence[str], params: TreeParams,
               binary: bool, output: str, floor: float | None = None):
    """80/20 split (by class for classifiers), early stop on the validation part.

    Returns validation rows with scores, model, names.
    """
    vectors, names = assemble(
        train_valid(df, keys, stratum=target if binary else None), features, [*keys, target, "is_valid"]
    )
    vectors = durable(vectors.withColumn(LABEL, F.col(target).cast("double")))
    model = boosted_trees(params, binary)(vectors)
    valid = score_column(model, vectors.filter("is_valid"), output, binary)
    if floor is not None:
        valid = valid.withColumn(output, F.greatest(F.col(output), F.lit(floor)))
    return valid.drop(LABEL), model, names


def refit_and_score(df: DataFrame, keys: Sequence[str], target: str, population: str, features: Sequence[str],
                    params: TreeParams, best_iteration: int, output: str):
    """Train on all "train" rows with ten more rounds than early stopping chose, score the "predict" rows.

    All rows come back; rows outside "predict" have no score.
    """
    vectors, names = assemble(df, features, [*keys, target, population])
    vectors = durable(vectors.withColumn(LABEL, F.col(target).cast("double")))
    longer = replace(params, n_estimators=best_iteration + 10)
    [model] = BoostedTrees(longer, False).fit_many(vectors, [F.when(F.col(population) == "train", histogram.TRAINS)])
    scored = score_column(model, vectors, output, binary=False)
    only = F.when(F.col(population) == "predict", F.col(output))
    return scored.withColumn(output, only).drop(LABEL, FEATURES), model, names


@dataclass(frozen=True)
class BoostedTrees:
    """Trainer on rows with `is_valid`: stops early on the valid ones; without any it runs to the last round."""

    params: TreeParams
    binary: bool = True

    def __call__(self, rows: DataFrame):
        [model] = self.fit_many(rows, [F.when(F.col("is_valid"), histogram.STOPS).otherwise(histogram.TRAINS)])
        return model

    def fit_many(self, rows: DataFrame, roles: Sequence[Column]) -> list:
        """One model for each role column, all in the same jobs."""
        label = F.col(LABEL)  # one column for all, which is stored once
        fits = [histogram.Fit(label, role, self.binary, self.params) for role in roles]
        return histogram.boost(rows, fits, FEATURES)


def boosted_trees(params: TreeParams, binary: bool = True) -> BoostedTrees:
    return BoostedTrees(params, binary)


def spark_trees(params: TreeParams, binary: bool = True) -> Callable:
    """The same with Spark ML's own boosted trees, one model after another."""

    def train(rows: DataFrame):
        learning, valid = rows.filter("NOT is_valid"), rows.filter("is_valid")
        if valid.isEmpty():
            return boosting(params, binary).fit(learning)
        return stopped_early(params, binary, learning, valid)

    return train


def logistic_regression(**params) -> Callable:
    """Trainer on all rows but the valid ones."""
    return lambda rows: LogisticRegression(featuresCol=FEATURES, labelCol=LABEL, **params).fit(rows.filter("NOT is_valid"))


def out_of_fold(df: DataFrame, keys: Sequence[str], target: str, features: Sequence[str], trainer: Callable,
                population: str | None = None, folds: int = 5, seed: int = 41, suffix: str = "_model_1",
                binary: bool = True, parallelism: int = 2, early_stop: bool = True):
    """k models; every training row is scored by the model that did not see it.

    Rows of the "predict" population get the mean of all k models; without `population` every row trains.
    Fold i is scored, fold i+1 stops the training early, so the scored fold never steers its own model
    (with two folds, or without `early_stop`, all other folds train, to the last round).
    Returns the rows with `preds_oof_<suffix>`, the models, and the feature names.
    """
    output = f"preds_oof_{suffix}"
    role = F.lit("train") if population is None else F.col(population)
    vectors, names = assemble(df.withColumn("__role", role), features, [*keys, target, "__role"])
    vectors = durable(
        vectors.filter(F.col("__role").isNotNull()).select(
            "*",
            F.col(target).cast("double").alias(LABEL),
            (portable_hash(seed, *keys) % folds).cast("int").alias("fold"),
        )
    )
    train = vectors.filter(F.col("__role") == "train")

    def fit(i: int):
        stops = F.col("fold") == (i + 1) % folds if folds > 2 and early_stop else F.lit(False)
        return trainer(train.filter(F.col("fold") != i).withColumn("is_valid", stops))

    if isinstance(trainer, BoostedTrees):
        models = trainer.fit_many(vectors, fold_roles(F.col("__role") == "train", F.col("fold"), folds, early_stop))
    else:
        with ThreadPoolExecutor(parallelism) as pool:
            models = list(pool.map(fit, range(folds)))
    scored = out_of_fold_scores(vectors, models, output, binary, population is not None)
    return scored.drop(LABEL, FEATURES).withColumnRenamed("__role", "role"), models, names


def fold_roles(trains: Column, fold: Column, folds: int = 5, early_stop: bool = True) -> list[Column]:
    """Model i learns from the rows that train but fold i; fold i + 1 stops it early, if there are more than two."""
    stops = [fold == (i + 1) % folds if folds > 2 and early_stop else F.lit(False) for i in range(folds)]
    return [F.when(trains & (fold != i), F.when(s, histogram.STOPS).otherwise(histogram.TRAINS)) for i, s in enumerate(stops)]


def out_of_fold_scores(vectors: DataFrame, models: Sequence, output: str, binary: bool, predict: bool) -> DataFrame:
    """Training rows by the model of their fold; with `predict`, also the "predict" rows, by the mean of all models."""
    folds = len(models)
    train = vectors.filter(F.col("__role") == "train")
    own = [score_column(m, train.filter(F.col("fold") == i), output, binary) for i, m in enumerate(models)]
    scored = reduce(DataFrame.unionByName, own)
    if predict:
        rest = vectors.filter(F.col("__role") == "predict")
        for i, m in enumerate(models):
            rest = score_column(m, rest, f"__p{i}", binary)
        mean = reduce(lambda a, b: a + b, [F.col(f"__p{i}") for i in range(folds)]) / folds
        scored = scored.unionByName(rest.withColumn(output, mean).drop(*[f"__p{i}" for i in range(folds)]))
    return scored
