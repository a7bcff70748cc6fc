"""Feature selection into the out-of-fold run: what helps on the validation rows trains the published models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import explain, models
from tidemark.session import durable


def helpful_features(importance: DataFrame, features: Sequence[str]) -> list[str]:
    """Features whose permutation lowers the quality, or whose missing flag does; all of them if none does.

    The table has one row for each feature of the model.
    """
    found = {r.feature.removesuffix(models.FLAG) for r in explain.useful_features(importance).select("feature").collect()}
    return [f for f in features if f in found] or list(features)


def selected_out_of_fold(df: DataFrame, keys: Sequence[str], target: str, features: Sequence[str], params: models.TreeParams,
                         n_iter: int = 2, binary: bool = True, population: Column | None = None, suffix: str = "_model_1"):
    """One model on an 80/20 split, permutation importance on its validation rows, then out-of-fold models on what helps.

    Rows of the "predict" population take no part in the choice. Returns the rows with `preds_oof_<suffix>`, the
    features that stayed and the importance table.
    """
    df = df if population is None else df.withColumn("population", population)
    known = df.filter(F.col(target).isNotNull() if population is None else F.col("population") == "train")
    valid, model, names = models.fit_single(known, keys, target, features, params, binary, "score")
    valid = valid.withColumn(models.LABEL, F.col(target).cast("double"))
    importance = durable(explain.permutation_importance(model, valid, keys, names, n_iter, binary, rank=True))
    kept = helpful_features(importance, features)
    scored, _fitted, _names = models.out_of_fold(
        df, keys, target, kept, models.boosted_trees(params, binary), population=None if population is None else "population",
        suffix=suffix, binary=binary,
    )
    return scored, kept, importance
