from dataclasses import replace

from pyspark.sql import functions as F

from tidemark.functions.hashing import portable_hash
from tidemark.operators import models
from tidemark.plans import selection
from tidemark.session import durable

FEATURES = ["signal", "gaps", *[f"noise{k}" for k in range(6)]]
PARAMS = replace(models.STEADY, n_estimators=6, max_depth=2, min_child_samples=10)


def planted(spark):
    """The target follows from `signal` and from whether `gaps` is missing."""
    made = spark.range(900).select(
        "id",
        (portable_hash(1, "id") % 1000 / 1000).alias("signal"),
        F.when(portable_hash(2, "id") % 3 != 0, F.lit(-1.0)).alias("gaps"),  # missing values and -1 are told apart by the flag
        *[(portable_hash(10 + k, "id") % 1000 / 1000).alias(f"noise{k}") for k in range(6)],
    )
    y = ((F.col("signal") > 0.6) | (F.col("gaps").isNull() & (F.col("signal") > 0.2))).cast("int")
    return durable(made.withColumn("y", F.when(F.col("id") % 10 != 0, y)))


def test_noise_goes_and_what_helps_trains_the_folds(spark):
    rows = planted(spark)
    population = F.when(F.col("y").isNotNull(), "train").otherwise("predict")
    scored, kept, importance = selection.selected_out_of_fold(rows, ["id"], "y", FEATURES, PARAMS, population=population, suffix="y_gbt")
    assert {"signal", "gaps"} <= set(kept) and len(kept) < len(FEATURES)
    by_name = {r.feature: r.perm_imp for r in importance.collect()}
    assert set(by_name) == {*FEATURES, "gaps__isnull"} and by_name["signal"] > by_name["gaps__isnull"] > 0 == by_name["gaps"]
    got = scored.select("id", "y", "role", F.col("preds_oof_y_gbt").alias("p")).collect()
    assert len(got) == 900 and {r.role for r in got if r.y is None} == {"predict"}
    right = [round(r.p) == r.y for r in got if r.y is not None]
    assert sum(right) / len(right) > 0.9  # six rounds of two levels; always guessing 1 gives about a half


def test_all_features_stay_if_none_helps(spark):
    table = spark.createDataFrame([("a", 0.0), ("b", -0.1)], "feature string, perm_imp double")
    assert selection.helpful_features(table, ["b", "a"]) == ["b", "a"]
    table = spark.createDataFrame([("a", 0.0), ("a__isnull", 0.1), ("b", -0.1)], "feature string, perm_imp double")
    assert selection.helpful_features(table, ["b", "a"]) == ["a"]
