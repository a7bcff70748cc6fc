from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tidemark.functions.hashing import portable_hash
from tidemark.operators import explain, metrics, models

KEYS = ["id"]
FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def planted(spark):
    """`a` and `b` carry the signal, `c` is noise, `a` has gaps, one label in ten is flipped."""
    rows = spark.range(600).select(
        "id",
        F.when(F.col("id") % 9 != 0, portable_hash(1, "id") % 100).alias("a"),
        (portable_hash(2, "id") % 100).cast("double").alias("b"),
        (portable_hash(3, "id") % 100).cast("double").alias("c"),
    )
    signal = (F.coalesce("a", F.lit(0)) > 60) | (F.col("b") > 80)
    return rows.withColumn("y", (signal != (portable_hash(4, "id") % 10 == 0)).cast("int"))


@pytest.fixture(scope="module")
def single(planted):
    valid, model, names = models.fit_single(planted, KEYS, "y", FEATURES, models.QUICK, True, "score")
    return valid.withColumn(models.LABEL, F.col("y").cast("double")), model, names


def test_beats_the_mean(single):
    valid, model, names = single
    assert names == ["a", "b", "c", "a__isnull"]
    assert valid.filter("score < 0 or score > 1").count() == 0
    got = metrics.binary_metrics(valid, "y", "score").first()
    share = valid.agg(F.avg("y")).first()[0]
    assert got["roc_auc"] > 0.7 and got["accuracy"] > max(share, 1 - share)


def test_importances(spark, single):
    _valid, model, names = single
    table = explain.feature_importance(spark, [model, model], names).orderBy("position").collect()
    assert [r["position"] for r in table] == [1, 2, 3, 4]
    assert sum(r["imp_0"] for r in table) == pytest.approx(1)
    assert {table[0]["feature"], table[1]["feature"]} == {"a", "b"}


def test_permutation_importance(single):
    valid, model, names = single
    got = {r["feature"]: r for r in explain.permutation_importance(model, valid, KEYS, names, 2, rank=True).collect()}
    assert set(got) == set(names)
    assert got["a"]["perm_imp"] > got["c"]["perm_imp"] and got["a"]["perm_imp_rank"] <= 2


def test_shapley_values_add_up(single):
    valid, model, names = single
    values = explain.sampled_shapley(model, valid, KEYS, names, rows=30, orderings=2)
    sums = values.groupBy("id").agg(F.sum("shap").alias("s"), F.max("score").alias("f"), F.max("base").alias("b")).collect()
    assert len(sums) == 30
    assert all(r["s"] == pytest.approx(r["f"] - r["b"], abs=1e-9) for r in sums)


def test_out_of_fold_covers_every_row_once(planted):
    role = F.when(F.col("id") < 400, "train").when(F.col("id") < 500, "predict")
    rows = planted.withColumn("population", role)
    scored, fitted, _names = models.out_of_fold(
        rows, KEYS, "y", FEATURES, models.logistic_regression(maxIter=5), population="population", folds=3,
        suffix="_model_1", parallelism=3,
    )
    got = scored.groupBy("role").agg(F.count("*").alias("n"), F.countDistinct("id").alias("d"), F.count("preds_oof__model_1").alias("p"))
    assert {r["role"]: tuple(r)[1:] for r in got.collect()} == {"train": (400, 400, 400), "predict": (100, 100, 100)}
    assert len(fitted) == 3


def test_refit_scores_only_the_predict_rows(planted):
    rows = planted.withColumn("population", F.when(F.col("id") < 300, "train").when(F.col("id") < 450, "predict"))
    scored, _model, _names = models.refit_and_score(rows, KEYS, "b", "population", FEATURES, models.QUICK, 3, "p")
    got = scored.agg(F.count("*"), F.count("p"), F.min(F.when(F.col("p").isNotNull(), F.col("id")))).first()
    assert tuple(got) == (600, 150, 300)


@pytest.fixture(scope="module")
def large(spark):
    """1000 rows whose target follows from `a` and `b`, with noise."""
    rows = spark.range(1000).select("id", *[(portable_hash(k, "id") % 1000 / 1000).alias(c) for k, c in enumerate("abc")])
    noise = portable_hash(9, "id") % 1000 / 2000
    rows = rows.withColumn("v", F.sin(F.col("a") * 6) + F.col("b") * F.col("b") * 2 + noise)
    return rows.withColumn("y", (F.col("v") > 1.4).cast("int"))


def test_patience_keeps_useful_rounds(large):
    from tidemark.session import durable

    rows = durable(large)
    # All of the real settings but the last rounds: each costs seven small jobs, and these suffice to see the point.
    params = replace(models.VALUE, n_estimators=60, max_depth=3)
    valid, model, names = models.fit_single(rows, KEYS, "v", FEATURES, params, False, "p")
    got = metrics.regression_metrics(durable(valid), "v", "p").first()
    assert model.getNumTrees > 20 and got["r2"] > 0.5
    tomorrow, again = models.assemble(rows.withColumn("a", F.lit(None).cast("double")), FEATURES, KEYS, names)
    assert again == names and tomorrow.count() == 1000


@pytest.mark.parametrize("params", [models.ORGANIC_OOF, models.GENERAL_OOF])
def test_patience_of_classifiers(large, params):
    from tidemark.session import durable

    params = replace(params, n_estimators=40, max_depth=3)
    valid, model, _names = models.fit_single(durable(large), KEYS, "y", FEATURES, params, True, "p")
    got = metrics.binary_metrics(durable(valid), "y", "p").first()
    assert model.getNumTrees > 20 and got["roc_auc"] > 0.9
    positives = valid.agg(F.sum("y"), F.count("*")).first()
    share = large.agg(F.avg("y")).first()[0]
    assert abs(positives[1] - 200) <= 1 and abs(positives[0] - share * 200) <= 1


def test_patience_goes_back_to_the_best_round(monkeypatch):
    class Fake:
        def __init__(self, rounds):
            self.rounds = rounds

        def fit(self, _rows):
            return self

        def evaluateEachIteration(self, _rows, _loss=None):  # noqa: N802
            return [abs(i + 1 - 57) for i in range(self.rounds)]

    trained = []
    monkeypatch.setattr(models, "boosting", lambda _params, _binary, rounds: trained.append(rounds) or Fake(rounds))
    assert models.stopped_early(models.VALUE, False, None, None).rounds == 57
    assert trained == [32, 64, 128, 57]


def test_every_training_row_is_scored_by_a_model_that_did_not_see_it(planted):
    seen = []

    def trainer(rows):
        seen.append({r.id for r in rows.filter("NOT is_valid").select("id").collect()})
        return models.logistic_regression(maxIter=3)(rows)

    scored, _fitted, _names = models.out_of_fold(planted, KEYS, "y", FEATURES, trainer, folds=3, parallelism=1)
    by_fold = {}
    for r in scored.select("id", "fold").collect():
        by_fold.setdefault(r.fold, set()).add(r.id)
    assert all(not seen[fold] & ids for fold, ids in by_fold.items())
