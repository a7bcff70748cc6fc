import math
from dataclasses import replace
from itertools import combinations

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tidemark.functions.hashing import portable_hash
from tidemark.operators import explain, models
from tidemark.operators.boosting import Boosted, Tree
from tidemark.session import durable

NAMES = [f"f{k}" for k in range(6)]
PARAMS = replace(models.QUICK, n_estimators=5, max_depth=3, min_child_samples=8)


@pytest.fixture(scope="module")
def rows(spark):
    made = spark.range(240).select("id", *[(portable_hash(k, "id") % 1000 / 1000).alias(c) for k, c in enumerate(NAMES)])
    value = F.sin(F.col("f0") * 6) + F.col("f1") * F.col("f2") * 2
    return durable(made.select("id", array_to_vector(F.array(*NAMES)).alias(models.FEATURES), value.alias("v"), (value > 0.7).cast("double").alias("y"), F.lit(False).alias("is_valid")))


@pytest.fixture(scope="module", params=[True, False], ids=["classifier", "regressor"])
def fitted(rows, request):
    labelled = rows.withColumn(models.LABEL, F.col("y" if request.param else "v"))
    return durable(labelled), models.boosted_trees(PARAMS, request.param)(labelled), request.param


def test_permutation_by_tree_equals_whole_vectors(fitted, monkeypatch):
    df, model, binary = fitted
    fast = {r.feature: (r.perm_imp, r.perm_imp_std) for r in explain.permutation_importance(model, df, ["id"], NAMES, 2, binary).collect()}
    monkeypatch.setattr(explain, "_runs_by_tree", explain._runs_by_vector)
    slow = {r.feature: (r.perm_imp, r.perm_imp_std) for r in explain.permutation_importance(model, df, ["id"], NAMES, 2, binary).collect()}
    assert fast.keys() == slow.keys() == set(NAMES)
    assert all(np.allclose(fast[n], slow[n], atol=1e-9) for n in NAMES)
    assert fast["f0"][0] > 0.05 and max(abs(fast[n][0]) for n in ("f3", "f4", "f5")) < fast["f0"][0]


def test_pair_contributions_are_the_exact_values(fitted):
    df, model, _binary = fitted
    bins = model.binned(np.array([r[0].toArray() for r in df.select(models.FEATURES).limit(12).collect()]))
    x, b = bins[:6], bins[6:]
    got = explain.pair_contributions(model, x, b)
    n = len(NAMES)
    for i in range(len(x)):
        def margin(chosen, i=i):
            mixed = np.array([[x[i, f] if f in chosen else b[i, f] for f in range(n)]])
            return model.margins(mixed)[0]

        for f in range(n):
            others = [o for o in range(n) if o != f]
            want = sum(math.factorial(k) * math.factorial(n - k - 1) / math.factorial(n) * (margin({*c, f}) - margin(set(c))) for k in range(n) for c in combinations(others, k))
            assert got[i, f] == pytest.approx(want, abs=1e-9)


def test_values_add_up_and_errors_shrink(fitted):
    df, model, _binary = fitted
    few = durable(explain.tree_shapley(model, df, ["id"], NAMES, rows=40, backgrounds=3))
    sums = few.groupBy("id").agg(F.sum("shap").alias("s"), F.max("score").alias("f"), F.max("base").alias("b"), F.count("*").alias("n")).collect()
    assert len(sums) == 40 and all(r.s == pytest.approx(r.f - r.b, abs=1e-9) and r.n == len(NAMES) for r in sums)
    more = durable(explain.tree_shapley(model, df, ["id"], NAMES, rows=40, backgrounds=3, tolerance=0.2))
    all_ = durable(explain.tree_shapley(model, df, ["id"], NAMES, rows=40, backgrounds=1000))
    error = [t.agg(F.avg("shap_se")).first()[0] for t in (few, more, all_)]
    assert error[0] > error[1] > error[2] == 0
    size = more.agg(F.avg(F.abs("shap"))).first()[0]
    assert error[1] <= 0.2 * size
    # against all backgrounds the values are exact: the errors of fewer are of the size they say
    exact = {(r.id, r.feature): r.shap for r in all_.collect()}
    off = [abs(r.shap - exact[r.id, r.feature]) for r in few.collect()]
    assert 0.2 * error[0] < np.mean(off) < 2 * error[0]


def test_importance_counts_splits(spark, fitted):
    _df, model, _binary = fitted
    table = {r.feature: r.imp_mean for r in explain.feature_importance(spark, [model], NAMES).collect()}
    splits = [int(f) for t in model.trees for f in t.feature if f >= 0]
    assert all(table[n] == pytest.approx(splits.count(k) / len(splits)) for k, n in enumerate(NAMES))


@pytest.mark.parametrize("block", [7, 1024])
def test_blocks_of_rows_meet_the_backgrounds_that_pairs_met(fitted, monkeypatch, block):
    df, model, _binary = fitted
    monkeypatch.setattr(explain, "SHAPLEY_BLOCK", block)
    got = {(r.id, r.feature): r for r in explain.tree_shapley(model, df, ["id"], NAMES, backgrounds=9).collect()}
    order = sorted((r.h, r.id, r.x) for r in df.select(portable_hash(43, "id").alias("h"), "id", models.FEATURES).toDF("h", "id", "x").collect())
    n = len(order)
    first = df.select((portable_hash(42, F.lit("first")) % (n - 1)).alias("s")).first().s
    bins = model.binned(np.array([x.toArray() for _, _, x in order]))
    partners = [(np.arange(n) + 1 + (first + o) % (n - 1)) % n for o in range(9)]
    values = np.array([explain.pair_contributions(model, bins, bins[p]) for p in partners])
    base = np.mean([model.margins(bins)[p] for p in partners], axis=0)
    assert len(got) == n * len(NAMES)
    for i, (_, key, _x) in enumerate(order):
        for f, name in enumerate(NAMES):
            r = got[key, name]
            assert r.shap == pytest.approx(values[:, i, f].mean(), abs=1e-9) and r.base == pytest.approx(base[i], abs=1e-9)
            assert r.shap_se == pytest.approx(math.sqrt(values[:, i, f].var(ddof=1) / 9 * (1 - 9 / (n - 1))), abs=1e-7)


def test_a_summary_of_unique_rows_adds_nothing_up_by_row_and_feature(fitted):
    df, model, _binary = fitted
    plans = []
    plain = explain.durable
    try:
        explain.durable = lambda frame: plans.append(frame._jdf.queryExecution().optimizedPlan().toString()) or plain(frame)
        explain.tree_shapley(model, df, ["id"], NAMES, backgrounds=3)
    finally:
        explain.durable = plain
    assert "Generate" in plans[-1] and "Aggregate" not in plans[-1]


def against_all(model, rows):
    """{key: (values, base)} of rows (key, features) by their pairs with every other row."""
    bins = model.binned(np.array([x.toArray() for _, x in rows]))
    margins, n = model.margins(bins), len(rows)
    out = {}
    for i, (key, _x) in enumerate(rows):
        others = [j for j in range(n) if j != i]
        values = explain.pair_contributions(model, np.tile(bins[i], (n - 1, 1)), bins[others])
        out[key] = (values.mean(axis=0), margins[others].mean())
    return out


@pytest.mark.parametrize("patterns", [1, 20, 1 << 20])  # groups of one leaf, of some, one for all
def test_each_row_meets_all_others_unless_backgrounds_are_drawn(fitted, monkeypatch, patterns):
    df, model, _binary = fitted
    monkeypatch.setattr(explain, "PATTERNS", patterns)
    df, model = df.filter("id < 60"), replace(model, trees=model.trees[:2])
    want = against_all(model, df.select("id", models.FEATURES).collect())
    got = explain.tree_shapley(model, df, ["id"], NAMES).collect()
    assert sorted((r.id, r.feature) for r in got) == sorted((i, f) for i in want for f in NAMES)
    for r in got:
        values, base = want[r.id]
        assert r.shap == pytest.approx(values[NAMES.index(r.feature)], abs=1e-9) and r.base == pytest.approx(base, abs=1e-9)
        assert r.shap_se == 0


def test_the_summary_is_of_all_pairs(spark, fitted, monkeypatch):
    from tidemark.catalog import models as catalog
    from tidemark.catalog.registry import QUERIES

    df, model, _binary = fitted
    df = df.withColumnRenamed("id", catalog.ID)
    monkeypatch.setattr(catalog, "_vectors", lambda *_: (df, model, NAMES))
    values = [v for v, _ in against_all(model, df.select(catalog.ID, models.FEATURES).collect()).values()]
    want = np.abs(values).mean(axis=0)
    got = {r.feature: r.mean_abs_shap for r in QUERIES["shapley_summary"](spark, "").collect()}
    assert got.keys() == set(NAMES) and all(got[f] == pytest.approx(w, abs=1e-9) for f, w in zip(NAMES, want, strict=True))


def test_repeated_and_missing_keys_share_their_mean(fitted):
    df, model, _binary = fitted
    df = df.filter("id < 12").withColumn("id", F.when(F.col("id") % 4 > 0, F.col("id") % 4))
    rows = df.select("id", models.FEATURES).collect()
    whole = against_all(model, [((i, key), x) for i, (key, x) in enumerate(rows)])
    got = explain.tree_shapley(model, df, ["id"], NAMES).collect()
    assert len(got) == len({key for key, _ in rows}) * len(NAMES) < len(rows) * len(NAMES)
    for r in got:
        mine = [v for (_, key), v in whole.items() if key == r.id]
        assert r.shap == pytest.approx(np.mean([v[NAMES.index(r.feature)] for v, _ in mine]), abs=1e-9)
        assert r.base == pytest.approx(np.mean([b for _, b in mine]), abs=1e-9)


def test_one_row_or_none_and_a_model_without_trees(fitted):
    df, model, _binary = fitted
    one = explain.tree_shapley(model, df.filter("id = 3"), ["id"], NAMES).collect()
    assert len(one) == len(NAMES) and all(r.shap == 0 and r.score == r.base for r in one)
    assert explain.tree_shapley(model, df.filter("id < 0"), ["id"], NAMES).count() == 0
    bare = explain.tree_shapley(replace(model, trees=[]), df, ["id"], NAMES).collect()
    assert len(bare) == 240 * len(NAMES) and all(r.shap == 0 and r.score == model.base for r in bare)


@pytest.mark.parametrize("k", range(7))
def test_leaf_contributions_are_those_of_the_pairs_counted(k):
    rng = np.random.default_rng(k)
    x = rng.integers(0, 2, (50, k + 1)).astype(np.uint8)
    # a path of k features, one node a level: bin 0 goes on to the left
    feature = np.full(2 ** (k + 1) - 1, -1, np.int32)
    for level in range(k):
        feature[2**level - 1] = level
    value = np.zeros(len(feature))
    value[2**k - 1] = 3.0
    model = Boosted([np.array([0.5])] * (k + 1), 0.0, False, [Tree(feature, np.zeros(len(feature), np.int32), value)])
    leaf = next(p for p in explain.leaf_paths(model.trees[0]) if p[0] == 3.0)
    pattern = explain._patterns(leaf, np.ascontiguousarray(x.T))
    table = explain.leaf_contributions(3.0, np.bincount(pattern, minlength=1 << k))
    assert table.shape == (k, 1 << k)
    for i in range(len(x)):
        want = explain.pair_contributions(model, np.tile(x[i], (len(x), 1)), x).sum(axis=0)
        assert np.allclose(table[:, pattern[i]], want[:k], atol=1e-9)
