from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tidemark.functions.hashing import portable_hash
from tidemark.operators import boosting
from tidemark.operators.boosting import STOPS, TRAINS, Fit, boost
from tidemark.operators.models import TreeParams
from tidemark.session import durable, scratch_path

PARAMS = TreeParams(n_estimators=30, learning_rate=0.5, max_depth=2, min_child_samples=10, patience=4, max_bins=16)


@pytest.fixture(scope="module")
def planted(spark):
    """A binary and a numeric target that follow from three of five features, with noise."""
    rows = spark.range(1200).select("id", *[(portable_hash(k, "id") % 1000 / 1000).alias(f"f{k}") for k in range(5)], (portable_hash(9, "id") % 1000 / 1000).alias("noise"))
    value = F.sin(F.col("f0") * 6) + F.col("f1") * F.col("f2") * 2 + F.col("noise") / 2
    rows = rows.select("id", array_to_vector(F.array(*[f"f{k}" for k in range(5)])).alias("features"), value.alias("v"))
    return durable(rows.select("*", ((F.col("v") > 0.7) != (portable_hash(11, "id") % 6 == 0)).cast("int").alias("y"), (F.col("id") % 5).alias("fold")))


def roles(fold):
    return F.when(F.col("fold") == fold, STOPS).otherwise(TRAINS)


def same(a, b):
    return a.base == b.base and len(a.trees) == len(b.trees) and all(np.array_equal(s.feature, t.feature) and np.array_equal(s.bin, t.bin) and np.array_equal(s.value, t.value) for s, t in zip(a.trees, b.trees, strict=True))


def plain_round(x, y, margin, edges, columns, p):
    """One regression tree by plain loops over nodes, features and limits; the margins after it."""
    def strength(g, n):
        return max(abs(g) - p.l1, 0) ** 2 / (n + p.l2)

    out = margin.copy()

    def split(rows, depth):
        g = (margin - y)[rows]
        leaf = -np.sign(g.sum()) * max(abs(g.sum()) - p.l1, 0) / (len(rows) + p.l2) * p.learning_rate
        best = (p.min_split_gain, None)
        if depth < p.max_depth and len(rows) >= 2 * p.min_child_samples:
            for f in columns:
                for limit in edges[f]:
                    left = x[rows, f] <= limit
                    if min(left.sum(), (~left).sum()) < p.min_child_samples:
                        continue
                    gain = strength(g[left].sum(), left.sum()) + strength(g[~left].sum(), (~left).sum()) - strength(g.sum(), len(rows))
                    if gain > best[0] + 1e-9:
                        best = (gain, (f, left))
        if best[1] is None:
            out[rows] += leaf
            return
        left = best[1][1]
        split(rows[left], depth + 1)
        split(rows[~left], depth + 1)

    split(np.arange(len(y)), 0)
    return out


def test_trees_follow_the_plain_rule(planted):
    p = replace(PARAMS, n_estimators=4, colsample=1.0, max_depth=3)
    [model] = boost(planted, [Fit(F.col("v"), F.lit(TRAINS), False, p)], "features")
    rows = planted.orderBy("id").collect()
    x, y = np.array([r.features.toArray() for r in rows]), np.array([r.v for r in rows])
    margin = np.full(len(y), model.base)
    for tree in model.trees:
        margin = plain_round(x, y, margin, model.edges, range(5), p)
    assert len(model.trees) == 4
    assert np.allclose(model.margins(model.binned(x)), margin, atol=1e-5)


def test_many_models_at_once_are_the_models_alone(planted):
    fits = [Fit(F.col("y"), roles(0), True, PARAMS), Fit(F.col("v"), roles(1), False, replace(PARAMS, n_estimators=6, max_depth=3, seed=7)), Fit(F.col("y"), F.when(F.col("id") < 300, TRAINS), True, replace(PARAMS, n_estimators=3))]
    together = boost(planted, fits, "features")
    alone = [boost(planted.repartition(5, "id"), [f], "features")[0] for f in fits]  # however the rows lie
    assert all(same(a, b) for a, b in zip(together, alone, strict=True))
    assert len(together[2].trees) == 3 and not together[2].losses


def test_the_best_round_is_what_a_full_training_gives(planted):
    fit = Fit(F.col("y"), roles(0), True, PARAMS)
    [stopped] = boost(planted, [fit], "features")
    best = len(stopped.trees)
    assert 0 < best < 30 and len(stopped.losses) == best + PARAMS.patience + 1  # patience acted
    assert stopped.losses[best] == min(stopped.losses)
    [full] = boost(planted.filter("fold <> 0"), [replace(fit, role=F.lit(TRAINS), params=replace(PARAMS, n_estimators=best))], "features")
    # The limits come from other rows, so only the size and quality are the same.
    assert len(full.trees) == best
    [again] = boost(planted, [replace(fit, role=F.when(F.col("fold") != 0, TRAINS), params=replace(PARAMS, n_estimators=best))], "features")
    assert same(stopped, again)
    valid = planted.filter("fold = 0").withColumn("s", stopped.scores(planted.sparkSession, F.col("features"))).select("s", "y").collect()
    loss = -np.mean([np.log(r.s if r.y else 1 - r.s) for r in valid])
    assert abs(loss - min(stopped.losses)) < 1e-6 and loss < 0.6


def test_a_run_that_was_killed_goes_on_from_its_last_stored_round(spark, planted, monkeypatch):
    fits = [Fit(F.col("v"), F.lit(TRAINS), False, replace(PARAMS, n_estimators=13))]
    path = scratch_path(spark, "run")
    plain, jobs = boosting._job, []

    def killed(*args, **how):
        jobs.append(1)
        if len(jobs) > 22:
            raise KeyboardInterrupt
        return plain(*args, **how)

    monkeypatch.setattr(boosting, "_job", killed)
    with pytest.raises(KeyboardInterrupt):
        boost(planted, fits, "features", path)
    monkeypatch.setattr(boosting, "_job", lambda *a, **h: jobs.append(1) or plain(*a, **h))
    jobs.clear()
    [resumed] = boost(planted, fits, "features", path)
    assert len(jobs) < 14  # five of thirteen rounds
    monkeypatch.undo()
    assert same(resumed, boost(planted, fits, "features")[0])
    with pytest.raises(ValueError, match="other settings"):
        boost(planted, [replace(fits[0], params=PARAMS)], "features", path)


def test_no_rows_one_class_and_nothing_to_split(spark, planted):
    [none] = boost(planted.limit(0), [Fit(F.col("y"), F.lit(TRAINS), True, PARAMS)], "features")
    assert none.trees == []
    one, few, unlabelled = boost(
        planted,
        [Fit(F.lit(1), F.lit(TRAINS), True, PARAMS), Fit(F.col("v"), F.when(F.col("id") < 5, TRAINS), False, PARAMS), Fit(F.lit(None).cast("double"), F.lit(None).cast("int"), False, PARAMS)],
        "features",
    )
    assert few.trees == [] and unlabelled.trees == []
    assert all(s > 0.999 for s in one.link(one.margins(one.binned(np.zeros((3, 5))))))


def test_features_with_few_bins_are_counted_together():
    rng = np.random.default_rng(3)
    sizes = [2, 1, 32, 2, 7, 32, 1, 3, 200, 2, 5]
    codes = boosting._codes([np.arange(s - 1.0) for s in sizes])
    assert sorted(f for c in codes for f in c.features) == list(range(len(sizes)))
    assert len(codes) == 3 and all(c.size <= boosting.CODES for c in codes)  # instead of one for each of eleven
    bins = np.stack([rng.integers(0, s, 500) for s in sizes], axis=1).astype(np.uint8)
    node, rows = rng.integers(0, 3, 400), np.sort(rng.permutation(500)[:400])
    gradient, hessian = rng.integers(-9, 9, 400).astype(float), rng.integers(1, 9, 400).astype(float)
    columns = np.array([0, 2, 4, 6, 8, 10])
    got, want = np.zeros((3, 3, len(columns), 200)), np.zeros((3, 3, len(columns), 200))
    boosting._count(got, codes, boosting._coded(bins, codes).T, columns, node, rows, gradient, hessian)
    for i, r in enumerate(rows):
        for place, f in enumerate(columns):
            want[:, node[i], place, bins[r, f]] += (gradient[i], hessian[i], 1)
    assert np.array_equal(got, want)


def test_rows_end_where_the_tree_leads_them():
    rng = np.random.default_rng(5)
    tree = boosting.Tree.empty(3)
    tree.feature[[0, 1, 2, 6]], tree.bin[[0, 1, 2, 6]] = [1, 0, 1, 2], [4, 2, 7, 0]
    bins = rng.integers(0, 10, (200, 3)).astype(np.uint8)

    def walk(row, node=0):
        f = tree.feature[node]
        return node if f < 0 else walk(row, 2 * node + 1 + int(row[f] > tree.bin[node]))

    assert tree.nodes(bins).tolist() == [walk(r) for r in bins]
    assert boosting.Tree.empty(2).nodes(bins).tolist() == [0] * 200


def test_rows_are_stored_by_pieces(spark, planted, monkeypatch):
    fits = [Fit(F.col("y"), roles(0), True, replace(PARAMS, n_estimators=10)), Fit(F.col("v"), F.lit(TRAINS), False, replace(PARAMS, n_estimators=10))]
    together = boost(planted, fits, "features")
    monkeypatch.setattr(boosting, "PIECE", 500)
    path = scratch_path(spark, "run")
    assert all(same(a, b) for a, b in zip(together, boost(planted.coalesce(1), fits, "features", path), strict=True))
    for round_ in (0, 8):
        stored = spark.read.parquet(f"{path}/rows-{round_}").collect()
        assert sorted(len(r.roles) // 2 for r in stored) == [200, 500, 500]  # instead of 1200 rows


def test_hessians_and_rows_counted_as_one_number_or_apart_are_the_same():
    rng = np.random.default_rng(7)
    codes = boosting._codes([np.arange(s - 1.0) for s in (4, 1, 7, 2, 3)])
    bins = np.stack([rng.integers(0, s, 3000) for s in (4, 1, 7, 2, 3)], axis=1).astype(np.uint8)
    coded, columns = boosting._coded(bins, codes).T, np.arange(5)
    node, rows = rng.integers(0, 2, 3000), np.arange(3000)
    gradient, hessian = rng.integers(-(2**24), 2**24, 3000).astype(float), rng.integers(0, 2**22, 3000).astype(float)
    one, apart = np.zeros((3, 2, 5, 7)), np.zeros((3, 2, 5, 7))
    boosting._count(one, codes, coded, columns, node, rows, gradient, hessian)
    hessian[0] += 2.0**50  # too much for one number
    boosting._count(apart, codes, coded, columns, node, rows, gradient, hessian)
    for f in range(5):
        apart[1, node[0], f, bins[0, f]] -= 2.0**50
    assert np.array_equal(one, apart) and one[2].sum() == 5 * 3000
    column = boosting._columns(coded, codes)
    assert all(np.array_equal(column(f), bins[:, f]) for f in range(5))


def test_labels_are_missing_or_stand_at_few_rows(spark, planted):
    few = F.when(F.col("id") % 40 == 0, STOPS).when(F.col("id") % 10 == 1, TRAINS)  # only these rows are looked at
    gaps = F.when(F.col("id") % 3 > 0, F.col("v"))
    for label, role, binary in ((F.col("y"), few, True), (gaps, F.lit(TRAINS), False)):
        p = replace(PARAMS, n_estimators=3)
        [model] = boost(planted, [Fit(label, role, binary, p)], "features")
        mean = planted.filter(role == TRAINS).agg(F.avg(label)).first()[0]
        assert abs(model.base - (np.log(mean / (1 - mean)) if binary else mean)) < 1e-5 and model.trees
