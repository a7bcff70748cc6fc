"""The sampling experiment, its stored scores recomputed by plain SQL."""

from dataclasses import replace

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.functions.hashing import portable_hash
from tidemark.operators import models
from tidemark.plans import experiment
from tidemark.session import durable, scratch_path

PARAMS = replace(models.STEADY, n_estimators=3, max_depth=2, min_child_samples=5)


@pytest.fixture(scope="module")
def rows(spark):
    made = spark.range(600).select("id", *[(portable_hash(k, "id") % 1000 / 1000).alias(c) for k, c in enumerate("abc")])
    made = made.withColumn("y", ((F.col("a") + F.col("b") > 1.2) != (portable_hash(5, "id") % 8 == 0)).cast("int"))
    return durable(made.select("*", F.when(F.col("id") % 50 != 0, 59 + F.col("b") / 2).alias("cust_lat"), F.when(F.col("id") % 50 != 0, 18 + F.col("c") / 2).alias("cust_long")))


def test_simulation_goes_on_and_equals_sql_over_its_scores(spark, rows, monkeypatch):
    monkeypatch.setattr(experiment, "GROUP", 4)
    path = scratch_path(spark, "simulation")
    plain, calls = models.BoostedTrees.fit_many, []

    def once(self, *args):
        calls.append(1)
        if len(calls) == 2:
            raise KeyboardInterrupt
        return plain(self, *args)

    monkeypatch.setattr(models.BoostedTrees, "fit_many", once)
    how = dict(seeds=3, fractions=(0.3, 0.9), path=path)
    with pytest.raises(KeyboardInterrupt):
        experiment.simulate_scores(rows, ["id"], "y", ["a", "b", "c"], PARAMS, **how)
    scores = experiment.simulate_scores(rows, ["id"], "y", ["a", "b", "c"], PARAMS, **how)
    assert len(calls) == 3  # the first group was not learned again
    runs = durable(experiment.recall_by_run(scores, "y"))
    sql = f"""SELECT fraction, seed, count(*) FILTER (y = 0 AND score <= 0.5) AS tn, count(*) FILTER (y = 0 AND score > 0.5) AS fp,
        count(*) FILTER (y = 1 AND score <= 0.5) AS fn, count(*) FILTER (y = 1 AND score > 0.5) AS tp
        FROM read_parquet('{path}/scores-*/*.parquet') GROUP BY 1, 2"""
    want = duckdb.sql(sql).fetchall()
    got = [tuple(r)[:6] for r in runs.collect()]
    assert sorted(got) == sorted(want) and len(got) == 6
    # all positives of the validation part are in every sample, negatives by fraction, one sample inside the other
    assert len({fn + tp for _, _, _, _, fn, tp in got}) == 1
    ids = {(f, s): {r.id for r in scores.filter((F.col("fraction") == f) & (F.col("seed") == s)).collect()} for f in (0.3, 0.9) for s in range(3)}
    assert all(ids[0.3, s] < ids[0.9, s] for s in range(3)) and ids[0.3, 0] != ids[0.3, 1]
    mean = duckdb.sql(f"SELECT fraction, count(*), round(avg(r), 6), round(avg(r) - 1.96 * stddev_pop(r) / sqrt(count(*)), 6) FROM (SELECT fraction, tp / (tp + fn) AS r FROM ({sql})) GROUP BY 1").fetchall()
    found = sorted(tuple(r)[:4] for r in experiment.recall_interval(runs).collect())
    assert len(found) == 2 and all(a == pytest.approx(b, abs=1e-6) for a, b in zip(found, sorted(mean), strict=True))


def test_experiment_from_features_to_intervals(spark, rows):
    path = scratch_path(spark, "experiment")
    run = experiment.run_experiment(
        rows, ["id"], "y", ["a"], PARAMS, cluster="cluster_kmeans_4", fraction=0.5, seeds=2, fractions=(0.5,), path=path,
        sizes=(4,), cluster_sizes=(5,), min_samples=8, radius=0.1, radii=(0.05,),
    )
    assert {"cluster_kmeans_4", "cluster_5", "outlier_score_5", "density_count_radius_0.05"} <= set(run.frame.columns)
    assert run.frame.count() == 588  # rows without coordinates have no place
    scored = {r.id: (r.y, r.score) for r in run.scores.collect()}
    places = {r.id: r for r in run.frame.collect()}
    for r in run.clusters.collect():
        mine = [(places[i].cust_lat, y, s) for i, (y, s) in scored.items() if places[i].cluster_kmeans_4 == r.cluster_kmeans_4]
        assert r.cust_lat == pytest.approx(sum(m[0] for m in mine) / len(mine), abs=1e-6)
        assert r.mean_score == pytest.approx(sum(m[2] for m in mine) / len(mine), abs=1e-6)
        hits, pos = sum(y == 1 and round(s) == 1 for _, y, s in mine), sum(y for _, y, _ in mine)
        assert r.recall == (pytest.approx(hits / pos, abs=1e-4) if 0 < pos < len(mine) else None)
    assert run.runs.count() == 2 and run.intervals.first().runs == 2
    assert {r.target for r in run.quality.collect()} == {"model", "benchmark"}
