import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import metrics, stats
from tidemark.operators.lookup import skew_safe_lookup
from tidemark.operators.ordering import average_rank, dense_index, quantiles
from tidemark.functions.hashing import portable_hash


def test_quantiles_interpolate(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (None,)], "v double")
    row = quantiles(df, "v", {"a": 0.333, "b": 0.0, "c": 1.0}).first()
    assert row["a"] == pytest.approx(1.999)
    assert (row["b"], row["c"]) == (1.0, 10.0)


def test_quantiles_hot_value_and_groups(spark):
    rng = random.Random(1)
    rows = [("a", 5.0 if rng.random() < 0.4 else rng.gauss(0, 3)) for _ in range(3000)]
    rows += [("b", rng.random()) for _ in range(500)] + [(None, 1.0), (None, 2.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: (r["q1"], r["q9"]) for r in quantiles(df, "v", {"q1": 0.1, "q9": 0.9}, ["g"]).collect()}
    pdf = pd.DataFrame(rows, columns=["g", "v"])
    for g in ("a", "b"):
        want = pdf[pdf.g == g].v.quantile([0.1, 0.9]).tolist()
        assert got[g] == pytest.approx(want)
    assert got[None] == pytest.approx((1.1, 1.9))


def test_average_rank_ties(spark):
    df = spark.createDataFrame([("a", 3.0), ("b", 3.0), ("c", 1.0), ("d", 9.0), ("e", None)], "k string, v double")
    got = {r["k"]: r["r"] for r in average_rank(df, "v", "r").collect()}
    assert got == {"d": 1, "a": 2, "b": 2, "c": 4, "e": None}  # 2.5 is cut to 2


def test_dense_index_is_a_numbering(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    got = sorted(r["i"] for r in dense_index(df, ["k"], portable_hash(1, "k"), "i").collect())
    assert got == list(range(1000))


def test_lookup_keeps_every_row(spark):
    """One key with most rows, NULL keys, unknown keys: same answer as a plain left join."""
    rows = [(i, 1 if i % 3 else i) for i in range(2000)] + [(5000 + i, None) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, k long")
    dim = df.filter("k is not null and k <> 9").groupBy("k").agg(F.count("*").alias("n")).withColumn("x", F.col("k") * 10)
    got = skew_safe_lookup(df, dim, ["k"], "n").orderBy("id").collect()
    want = df.join(dim.drop("n"), "k", "left").select("id", "k", "x").orderBy("id").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]


def brute_auc(y, s):
    pos, neg = [b for a, b in zip(y, s) if a], [b for a, b in zip(y, s) if not a]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_auc_ties_and_monotone_transform(spark):
    rng = random.Random(3)
    rows = [(int(rng.random() < 0.4), round(rng.random(), 2)) for _ in range(400)]
    df = spark.createDataFrame(rows, "y int, s double")
    got = metrics.roc_auc(df, "y", "s").first()[0]
    assert got == pytest.approx(brute_auc(*zip(*rows)), abs=5e-5)
    assert metrics.roc_auc(df.withColumn("s", F.exp(F.col("s") * 3)), "y", "s").first()[0] == got


def test_one_class_and_exact_half(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 1.0), (1, 0.0)], "y int, s double")
    row = metrics.binary_metrics(df, "y", "s").first()
    assert row["roc_auc"] is None
    assert row["recall"] == 0.3333  # 0.5 rounds to 0
    empty = metrics.binary_metrics(df.filter("y = 9"), "y", "s").first()
    assert empty["accuracy"] is None


def test_regression_metrics(spark):
    rng = np.random.default_rng(0)
    y, p = rng.random(201) + 0.5, rng.random(201)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p)], "y double, p double")
    row = metrics.regression_metrics(df, "y", "p").first()
    assert row["mse"] == round(float(np.mean((y - p) ** 2)), 4)
    assert row["mae"] == row["median_ae"] == round(float(np.median(np.abs(y - p))), 4)
    assert row["r2"] == round(float(1 - np.sum((y - p) ** 2) / np.sum((y - y.mean()) ** 2)), 4)
    assert row["mape"] == round(float(np.mean(np.abs((y - p) / y))), 4)
    constant = spark.createDataFrame([(0.0, -1.0), (0.0, 1.0)], "y double, p double")
    row = metrics.regression_metrics(constant, "y", "p").first()
    assert row["mape"] is None and row["r2"] is None and row["y_pred_lower_equal_0"] == 1


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (9.9,), (10.0,), (None,)], "v double")
    got = {r["bin"]: r["n"] for r in stats.histogram(df, ["v"], 5).collect()}
    assert got == {0: 2, 1: 0, 2: 0, 3: 0, 4: 2}
    same = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    assert sum(r["n"] for r in stats.histogram(same, ["v"], 4).collect()) == 2


def test_partitioning_does_not_matter(spark):
    df = spark.range(3000).select(((F.col("id") * 7919) % 1013).cast("double").alias("v"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    try:
        for n in ("1", "4", "17"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            results.append(tuple(quantiles(df.repartition(int(n)), "v", {"a": 0.123, "b": 0.9}).first()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(set(results)) == 1


def test_text_line(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.2), (1, 0.4)], "y int, s double")
    line = metrics.binary_metrics(df, "y", "s").select(metrics.binary_text()).first()[0]
    assert line.startswith("roc auc: 1.0000 | f1: 0.6667 | precision: 1.0000 | recall: 0.5000 | accuracy: 0.6667 | log loss: ")
