import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import radix

P = [0.0, 0.1, 0.333, 0.5, 0.9, 0.99, 1.0]


def columns():
    rng = np.random.default_rng(2)
    n = 4000
    return {
        "spread": rng.normal(size=n) * 10.0 ** rng.integers(-200, 200, n),
        "close": 1000 + rng.random(n) * 1e-9,
        "few": rng.integers(-2, 3, n).astype(float),
        "hot": np.where(np.arange(n) % 3 == 0, 7.25, rng.normal(size=n)),
        "zeros": np.where(np.arange(n) % 2 == 0, -0.0, 0.0),
        "one": np.full(n, -3.5),
    }


@pytest.mark.parametrize("few_rows", [1 << 20, 10])
def test_exact_quantiles(spark, monkeypatch, few_rows):
    monkeypatch.setattr(radix, "FEW_ROWS", few_rows)  # 10: every step of bits is taken
    data = columns()
    df = spark.createDataFrame(list(zip(*(c.tolist() for c in data.values()), strict=True)), ", ".join(f"`{c}.x` double" for c in data)).repartition(5)
    got = radix.order_statistics(df, {f"{c}.x": P for c in data})
    for c, values in data.items():
        ordered = np.sort(values)
        for p, value in zip(P, got[f"{c}.x"], strict=True):
            at = p * (len(ordered) - 1)
            low, high = ordered[int(np.floor(at))], ordered[int(np.ceil(at))]
            assert value == low + (high - low) * (at - np.floor(at))


def test_nulls_and_no_values(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (float("nan"), None), (-5.0, None)], "a double, b double")
    a, b = radix.order_statistics(df, {"a": [0.0, 0.5, 1.0], "b": [0.5]}).values()
    assert a[:2] == [-5.0, 1.0] and np.isnan(a[2]) and b == [None]


def test_limits_do_not_depend_on_partitions_and_keep_equal_values_together(spark):
    df = spark.range(5000).select((F.col("id") % 97 / 7).alias("x"), (F.col("id") % 2).cast("double").alias("flag"), F.lit(1.0).alias("one"), F.lit(None).cast("double").alias("none"))
    one = radix.coarse_limits(df.repartition(1), df.columns, 16)
    many = radix.coarse_limits(df.repartition(7, "x"), df.columns, 16)
    assert all(np.array_equal(a, b) for a, b in zip(one, many, strict=True))
    assert len(one[0]) == 15 and len(one[1]) == 1 and 0 <= one[1][0] < 1 and len(one[2]) == 0 and len(one[3]) == 0
    parts = np.bincount(np.searchsorted(one[0], np.arange(5000) % 97 / 7))
    assert parts.min() > 200 and parts.max() < 450


def test_no_value_is_shuffled(spark):
    seen = []
    plain = type(spark.range(1)).toArrow

    class Spy:
        def __get__(self, df, _kind):
            seen.append(df._jdf.queryExecution().executedPlan().toString())
            return lambda: plain(df)

    frame = type(spark.range(1))
    try:
        frame.toArrow = Spy()
        radix.order_statistics(spark.range(100).select(F.col("id").cast("double").alias("x")), {"x": [0.5]})
    finally:
        frame.toArrow = plain
    assert len(seen) == 2
    for plan in seen:
        exchange = plan.index("Exchange hashpartitioning")
        assert "partial_sum" in plan[exchange:] and "MapInArrow" in plan[exchange:] and "Sort" not in plan
