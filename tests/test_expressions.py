import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import expressions as x
from tidemark.functions.hashing import portable_hash, uniform
from tidemark.operators import cohorts, flatten, targets

D = dt.date


def values(df, expr):
    return [r[0] for r in df.select(expr.alias("v")).collect()]


def test_safe_divide(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (None, 2), (2, None), (1, 4)], "a long, b long")
    assert values(df, x.safe_divide("a", "b")) == [None, None, None, None, 0.25]


def test_strict_least_and_first_voucher(spark):
    rows = [
        (D(2020, 1, 1), None, 5.0, None),
        (None, D(2020, 1, 2), None, 7.0),
        (D(2020, 1, 1), D(2020, 1, 2), 5.0, 7.0),
        (D(2020, 1, 3), D(2020, 1, 2), 5.0, 7.0),
        (D(2020, 1, 2), D(2020, 1, 2), 5.0, 7.0),
        (None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "dm date, ls date, dv double, lv double")
    assert values(df, x.least_strict("dm", "ls")) == [None, None, D(2020, 1, 1), D(2020, 1, 2), D(2020, 1, 2), None]
    assert values(df, x.earlier_vertical_value("dm", "dv", "ls", "lv")) == [None, None, 5.0, 7.0, 7.0, None]
    assert values(df, x.least_of_array(F.array("dm", "ls")))[0] == D(2020, 1, 1)


def test_gate_and_clip(spark):
    df = spark.createDataFrame([(None, 3.0), (0, 3.0), (1, 3.0), (1, None)], "n long, v double")
    assert values(df, x.gated("n", "v")) == [None, None, 3.0, None]
    assert values(df, x.gated("n", "v", otherwise=0)) == [0.0, 0.0, 3.0, None]
    assert values(df, x.clip("v", 0.0, 2.0)) == [2.0, 2.0, 2.0, None]


def test_dates(spark):
    df = spark.createDataFrame([(D(2021, 7, 1),), (D(2021, 7, 4),), (None,)], "d date")
    assert values(df, x.days_since("d", D(2021, 7, 5))) == [4, 1, None]
    assert values(df, x.day_of_week("d")) == [5, 1, None]
    assert values(df, x.week_anchor("d")) == [D(2021, 6, 27), D(2021, 6, 27), None]


def test_clean_names(spark):
    df = spark.createDataFrame([("ft_a__count__fillna_-1",), ("plain",)], "n string")
    assert values(df, x.clean_feature_name("n")) == ["a__count", "plain"]


def test_portable_hash(spark):
    df = spark.createDataFrame([(17,)], "k long")
    assert values(df, portable_hash(42, "k")) == [2470515424]
    assert 0 <= values(df, uniform(42, "k"))[0] < 1


def test_targets(spark):
    rows = [(2, None), (2, 0.0), (2, 5.0), (2, -1.0), (0, 5.0), (0, None), (None, 0.0)]
    df = spark.createDataFrame(rows, "c long, v double")
    assert values(df, targets.organic(F.col("c"), F.col("v"))) == [1, 1, 0, None, None, None, None]
    assert values(df, targets.general(F.col("c"))) == [1, 1, 1, 1, 0, 0, 0]


AS_OF = D(2021, 7, 2)  # yesterday is July 1


@pytest.mark.parametrize(
    ("first", "last", "kept"),
    [
        (D(2021, 6, 16), D(2021, 6, 30), True),
        (D(2021, 6, 17), D(2021, 6, 30), False),
        (D(2020, 1, 1), D(2021, 1, 2), False),
        (D(2020, 1, 1), D(2021, 1, 3), True),
    ],
)
def test_active_cohort_boundaries(spark, first, last, kept):
    df = spark.createDataFrame([(first, last)], "f date, l date")
    assert (df.filter(cohorts.active_cohort(F.col("f"), F.col("l"), AS_OF)).count() == 1) is kept


def test_conversion_cohort_precedence(spark):
    old = (D(2015, 1, 1), D(2015, 2, 1), None)
    moved = (D(2021, 1, 1), D(2021, 3, 1), D(2021, 4, 1))
    recent = (D(2021, 6, 1), D(2021, 6, 20), D(2021, 6, 25))
    df = spark.createDataFrame([old, moved, recent], "f date, l date, d date")
    def kept(strict):
        test = cohorts.conversion_cohort(F.col("f"), F.col("l"), F.col("d"), AS_OF, strict=strict)
        return {r["f"] for r in df.filter(test).collect()}
    assert kept(False) == {old[0], moved[0]}
    assert kept(True) == {moved[0]}


def test_value_population(spark):
    until = D(2021, 6, 27)
    rows = [(2, D(2021, 5, 29), 1.0), (2, D(2021, 5, 30), 1.0), (2, D(2021, 5, 29), None), (1, None, 1.0), (0, None, None)]
    df = spark.createDataFrame(rows, "c long, f date, t double")
    got = values(df, cohorts.value_population(F.col("c"), F.col("f"), F.col("t"), until))
    assert got == ["train", None, None, "predict", "predict"]


def test_required_values_fail_loudly(spark):
    df = spark.createDataFrame([(1, None)], "c long, v double")
    with pytest.raises(Exception, match="missing v"):
        cohorts.require_values(df, "c", "v").collect()


def test_rollup_needs_no_self_join(spark, sf):
    from tidemark.params import TEST_RUN
    from tidemark.sources.snapshot import customer_snapshot

    snapshot = customer_snapshot(spark, sf, TEST_RUN.as_of, paths=("*.first_order.order_date", "*.lifetime.*"))
    ours = flatten.flatten(snapshot, flatten.qc_rollup_columns())
    pooled = flatten.flatten(snapshot, {"n": flatten.qc_rollup_columns()["order_count_lifetime_vert_qc"]})
    joined = snapshot.select(*flatten.KEYS).join(pooled, list(flatten.KEYS), "left")
    assert ours.count() == joined.count()
    assert ours.agg(F.sum("order_count_lifetime_vert_qc")).first()[0] == joined.agg(F.sum("n")).first()[0]
