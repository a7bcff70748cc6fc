from pyspark.sql import functions as F

from tidemark.operators import columns, encoders, sampling, stats


def test_bin_rare_boundary(spark):
    rows = [("a",)] * 3 + [("b",)] * 2 + [(None,)] * 4
    got = encoders.bin_rare(spark.createDataFrame(rows, "c string"), ["c"], min_count=3)[0].collect()
    assert {(r["c"], r["c__min_count_3"]) for r in got} == {("a", "a"), ("b", "OTHER_HIGH_CARDINALITY"), (None, None)}
    assert len(got) == 9


def test_one_hot_share_idempotence_and_limit(spark):
    rows = [("a", i) for i in range(30)] + [("b", i + 100) for i in range(2)] + [(None, i + 500) for i in range(568)]
    df = spark.createDataFrame(rows, "c string, id long")
    out, names = encoders.one_hot(df, ["c", "id"], min_share=0.05)
    assert names == ["ft_c__one_hot__a"]  # exactly 30 of 600; id has more than 500 values
    again, _ = encoders.one_hot(out, ["c"], min_share=0.05)
    assert again.columns == out.columns
    assert out.agg(F.sum("ft_c__one_hot__a"), F.count("ft_c__one_hot__a")).first()[:] == (30, 600)


def test_label_order(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("a",), (None,)], "c string")
    got = {r["c"]: r["ft_c__label"] for r in encoders.label_encode(df, ["c"])[0].collect()}
    assert got == {"a": 0, "b": 1, "c": 2, None: None}


def test_select_and_prefixes(spark):
    df = spark.createDataFrame([(1, 2.0, "x")], "b_vert_rs int, a_vert_rs double, c_vert_rs string")
    assert columns.select_features(df, "number", ["vert_rs"]) == ["a_vert_rs", "b_vert_rs"]
    assert columns.select_features(df, None, ["vert_rs"], ["c_"]) == ["a_vert_rs", "b_vert_rs"]
    assert columns.name_prefixes(["visits_past_4w", "gmv_nv_x", "z"]) == ["gmv_", "visits_", "z"]


def test_splits(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 10 == 0).cast("int").alias("y"))
    exact = sampling.split_exact(df, ["k"], "y")
    assert {(r["y"], r["n"]) for r in exact.filter("split = 'valid'").groupBy("y").agg(F.count("*").alias("n")).collect()} == {
        (0, 180),
        (1, 20),
    }
    folds = sampling.assign_folds(df, ["k"])
    assert {r["fold"] for r in folds.select("fold").distinct().collect()} == {0, 1, 2, 3, 4}
    assert sampling.hash_sample(df, ["k"], 37).count() == 37
    under = sampling.undersample(df, "y", ["k"], 0.1, 5)
    split_union = df.filter("y = 1").unionByName(sampling.undersample(df.filter("y = 0"), "y", ["k"], 0.1, 5))
    assert under.exceptAll(split_union).count() == 0 and under.count() == split_union.count()


def test_distinct_counts_ignore_null(spark):
    df = spark.createDataFrame([("a",), (None,), ("b",), ("a",)], "c string")
    assert stats.distinct_counts(df, ["c"]).first()[:] == ("c", 2)
