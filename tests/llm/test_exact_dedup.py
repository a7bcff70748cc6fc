import hashlib

from pyspark.sql import functions as F

from tidemark.llm.exact_dedup import drop_duplicates, exact_duplicates

ROWS = [(1, "a", "x"), (2, "b", "y"), (3, "a", "z"), (4, None, "n"), (5, "", "e"), (6, "c" * 100_000, "l"), (7, "c" * 100_000, "l"), (8, "a ", "w"), (3, "a", "z"), (None, "b", "q"), (None, "only", "q")]
SCHEMA = "doc_id bigint, text string, `__key` string"


def brute(rows, largest):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t, *_ in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = (max if largest else min)(ids) if ids else None
        out.append((i, keep, len(groups[t or ""]), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    for keep in ("smallest", "largest"):
        got = [tuple(r) for r in exact_duplicates(docs, keep=keep).collect()]
        assert sorted(got, key=str) == brute(ROWS, keep == "largest")


def test_hot_group_spans_partitions(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"))
    rows = exact_duplicates(docs.repartition(8), keep="largest")
    hot = rows.filter("group_size > 1").agg(F.count("*"), F.min("keep_id"), F.max("keep_id"), F.max("group_size"), F.sum(F.col("kept").cast("int"))).first()
    assert tuple(hot) == (1000, 2997, 2997, 1000, 1)
    left = drop_duplicates(docs.repartition(8), keep="largest")
    assert left.count() == 2001 and left.filter("text = 'hot'").first().doc_id == 2997


def test_dropped_rows_keep_columns(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    left = drop_duplicates(docs, keep="smallest")
    assert left.columns == docs.columns
    assert sorted(((r.text or "", r.doc_id) for r in left.collect()), key=str) == sorted([("a", 1), ("b", 2), ("", 4), ("c" * 100_000, 6), ("a ", 8), ("only", None)], key=str)


def test_normalised_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "A b"), (2, "a B")], "doc_id bigint, text string")
    assert drop_duplicates(docs, normalised=F.lower("text")).count() == 1
    assert exact_duplicates(docs.limit(0)).count() == 0 and drop_duplicates(docs.limit(0)).count() == 0
