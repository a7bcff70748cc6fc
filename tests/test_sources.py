import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions.expressions import days_since
from tidemark.operators import flatten
from tidemark.operators.dedup import dedup_latest
from tidemark.params import TEST_RUN
from tidemark.plans import features
from tidemark.session import scratch_path
from tidemark.sources import readers, writers
from tidemark.sources.snapshot import customer_snapshot


def test_read_query_text_file_and_parameters(spark, tmp_path):
    spark.range(10).createOrReplaceTempView("numbers")
    assert readers.read_query(spark, "SELECT id FROM numbers WHERE id >= :low", {"low": 7}).count() == 3
    path = tmp_path / "q.sql"
    path.write_text("SELECT id, '2020-01-0' || id AS day FROM numbers WHERE id BETWEEN 1 AND 3")
    assert dict(readers.read_query(spark, str(path), dates=["day"]).dtypes)["day"] == "timestamp_ntz"


def test_unknown_type_is_a_plan_time_error(spark):
    with pytest.raises(ValueError, match="no engine type"):
        readers.apply_schema(spark.range(1), {"id": "ARRAY"})


def test_repair_is_all_or_nothing(spark):
    df = spark.createDataFrame([("1", "1", "2020-01-01", None), ("2", "x", "bad", None)],
                               "a string, b string, c_date string, d_date string")
    assert dict(readers.coerce_numeric(df).dtypes)["a"] == "double"
    assert dict(readers.coerce_numeric(df).dtypes)["b"] == "string"
    types = dict(readers.parse_dates(df).dtypes)
    assert types["c_date"] == "string" and types["d_date"] == "timestamp_ntz"


def test_rewriting_a_day_keeps_the_others(spark):
    path = scratch_path(spark, "test")
    df = spark.createDataFrame([("A", "1", 1), ("A", "2", 2), ("B", "1", 3)], "entity string, date string, v int")
    writers.save_partitioned(df, path, sort_by="v")
    writers.save_partitioned(df.filter("entity = 'A' and date = '2'").withColumn("v", F.lit(9)), path)
    assert sorted(r["v"] for r in spark.read.parquet(path).collect()) == [1, 3, 9]
    plan = spark.read.parquet(path).filter("entity = 'A'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(entity" in plan


def test_stored_snapshot_is_pruned_to_the_fields_read(spark, sf):
    path = scratch_path(spark, "snapshot")
    customer_snapshot(spark, sf, TEST_RUN.as_of).write.parquet(path)
    stored = spark.read.parquet(path)
    days = days_since("orders.restaurants.first_order.order_date", TEST_RUN.as_of)
    physical = flatten.flatten(stored, {"d": days})._jdf.queryExecution().sparkPlan().toString()
    schema = physical[physical.index("ReadSchema"):]
    assert "restaurants" in schema and "darkstores" not in schema and "location" not in schema
    from_store = features.assemble_features(stored, features.behaviour(spark, sf, TEST_RUN), TEST_RUN)
    live = features.feature_table(spark, sf, TEST_RUN)
    assert sorted(map(str, from_store.collect())) == sorted(map(str, live.collect()))


def test_hot_path_plans(spark, sf):
    plan = features.feature_table(spark, sf, TEST_RUN)._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "NestedLoop", "Python", "SortAggregate", "Window"):
        assert bad not in plan, bad


def test_dedup_has_a_total_order(spark):
    rows = [("e", 1, 1, 5), ("e", 1, 2, 6), ("e", 1, 2, 7), ("e", 2, 1, 1)]
    df = spark.createDataFrame(rows, "e string, c int, at int, seq int")
    for n in (1, 3):
        got = {tuple(r) for r in dedup_latest(df.repartition(n), ["e", "c"], ["at", "seq"]).collect()}
        assert got == {("e", 1, 2, 7), ("e", 2, 1, 1)}


def test_stage_features_take_the_latest_copy_and_read_only_their_fields(spark, sf):
    path = scratch_path(spark, "snapshot-copies")
    now = customer_snapshot(spark, sf, TEST_RUN.as_of)
    last = "restaurants.last_order.order_date"
    stale = now.withColumn("orders", F.col("orders").withField(last, F.date_sub(f"orders.{last}", 30)))
    now.unionByName(now).unionByName(stale).write.parquet(path)
    rolled = features.behaviour(spark, sf, TEST_RUN)
    got = features.assemble_stage_features(spark.read.parquet(path), rolled, TEST_RUN)
    want = features.stage_feature_table(spark, sf, TEST_RUN)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    scanned = {f.name for f in now.schema["orders"].dataType["darkstores"].dataType.fields}
    schema = got._jdf.queryExecution().sparkPlan().toString()
    assert any(name not in schema[schema.index("ReadSchema"):] for name in scanned)


def test_behaviour_gates_and_session_average(spark):
    cohort = spark.createDataFrame(
        [("e", 1, None, 3, 28), ("e", 2, 0, 0, None), ("e", 3, 1, 1, 0), ("e", 4, 1, 2, 56)],
        "global_entity_id string, analytical_customer_id long, order_count_l04w_vert_rs long, "
        "order_count_lifetime_vert_qc long, days_since_first_order_vert_qc int",
    )
    measures = [*features.ROLLUP_MAX, "visit_count_l04w_vs_l12w", "visit_session_dur_avg_l04w"]
    rolled = spark.createDataFrame(
        [("e", k, dt.datetime(2024, 1, 1), *[float(i + 1) for i in range(len(measures))]) for k in (1, 2, 3)],
        "global_entity_id string, analytical_customer_id long, first_order_timestamp timestamp_ntz, "
        + ", ".join(f"{m} double" for m in measures),
    )
    total = float(measures.index("visit_session_dur_sum_l04w") + 1)
    average = float(len(measures))
    got = {r["analytical_customer_id"]: r for r in features.attach_behaviour(cohort, rolled).collect()}
    assert [got[k]["rating_avg_l04w"] is None for k in (1, 2, 3, 4)] == [True, True, False, True]
    assert [got[k]["ccc_sessions_l04w"] for k in (1, 2, 3, 4)] == [0, 0, 15.0, None]
    assert [got[k]["order_freq_4w_vert_qc"] for k in (1, 2, 3, 4)] == [3.0, None, None, 1.0]
    assert [got[k]["visit_session_dur_avg_l04w"] for k in (1, 4)] == [total, 0.0]
    fixed = features.attach_behaviour(cohort, rolled, fix_session_avg=True).collect()
    assert {r["visit_session_dur_avg_l04w"] for r in fixed} == {average, 0.0}


def test_event_bounds_reach_the_scan(spark, sf):
    from tidemark.params import TEST_RUN
    from tidemark.plans.features import feature_table

    plan = feature_table(spark, sf, TEST_RUN)._jdf.queryExecution().toString()
    scans = [line for line in plan.split("== Physical Plan ==")[1].splitlines() if "events.parquet" in line]
    assert len(scans) == 1 and "GreaterThanOrEqual(ts," in scans[0] and "LessThan(ts," in scans[0]
    assert "Expand" not in plan.split("== Physical Plan ==")[1]


def test_stage_plan_keeps_one_row_of_a_repeated_customer(spark, sf):
    from tidemark.operators.flatten import STAGE_PATHS
    from tidemark.params import TEST_RUN
    from tidemark.plans.features import assemble_stage_features, behaviour
    from tidemark.session import durable
    from tidemark.sources.snapshot import customer_snapshot

    snapshot = durable(customer_snapshot(spark, sf, TEST_RUN.as_of, TEST_RUN.entity, STAGE_PATHS))
    rolled = durable(behaviour(spark, sf, TEST_RUN))
    once = assemble_stage_features(snapshot, rolled, TEST_RUN).count()
    assert once and assemble_stage_features(snapshot.union(snapshot), rolled, TEST_RUN).count() == once


def test_scratch_of_a_run_is_dropped_and_clusters_must_share(spark):
    from pathlib import Path
    from types import SimpleNamespace

    import pytest

    from tidemark import session

    with session.scratch_run(spark) as top:
        assert session.durable(spark.range(3)).count() == 3
        assert Path(top.removeprefix("file:")).exists()
    assert not Path(top.removeprefix("file:")).exists()
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None))
    with pytest.raises(RuntimeError, match="share"):
        session.shared_dir(cluster)
