import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from tidemark.params import TEST_RUN as RUN
from tidemark.plans import features
from tidemark.session import scratch_path
from tidemark.sources import profile_store
from tidemark.sources.profile import behaviour_profile

WEEK = dt.timedelta(days=7)


@pytest.fixture
def store(spark):
    return scratch_path(spark, "store")


def rows(df):
    return sorted(map(str, df.collect()))


def test_weekly_runs_equal_the_direct_profile_and_read_their_own_week(spark, sf, store):
    sf = sf.replace("0.001", "0.01")
    day = RUN.profile_day
    assert profile_store.stored_through(spark, store) is None
    for step in (2, 1):
        profile_store.update_store(spark, sf, store, day - step * WEEK)
        assert profile_store.stored_through(spark, store) == day - step * WEEK
        assert rows(profile_store.profile_from_store(spark, sf, store, day - step * WEEK)) == rows(behaviour_profile(spark, sf, [day - step * WEEK]))
    new = profile_store.missing_states(spark, sf, store, day)
    scan = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", new._jdf.queryExecution().executedPlan().toString()).group(1)
    assert f"GreaterThanOrEqual(ts,{day - WEEK + dt.timedelta(days=1)}T00:00)" in scan and f"LessThan(ts,{day + dt.timedelta(days=1)}T00:00)" in scan
    assert 1 <= new.select("event_date").distinct().count() <= 7
    # a week that was cut short is written again, and one that is there is not
    new.limit(1).write.partitionBy("event_date").parquet(f"{store}/_temporary/through={day}")
    profile_store.update_store(spark, sf, store, day)
    assert profile_store.missing_states(spark, sf, store, day) is None
    got = profile_store.profile_from_store(spark, sf, store, day)
    assert rows(got) == rows(behaviour_profile(spark, sf, [day])) and got.count() > 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*event_date", plan) and "Expand" not in plan


def test_a_gap_of_more_than_84_days_reads_84(spark, sf, store):
    day = RUN.profile_day
    profile_store.update_store(spark, sf, store, day - dt.timedelta(days=200))
    scan = profile_store.missing_states(spark, sf, store, day)._jdf.queryExecution().executedPlan().toString()
    assert f"GreaterThanOrEqual(ts,{day - dt.timedelta(days=83)}T00:00)" in scan


def test_roll_up_of_the_weekly_run(spark, sf, store):
    direct = features.behaviour(spark, sf, RUN)
    assert rows(features.behaviour(spark, sf, RUN, store)) == rows(direct)
    assert rows(features.behaviour(spark, sf, RUN, store).withColumn("x", F.lit(1)).drop("x")) == rows(direct)
