"""A store of daily behaviour states, so that a weekly run reads the events of its own week only.

The store has one folder for each run, `through=<day>`, and in it one for each day of events. A run writes the days after
the last stored one; a run that is cut short leaves nothing behind and writes the same folder when it is repeated. The
profile of any day merges the states of the 84 days before it, and equals the one computed from the events themselves.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tidemark.sources.profile import daily_states, events_between, profile_of_states

DAYS = 84  # that a profile looks back
_SCHEMA = "external_id bigint, k bigint, last_ts timestamp_ntz, first_purchase timestamp_ntz, n bigint, cents bigint, view bigint, click bigint, purchase bigint, error bigint, through date, event_date date"


def stored_through(spark: SparkSession, path: str) -> dt.date | None:
    """The last day that the store covers."""
    try:
        return spark.read.schema(_SCHEMA).parquet(path).agg(F.max("through")).first()[0]
    except AnalysisException:
        return None


def missing_states(spark: SparkSession, directory: str, path: str, day: dt.date) -> DataFrame | None:
    """States of the days up to `day` that the store does not cover (of the 84 days before `day`, if it is new)."""
    last = stored_through(spark, path)
    first = day - dt.timedelta(days=DAYS - 1) if last is None else max(last + dt.timedelta(days=1), day - dt.timedelta(days=DAYS - 1))
    return None if first > day else daily_states(events_between(spark, directory, first, day))


def update_store(spark: SparkSession, directory: str, path: str, day: dt.date) -> None:
    """Bring the store up to `day`."""
    new = missing_states(spark, directory, path, day)
    if new is not None:
        new.write.mode("overwrite").partitionBy("event_date").parquet(f"{path}/through={day}")


def profile_from_store(spark: SparkSession, directory: str, path: str, day: dt.date) -> DataFrame:
    """The behaviour profile of `day`, from the days in the store alone (and the customers' entities)."""
    bounds = F.col("event_date").between(F.lit(day - dt.timedelta(days=DAYS - 1)), F.lit(day))
    states = spark.read.schema(_SCHEMA).parquet(path).filter(bounds)
    return profile_of_states(spark, directory, states, [day])
