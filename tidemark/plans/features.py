"""The wide feature table: cohort of the snapshot, behaviour roll-up, gates and outlier filter."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.expressions import frequency_per_4_weeks, gated, or_zero, safe_divide
from tidemark.operators.cohorts import active_cohort, conversion_cohort, in_entity, within_usual_range
from tidemark.operators.dedup import dedup_latest
from tidemark.operators.flatten import FEATURE_PATHS, KEYS, STAGE_PATHS, flatten_features
from tidemark.params import RunParams
from tidemark.sources.profile import behaviour_profile, id_map
from tidemark.sources.profile_store import profile_from_store, update_store
from tidemark.sources.snapshot import customer_snapshot

# Roll-up column -> field of the behaviour profile; each takes the largest value over a customer's profiles (fixed values).
ROLLUP_MAX = {
    "order_rate_online_payment_l04w": "order_attributes.online_payment_order_rate_last_4_weeks",
    "visit_vendors_viewed_l04w": "visit_attributes.unique_vendors_viewed_last_4_weeks",
    "visit_vendors_available_l04w": "visit_attributes.avg_unique_vendors_available_last_4_weeks",
    "visit_addresses_unique_l04w": "visit_attributes.unique_addresses_used_last_4_weeks",
    "visit_count_l04w": "visit_attributes.visits_last_4_weeks",
    "visit_count_l12w": "visit_attributes.visits_last_12_weeks",
    "visit_session_dur_sum_l04w": "visit_attributes.session_duration_last_4_weeks",
    "visit_interact_speed_avg_l04w": "visit_attributes.avg_interaction_speed_last_4_weeks",
    "visit_cart_abandon_rate_l04w": "visit_attributes.abandoned_cart_rate_last_4_weeks",
    "visit_search_fail_rate_l04w": "visit_attributes.search_fail_rate_last_4_weeks",
    "visit_voucher_error_rate_l04w": "visit_attributes.voucher_error_rate_last_4_weeks",
    "rating_avg_l04w": "order_attributes.avg_ordered_vendors_rating_last_4_weeks",
    "aos_score_last": "order_attributes.last_after_order_survey_response_score",
    "aos_rating_last": "order_attributes.last_after_order_survey_response_avg_rating",
    "ccc_sessions_l04w": "customer_cc_interactions.total_cc_sessions_last_4_weeks",
}

ZERO_FILLED = ("visit_vendors_viewed_l04w", "visit_addresses_unique_l04w", "visit_count_l04w", "visit_count_l12w")
ACTIVE_ONLY = (
    "order_rate_online_payment_l04w",
    "visit_voucher_error_rate_l04w",
    "rating_avg_l04w",
    "aos_score_last",
    "aos_rating_last",
)
AS_IS = (
    "visit_vendors_available_l04w",
    "visit_count_l04w_vs_l12w",
    "visit_session_dur_sum_l04w",
    "visit_interact_speed_avg_l04w",
    "visit_cart_abandon_rate_l04w",
    "visit_search_fail_rate_l04w",
)


def profile_snapshot(profile: DataFrame, day: dt.date) -> DataFrame:
    """One calculation day; on date-partitioned storage this prunes to a single partition."""
    return profile.filter(F.col("calculation_date") == F.lit(day))


def map_profiles(profile: DataFrame, mapping: DataFrame) -> DataFrame:
    """Attach the customer key; both sides are unique per external id, so no key is hot."""
    return profile.join(mapping, ["global_entity_id", "external_id"], "inner")


def profile_rollup(mapped: DataFrame) -> DataFrame:
    """One row per customer; profiles that never saw an order do not count."""
    values = [F.max(path).alias(name) for name, path in ROLLUP_MAX.items() if name != "ccc_sessions_l04w"]
    sessions = or_zero(F.max(ROLLUP_MAX["ccc_sessions_l04w"])).alias("ccc_sessions_l04w")
    rolled = (
        mapped.filter(F.col("order_attributes.first_order_timestamp").isNotNull())
        .groupBy(*KEYS)
        .agg(F.min("order_attributes.first_order_timestamp").alias("first_order_timestamp"), *values, sessions)
    )
    return rolled.select(
        "*",
        safe_divide("visit_count_l04w", "visit_count_l12w").alias("visit_count_l04w_vs_l12w"),
        safe_divide("visit_session_dur_sum_l04w", "visit_count_l04w").alias("visit_session_dur_avg_l04w"),
    )


def _frequency() -> Column:
    return frequency_per_4_weeks("order_count_lifetime_vert_qc", "days_since_first_order_vert_qc")


def attach_behaviour(cohort: DataFrame, rolled: DataFrame, fix_session_avg: bool = False) -> DataFrame:
    """Left join on the customer key; cohort columns stay as they are.

    `visit_session_dur_avg_l04w` carries the zero-filled *sum* unless `fix_session_avg` asks for the
    real average.
    """
    if "order_freq_4w_vert_qc" not in cohort.columns:
        cohort = cohort.withColumn("order_freq_4w_vert_qc", _frequency())
    active = F.col("order_count_l04w_vert_rs")
    average = F.col("visit_session_dur_avg_l04w") if fix_session_avg else F.col("visit_session_dur_sum_l04w")
    joined = cohort.join(rolled.drop("first_order_timestamp"), list(KEYS), "left")
    return joined.select(
        *[F.col(c) for c in cohort.columns],
        *[F.col(c) for c in AS_IS],
        *[or_zero(c).alias(c) for c in ZERO_FILLED],
        F.coalesce(average, F.lit(0.0)).alias("visit_session_dur_avg_l04w"),
        *[gated(active, c).alias(c) for c in ACTIVE_ONLY],
        gated(active, "ccc_sessions_l04w", otherwise=0).alias("ccc_sessions_l04w"),
    )


def behaviour(spark: SparkSession, directory: str, run: RunParams, store: str | None = None) -> DataFrame:
    """Rolled-up profiles of the snapshot day; with `store`, from its daily states, after adding the days it lacks."""
    if store is not None:
        update_store(spark, directory, store, run.profile_day)
        daily = profile_from_store(spark, directory, store, run.profile_day)
    else:
        daily = behaviour_profile(spark, directory, [run.profile_day])
    profile = profile_snapshot(daily, run.profile_day)
    if run.entity is not None:
        profile = profile.filter(in_entity(run.entity))
    return profile_rollup(map_profiles(profile, id_map(spark, directory)))


def active_features(spark: SparkSession, directory: str, run: RunParams) -> DataFrame:
    """Flat cohort rows before behaviour is attached."""
    snapshot = customer_snapshot(spark, directory, run.as_of, run.entity, FEATURE_PATHS)
    return flatten_features(snapshot, run.as_of).filter(
        active_cohort(F.col("first_order_date_vert_rs"), F.col("last_order_date_vert_rs"), run.as_of)
    )


# Needed by filters and roll-ups only, not part of the published table.
INTERNAL = ("last_order_date_vert_rs", "order_count_late_lifetime_vert_qc")
# Which copy of a customer is the latest.
RECENCY = ("last_order_date_vert_rs", "first_order_date_vert_dmart")


def assemble_features(snapshot: DataFrame, rolled: DataFrame, run: RunParams, fix_session_avg: bool = False,
                      dark_stores: bool = False) -> DataFrame:
    """Canonical feature table from a nested snapshot (unique per customer) and rolled-up profiles.

    Left unsorted: ordering belongs to the sink.
    """
    if run.entity is not None:
        snapshot, rolled = snapshot.filter(in_entity(run.entity)), rolled.filter(in_entity(run.entity))
    flat = flatten_features(snapshot, run.as_of, dark_stores=dark_stores)
    active = active_cohort(F.col("first_order_date_vert_rs"), F.col("last_order_date_vert_rs"), run.as_of)
    # every test reads cohort columns only, so rows leave before the join
    cohort = flat.withColumn("order_freq_4w_vert_qc", _frequency()).filter(active & within_usual_range())
    return attach_behaviour(cohort.drop(*INTERNAL), rolled, fix_session_avg)


def assemble_stage_features(snapshot: DataFrame, rolled: DataFrame, run: RunParams, strict: bool = False,
                            unique: bool = False) -> DataFrame:
    """Variant for the dark-store study: conversion cohort, local-store columns, no coverage filter.

    A stored snapshot may repeat customers; of each the copy with the latest order stays. Copies are compared as flat
    rows, so fields of the snapshot that no feature reads are neither scanned nor shuffled. `unique`: it has no copies.
    """
    if run.entity is not None:
        snapshot, rolled = snapshot.filter(in_entity(run.entity)), rolled.filter(in_entity(run.entity))
    flat = flatten_features(snapshot, run.as_of, local_stores=True, dark_stores=True)
    if not unique:
        flat = dedup_latest(flat, KEYS, RECENCY)
    moved = conversion_cohort(
        F.col("first_order_date_vert_rs"),
        F.col("last_order_date_vert_rs"),
        F.col("first_order_date_vert_dmart"),
        run.as_of,
        strict=strict,
    )
    usual = within_usual_range(require_coverage=False)
    cohort = flat.withColumn("order_freq_4w_vert_qc", _frequency()).filter(moved & usual)
    return attach_behaviour(cohort.drop(*INTERNAL), rolled)


def feature_table(spark: SparkSession, directory: str, run: RunParams, fix_session_avg: bool = False,
                  dark_stores: bool = False) -> DataFrame:
    snapshot = customer_snapshot(spark, directory, run.as_of, run.entity, FEATURE_PATHS)
    return assemble_features(snapshot, behaviour(spark, directory, run), run, fix_session_avg, dark_stores)


def stage_feature_table(spark: SparkSession, directory: str, run: RunParams, strict: bool = False) -> DataFrame:
    snapshot = customer_snapshot(spark, directory, run.as_of, run.entity, STAGE_PATHS)
    # an aggregate by customer has one row of each
    return assemble_stage_features(snapshot, behaviour(spark, directory, run), run, strict, unique=True)
