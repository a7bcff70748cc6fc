"""Event stream table -> daily states, behaviour profile, id map and visit record."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.expressions import safe_divide
from tidemark.sources.tables import customers_with_entity, table

CENTS = 100.0


def events(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "events").select(
        F.col("user_id").alias("external_id"),
        F.col("ts"),
        F.to_date("ts").alias("event_date"),
        "event_type",
        F.round(F.col("value") * 100).cast("bigint").alias("value_cents"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )


def events_between(spark: SparkSession, directory: str, first: dt.date, last: dt.date) -> DataFrame:
    """Events of whole days. The bounds are literals on the stored column, so the scan skips what lies outside."""
    bounds = [F.lit(str(day)).cast("timestamp_ntz") for day in (first, last + dt.timedelta(days=1))]
    return events(spark, directory).filter((F.col("ts") >= bounds[0]) & (F.col("ts") < bounds[1]))


def _customer_of(external_id: str) -> Column:
    return F.floor(F.col(external_id) / 2) * 20


def id_map(spark: SparkSession, directory: str) -> DataFrame:
    """External id -> (entity, customer): two external ids point at one customer. Reads no events."""
    people = customers_with_entity(spark, directory).filter(F.col("analytical_customer_id") % 20 == 0)
    first = (F.col("analytical_customer_id") / 10).cast("bigint")
    return people.select("global_entity_id", F.explode(F.array(first, first + 1)).alias("external_id"), "analytical_customer_id")


def _count_if(condition: Column) -> Column:
    return F.sum(condition.cast("bigint"))


KINDS = ("view", "click", "purchase", "error")


def _event_states(stream: DataFrame) -> DataFrame:
    """Every event as a state of its day and value that counts one event."""
    purchase = F.col("event_type") == "purchase"
    return stream.select(
        "external_id",
        "event_date",
        "k",
        F.col("ts").alias("last_ts"),
        F.when(purchase, F.col("ts")).alias("first_purchase"),
        F.lit(1).cast("bigint").alias("n"),
        F.col("value_cents").alias("cents"),
        *[(F.col("event_type") == name).cast("bigint").alias(name) for name in KINDS],
    )


def daily_states(stream: DataFrame) -> DataFrame:
    """One row per (external id, day, value): what the profile needs of them, and what can be merged further."""
    return _event_states(stream).groupBy("external_id", "event_date", "k").agg(
        F.max("last_ts").alias("last_ts"), F.min("first_purchase").alias("first_purchase"), *[F.sum(c).alias(c) for c in ("n", "cents", *KINDS)]
    )


def behaviour_profile(spark: SparkSession, directory: str, days: Sequence[dt.date]) -> DataFrame:
    """One row per (entity, external id, calculation date), with 4 and 12 week attributes."""
    stream = events_between(spark, directory, min(days) - dt.timedelta(days=83), max(days))
    return profile_of_states(spark, directory, _event_states(stream), days)


def profile_of_states(spark: SparkSession, directory: str, states: DataFrame, days: Sequence[dt.date]) -> DataFrame:
    """The profile from single events or from stored days: both are states, merged the same way."""
    if len(days) == 1:
        dated = states.withColumn("calculation_date", F.lit(days[0]))
    else:
        dated = states.withColumn("calculation_date", F.explode(F.array(*[F.lit(d) for d in days])))
    age = F.datediff("calculation_date", "event_date")
    recent = (age >= 0) & (age < 28)
    kind = {name: recent.cast("bigint") * F.col(name) for name in KINDS}
    k = F.col("k")
    stars = k % 5 + 1
    bought = recent & (F.col("purchase") > 0)
    # Distinct values become groups, distinct days become bits: no event is copied for a distinct count, and a user
    # with very many events collapses before the first shuffle.
    per_value = {
        "timestamp": (F.max("last_ts"), F.max),
        "first_purchase": (F.min("first_purchase"), F.min),
        "days_near": (F.bit_or(F.when(age < 42, F.expr("shiftleft(1L, datediff(calculation_date, event_date))"))), F.bit_or),
        "days_far": (F.bit_or(F.when(age >= 42, F.expr("shiftleft(1L, datediff(calculation_date, event_date) - 42)"))), F.bit_or),
        "n_recent": (F.sum(recent.cast("bigint") * F.col("n")), F.sum),
        "k_recent": (F.sum(F.when(recent, k * F.col("n"))), F.sum),
        "cents": (F.sum(F.when(recent, F.col("cents"))), F.sum),
        **{name: (F.sum(n), F.sum) for name, n in kind.items()},
        # purchases without a value are neither paid online nor not
        "online": (F.sum(F.when(bought & k.isNull(), F.when(F.col("n") > F.col("purchase"), 0)).when(k % 2 == 0, kind["purchase"]).otherwise(0)), F.sum),
        "purchase_stars": (F.sum(F.when(bought, stars * F.col("purchase"))), F.sum),
        "click_stars": (F.sum(F.when(recent & (F.col("click") > 0), stars * F.col("click"))), F.sum),
        "survey": (F.max(F.when(bought, k % 11)), F.max),
    }
    again = [combine(name).alias(name) for name, (_, combine) in per_value.items()]
    user = ("external_id", "calculation_date")
    area = F.floor(k / 25).alias("area")
    by_value = dated.filter((age >= 0) & (age < 84)).groupBy(*user, "k").agg(*[e.alias(name) for name, (e, _) in per_value.items()])
    by_area = by_value.groupBy(*user, area).agg(_count_if((F.col("view") > 0) & k.isNotNull()).alias("vendors_viewed"), *again)
    summed = by_area.groupBy(*user).agg(
        F.sum("vendors_viewed").alias("vendors_viewed"),
        _count_if((F.col("n_recent") > 0) & F.col("area").isNotNull()).alias("addresses"),
        *again,
    )
    duration = F.col("cents") / F.lit(CENTS)
    last_4_weeks = F.bit_count(F.coalesce("days_near", F.lit(0).cast("bigint")).bitwiseAND(F.lit((1 << 28) - 1))).cast("bigint")
    days = [F.bit_count(F.coalesce(c, F.lit(0).cast("bigint"))) for c in ("days_near", "days_far")]
    per_user = summed.select(
        *user,
        "timestamp",
        "vendors_viewed",
        safe_divide("k_recent", "n_recent").alias("vendors_available"),
        "addresses",
        last_4_weeks.alias("visits_4w"),
        (days[0] + days[1]).cast("bigint").alias("visits_12w"),
        duration.alias("session_duration"),
        safe_divide(duration, "n_recent").alias("interaction_speed"),
        (1 - safe_divide("purchase", "click")).alias("abandoned_cart_rate"),
        safe_divide("error", "n_recent").alias("search_fail_rate"),
        safe_divide("error", "purchase").alias("voucher_error_rate"),
        F.when(F.col("external_id") % 10 != 9, F.col("first_purchase")).alias("first_order_timestamp"),
        safe_divide("online", "purchase").alias("online_rate"),
        safe_divide("purchase_stars", "purchase").alias("vendor_rating"),
        F.col("survey").alias("survey_score"),
        safe_divide("click_stars", "click").alias("survey_rating"),
        F.when(F.col("error") > 0, F.col("error")).alias("cc_sessions"),
    )
    people = customers_with_entity(spark, directory).select("global_entity_id", "analytical_customer_id")
    owner = _customer_of("external_id") == F.col("analytical_customer_id")
    return per_user.join(people, owner).select(
        "global_entity_id",
        "external_id",
        "calculation_date",
        "timestamp",
        F.struct(
            F.col("vendors_viewed").alias("unique_vendors_viewed_last_4_weeks"),
            F.col("vendors_available").alias("avg_unique_vendors_available_last_4_weeks"),
            F.col("addresses").alias("unique_addresses_used_last_4_weeks"),
            F.col("visits_4w").alias("visits_last_4_weeks"),
            F.col("visits_12w").alias("visits_last_12_weeks"),
            F.col("session_duration").alias("session_duration_last_4_weeks"),
            F.col("interaction_speed").alias("avg_interaction_speed_last_4_weeks"),
            F.col("abandoned_cart_rate").alias("abandoned_cart_rate_last_4_weeks"),
            F.col("search_fail_rate").alias("search_fail_rate_last_4_weeks"),
            F.col("voucher_error_rate").alias("voucher_error_rate_last_4_weeks"),
        ).alias("visit_attributes"),
        F.struct(
            F.col("first_order_timestamp"),
            F.col("online_rate").alias("online_payment_order_rate_last_4_weeks"),
            F.col("vendor_rating").alias("avg_ordered_vendors_rating_last_4_weeks"),
            F.col("survey_score").alias("last_after_order_survey_response_score"),
            F.col("survey_rating").alias("last_after_order_survey_response_avg_rating"),
        ).alias("order_attributes"),
        F.struct(F.col("cc_sessions").alias("total_cc_sessions_last_4_weeks")).alias(
            "customer_cc_interactions"
        ),
    )


def visit_record(spark: SparkSession, directory: str, day: dt.date) -> DataFrame:
    """Visit history per customer over all of its external ids."""
    age = F.datediff(F.lit(day), F.col("event_date"))
    recent = (age >= 0) & (age < 28)
    platforms = F.array(F.lit("android"), F.lit("ios"), F.lit("web"))
    code = (F.col("k") % 3 + 1).cast("int")
    # Days of an external id first: what meets the id map is one row for each day, however busy the user was.
    daily = (
        events(spark, directory)
        .groupBy("external_id", "event_date")
        .agg(
            F.min("ts").alias("first_ts"),
            F.max("ts").alias("last_ts"),
            F.min_by(code, "ts").alias("first_code"),
            F.max_by(code, "ts").alias("last_code"),
            F.sum("value_cents").alias("cents"),
            F.count(F.lit(1)).alias("n"),
            *[_count_if(F.col("event_type") == t).alias(t) for t in ("click", "purchase", "view")],
        )
    )
    person = ("global_entity_id", "analytical_customer_id")
    of_day = daily.join(id_map(spark, directory), "external_id").groupBy(*person, "event_date").agg(
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
        F.min_by("first_code", "first_ts").alias("first_code"),
        F.max_by("last_code", "last_ts").alias("last_code"),
        *[F.sum(c).alias(c) for c in ("cents", "n", "click", "purchase", "view")],
    )
    visits = _count_if(recent)
    counts = {c: F.coalesce(F.sum(F.when(recent, F.col(c))), F.lit(0)) for c in ("n", "click", "purchase", "view")}
    duration = F.sum(F.when(recent, F.col("cents"))) / F.lit(CENTS)
    return (
        of_day.groupBy(*person)
        .agg(
            F.element_at(platforms, F.min_by("first_code", "first_ts")).alias("first_platform_device"),
            F.element_at(platforms, F.max_by("last_code", "last_ts")).alias("last_platform_device"),
            F.count(F.lit(1)).alias("lifetime_visit_count"),
            visits.alias("visits_count"),
            duration.alias("sum_session_duration"),
            safe_divide(duration, visits).alias("average_session_duration"),
            (1 - safe_divide(counts["purchase"], counts["click"])).alias("abandoned_cart_rate"),
            safe_divide(counts["view"], counts["n"]).alias("qc_visit_rate"),
        )
        .select(
            "global_entity_id",
            "analytical_customer_id",
            F.struct(
                "first_platform_device",
                "last_platform_device",
                "lifetime_visit_count",
                F.struct(
                    "visits_count",
                    "sum_session_duration",
                    "average_session_duration",
                    "abandoned_cart_rate",
                    "qc_visit_rate",
                ).alias("last4w"),
            ).alias("visits"),
        )
    )
