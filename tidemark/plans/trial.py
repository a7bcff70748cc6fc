"""Older flat projection of the wide customer record: orders, ratings, visits and vendor loyalty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import sql as q
from tidemark.functions.expressions import least_strict, safe_divide
from tidemark.operators.flatten import KEYS
from tidemark.params import RunParams
from tidemark.sources.orders import RESTAURANTS, order_facts
from tidemark.sources.profile import visit_record
from tidemark.sources.snapshot import customer_snapshot, in_window, order_rank

# Output names -> fields of the record, here and in the three lists below (fixed values). Window measures are published
# for lifetime and the last 16 weeks.
TRIAL_MEASURES = {
    "order_count_all": "order_count",
    "order_count_late": "late_orders",
    "gmv_sum": "gmv_sum",
    "gmv_avg": "gmv_avg",
    "discount_sum": "discount_sum",
    "voucher_sum": "voucher_sum",
    "delivery_fee_sum": "delivery_fee_sum",
    "delivery_time_delay_avg": "delivery_delay_avg",
    "delivery_time_promised": "deliv_time_promised_avg",
    "delivery_distance_avg": "deliv_dist_m_avg",
}
TRIAL_RATINGS = {
    "rating_first_vert_rs": "first_rating",
    "rating_count_vert_rs": "rating_count",
    "rating_avg_vert_rs": "rating_average",
    "rating_avg_normalised_vert_rs": "normalised_rating",
    "rating_vendor_countd_vert_rs": "distinct_vendor_ratings_count",
}
TRIAL_VISITS = {
    "visits_first_platform_device": "first_platform_device",
    "visits_last_platform_device": "last_platform_device",
    "visits_count_lifetime": "lifetime_visit_count",
    "visits_count_last4w": "last4w.visits_count",
    "visits_session_duration_sum": "last4w.sum_session_duration",
    "visits_session_duration_avg": "last4w.average_session_duration",
    "visits_cart_abandonment_rate": "last4w.abandoned_cart_rate",
    "visits_qc_visit_rate": "last4w.qc_visit_rate",
}
TRIAL_VENDORS = {
    "vendor_favorite_cuisine_vert_rs": "favorite_cuisine",
    "vendor_distinct_orders_l16w_vert_rs": "distinct_vendor_orders_last16w",
    "vendor_distinct_orders_l4w_vert_rs": "distinct_vendor_orders_last4w",
    "vendor_loyalty_vert_rs": "restaurant_loyalty",
}
TRIAL_PATHS = (
    "*.first_order.order_date",
    "restaurants.first_order.gmv",
    "restaurants.first_order.delivery_delay",
    "restaurants.lifetime.*",
    "restaurants.last16w.*",
)
CUISINES = 7


def ratings_and_vendors(spark: SparkSession, directory: str, run: RunParams) -> DataFrame:
    """Restaurant ratings and vendor habits per customer.

    Orders are grouped by customer and vendor first, so distinct vendors are plain counts of groups: a vendor lies in a
    window if its last order does. No row is copied for a distinct count, and all buffers have a fixed width.
    """
    orders = order_facts(spark, directory).filter(F.col("vertical") == RESTAURANTS).withColumn("order_rank", order_rank())
    by_vendor = orders.groupBy("analytical_customer_id", "vendor_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("rating").alias("stars"),
        F.min("order_rank").alias("first_rank"),
        F.min_by("rating", "order_rank").alias("first_rating"),
        F.max("order_date").alias("order_date"),
    )
    known = F.col("vendor_id").isNotNull()
    vendors = F.count("vendor_id")
    recent = {w: F.count(F.when(in_window(w, run.as_of) & known, 1)) for w in ("last4w", "last16w")}
    # At most seven cuisines: one counter each, most frequent wins, lowest code on ties.
    cuisine = F.col("vendor_id") % CUISINES
    favourite = F.greatest(
        *[
            F.struct(F.coalesce(F.sum(F.when(cuisine == c, F.col("n"))), F.lit(0)).alias("n"), F.lit(-c).alias("code"))
            for c in range(CUISINES)
        ]
    )
    average = safe_divide(F.sum("stars"), F.sum("n"))
    return by_vendor.groupBy("analytical_customer_id").agg(
        F.struct(
            F.struct(
                F.min_by("first_rating", "first_rank").alias("first_rating"),
                F.sum("n").alias("rating_count"),
                average.alias("rating_average"),
                (average / 5).alias("normalised_rating"),
                vendors.alias("distinct_vendor_ratings_count"),
            ).alias("restaurants")
        ).alias("ratings"),
        F.struct(
            F.struct(
                F.concat(F.lit("cuisine_"), (-favourite.getField("code")).cast("string")).alias("favorite_cuisine"),
                recent["last16w"].alias("distinct_vendor_orders_last16w"),
                recent["last4w"].alias("distinct_vendor_orders_last4w"),
                (1 - safe_divide(vendors, F.sum("n"))).alias("restaurant_loyalty"),
            ).alias("restaurants")
        ).alias("vendors"),
    )


def trial_snapshot(spark: SparkSession, directory: str, run: RunParams) -> DataFrame:
    base = customer_snapshot(spark, directory, run.as_of, run.entity, TRIAL_PATHS).select(
        *KEYS,
        F.struct(
            F.col("orders.restaurants").alias("restaurants"),
            F.struct(
                F.col("orders.darkstores").alias("darkstores"), F.col("orders.localstores").alias("local_stores")
            ).alias("qc"),
        ).alias("orders"),
    )
    return (
        base.join(ratings_and_vendors(spark, directory, run), "analytical_customer_id", "left")
        .join(visit_record(spark, directory, run.profile_day), list(KEYS), "left")
    )


def trial_columns() -> dict[str, Column]:
    dm = "orders.qc.darkstores.first_order.order_date"
    ls = "orders.qc.local_stores.first_order.order_date"
    out = {
        "first_order_date_vert_rs": F.col("orders.restaurants.first_order.order_date"),
        "first_order_date_vert_dm": F.col(dm),
        "first_order_date_vert_ls": F.col(ls),
        "first_order_date_vert_qc": least_strict(dm, ls),
        "first_order_gmv_eur_vert_rs": F.col("orders.restaurants.first_order.gmv"),
        "first_order_delivery_delay_vert_rs": F.col("orders.restaurants.first_order.delivery_delay"),
    }
    for window in ("lifetime", "last16w"):
        for name, field in TRIAL_MEASURES.items():
            out[f"{name}_{window}_vert_rs"] = F.col(f"orders.restaurants.{window}.{field}")
    out.update({name: F.col(f"ratings.restaurants.{field}") for name, field in TRIAL_RATINGS.items()})
    out.update({name: F.col(f"visits.{field}") for name, field in TRIAL_VISITS.items()})
    out.update({name: F.col(f"vendors.restaurants.{field}") for name, field in TRIAL_VENDORS.items()})
    return out


def project_trial(snapshot: DataFrame) -> DataFrame:
    return snapshot.select(*KEYS, *[value.alias(name) for name, value in trial_columns().items()])


def trial_input(spark: SparkSession, directory: str, run: RunParams) -> DataFrame:
    return project_trial(trial_snapshot(spark, directory, run))


_WINDOW_SQL = ",\n      ".join(
    f"rs_{'l16w' if w == 'last16w' else w}_{field} AS {name}_{w}_vert_rs"
    for w in ("lifetime", "last16w")
    for name, field in TRIAL_MEASURES.items()
)

TRIAL_SQL = f"""WITH {q.BASE}, {q.PROFILE}, rated AS (
      SELECT cust AS v_cust, count(*) AS n, sum(rating) AS stars,
        count(DISTINCT vendor) AS vendors,
        count(DISTINCT vendor) FILTER (order_date > {q.AS_OF} - 113) AS vendors16,
        count(DISTINCT vendor) FILTER (order_date > {q.AS_OF} - 29) AS vendors4
      FROM facts WHERE vertical = 'restaurants' GROUP BY cust
    ), first_rating AS (
      SELECT cust AS f_cust, rating AS first_rating FROM facts WHERE vertical = 'restaurants'
      QUALIFY row_number() OVER (PARTITION BY cust ORDER BY order_date, oid) = 1
    ), favourite AS (
      SELECT c_cust, code FROM (SELECT cust AS c_cust, vendor % 7 AS code, count(*) AS n FROM facts
        WHERE vertical = 'restaurants' GROUP BY ALL)
      QUALIFY row_number() OVER (PARTITION BY c_cust ORDER BY n DESC, code) = 1
    ), seen AS (
      SELECT entity AS s_entity, cust AS s_cust, ev.*, date_diff('day', d, {q.PROFILE_DAY}) BETWEEN 0 AND 27 AS recent,
        CASE k % 3 WHEN 0 THEN 'android' WHEN 1 THEN 'ios' ELSE 'web' END AS device
      FROM ev JOIN mapping USING (ext)
    ), visited AS (
      SELECT s_entity, s_cust, arg_min(device, ts) AS visits_first_platform_device,
        arg_max(device, ts) AS visits_last_platform_device, count(DISTINCT d) AS visits_count_lifetime,
        count(DISTINCT d) FILTER (recent) AS visits_count_last4w,
        sum(cents) FILTER (recent) / 1e2 AS visits_session_duration_sum,
        sum(cents) FILTER (recent) / 1e2 / nullif(count(DISTINCT d) FILTER (recent), 0) AS visits_session_duration_avg,
        1 - count(*) FILTER (recent AND t = 'purchase') / nullif(count(*) FILTER (recent AND t = 'click'), 0)
          AS visits_cart_abandonment_rate,
        count(*) FILTER (recent AND t = 'view') / nullif(count(*) FILTER (recent), 0) AS visits_qc_visit_rate
      FROM seen GROUP BY s_entity, s_cust
    )
    SELECT {q.KEYS}, rs_first_date AS first_order_date_vert_rs, dm_first_date AS first_order_date_vert_dm,
      ls_first_date AS first_order_date_vert_ls, qc_first_date AS first_order_date_vert_qc,
      rs_first_gmv AS first_order_gmv_eur_vert_rs, rs_first_delay AS first_order_delivery_delay_vert_rs,
      {_WINDOW_SQL},
      first_rating AS rating_first_vert_rs, n AS rating_count_vert_rs, stars / n AS rating_avg_vert_rs,
      stars / n / 5 AS rating_avg_normalised_vert_rs, vendors AS rating_vendor_countd_vert_rs,
      visited.* EXCLUDE (s_entity, s_cust),
      'cuisine_' || code AS vendor_favorite_cuisine_vert_rs, vendors16 AS vendor_distinct_orders_l16w_vert_rs,
      vendors4 AS vendor_distinct_orders_l4w_vert_rs, 1 - vendors / n AS vendor_loyalty_vert_rs
    FROM snap LEFT JOIN rated ON v_cust = cust LEFT JOIN first_rating ON f_cust = cust
      LEFT JOIN favourite ON c_cust = cust LEFT JOIN visited ON s_entity = entity AND s_cust = cust"""
