"""Feature tables, scans, scalar expressions, cohorts and targets."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import sql as q
from tidemark.catalog.base import query
from tidemark.functions import expressions as x
from tidemark.operators import cohorts, flatten, targets
from tidemark.operators.dedup import dedup_latest
from tidemark.params import TEST_RUN as RUN
from tidemark.plans import features, trial
from tidemark.session import scratch_path
from tidemark.sources import readers, writers
from tidemark.sources.orders import order_facts
from tidemark.sources.profile import behaviour_profile, id_map
from tidemark.sources.profile_store import profile_from_store, update_store
from tidemark.sources.snapshot import customer_snapshot
from tidemark.sources.tables import customers_with_entity, table

KEYS = flatten.KEYS


FIRST = "*.first_order.order_date"
VOUCHER = "*.first_order.voucher"
COUNTS = "*.lifetime.order_count"


def _snapshot(spark: SparkSession, sf: str, *paths: str) -> DataFrame:
    return customer_snapshot(spark, sf, RUN.as_of, paths=paths)


def _from_snapshot(spark: SparkSession, sf: str, paths: tuple[str, ...], columns: dict) -> DataFrame:
    return flatten.flatten(_snapshot(spark, sf, *paths), columns)


def _qc_figures(spark: SparkSession, sf: str) -> DataFrame:
    """Pooled quick-commerce columns, voucher and frequency: what targets and populations need."""
    columns = {
        **flatten.qc_rollup_columns(),
        "first_order_voucher_vert_qc": flatten.first_qc_voucher(),
        "days_since_first_order_vert_qc": x.days_since(flatten.first_qc_date(), RUN.as_of),
        "gmv_avg_lifetime_vert_dmart": flatten.dark_store_columns()["gmv_avg_lifetime_vert_dmart"],
    }
    rows = _from_snapshot(spark, sf, QC_PATHS, columns)
    freq = x.frequency_per_4_weeks("order_count_lifetime_vert_qc", "days_since_first_order_vert_qc")
    return rows.withColumn("order_freq_4w_vert_qc", freq)


QC_PATHS = (FIRST, VOUCHER, COUNTS, "*.lifetime.gmv_sum", "*.lifetime.late_orders")


# ---------------------------------------------------------------- feature tables


@query("feature_table", f"WITH {q.WITH_PROFILE} {q.feature_sql()}")
def _(spark, sf):
    return features.feature_table(spark, sf, RUN)


@query("stage_feature_table", f"WITH {q.WITH_PROFILE}, {q.STAGE} SELECT * FROM stage")
def _(spark, sf):
    return features.stage_feature_table(spark, sf, RUN)


@query("flatten_features", f"WITH {q.BASE} SELECT {q.KEYS}, {q.flat_columns(internal=True)} FROM snap")
def _(spark, sf):
    return flatten.flatten_features(_snapshot(spark, sf, *flatten.FEATURE_PATHS), RUN.as_of)


@query("trial_input", trial.TRIAL_SQL)
def _(spark, sf):
    return trial.trial_input(spark, sf, RUN)


_SNAPSHOT_SQL = f"""WITH {q.PEOPLE}, {q.PROFILE}, {q.profile_rows()}
    SELECT entity AS global_entity_id, ext AS external_id, calculation_date, visits_4w, visits_12w, vendors_viewed,
      duration, online FROM profile"""


def _snapshot_columns(profile: DataFrame) -> DataFrame:
    return features.profile_snapshot(profile, RUN.profile_day).select(
        "global_entity_id",
        "external_id",
        "calculation_date",
        F.col("visit_attributes.visits_last_4_weeks").alias("visits_4w"),
        F.col("visit_attributes.visits_last_12_weeks").alias("visits_12w"),
        F.col("visit_attributes.unique_vendors_viewed_last_4_weeks").alias("vendors_viewed"),
        F.col("visit_attributes.session_duration_last_4_weeks").alias("duration"),
        F.col("order_attributes.online_payment_order_rate_last_4_weeks").alias("online"),
    )


@query("profile_snapshot", _SNAPSHOT_SQL)
def _(spark, sf):
    days = [RUN.profile_day - dt.timedelta(days=n) for n in range(3)]
    return _snapshot_columns(behaviour_profile(spark, sf, days))


@query("profile_store", _SNAPSHOT_SQL)
def _(spark, sf):
    store = scratch_path(spark, "profile-store")
    for weeks in (2, 1, 0):  # three weekly runs, each adding its own days
        update_store(spark, sf, store, RUN.profile_day - dt.timedelta(days=7 * weeks))
    return _snapshot_columns(profile_from_store(spark, sf, store, RUN.profile_day))


@query(
    "profile_map_join",
    f"""WITH {q.PEOPLE}, {q.PROFILE}, {q.profile_rows()}
    SELECT m.entity AS global_entity_id, m.ext AS external_id, cust AS analytical_customer_id, last_ts, addresses,
      visits_4w, abandoned FROM profile p JOIN mapping m ON p.entity = m.entity AND p.ext = m.ext""",
)
def _(spark, sf):
    profile = behaviour_profile(spark, sf, [RUN.profile_day])
    return features.map_profiles(profile, id_map(spark, sf)).select(
        *KEYS,
        "external_id",
        F.col("timestamp").alias("last_ts"),
        F.col("visit_attributes.unique_addresses_used_last_4_weeks").alias("addresses"),
        F.col("visit_attributes.visits_last_4_weeks").alias("visits_4w"),
        F.col("visit_attributes.abandoned_cart_rate_last_4_weeks").alias("abandoned"),
    )


@query(
    "profile_rollup",
    f"""WITH {q.WITH_PROFILE}
    SELECT entity AS global_entity_id, cust AS analytical_customer_id, rolled.* EXCLUDE (r_entity, r_cust)
    FROM snap JOIN rolled ON r_entity = entity AND r_cust = cust WHERE {q.ACTIVE}""",
)
def _(spark, sf):
    cohort = features.active_features(spark, sf, RUN).select(*KEYS)
    return cohort.join(features.behaviour(spark, sf, RUN), list(KEYS), "inner")


# ---------------------------------------------------------------- scans and sinks


@query("scan_parquet", "SELECT * FROM orders")
def _(spark, sf):
    return readers.load(spark, f"{sf}/orders.parquet")


@query("parquet_roundtrip", "SELECT * FROM customer")
def _(spark, sf):
    path = scratch_path(spark, "roundtrip")
    writers.save(table(spark, sf, "customer"), path)
    return readers.load(spark, path)


@query(
    "param_query",
    f"""WITH {q.BASE} SELECT {q.KEYS}, rs_lifetime_order_count AS orders, rs_first_date AS first_order_date
    FROM snap WHERE entity = 'EUROPE'""",
)
def _(spark, sf):
    text = """SELECT global_entity_id, analytical_customer_id,
        orders.restaurants.lifetime.order_count AS orders,
        orders.restaurants.first_order.order_date AS first_order_date
      FROM {snapshot} WHERE global_entity_id = :entity"""
    _snapshot(spark, sf, FIRST, COUNTS).createOrReplaceTempView("tidemark_snapshot")
    return readers.read_query(spark, text.format(snapshot="IDENTIFIER(:source)"),
                              {"entity": "EUROPE", "source": "tidemark_snapshot"})


@query(
    "schema_cast",
    """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS BIGINT) AS o_custkey,
      CAST(o_totalprice AS DOUBLE) AS o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority
    FROM orders""",
)
def _(spark, sf):
    mapping = {"o_orderkey": "STRING", "o_custkey": "INTEGER", "o_totalprice": "NUMERIC", "o_orderdate": "DATE"}
    text = table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_custkey").cast("string"), F.col("o_totalprice").cast("string"), "o_orderdate",
        "o_orderpriority",
    )
    return readers.apply_schema(text, mapping)


@query(
    "parse_dates",
    """SELECT o_orderkey, o_orderdate AS order_date, o_orderpriority AS date_hint,
      strftime(o_orderdate, '%Y-%m-%d') AS ordered FROM orders""",
)
def _(spark, sf):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return readers.parse_dates(
        table(spark, sf, "orders").select(
            "o_orderkey", day.alias("order_date"), F.col("o_orderpriority").alias("date_hint"), day.alias("ordered")
        )
    )


@query(
    "coerce_numeric",
    """SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_retailprice AS price, CAST(p_size AS DOUBLE) AS size,
      CAST(replace(p_brand, 'Brand#', '') AS DOUBLE) AS brand_no, p_brand AS brand,
      CASE WHEN p_type = 'SMALL' THEN '12' ELSE p_type END AS mixed FROM part""",
)
def _(spark, sf):
    text = table(spark, sf, "part").select(
        F.col("p_partkey").cast("string"),
        F.col("p_retailprice").cast("string").alias("price"),
        F.col("p_size").cast("string").alias("size"),
        F.replace("p_brand", F.lit("Brand#"), F.lit("")).alias("brand_no"),
        F.col("p_brand").alias("brand"),
        F.when(F.col("p_type") == "SMALL", "12").otherwise(F.col("p_type")).alias("mixed"),
    )
    return readers.coerce_numeric(text, keys=["p_partkey"])


@query(
    "partitioned_export",
    f"""WITH {q.PEOPLE}, {q.FACTS} SELECT cust AS analytical_customer_id, oid AS order_id,
      gmv_c / 1e2 AS gmv, entity, order_date AS date
    FROM facts JOIN people USING (cust) WHERE entity = 'ASIA'""",
)
def _(spark, sf):
    path = scratch_path(spark, "export")
    rows = order_facts(spark, sf).join(customers_with_entity(spark, sf), "analytical_customer_id")
    rows = rows.select(
        "analytical_customer_id",
        "order_id",
        (F.col("gmv_cents") / F.lit(100.0)).alias("gmv"),
        F.col("global_entity_id").alias("entity"),
        F.col("order_date").alias("date"),
        F.trunc("order_date", "year").alias("year"),
    )
    writers.save_partitioned(rows, path, ("entity", "year"), sort_by="analytical_customer_id")
    return readers.load(spark, path).filter(F.col("entity") == "ASIA").drop("year")


@query(
    "scan_in_list",
    "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_totalprice AS BIGINT) AS o_totalprice FROM "
    "(SELECT o_orderkey, trunc(o_totalprice) AS o_totalprice FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH'))",
)
def _(spark, sf):
    return readers.scan_in_list(
        table(spark, sf, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH"],
        {"o_orderkey": "string", "o_totalprice": "bigint"},
    )


# ---------------------------------------------------------------- scalar expressions


@query(
    "safe_divide",
    f"""WITH {q.FACTS} SELECT oid AS order_id, fee / nullif(gmv_c / 1e2, 0) AS fee_rate,
      discount_f / nullif(gmv_c, 0) AS discount_rate, oid % 4 / nullif(oid % 5, 0) AS int_rate FROM facts""",
)
def _(spark, sf):
    return order_facts(spark, sf).select(
        "order_id",
        x.safe_divide("delivery_fee", F.col("gmv_cents") / F.lit(100.0)).alias("fee_rate"),
        x.safe_divide("discount_fine", "gmv_cents").alias("discount_rate"),
        x.safe_divide(F.col("order_id") % 4, F.col("order_id") % 5).alias("int_rate"),
    )


@query(
    "coalesce_fill",
    f"""WITH {q.BASE} SELECT {q.KEYS}, ifnull(dm_lifetime_order_count, 0) AS dm_orders,
      ifnull(ls_l16w_gmv_sum, 0) AS ls_gmv_l16w FROM snap""",
)
def _(spark, sf):
    return _from_snapshot(spark, sf, (COUNTS, "localstores.last16w.gmv_sum"), {
        "dm_orders": x.or_zero("orders.darkstores.lifetime.order_count"),
        "ls_gmv_l16w": F.coalesce("orders.localstores.last16w.gmv_sum", F.lit(0.0)),
    })


@query("least_strict", f"WITH {q.BASE} SELECT {q.KEYS}, qc_first_date AS first_qc, "
       "CASE WHEN dm_first_date IS NULL OR ls_first_date IS NULL THEN NULL "
       "WHEN dm_first_date > ls_first_date THEN dm_first_date ELSE ls_first_date END AS later_first FROM snap")
def _(spark, sf):
    dm, ls = "orders.darkstores.first_order.order_date", "orders.localstores.first_order.order_date"
    return _from_snapshot(spark, sf, (FIRST,), {"first_qc": x.least_strict(dm, ls), "later_first": x.greatest_strict(dm, ls)})


@query(
    "least_greatest_array",
    f"""WITH {q.BASE} SELECT {q.KEYS}, list_min([rs_first_date, dm_first_date, ls_first_date]) AS first_any,
      list_max([dm_first_date, ls_first_date]) AS last_qc_first FROM snap""",
)
def _(spark, sf):
    firsts = {v: F.col(f"orders.{v}.first_order.order_date") for v in ("restaurants", "darkstores", "localstores")}
    return _from_snapshot(spark, sf, (FIRST,), {
        "first_any": x.least_of_array(F.array(*firsts.values())),
        "last_qc_first": x.greatest_of_array(F.array(firsts["darkstores"], firsts["localstores"])),
    })


@query("first_qc_voucher", f"WITH {q.BASE} SELECT {q.KEYS}, {q.QC_VOUCHER} AS first_order_voucher_vert_qc FROM snap")
def _(spark, sf):
    return _from_snapshot(spark, sf, (FIRST, VOUCHER), {"first_order_voucher_vert_qc": flatten.first_qc_voucher()})


@query(
    "gated_features",
    f"""WITH {q.BASE} SELECT {q.KEYS}, CASE WHEN coalesce(rs_l04w_order_count, 0) > 0 THEN rs_lifetime_gmv_avg END
      AS gmv_if_active, CASE WHEN coalesce(rs_l04w_order_count, 0) > 0 THEN rs_l16w_late_orders ELSE 0 END
      AS late_if_active FROM snap""",
)
def _(spark, sf):
    recent = "orders.restaurants.last4w.order_count"
    return _from_snapshot(spark, sf, ("restaurants.last*.*", "restaurants.lifetime.gmv_avg"), {
        "gmv_if_active": x.gated(recent, "orders.restaurants.lifetime.gmv_avg"),
        "late_if_active": x.gated(recent, "orders.restaurants.last16w.late_orders", otherwise=0),
    })


@query(
    "recency_days",
    f"""WITH {q.BASE} SELECT {q.KEYS}, CAST({q.AS_OF} - rs_first_date AS INTEGER) AS days_since_first_order_vert_rs,
      CAST({q.AS_OF} - qc_first_date AS INTEGER) AS days_since_first_order_vert_qc,
      CAST({q.AS_OF} - rs_last_date AS INTEGER) AS days_since_last_order_vert_rs FROM snap""",
)
def _(spark, sf):
    return _from_snapshot(spark, sf, ("*.first_order.order_date", "*.last_order.order_date"), flatten.recency_columns(RUN.as_of))


@query("day_of_week", f"WITH {q.FACTS} SELECT oid AS order_id, CAST(dayofweek(order_date) + 1 AS INTEGER) AS weekday FROM facts")
def _(spark, sf):
    return order_facts(spark, sf).select("order_id", x.day_of_week("order_date").alias("weekday"))


@query(
    "week_anchor",
    f"WITH {q.FACTS} SELECT oid AS order_id, order_date - CAST(isodow(order_date) AS INTEGER) AS last_sunday FROM facts",
)
def _(spark, sf):
    return order_facts(spark, sf).select("order_id", x.week_anchor("order_date").alias("last_sunday"))


@query(
    "late_share",
    f"""WITH {q.BASE} SELECT {q.KEYS},
      round(rs_l16w_late_orders / nullif(rs_l16w_order_count, 0), 2) AS order_pct_late_l16w_vert_rs,
      round(rs_lifetime_late_orders / nullif(rs_lifetime_order_count, 0), 2) AS order_pct_late_lifetime_vert_rs
    FROM snap""",
)
def _(spark, sf):
    return _from_snapshot(spark, sf, ("restaurants.*.order_count", "restaurants.*.late_orders"), flatten.late_share_columns())


@query(
    "first_order_pct",
    f"""WITH {q.BASE} SELECT {q.KEYS}, coalesce(rs_first_fee / nullif(rs_first_gmv, 0), 0) AS fee_pct,
      coalesce(rs_first_discount / nullif(rs_first_gmv, 0), 0) AS discount_pct,
      coalesce(rs_first_voucher / nullif(rs_first_gmv, 0), 0) AS voucher_pct FROM snap""",
)
def _(spark, sf):
    cols = flatten.first_order_columns()
    return _from_snapshot(spark, sf, ("restaurants.first_order.*",), {
        f"{name}_pct": cols[f"first_order_{source}_pct_vert_rs"]
        for name, source in (("fee", "delivery_fee"), ("discount", "discount"), ("voucher", "voucher"))
    })


@query(
    "daypart_shares",
    f"WITH {q.BASE} SELECT {q.KEYS}, " + ", ".join(
        f"rs_lifetime_{p}_order_count / nullif(rs_lifetime_order_count, 0) AS order_perc_{p}_vert_rs"
        for p in ("weekend", "morning", "afternoon", "night")) + " FROM snap",
)
def _(spark, sf):
    return _from_snapshot(spark, sf, ("restaurants.lifetime.*order_count",), flatten.daypart_share_columns())


@query("order_freq_4w", f"WITH {q.BASE} SELECT {q.KEYS}, {q.QC_FREQ} AS order_freq_4w_vert_qc FROM snap")
def _(spark, sf):
    return _qc_figures(spark, sf).select(*KEYS, "order_freq_4w_vert_qc")


@query(
    "qc_rollup",
    f"""WITH {q.BASE}, qc AS (
      SELECT cust, min(order_date) FILTER (vertical = 'darkstores') AS dm, min(order_date) FILTER (vertical = 'localstores') AS ls,
        count(*) AS n, count(*) FILTER (delay_f > 0) AS late, (coalesce(sum(gmv_c) FILTER (vertical = 'darkstores'), 0) / 1e2
          + coalesce(sum(gmv_c) FILTER (vertical = 'localstores'), 0) / 1e2) / count(*) AS aov,
        count(*) FILTER (vertical = 'darkstores') AS n_dm
      FROM facts WHERE vertical <> 'restaurants' GROUP BY cust)
    SELECT entity AS global_entity_id, people.cust AS analytical_customer_id,
      CASE WHEN dm < ls THEN dm WHEN dm >= ls THEN ls END AS first_order_date_vert_qc,
      coalesce(n, 0) AS order_count_lifetime_vert_qc, coalesce(late, 0) AS order_count_late_lifetime_vert_qc,
      coalesce(aov, 0) AS gmv_avg_lifetime_vert_qc, coalesce(n_dm, 0) AS order_count_lifetime_vert_dmart
    FROM people JOIN (SELECT DISTINCT cust FROM facts) USING (cust) LEFT JOIN qc USING (cust)""",
)
def _(spark, sf):
    return _from_snapshot(spark, sf, QC_PATHS, flatten.qc_rollup_columns())


@query(
    "clean_feature_name",
    """SELECT DISTINCT 'ft_' || p_brand || '__count__fillna_' || p_size AS raw,
      p_brand || '__count' AS cleaned FROM part""",
)
def _(spark, sf):
    raw = F.concat(F.lit("ft_"), F.col("p_brand"), F.lit("__count__fillna_"), F.col("p_size").cast("string"))
    names = table(spark, sf, "part").select(raw.alias("raw")).distinct()
    return names.select("raw", x.clean_feature_name("raw").alias("cleaned"))


@query(
    "fill_sentinel",
    f"""WITH {q.WITH_PROFILE}, {q.FEATURES} SELECT global_entity_id, analytical_customer_id,
      coalesce(rating_avg_l04w, -1) AS rating_avg_l04w, coalesce(dist_nearest_dmart, -1) AS dist_nearest_dmart,
      coalesce(gmv_sum_l04w_vert_rs, -1) AS gmv_sum_l04w_vert_rs FROM features""",
)
def _(spark, sf):
    cols = ["rating_avg_l04w", "dist_nearest_dmart", "gmv_sum_l04w_vert_rs"]
    return features.feature_table(spark, sf, RUN).select(*KEYS, *cols).fillna(-1, subset=cols)


@query(
    "orders_per_visit",
    f"""WITH {q.WITH_PROFILE}, {q.FEATURES} SELECT global_entity_id, analytical_customer_id,
      CASE WHEN order_count_l04w_vert_rs IS NULL OR visit_count_l04w = 0 THEN NULL
           ELSE greatest(-1, least(2, order_count_l04w_vert_rs / visit_count_l04w)) END AS orders_per_visit
    FROM features""",
)
def _(spark, sf):
    ratio = x.orders_per_visit("order_count_l04w_vert_rs", "visit_count_l04w")
    return features.feature_table(spark, sf, RUN).select(*KEYS, ratio.alias("orders_per_visit"))


# ---------------------------------------------------------------- cohorts


@query("cohort_active", f"WITH {q.BASE} SELECT {q.KEYS}, rs_first_date AS first_order_date_vert_rs, "
       f"rs_last_date AS last_order_date_vert_rs FROM snap WHERE {q.ACTIVE}")
def _(spark, sf):
    cols = ("first_order_date_vert_rs", "last_order_date_vert_rs")
    return features.active_features(spark, sf, RUN).select(*KEYS, *cols)


@query("cohort_conversion", f"WITH {q.BASE} SELECT {q.KEYS}, rs_last_date, dm_first_date FROM snap WHERE {q.CONVERSION}")
def _(spark, sf):
    rows = _from_snapshot(spark, sf, (FIRST, "*.last_order.order_date"), {
        "rs_first_date": F.col("orders.restaurants.first_order.order_date"),
        "rs_last_date": F.col("orders.restaurants.last_order.order_date"),
        "dm_first_date": F.col("orders.darkstores.first_order.order_date"),
    })
    keep = cohorts.conversion_cohort(F.col("rs_first_date"), F.col("rs_last_date"), F.col("dm_first_date"), RUN.as_of)
    return rows.filter(keep).drop("rs_first_date")


@query(
    "cohort_conversion_strict",
    f"""WITH {q.BASE} SELECT {q.KEYS}, rs_last_date, dm_first_date FROM snap
    WHERE rs_first_date < {q.AS_OF} - 91 AND rs_last_date > {q.AS_OF} - 271
      AND (dm_first_date IS NULL OR (rs_first_date < rs_last_date AND rs_last_date < dm_first_date))""",
)
def _(spark, sf):
    rows = _from_snapshot(spark, sf, (FIRST, "*.last_order.order_date"), {
        "rs_first_date": F.col("orders.restaurants.first_order.order_date"),
        "rs_last_date": F.col("orders.restaurants.last_order.order_date"),
        "dm_first_date": F.col("orders.darkstores.first_order.order_date"),
    })
    keep = cohorts.conversion_cohort(
        F.col("rs_first_date"), F.col("rs_last_date"), F.col("dm_first_date"), RUN.as_of, strict=True
    )
    return rows.filter(keep).drop("rs_first_date")


@query(
    "drop_outliers",
    f"""WITH {q.BASE} SELECT {q.KEYS}, rs_lifetime_order_count AS order_count_lifetime_vert_rs,
      rs_l16w_order_count AS order_count_l16w_vert_rs FROM snap WHERE cust % 10 > 0 AND {q.USUAL}""",
)
def _(spark, sf):
    flat = flatten.flatten_features(_snapshot(spark, sf, *flatten.FEATURE_PATHS), RUN.as_of)
    freq = x.frequency_per_4_weeks("order_count_lifetime_vert_qc", "days_since_first_order_vert_qc")
    kept = flat.withColumn("order_freq_4w_vert_qc", freq).filter(cohorts.within_usual_range())
    return kept.select(*KEYS, "order_count_lifetime_vert_rs", "order_count_l16w_vert_rs")


@query(
    "value_band",
    f"""WITH {q.BASE} SELECT {q.KEYS}, rs_lifetime_delivery_fee_sum AS fees FROM snap
    WHERE rs_lifetime_delivery_fee_sum >= 0 AND rs_lifetime_delivery_fee_sum <= 20""",
)
def _(spark, sf):
    rows = _from_snapshot(spark, sf, ("restaurants.lifetime.delivery_fee_sum",), {"fees": F.col("orders.restaurants.lifetime.delivery_fee_sum")})
    return rows.filter(cohorts.value_band(F.col("fees"), 0, 20))


@query(
    "geo_box",
    f"WITH {q.BASE} SELECT {q.KEYS}, lat AS cust_lat, lon AS cust_long FROM snap WHERE lat > 59.2 AND lon > 18.1",
)
def _(spark, sf):
    rows = _from_snapshot(spark, sf, (COUNTS,), flatten.location_columns()).select(*KEYS, "cust_lat", "cust_long")
    return cohorts.with_coordinates(rows).filter(cohorts.geo_box(lat_from=59.2, long_from=18.1))


@query(
    "population_organic",
    f"""WITH {q.BASE} SELECT {q.KEYS}, CASE WHEN qc_count > 0 AND coalesce(qc_voucher, 0) >= 0 THEN 'train'
      ELSE 'predict' END AS population FROM (SELECT *, {q.QC_VOUCHER} AS qc_voucher FROM snap)""",
)
def _(spark, sf):
    flat = _qc_figures(spark, sf)
    return flat.select(*KEYS, cohorts.organic_population(targets.organic()).alias("population"))


@query(
    "population_value",
    f"""WITH {q.BASE} SELECT {q.KEYS}, CASE WHEN qc_count > 1 AND qc_first_date < DATE '2001-07-29' - 28 THEN 'train'
      WHEN qc_count <= 1 THEN 'predict' END AS population FROM snap""",
)
def _(spark, sf):
    flat = _qc_figures(spark, sf)
    population = cohorts.value_population(
        F.col("order_count_lifetime_vert_qc"), F.col("first_order_date_vert_qc"), targets.order_value(), RUN.date_until
    )
    return flat.select(*KEYS, population.alias("population"))


@query(
    "dq_missing_gmv",
    f"""WITH {q.BASE} SELECT CAST(count(*) FILTER (qc_count > 0 AND {q.QC_GMV_AVG} IS NULL) AS BIGINT) AS violations,
      count(*) AS customers FROM snap""",
)
def _(spark, sf):
    flat = _qc_figures(spark, sf)
    broken = (F.col("order_count_lifetime_vert_qc") > 0) & F.col("gmv_avg_lifetime_vert_qc").isNull()
    return flat.agg(F.count(F.when(broken, 1)).alias("violations"), F.count("*").alias("customers"))


@query(
    "dedup_latest",
    f"""WITH {q.PEOPLE}, {q.FACTS} SELECT entity AS global_entity_id, cust AS analytical_customer_id,
      order_date AS updated_at, oid AS order_id, vertical, gmv_c / 1e2 AS gmv
    FROM facts JOIN people USING (cust)
    QUALIFY row_number() OVER (PARTITION BY entity, cust ORDER BY order_date DESC, oid DESC) = 1""",
)
def _(spark, sf):
    versions = order_facts(spark, sf).join(customers_with_entity(spark, sf), "analytical_customer_id").select(
        *KEYS,
        F.col("order_date").alias("updated_at"),
        "order_id",
        "vertical",
        (F.col("gmv_cents") / F.lit(100.0)).alias("gmv"),
    )
    return dedup_latest(versions, KEYS, ("updated_at", "order_id"))


# ---------------------------------------------------------------- targets


def _target(name: str, column, sql_expr: str, output: str = "target") -> None:
    @query(name, f"WITH {q.BASE} SELECT {q.KEYS}, {sql_expr} AS {output} FROM snap")
    def _(spark, sf):
        return _qc_figures(spark, sf).select(*KEYS, column().alias(output))


_GENERAL_SQL = "CAST(dm_lifetime_order_count IS NOT NULL AND dm_lifetime_order_count > 0 AS INTEGER)"
_target("target_general", targets.general, _GENERAL_SQL)
_target("target_general_dm", targets.general, _GENERAL_SQL, targets.GENERAL_DARK)
_target(
    "target_organic",
    targets.organic,
    f"CASE WHEN qc_count > 0 THEN CASE WHEN coalesce({q.QC_VOUCHER}, 0) = 0 THEN 1 "
    f"WHEN {q.QC_VOUCHER} > 0 THEN 0 END END",
)
_target("target_freq", targets.frequency, q.QC_FREQ)
_target("target_aov", targets.order_value, q.QC_GMV_AVG)
_target(
    "target_aov_dm",
    lambda: F.col("gmv_avg_lifetime_vert_dmart"),
    "coalesce(dm_lifetime_gmv_sum / nullif(dm_lifetime_order_count, 0), 0)",
)
