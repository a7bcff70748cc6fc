"""DuckDB building blocks for the reference queries: named common table expressions, written from the
semantics of the data (joins, FILTER clauses, QUALIFY), not from the Spark plans."""

from __future__ import annotations

AS_OF = "DATE '2001-08-02'"
PROFILE_DAY = "DATE '2024-01-30'"

_SHORT = {"rs": "restaurants", "dm": "darkstores", "ls": "localstores"}
_WINDOW = {
    "lifetime": "true",
    "l04w": f"order_date > {AS_OF} - 29",
    "l16w": f"order_date > {AS_OF} - 113",
}

PEOPLE = """people AS (
  SELECT r_name AS entity, c_custkey AS cust, c_mktsegment AS segment
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""

FACTS = """facts AS (
  SELECT o_custkey AS cust, o_orderkey AS oid, CAST(o_orderdate AS DATE) AS order_date,
    CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN 'darkstores'
         WHEN o_orderstatus = 'F' AND o_orderpriority = '2-HIGH' THEN 'localstores'
         ELSE 'restaurants' END AS vertical,
    CASE WHEN o_orderkey % 97 = 0 THEN 0 ELSE CAST(round(o_totalprice * 100) AS BIGINT) END AS gmv_c,
    CAST(round(o_totalprice * 100) AS BIGINT) * (o_orderkey % 5) AS discount_f,
    CAST(o_orderkey % 4 AS DOUBLE) AS fee,
    CASE WHEN o_orderkey % 7 = 0 THEN 5e0 ELSE 0e0 END AS voucher,
    CAST(o_orderkey % 60 * 100 AS DOUBLE) AS dist,
    CAST(15 + o_orderkey % 45 AS DOUBLE) AS promised,
    o_orderkey % 3 * 5e-1 AS joker_c, o_orderkey % 6 * 25e-2 AS joker_v,
    CAST(round(delay * 10000) AS BIGINT) AS delay_f,
    o_orderkey % 24 AS hour, dayofweek(o_orderdate) IN (0, 6) AS weekend,
    o_orderkey % 50 AS vendor, 1 + o_orderkey % 5 AS rating
  FROM orders LEFT JOIN (
    SELECT o_orderkey AS k, avg(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) AS delay
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey) ON k = o_orderkey
)"""


def _cell(short: str, window: str) -> list[str]:
    where = f"FILTER (vertical = '{_SHORT[short]}' AND {_WINDOW[window]})"
    n = f"nullif(count(*) {where}, 0)"
    sums = {
        "gmv": f"sum(gmv_c) {where} / 1e2",
        "delivery_fee": f"sum(fee) {where}",
        "discount": f"sum(discount_f) {where} / 1e4",
        "voucher": f"sum(voucher) {where}",
    }
    out = {
        "order_count": n,
        "late_orders": f"CAST(sum(CASE WHEN delay_f > 0 THEN 1 WHEN delay_f <= 0 THEN 0 END) {where} AS BIGINT)",
    }
    for name, total in sums.items():
        out[f"{name}_sum"] = total
        out[f"{name}_avg"] = f"({total}) / {n}"
    out["joker_cust_discount_sum"] = f"sum(joker_c) {where}"
    out["joker_vendor_fee_sum"] = f"sum(joker_v) {where}"
    out["deliv_dist_m_avg"] = f"sum(dist) {where} / {n}"
    out["deliv_time_promised_avg"] = f"sum(promised) {where} / {n}"
    out["delivery_delay_avg"] = f"(sum(delay_f) {where} / 1e4) / nullif(count(delay_f) {where}, 0)"
    if window == "lifetime":
        for part, test in {
            "weekend": "weekend",
            "morning": "hour BETWEEN 5 AND 11",
            "afternoon": "hour BETWEEN 12 AND 17",
            "night": "(hour >= 21 OR hour <= 4)",
        }.items():
            out[f"{part}_order_count"] = f"CAST(sum(CASE WHEN {test} THEN 1 ELSE 0 END) {where} AS BIGINT)"
    return [f"{expr} AS {short}_{window}_{name}" for name, expr in out.items()]


_TOTALS = ",\n    ".join(c for s in _SHORT for w in _WINDOW for c in _cell(s, w))
_FIRST = {
    "date": "order_date",
    "gmv": "gmv_c / 1e2",
    "fee": "fee",
    "dist": "dist",
    "promised": "promised",
    "delay": "delay_f / 1e4",
    "discount": "discount_f / 1e4",
    "voucher": "voucher",
}
_FIRST_COLS = ",\n    ".join(
    f"max({expr}) FILTER (vertical = '{_SHORT[s]}') AS {s}_first_{name}" for s in _SHORT for name, expr in _FIRST.items()
)

SNAP = f"""first_orders AS (
  SELECT * FROM facts QUALIFY row_number() OVER (PARTITION BY cust, vertical ORDER BY order_date, oid) = 1
), first_wide AS (
  SELECT cust AS fcust, {_FIRST_COLS}
  FROM first_orders GROUP BY cust
), totals AS (
  SELECT cust AS tcust, {_TOTALS},
    max(order_date) FILTER (vertical = 'restaurants') AS rs_last_date
  FROM facts GROUP BY cust
), snap AS (
  SELECT people.*, totals.* EXCLUDE (tcust), first_wide.* EXCLUDE (fcust),
    CASE WHEN dm_first_date IS NOT NULL AND ls_first_date IS NOT NULL
         THEN CASE WHEN dm_first_date < ls_first_date THEN dm_first_date ELSE ls_first_date END END AS qc_first_date,
    coalesce(dm_lifetime_order_count, 0) + coalesce(ls_lifetime_order_count, 0) AS qc_count,
    CASE WHEN cust % 50 <> 0 THEN 59e0 + (cust * 7919 % 10007) / 10007e0 * 5e-1 END AS lat,
    CASE WHEN cust % 50 <> 0 THEN 18e0 + (cust * 104729 % 10009) / 10009e0 * 5e-1 END AS lon,
    CASE WHEN cust % 11 <> 0 THEN cust % 400 * 1e1 END AS reach
  FROM people JOIN totals ON cust = tcust JOIN first_wide ON cust = fcust
)"""

BASE = f"{PEOPLE}, {FACTS}, {SNAP}"

PROFILE = f"""mapping AS (
  SELECT entity, user_id AS ext, cust
  FROM (SELECT DISTINCT user_id FROM events) JOIN people ON cust = (user_id // 2) * 20
), ev AS (
  SELECT user_id AS ext, ts, CAST(ts AS DATE) AS d, event_type AS t,
    CAST(round(value * 100) AS BIGINT) AS cents, CAST(json_extract(props, '$.k') AS BIGINT) AS k
  FROM events
)"""


def profile_rows(day: str = PROFILE_DAY, name: str = "profile") -> str:
    recent = f"date_diff('day', d, {day}) < 28"
    def cnt(kind: str) -> str:
        return f"count(*) FILTER (t = '{kind}' AND {recent})"
    n = f"count(*) FILTER ({recent})"
    buys, clicks, errors = cnt("purchase"), cnt("click"), cnt("error")
    return f"""{name} AS (
  SELECT entity, ext, {day} AS calculation_date, max(ts) AS last_ts,
    count(DISTINCT k) FILTER (t = 'view' AND {recent}) AS vendors_viewed,
    sum(k) FILTER ({recent}) / nullif({n}, 0) AS vendors_available,
    count(DISTINCT k // 25) FILTER ({recent}) AS addresses,
    count(DISTINCT d) FILTER ({recent}) AS visits_4w, count(DISTINCT d) AS visits_12w,
    sum(cents) FILTER ({recent}) / 1e2 AS duration,
    sum(cents) FILTER ({recent}) / 1e2 / nullif({n}, 0) AS speed,
    1 - {buys} / nullif({clicks}, 0) AS abandoned,
    {errors} / nullif({n}, 0) AS search_fail,
    {errors} / nullif({buys}, 0) AS voucher_error,
    CASE WHEN ext % 10 <> 9 THEN min(ts) FILTER (t = 'purchase') END AS first_order_ts,
    count(*) FILTER (t = 'purchase' AND {recent} AND k % 2 = 0) / nullif({buys}, 0) AS online,
    sum(k % 5 + 1) FILTER (t = 'purchase' AND {recent}) / nullif({buys}, 0) AS vendor_rating,
    max(k % 11) FILTER (t = 'purchase' AND {recent}) AS survey_score,
    sum(k % 5 + 1) FILTER (t = 'click' AND {recent}) / nullif({clicks}, 0) AS survey_rating,
    nullif({errors}, 0) AS cc_sessions
  FROM ev JOIN mapping USING (ext)
  WHERE date_diff('day', d, {day}) BETWEEN 0 AND 83
  GROUP BY entity, ext
)"""


ROLLUP = """rolled AS (
  SELECT m.entity AS r_entity, m.cust AS r_cust, min(first_order_ts) AS first_order_timestamp,
    max(online) AS order_rate_online_payment_l04w, max(vendors_viewed) AS visit_vendors_viewed_l04w,
    max(vendors_available) AS visit_vendors_available_l04w, max(addresses) AS visit_addresses_unique_l04w,
    max(visits_4w) AS visit_count_l04w, max(visits_12w) AS visit_count_l12w,
    max(visits_4w) / nullif(max(visits_12w), 0) AS visit_count_l04w_vs_l12w,
    max(duration) AS visit_session_dur_sum_l04w,
    max(duration) / nullif(max(visits_4w), 0) AS visit_session_dur_avg_l04w,
    max(speed) AS visit_interact_speed_avg_l04w, max(abandoned) AS visit_cart_abandon_rate_l04w,
    max(search_fail) AS visit_search_fail_rate_l04w, max(voucher_error) AS visit_voucher_error_rate_l04w,
    max(vendor_rating) AS rating_avg_l04w, max(survey_score) AS aos_score_last,
    max(survey_rating) AS aos_rating_last, coalesce(max(cc_sessions), 0) AS ccc_sessions_l04w
  FROM profile p JOIN mapping m ON p.entity = m.entity AND p.ext = m.ext
  WHERE first_order_ts IS NOT NULL
  GROUP BY m.entity, m.cust
)"""

KEYS = "entity AS global_entity_id, cust AS analytical_customer_id"

_MEASURE = {
    "order_count": "order_count",
    "order_count_late": "late_orders",
    "gmv_sum": "gmv_sum",
    "gmv_avg": "gmv_avg",
    "delivery_fee_sum": "delivery_fee_sum",
    "delivery_fee_avg": "delivery_fee_avg",
    "discount_sum": "discount_sum",
    "discount_avg": "discount_avg",
    "voucher_sum": "voucher_sum",
    "voucher_avg": "voucher_avg",
    "joker_cust_discount_sum": "joker_cust_discount_sum",
    "joker_vendor_fee_sum": "joker_vendor_fee_sum",
    "deliv_dist_m_avg": "deliv_dist_m_avg",
    "deliv_time_promised_avg": "deliv_time_promised_avg",
    "delivery_delay_avg": "delivery_delay_avg",
}
_COVER = {
    "coverage_vendors_qc": 10,
    "coverage_dmart": 3,
    "coverage_localstore": 4,
    "coverage_convenience": 5,
    "coverage_groceries": 6,
    "coverage_supermarket": 7,
    "coverage_vendors_qc_in_2000m": 8,
    "coverage_vendors_qc_in_4000m": 9,
    "coverage_vendors_qc_in_6000m": 13,
}

QC_GMV_AVG = (
    "coalesce((coalesce(dm_lifetime_gmv_sum, 0) + coalesce(ls_lifetime_gmv_sum, 0)) / nullif(qc_count, 0), 0)"
)
QC_VOUCHER = """CASE WHEN dm_first_date < ls_first_date THEN dm_first_voucher
      WHEN ls_first_date <= dm_first_date THEN ls_first_voucher END"""
QC_FREQ = f"qc_count / nullif(date_diff('day', qc_first_date, {AS_OF}), 0) * 28"


def flat_columns(local_stores: bool = False, dark_stores: bool = False, internal: bool = False) -> str:
    cols = {
        "first_order_date_vert_rs": "rs_first_date",
        "first_order_date_vert_qc": "qc_first_date",
        "order_count_lifetime_vert_qc": "qc_count",
        "order_count_lifetime_vert_dmart": "coalesce(dm_lifetime_order_count, 0)",
        "gmv_avg_lifetime_vert_qc": QC_GMV_AVG,
        "days_since_first_order_vert_rs": f"CAST(date_diff('day', rs_first_date, {AS_OF}) AS INTEGER)",
        "days_since_first_order_vert_qc": f"CAST(date_diff('day', qc_first_date, {AS_OF}) AS INTEGER)",
        "days_since_last_order_vert_rs": f"CAST(date_diff('day', rs_last_date, {AS_OF}) AS INTEGER)",
        "first_order_dayofweek_vert_rs": "CAST(dayofweek(rs_first_date) + 1 AS INTEGER)",
        "first_order_amt_gmv_eur_vert_rs": "rs_first_gmv",
        "first_order_delivery_fee_vert_rs": "rs_first_fee",
        "first_order_delivery_fee_pct_vert_rs": "coalesce(rs_first_fee / nullif(rs_first_gmv, 0), 0)",
        "first_order_delivery_dist_m_vert_rs": "rs_first_dist",
        "first_order_delivery_time_promised_vert_rs": "rs_first_promised",
        "first_order_delivery_delay_vert_rs": "rs_first_delay",
        "first_order_discount_vert_rs": "rs_first_discount",
        "first_order_discount_pct_vert_rs": "coalesce(rs_first_discount / nullif(rs_first_gmv, 0), 0)",
        "first_order_voucher_vert_rs": "rs_first_voucher",
        "first_order_voucher_pct_vert_rs": "coalesce(rs_first_voucher / nullif(rs_first_gmv, 0), 0)",
        "first_order_voucher_vert_qc": QC_VOUCHER,
        "cust_lat": "lat",
        "cust_long": "lon",
        "order_pct_late_l16w_vert_rs": "round(rs_l16w_late_orders / nullif(rs_l16w_order_count, 0), 2)",
        "order_pct_late_lifetime_vert_rs": "round(rs_lifetime_late_orders / nullif(rs_lifetime_order_count, 0), 2)",
    }
    for part in ("weekend", "morning", "afternoon", "night"):
        cols[f"order_perc_{part}_vert_rs"] = f"rs_lifetime_{part}_order_count / nullif(rs_lifetime_order_count, 0)"
    for name, source in _MEASURE.items():
        for window in _WINDOW:
            cols[f"{name}_{window}_vert_rs"] = f"rs_{window}_{source}"
    for name, modulus in _COVER.items():
        cols[name] = f"cust % {modulus}"
    cols["dist_nearest_vendor_qc"] = "reach"
    cols["dist_nearest_dmart"] = "reach + 50"
    cols["dist_nearest_localstore_vert_ls" if local_stores else "dist_nearest_localstore"] = "reach + 25"
    if local_stores:
        for window in _WINDOW:
            cols[f"deliv_dist_m_avg_{window}_vert_ls"] = f"ls_{window}_deliv_dist_m_avg"
    if dark_stores:
        cols["first_order_date_vert_dmart"] = "dm_first_date"
        cols["gmv_avg_lifetime_vert_dmart"] = (
            "coalesce(dm_lifetime_gmv_sum / nullif(dm_lifetime_order_count, 0), 0)"
        )
    if internal:
        cols["last_order_date_vert_rs"] = "rs_last_date"
        cols["order_count_late_lifetime_vert_qc"] = (
            "coalesce(dm_lifetime_late_orders, 0) + coalesce(ls_lifetime_late_orders, 0)"
        )
    return ",\n  ".join(f"{expr} AS {name}" for name, expr in cols.items())


ACTIVE = f"rs_first_date < {AS_OF} - 15 AND rs_last_date > {AS_OF} - 181"
CONVERSION = f"""(dm_first_date IS NULL OR (rs_first_date < {AS_OF} - 91 AND rs_last_date > {AS_OF} - 271
    AND rs_first_date < rs_last_date AND rs_last_date < dm_first_date))"""
_IS_ACTIVE = "coalesce(rs_l04w_order_count, 0) <> 0"
BEHAVIOUR = f"""{QC_FREQ} AS order_freq_4w_vert_qc,
  visit_vendors_available_l04w, visit_count_l04w_vs_l12w, visit_session_dur_sum_l04w,
  visit_interact_speed_avg_l04w, visit_cart_abandon_rate_l04w, visit_search_fail_rate_l04w,
  coalesce(visit_vendors_viewed_l04w, 0) AS visit_vendors_viewed_l04w,
  coalesce(visit_addresses_unique_l04w, 0) AS visit_addresses_unique_l04w,
  coalesce(visit_count_l04w, 0) AS visit_count_l04w, coalesce(visit_count_l12w, 0) AS visit_count_l12w,
  coalesce(visit_session_dur_sum_l04w, 0) AS visit_session_dur_avg_l04w,
  CASE WHEN {_IS_ACTIVE} THEN order_rate_online_payment_l04w END AS order_rate_online_payment_l04w,
  CASE WHEN {_IS_ACTIVE} THEN visit_voucher_error_rate_l04w END AS visit_voucher_error_rate_l04w,
  CASE WHEN {_IS_ACTIVE} THEN rating_avg_l04w END AS rating_avg_l04w,
  CASE WHEN {_IS_ACTIVE} THEN aos_score_last END AS aos_score_last,
  CASE WHEN {_IS_ACTIVE} THEN aos_rating_last END AS aos_rating_last,
  CASE WHEN {_IS_ACTIVE} THEN ccc_sessions_l04w ELSE 0 END AS ccc_sessions_l04w"""
USUAL = f"rs_lifetime_order_count > 0 AND NOT coalesce({QC_FREQ} >= 40, false) AND NOT coalesce(rs_l16w_order_count >= 100, false)"

WITH_PROFILE = f"{BASE}, {PROFILE}, {profile_rows()}, {ROLLUP}"


def feature_sql(where_entity: str = "true") -> str:
    return f"""SELECT {KEYS}, {flat_columns()}, {BEHAVIOUR}
FROM snap LEFT JOIN rolled ON r_entity = entity AND r_cust = cust
WHERE {ACTIVE} AND {USUAL} AND cust % 10 > 0 AND {where_entity}"""


FEATURES = f"features AS ({feature_sql()})"
STAGE = f"""stage AS (SELECT {KEYS}, {flat_columns(local_stores=True, dark_stores=True)}, {BEHAVIOUR}
FROM snap LEFT JOIN rolled ON r_entity = entity AND r_cust = cust
WHERE {CONVERSION} AND {USUAL})"""


def score(seed: int | str, key: str = "cust") -> str:
    return f"CAST('0x' || substr(md5('{seed}:' || {key}), 1, 8) AS BIGINT)"
