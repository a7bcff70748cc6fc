"""Statistics, metrics, encoders, column choice, splits and published tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import sql as q
from tidemark.catalog.base import query
from tidemark.functions.expressions import days_since, frequency_per_4_weeks
from tidemark.functions.hashing import noise_score, portable_hash, uniform
from tidemark.operators import cohorts, columns, encoders, flatten, metrics, sampling, stats, targets
from tidemark.operators.ordering import average_rank
from tidemark.params import TEST_RUN as RUN
from tidemark.plans import features
from tidemark.session import durable, scratch_path
from tidemark.sources import readers, writers
from tidemark.sources.snapshot import customer_snapshot
from tidemark.sources.tables import customers_with_entity, table

KEYS = flatten.KEYS
ID = "analytical_customer_id"

SCORED_PATHS = (
    "*.first_order.order_date",
    "*.first_order.voucher",
    "*.lifetime.order_count",
    "*.lifetime.gmv_sum",
    "restaurants.lifetime.gmv_avg",
    "restaurants.last*.order_count",
    "restaurants.lifetime.delivery_delay_avg",
    "restaurants.last_order.order_date",
)


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Every customer with targets, a model-free score in [0, 1) and a rough order-value prediction."""
    rs = "orders.restaurants"
    qc = flatten.qc_rollup_columns()
    cols = {
        "order_count_lifetime_vert_qc": qc["order_count_lifetime_vert_qc"],
        "order_count_lifetime_vert_dmart": qc["order_count_lifetime_vert_dmart"],
        "gmv_avg_lifetime_vert_qc": qc["gmv_avg_lifetime_vert_qc"],
        "first_order_voucher_vert_qc": flatten.first_qc_voucher(),
        "days_since_first_order_vert_qc": days_since(flatten.first_qc_date(), RUN.as_of),
        "days_since_first_order_vert_rs": days_since(f"{rs}.first_order.order_date", RUN.as_of),
        "gmv_avg_lifetime_vert_rs": F.col(f"{rs}.lifetime.gmv_avg"),
        "order_count_lifetime_vert_rs": F.col(f"{rs}.lifetime.order_count"),
        "order_count_l16w_vert_rs": F.col(f"{rs}.last16w.order_count"),
        "delivery_delay_avg_lifetime_vert_rs": F.col(f"{rs}.lifetime.delivery_delay_avg"),
        "cust_lat": F.col("location.last_order_location.last_order_latitude"),
        "cust_long": F.col("location.last_order_location.last_order_longitude"),
        "dist_nearest_dmart": F.col("location.coverage_metrics.dist_nearest_dmart"),
        "segment": F.nullif(F.col("segment"), F.lit("BUILDING")),
    }
    rows = flatten.flatten(customer_snapshot(spark, sf, RUN.as_of, paths=SCORED_PATHS), cols)
    rows = rows.withColumn(
        "order_freq_4w_vert_qc",
        frequency_per_4_weeks("order_count_lifetime_vert_qc", "days_since_first_order_vert_qc"),
    )
    return targets.with_targets(rows).select(
        "*",
        F.round(uniform(42, ID), 3).alias("score"),
        (F.col("gmv_avg_lifetime_vert_rs") * (uniform(43, ID) + 0.5)).alias("predicted_value"),
    )


def kept(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    """The named columns of `scored`, stored once for analyses that read their input more than once."""
    return durable(scored(spark, sf).select(*KEYS, *cols))


SCORED = f"""{q.BASE}, scored AS (
  SELECT {q.KEYS}, qc_count AS order_count_lifetime_vert_qc,
    coalesce(dm_lifetime_order_count, 0) AS order_count_lifetime_vert_dmart,
    {q.QC_GMV_AVG} AS gmv_avg_lifetime_vert_qc, rs_lifetime_gmv_avg AS gmv_avg_lifetime_vert_rs,
    date_diff('day', rs_first_date, {q.AS_OF}) AS days_since_first_order_vert_rs,
    rs_lifetime_order_count AS order_count_lifetime_vert_rs, rs_l16w_order_count AS order_count_l16w_vert_rs,
    rs_lifetime_delivery_delay_avg AS delivery_delay_avg_lifetime_vert_rs, lat AS cust_lat, lon AS cust_long,
    reach + 50 AS dist_nearest_dmart, nullif(segment, 'BUILDING') AS segment,
    CASE WHEN dm_lifetime_order_count > 0 THEN 1 ELSE 0 END AS {targets.GENERAL},
    CASE WHEN qc_count > 0 THEN CASE WHEN coalesce({q.QC_VOUCHER}, 0) = 0 THEN 1
      WHEN {q.QC_VOUCHER} > 0 THEN 0 END END AS {targets.ORGANIC},
    {q.QC_FREQ} AS {targets.FREQUENCY}, {q.QC_GMV_AVG} AS {targets.ORDER_VALUE},
    round({q.score(42)} / 4294967296e0, 3) AS score,
    rs_lifetime_gmv_avg * ({q.score(43)} / 4294967296e0 + 5e-1) AS predicted_value
  FROM snap
)"""
Y = targets.GENERAL
V = "gmv_avg_lifetime_vert_rs"


# ---------------------------------------------------------------- statistics


@query(
    "value_counts",
    f"WITH {SCORED} SELECT {targets.ORGANIC} AS target, count(*) AS n, count(*) / sum(count(*)) OVER () AS share "
    "FROM scored GROUP BY 1",
)
def _(spark, sf):
    return stats.value_counts(scored(spark, sf).select(F.col(targets.ORGANIC).alias("target")), "target")


@query(
    "distinct_counts",
    """SELECT 'p_brand' AS feature, count(DISTINCT p_brand) AS n_distinct FROM part
    UNION ALL SELECT 'p_type', count(DISTINCT p_type) FROM part
    UNION ALL SELECT 'p_size', count(DISTINCT p_size) FROM part
    UNION ALL SELECT 'p_name', count(DISTINCT p_name) FROM part""",
)
def _(spark, sf):
    return stats.distinct_counts(table(spark, sf, "part"), ["p_brand", "p_type", "p_size", "p_name"])


@query(
    "baseline_mean",
    f"WITH {SCORED} SELECT global_entity_id, {ID}, round(avg({Y}) OVER (), 9) AS preds_benchmark FROM scored",
)
def _(spark, sf):
    rows = stats.with_baseline(scored(spark, sf), Y, "preds_benchmark")
    return rows.select(*KEYS, F.round("preds_benchmark", 9).alias("preds_benchmark"))


@query(
    "crosstab_confusion",
    f"""WITH {SCORED} SELECT {Y} AS actual, count(*) FILTER (round_even(score, 0) = 0) AS predicted_0,
      count(*) FILTER (round_even(score, 0) = 1) AS predicted_1 FROM scored GROUP BY 1""",
)
def _(spark, sf):
    return stats.crosstab(scored(spark, sf), Y, "score", ID)


@query(
    "score_terciles",
    f"""WITH {SCORED}, cut AS (
      SELECT quantile_cont(score, 0.333) AS p33, quantile_cont(score, 0.666) AS p66 FROM scored WHERE {Y} = 0)
    SELECT global_entity_id, {ID}, score, round(p33, 9) AS p33, round(p66, 9) AS p66,
      CASE WHEN score <= p33 THEN 'low' WHEN score <= p66 THEN 'mid' ELSE 'high' END AS segment FROM scored, cut""",
)
def _(spark, sf):
    rows = kept(spark, sf, "score", Y)
    return stats.tercile_segments(rows, "score", Y).drop(Y)


_DESCRIBED = (V, "order_count_lifetime_vert_rs", "dist_nearest_dmart", "order_count_l16w_vert_rs", targets.FREQUENCY)


@query(
    "describe_features",
    f"WITH {SCORED} " + " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, count({c}) AS "count", round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
          round(min({c}), 6) AS min, """
        + ", ".join(
            f"round(quantile_cont(CAST({c} AS DOUBLE), {p}), 6) AS {n}" for n, p in stats.DESCRIBE_PROBABILITIES.items()
        )
        + f", round(max({c}), 6) AS max FROM scored" for c in _DESCRIBED),
)
def _(spark, sf):
    return stats.describe(kept(spark, sf, *_DESCRIBED), _DESCRIBED)


_PROFILED = ("rating_avg_l04w", "visit_count_l12w", "gmv_sum_l04w_vert_rs", "dist_nearest_dmart", "first_order_date_vert_qc")


@query(
    "column_profile",
    f"WITH {q.WITH_PROFILE}, {q.FEATURES} " + " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, '{t}' AS type, count(*) AS n_rows, count(*) - count({c}) AS n_null,
          round((count(*) - count({c})) * 100 / nullif(count(*), 0), 4) AS isnull_pct FROM features"""
        for c, t in zip(_PROFILED, ("double", "bigint", "double", "double", "date"), strict=True)),
)
def _(spark, sf):
    return stats.column_profile(features.feature_table(spark, sf, RUN).select(*_PROFILED))


def _histogram_sql(source: str, expr: str, bins: int, keys: str = "", condition: str = "true") -> str:
    key_list = f"{keys}, " if keys else ""
    return f"""v AS (SELECT {key_list}{expr} AS v FROM {source} WHERE {expr} IS NOT NULL AND {condition}),
    e AS (SELECT min(v) AS lo, max(v) AS hi, (max(v) - min(v)) / {bins} AS w FROM v),
    c AS (SELECT {key_list}least(CAST(floor((v - lo) / w) AS INTEGER), {bins - 1}) AS bin, count(*) AS n FROM v, e GROUP BY ALL),
    g AS (SELECT * FROM (SELECT {f'DISTINCT {keys} FROM v' if keys else '1 AS one'}), (SELECT CAST(unnest(range({bins})) AS INTEGER) AS bin)),
    t AS (SELECT {key_list}count(*) AS n_all FROM v GROUP BY ALL)"""


@query(
    "histogram",
    f"""WITH {SCORED}, {_histogram_sql('scored', V, 25)}
    SELECT '{V}' AS feature, g.bin, round(lo + g.bin * w, 6) AS bin_from, coalesce(n, 0) AS n,
      round(coalesce(n, 0) / (n_all * w), 9) AS density
    FROM g CROSS JOIN e CROSS JOIN t LEFT JOIN c ON c.bin = g.bin""",
)
def _(spark, sf):
    return stats.histogram(kept(spark, sf, V), [V], 25)


@query(
    "histogram_by_target",
    f"""WITH {SCORED}, {_histogram_sql('scored', 'score', 50, Y)}
    SELECT 'score' AS feature, g.{Y}, g.bin, round(lo + g.bin * w, 6) AS bin_from, coalesce(n, 0) AS n,
      round(coalesce(n, 0) / (n_all * w), 9) AS density
    FROM g CROSS JOIN e JOIN t ON t.{Y} = g.{Y} LEFT JOIN c ON c.bin = g.bin AND c.{Y} = g.{Y}""",
)
def _(spark, sf):
    return stats.histogram(kept(spark, sf, "score", Y), ["score"], 50, by=Y)


@query(
    "clip_quantile",
    f"""WITH {SCORED} SELECT global_entity_id, {ID}, CASE WHEN {targets.FREQUENCY} IS NOT NULL THEN
      round(greatest(0, least({targets.FREQUENCY}, (SELECT quantile_cont({targets.FREQUENCY}, 0.99) FROM scored))), 9) END
      AS clipped FROM scored""",
)
def _(spark, sf):
    rows = stats.clip_at_quantile(kept(spark, sf, targets.FREQUENCY), targets.FREQUENCY, 0.0, 0.99, "clipped")
    return rows.select(*KEYS, F.round("clipped", 9).alias("clipped"))


_LEAK = ("days_since_first_order_vert_rs", V, "delivery_delay_avg_lifetime_vert_rs")


@query(
    "leakage_check",
    f"WITH {SCORED} SELECT {Y} AS target, " + ", ".join(
        f"round(avg({c}), 6) AS {c}_mean, min({c}) AS {c}_min, max({c}) AS {c}_max" for c in _LEAK)
    + " FROM scored GROUP BY 1",
)
def _(spark, sf):
    rows = scored(spark, sf).withColumn("days_since_first_order_vert_rs", F.col(_LEAK[0]).cast("bigint"))
    return stats.group_summary(rows.withColumnRenamed(Y, "target"), "target", _LEAK)


@query(
    "joint_regression",
    f"""WITH {SCORED} SELECT count(*) AS n, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 4) AS intercept,
      round(regr_r2(y, x), 6) AS r2, round(corr(x, y), 6) AS corr
    FROM (SELECT gmv_avg_lifetime_vert_rs AS x, gmv_avg_lifetime_vert_qc AS y FROM scored WHERE {Y} = 1)
    WHERE x IS NOT NULL AND y IS NOT NULL""",
)
def _(spark, sf):
    converted = scored(spark, sf).filter(F.col(Y) == 1)
    return stats.joint_regression(converted, V, "gmv_avg_lifetime_vert_qc")


@query(
    "ci95",
    f"""WITH {SCORED}, runs AS (SELECT global_entity_id, segment, avg(score) AS value FROM scored GROUP BY ALL)
    SELECT global_entity_id, count(*) AS runs, round(avg(value), 6) AS mean,
      round(avg(value) - 1.96e0 * stddev_pop(value) / sqrt(count(*)), 6) AS ci_low,
      round(avg(value) + 1.96e0 * stddev_pop(value) / sqrt(count(*)), 6) AS ci_high FROM runs GROUP BY 1""",
)
def _(spark, sf):
    runs = scored(spark, sf).groupBy("global_entity_id", "segment").agg(F.avg("score").alias("value"))
    return stats.confidence_interval(runs, "value", ["global_entity_id"])


@query(
    "quantile_bands",
    f"""WITH {SCORED}, conv AS (SELECT {V} AS a, gmv_avg_lifetime_vert_qc AS b FROM scored WHERE {Y} = 1),
    e AS (SELECT quantile_cont(a, [0e0, 3e-1, 6e-1, 9e-1, 1e0]) AS q FROM conv),
    banded AS (SELECT CASE WHEN a > q[1] AND a < q[2] THEN 0 WHEN a > q[2] AND a < q[3] THEN 1
        WHEN a > q[3] AND a < q[4] THEN 2 WHEN a > q[4] AND a < q[5] THEN 3 END AS band, a, b FROM conv, e),
    long AS (SELECT band, '{V}' AS feature, a AS v FROM banded UNION ALL
             SELECT band, 'gmv_avg_lifetime_vert_qc', b FROM banded),
    span AS (SELECT band, min(v) AS lo, (max(v) - min(v)) / 30 AS w FROM long WHERE v IS NOT NULL GROUP BY 1)
    SELECT band, feature, least(CAST(floor((v - lo) / w) AS INTEGER), 29) AS bin, count(*) AS n
    FROM long JOIN span USING (band) WHERE v IS NOT NULL GROUP BY ALL""",
)
def _(spark, sf):
    converted = kept(spark, sf, V, "gmv_avg_lifetime_vert_qc", Y).filter(F.col(Y) == 1)
    return stats.quantile_band_histogram(converted, V, [V, "gmv_avg_lifetime_vert_qc"])


@query(
    "avg_rank",
    f"""WITH {SCORED} SELECT global_entity_id, {ID}, order_count_lifetime_vert_rs,
      CASE WHEN order_count_lifetime_vert_rs IS NOT NULL THEN CAST(floor(rank() OVER (ORDER BY order_count_lifetime_vert_rs DESC NULLS LAST)
        + (count(*) OVER (PARTITION BY order_count_lifetime_vert_rs) - 1) / 2) AS INTEGER) END AS order_rank FROM scored""",
)
def _(spark, sf):
    rows = kept(spark, sf, "order_count_lifetime_vert_rs")
    return average_rank(rows, "order_count_lifetime_vert_rs", "order_rank")


@query(
    "score_bands",
    f"""WITH {SCORED} SELECT global_entity_id, {ID}, score, {Y} AS target,
      CASE WHEN score > 0.999e0 THEN 'overfit' ELSE 'normal' END AS band, dist_nearest_dmart
    FROM scored WHERE score > 0.999e0 OR (score > 0.2e0 AND score < 0.21e0)""",
)
def _(spark, sf):
    s = F.col("score")
    overfit, normal = cohorts.score_band(s, 0.999), cohorts.score_band(s, 0.2, 0.21)
    return scored(spark, sf).filter(overfit | normal).select(
        *KEYS, "score", F.col(Y).alias("target"), F.when(overfit, "overfit").otherwise("normal").alias("band"),
        "dist_nearest_dmart",
    )


@query(
    "noise_score",
    f"SELECT c_custkey AS {ID}, ({q.score(7, 'c_custkey')} % 9999 + 1) / 1e4 AS noise FROM customer",
)
def _(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias(ID), noise_score(7, "c_custkey").alias("noise"))


@query(
    "blend_scores",
    f"""SELECT c_custkey AS {ID}, round({q.score(1, 'c_custkey')} / 4294967296e0 * 0.9e0
      + {q.score(2, 'c_custkey')} / 4294967296e0 * 0.1e0, 9) AS preds_final FROM customer""",
)
def _(spark, sf):
    rows = table(spark, sf, "customer").select(
        F.col("c_custkey").alias(ID), uniform(1, "c_custkey").alias("a"), uniform(2, "c_custkey").alias("b")
    )
    return rows.select(ID, F.round(columns.blend({"a": 0.9, "b": 0.1}), 9).alias("preds_final"))


@query(
    "select_features",
    f"""WITH {SCORED} SELECT global_entity_id, {ID}, {V}, order_count_l16w_vert_rs, order_count_lifetime_vert_rs,
      CAST(days_since_first_order_vert_rs AS INTEGER) AS days_since_first_order_vert_rs FROM scored""",
)
def _(spark, sf):
    rows = scored(spark, sf)
    names = columns.select_features(rows, "number", contains=["vert_rs"], not_contains=["delay"])
    return rows.select(*KEYS, *names)


# ---------------------------------------------------------------- metrics

_AUC_SQL = """(SELECT round(sum(CASE WHEN p.s > n.s THEN 1e0 WHEN p.s = n.s THEN 5e-1 ELSE 0 END) / count(*), 4)
      FROM (SELECT score AS s FROM scored WHERE {y} = 1 AND {c}) p, (SELECT score AS s FROM scored WHERE {y} = 0 AND {c}) n)"""


def _binary_sql(group: str = "", auc_condition: str = "true") -> str:
    y = Y
    tp = f"count(*) FILTER ({y} = 1 AND hit = 1)"
    return f"""SELECT {group}{_AUC_SQL.format(y=y, c=auc_condition)} AS roc_auc,
      round(coalesce(2 * {tp} / nullif(2 * {tp} + count(*) FILTER ({y} = 0 AND hit = 1) + count(*) FILTER ({y} = 1 AND hit = 0), 0), 0), 4) AS f1,
      round(coalesce({tp} / nullif(count(*) FILTER (hit = 1), 0), 0), 4) AS precision,
      round(coalesce({tp} / nullif(count(*) FILTER ({y} = 1), 0), 0), 4) AS recall,
      round(avg(CAST({y} = hit AS INTEGER)), 4) AS accuracy,
      round(avg(-CASE WHEN {y} = 1 THEN ln(p) ELSE ln(1 - p) END), 4) AS log_loss
    FROM (SELECT *, round_even(score, 0) AS hit,
      least(greatest(score, 2.220446049250313e-16), 1 - 2.220446049250313e-16) AS p FROM scored)"""


@query("binary_metrics", f"WITH {SCORED} {_binary_sql()}")
def _(spark, sf):
    return metrics.binary_metrics(kept(spark, sf, Y, "score"), Y, "score")


@query(
    "binary_metrics_by_entity",
    f"""WITH {SCORED}, ranked AS (SELECT *, rank() OVER (PARTITION BY global_entity_id ORDER BY score)
        + (count(*) OVER (PARTITION BY global_entity_id, score) - 1) / 2 AS r FROM scored),
    auc AS (SELECT global_entity_id, sum({Y}) AS pos, round((sum(r) FILTER ({Y} = 1) - sum({Y}) * (sum({Y}) + 1) / 2)
        / (sum({Y}) * (count(*) - sum({Y}))), 4) AS roc_auc FROM ranked GROUP BY 1)
    SELECT global_entity_id, roc_auc, * EXCLUDE (global_entity_id, pos, roc_auc) FROM (
      {_binary_sql('global_entity_id, ').replace(_AUC_SQL.format(y=Y, c='true') + ' AS roc_auc,', '')} GROUP BY 1)
      JOIN auc USING (global_entity_id)""",
)
def _(spark, sf):
    return metrics.binary_metrics(kept(spark, sf, Y, "score"), Y, "score", ["global_entity_id"])


def _reg_sql(group: str) -> str:
    return f"""SELECT {group}round(avg((y - p) ** 2), 4) AS mse, round(sqrt(avg((y - p) ** 2)), 4) AS rmse,
      round(median(abs(y - p)), 4) AS median_ae, round(median(abs(y - p)), 4) AS mae,
      round(1 - sum((y - p) ** 2) / nullif(var_pop(y) * count(*), 0), 4) AS r2,
      CASE WHEN min(y) > 0 THEN round(avg(abs((y - p) / nullif(y, 0))), 4) END AS mape,
      count(*) FILTER (p <= 0) AS y_pred_lower_equal_0, round(max(p), 2) AS y_pred_max, round(stddev_pop(p), 4) AS std
    FROM (SELECT global_entity_id, {V} / 1000 AS y, predicted_value / 1000 AS p FROM scored)
    WHERE y IS NOT NULL AND p IS NOT NULL"""


def _valued(spark, sf):
    rows = kept(spark, sf, V, "predicted_value")
    return rows.select(*KEYS, (F.col(V) / 1000).alias("y"), (F.col("predicted_value") / 1000).alias("p"))


@query("reg_metrics", f"WITH {SCORED} {_reg_sql('')}")
def _(spark, sf):
    return metrics.regression_metrics(_valued(spark, sf), "y", "p")


@query("reg_metrics_by_entity", f"WITH {SCORED} {_reg_sql('global_entity_id, ')} GROUP BY 1")
def _(spark, sf):
    return metrics.regression_metrics(_valued(spark, sf), "y", "p", ["global_entity_id"])


# The area under the curve is one half for any constant score, whatever the rows.
@query(
    "baseline_metrics",
    f"""WITH {SCORED}, b AS (SELECT *, avg({Y}) OVER () AS p FROM scored)
    SELECT CAST(0.5 AS DOUBLE) AS roc_auc,
      round(coalesce(2 * sum({Y} * round_even(p, 0)) / nullif(sum({Y} + round_even(p, 0)), 0), 0), 4) AS f1,
      round(coalesce(sum({Y} * round_even(p, 0)) / nullif(sum(round_even(p, 0)), 0), 0), 4) AS precision,
      round(coalesce(sum({Y} * round_even(p, 0)) / nullif(sum({Y}), 0), 0), 4) AS recall,
      round(avg(CAST({Y} = round_even(p, 0) AS INT)), 4) AS accuracy, round(avg(-CASE WHEN {Y} = 1 THEN ln(p) ELSE ln(1 - p) END), 4) AS log_loss
    FROM b""",
)
def _(spark, sf):
    rows = stats.with_baseline(kept(spark, sf, Y), Y, "preds_benchmark")
    return metrics.binary_metrics(rows, Y, "preds_benchmark")


@query(
    "confusion_rates",
    f"""WITH {SCORED}, n AS (SELECT count(*) FILTER ({Y} = 0 AND score <= 0.5) AS tn, count(*) FILTER ({Y} = 0 AND score > 0.5) AS fp,
      count(*) FILTER ({Y} = 1 AND score <= 0.5) AS fn, count(*) FILTER ({Y} = 1 AND score > 0.5) AS tp FROM scored)
    SELECT *, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, tn / (tn + fp) AS specificity, tn / (tn + fn) AS npv FROM n""",
)
def _(spark, sf):
    return metrics.confusion_rates(scored(spark, sf), Y, "score")


@query(
    "metrics_text",
    f"""WITH {SCORED}, m AS ({_binary_sql()}) SELECT printf('roc auc: %.4f | f1: %.4f | precision: %.4f | recall: %.4f | '
      || 'accuracy: %.4f | log loss: %.4f | ', roc_auc, f1, precision, recall, accuracy, log_loss) AS line FROM m""",
)
def _(spark, sf):
    return metrics.binary_metrics(kept(spark, sf, Y, "score"), Y, "score").select(metrics.binary_text().alias("line"))


@query(
    "metrics_table",
    f"""WITH {SCORED}, b AS ({_binary_sql()}), r AS ({_reg_sql('')})
    SELECT '{Y}' AS target, * FROM b UNION ALL BY NAME SELECT '{targets.ORDER_VALUE}' AS target, * FROM r""",
)
def _(spark, sf):
    rows = kept(spark, sf, Y, "score")
    return metrics.metrics_table({
        Y: metrics.binary_metrics(rows, Y, "score"),
        targets.ORDER_VALUE: metrics.regression_metrics(_valued(spark, sf), "y", "p"),
    })


@query(
    "cluster_eval",
    f"""WITH {SCORED} SELECT segment, round(avg(cust_lat), 6) AS cust_lat, round(avg(cust_long), 6) AS cust_long,
      round(avg(score), 6) AS mean_score,
      CASE WHEN min({Y}) <> max({Y}) THEN round(count(*) FILTER ({Y} = 1 AND round_even(score, 0) = 1) / count(*) FILTER ({Y} = 1), 4) END AS recall
    FROM scored GROUP BY segment""",
)
def _(spark, sf):
    return metrics.cluster_evaluation(scored(spark, sf), "segment", Y, "score")


@query(
    "topk_importance",
    """SELECT p_brand AS feature, round(sum(p_retailprice) / (SELECT sum(p_retailprice) FROM part), 6) AS imp_mean
    FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
)
def _(spark, sf):
    from tidemark.operators.explain import top_features

    part = table(spark, sf, "part")
    whole = part.agg(F.sum("p_retailprice")).scalar()
    shares = part.groupBy(F.col("p_brand").alias("feature")).agg(
        F.round(F.sum("p_retailprice") / whole, 6).alias("imp_mean")
    )
    return top_features(shares, "imp_mean", 10)


# ---------------------------------------------------------------- encoders


def _orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")


def _people(spark, sf):
    rows = customers_with_entity(spark, sf)
    return rows.select(ID, F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("segment"), F.col("global_entity_id").alias("entity"))


_PEOPLE_SQL = f"{q.PEOPLE}, p AS (SELECT cust AS {ID}, nullif(segment, 'BUILDING') AS segment, entity FROM people)"


@query(
    "bin_rare",
    """SELECT o_orderkey, o_custkey, o_orderpriority,
      CASE WHEN count(*) OVER (PARTITION BY o_custkey) < 10 THEN 'OTHER_HIGH_CARDINALITY' ELSE CAST(o_custkey AS VARCHAR) END
        AS o_custkey__min_count_10,
      CASE WHEN count(*) OVER (PARTITION BY o_orderpriority) < 10 THEN 'OTHER_HIGH_CARDINALITY' ELSE o_orderpriority END
        AS o_orderpriority__min_count_10 FROM orders""",
)
def _(spark, sf):
    return encoders.bin_rare(_orders(spark, sf), ["o_custkey", "o_orderpriority"], min_count=10)[0]


@query(
    "count_encode",
    f"""WITH {_PEOPLE_SQL} SELECT *, CASE WHEN segment IS NOT NULL THEN count(*) OVER (PARTITION BY segment) END AS ft_segment__count,
      count(*) OVER (PARTITION BY entity) AS ft_entity__count FROM p""",
)
def _(spark, sf):
    return encoders.count_encode(_people(spark, sf), ["segment", "entity"])[0]


@query(
    "count_encode_scaled",
    f"""WITH {_PEOPLE_SQL}, n AS (SELECT *, CASE WHEN segment IS NOT NULL THEN count(*) OVER (PARTITION BY segment) END AS c,
        count(*) OVER (PARTITION BY entity) AS d FROM p)
    SELECT {ID}, round((c - avg(c) OVER ()) / stddev_pop(c) OVER (), 6) AS ft_segment__count_scaled_standard,
      round((d - min(d) OVER ()) / (max(d) OVER () - min(d) OVER ()), 6) AS ft_entity__count_scaled_minmax FROM n""",
)
def _(spark, sf):
    rows, _a = encoders.count_encode(_people(spark, sf), ["segment"], scaler="standard", drop=True)
    rows, _b = encoders.count_encode(rows, ["entity"], scaler="minmax", drop=True)
    return rows.select(ID, *[F.round(c, 6).alias(c) for c in rows.columns if c.startswith("ft_")])


@query(
    "label_encode",
    """SELECT *, dense_rank() OVER (ORDER BY p_brand) - 1 AS ft_p_brand__label,
      dense_rank() OVER (ORDER BY p_size) - 1 AS ft_p_size__label,
      dense_rank() OVER (ORDER BY p_name) - 1 AS ft_p_name__label FROM (SELECT p_partkey, p_brand, p_size, p_name FROM part)""",
)
def _(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_brand", "p_size", "p_name")
    return encoders.label_encode(part, ["p_brand", "p_size", "p_name"])[0]


_SEGMENTS = ("AUTOMOBILE", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query(
    "one_hot",
    f"""WITH {_PEOPLE_SQL} SELECT *, """ + ", ".join(
        f'CASE WHEN segment = \'{s}\' THEN 1 ELSE 0 END AS "ft_segment__one_hot__{s}"' for s in _SEGMENTS) + " FROM p",
)
def _(spark, sf):
    return encoders.one_hot(_people(spark, sf), ["segment", ID])[0]


# ---------------------------------------------------------------- splits and samples


def _u(seed: int | str) -> str:
    return f"{q.score(seed, ID)} / 4294967296e0"


@query(
    "split_stratified",
    f"""WITH {SCORED}, r AS (SELECT {Y} AS target, row_number() OVER (PARTITION BY {Y} ORDER BY {q.score("split42", ID)}, {ID}) AS k,
      count(*) OVER (PARTITION BY {Y}) AS n, {ID} FROM scored)
    SELECT {ID}, target, CASE WHEN k <= floor(n * 0.2e0 + 0.5e0) THEN 'valid' ELSE 'train' END AS split FROM r""",
)
def _(spark, sf):
    rows = kept(spark, sf, Y).select(ID, F.col(Y).alias("target"))
    return sampling.split_exact(rows, [ID], "target")


@query(
    "split_plain",
    f"SELECT c_custkey AS {ID}, CASE WHEN {q.score('split42', 'c_custkey')} / 4294967296e0 < 0.2e0 THEN 'valid' ELSE 'train' END AS split FROM customer",
)
def _(spark, sf):
    return sampling.split(table(spark, sf, "customer").select(F.col("c_custkey").alias(ID)), [ID])


@query("kfold_assign", f"SELECT c_custkey AS {ID}, CAST({q.score(41, 'c_custkey')} % 5 AS INTEGER) AS fold FROM customer")
def _(spark, sf):
    return sampling.assign_folds(table(spark, sf, "customer").select(F.col("c_custkey").alias(ID)), [ID])


@query(
    "undersample",
    f"""WITH {SCORED} SELECT {ID}, {Y} AS target FROM scored WHERE {Y} = 1
    UNION ALL SELECT {ID}, {Y} FROM scored WHERE {Y} = 0 AND {_u(2)} < 0.07e0""",
)
def _(spark, sf):
    rows = scored(spark, sf).select(ID, F.col(Y).alias("target"))
    return sampling.undersample(rows, "target", [ID])


@query(
    "simulate_samples",
    f"""WITH {SCORED}, runs AS (SELECT CAST(unnest(range(30)) AS INTEGER) AS seed)
    SELECT seed, count(*) AS n, sum({Y})::BIGINT AS positives, round(avg(score), 6) AS mean_score FROM scored, runs
    WHERE {Y} = 1 OR CAST('0x' || substr(md5(seed || ':' || {ID}), 1, 8) AS BIGINT) / 4294967296e0 < 0.07e0 GROUP BY seed""",
)
def _(spark, sf):
    rows = scored(spark, sf).select(ID, F.col(Y).alias("target"), "score")
    return (
        sampling.simulated_samples(rows, "target", [ID])
        .groupBy("seed")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("target").alias("positives"),
            F.round(F.avg("score"), 6).alias("mean_score"),
        )
    )


@query(
    "imbalance_sweep",
    f"""WITH {SCORED}, f AS (SELECT unnest([1e-2, 2e-2, 3e-2, 4e-2, 5e-2, 6e-2, 7e-2, 8e-2, 9e-2, 1e-1]) AS fraction)
    SELECT fraction, count(*) FILTER ({Y} = 0 AND {_u(0)} < fraction) AS negatives, count(*) FILTER ({Y} = 1) AS positives,
      round(count(*) FILTER ({Y} = 1) / (count(*) FILTER ({Y} = 1) + count(*) FILTER ({Y} = 0 AND {_u(0)} < fraction)), 6)
        AS positive_share FROM scored, f GROUP BY fraction""",
)
def _(spark, sf):
    rows = scored(spark, sf).select(ID, F.col(Y).alias("target"))
    return sampling.imbalance_sweep(rows, "target", [ID])


@query(
    "hash_sample",
    f"SELECT c_custkey AS {ID} FROM customer ORDER BY {q.score(42, 'c_custkey')}, c_custkey LIMIT 500",
)
def _(spark, sf):
    return sampling.hash_sample(table(spark, sf, "customer").select(F.col("c_custkey").alias(ID)), [ID], 500)


# ---------------------------------------------------------------- published tables


@query(
    "prediction_export",
    f"""WITH {SCORED} SELECT global_entity_id AS entity, DATE '2001-07-29' AS date, {ID}, {Y},
      CAST({targets.ORGANIC} AS FLOAT) AS {targets.ORGANIC}, CAST({targets.FREQUENCY} AS FLOAT) AS {targets.FREQUENCY},
      CAST({targets.ORDER_VALUE} AS FLOAT) AS {targets.ORDER_VALUE},
      CAST(score AS FLOAT) AS preds_acquisition_qc_general_0_1_final FROM scored""",
)
def _(spark, sf):
    rows = scored(spark, sf).withColumnRenamed("score", "preds_acquisition_qc_general_0_1_final")
    partitions = [F.col("global_entity_id").alias("entity"), F.lit(RUN.date_until).alias("date")]
    path = scratch_path(spark, "predictions")
    writers.save_partitioned(writers.prediction_export(rows, extra=partitions), path, sort_by=ID)
    return readers.load(spark, path)
