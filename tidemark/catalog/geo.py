"""Geographic queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import sql as q
from tidemark.catalog.analysis import SCORED, scored
from tidemark.catalog.base import query
from tidemark.functions.hashing import portable_hash
from tidemark.operators import geo, targets
from tidemark.operators.flatten import KEYS, flatten, location_columns
from tidemark.params import TEST_RUN as RUN
from tidemark.session import durable, scratch_path
from tidemark.sources.readers import read_lookup_csv
from tidemark.sources.snapshot import customer_snapshot

ID = "analytical_customer_id"


def positions(spark: SparkSession, sf: str) -> DataFrame:
    snapshot = customer_snapshot(spark, sf, RUN.as_of, paths=("restaurants.lifetime.order_count",))
    return durable(flatten(snapshot, location_columns()).select(*KEYS, "cust_lat", "cust_long"))


POSITIONS = f"{q.BASE}, pos AS (SELECT {q.KEYS}, lat AS cust_lat, lon AS cust_long FROM snap)"


def _near(radius: str) -> str:
    return f"""CASE WHEN p.cust_lat IS NOT NULL THEN (SELECT count(*) FROM pos o
      WHERE (o.cust_lat - p.cust_lat) * (o.cust_lat - p.cust_lat) + (o.cust_long - p.cust_long) * (o.cust_long - p.cust_long)
        <= {radius} * {radius}) END"""


@query(
    "radius_density",
    f"""WITH {POSITIONS} SELECT p.*, {_near('1e-2')} AS "density_count_radius_0.01",
      {_near('3e-2')} AS "density_count_radius_0.03" FROM pos p""",
)
def _(spark, sf):
    return geo.radius_density(positions(spark, sf), [0.01, 0.03])


_CELL_SQL = "CAST(floor(cust_lat * 100) AS BIGINT) || '_' || CAST(floor(cust_long * 100) AS BIGINT)"


@query(
    "cell_population",
    f"""WITH {POSITIONS}, c AS (SELECT *, {_CELL_SQL} AS cell FROM pos),
    h AS (SELECT DISTINCT cell, CAST('0x' || substr(md5('42:' || cell), 1, 8) AS BIGINT) AS h FROM c WHERE cell IS NOT NULL)
    SELECT global_entity_id, {ID}, cell AS last_order_h3_level_8, h % 5000 AS h38_population
    FROM c LEFT JOIN (SELECT * FROM h WHERE h % 4 <> 0) USING (cell)""",
)
def _(spark, sf):
    def part(c: str):
        return F.floor(F.col(c) * 100).cast("string")

    cell = F.when(F.col("cust_lat").isNotNull(), F.concat_ws("_", part("cust_lat"), part("cust_long")))
    rows = positions(spark, sf).select(*KEYS, cell.alias("last_order_h3_level_8"))
    hashed = portable_hash(42, "h38_id")
    census = (
        rows.filter(F.col("last_order_h3_level_8").isNotNull())
        .select(F.col("last_order_h3_level_8").alias("h38_id"))
        .distinct()
        .filter(hashed % 4 != 0)
        .select("h38_id", (hashed % 5000).alias("h38_population"))
    )
    path = scratch_path(spark, "population")
    census.write.option("header", True).csv(path)
    lookup = read_lookup_csv(spark, path, "h38_id string, h38_population bigint")
    return geo.cell_population(rows, lookup, "last_order_h3_level_8")


KMEANS_STEPS = 25  # what both sides take at most; centres that rest earlier stay where they are


def _kmeans_column(k: int) -> str:
    return f"CAST(arg_min(c, CAST((lat - px) * (lat - px) + (lon - py) * (lon - py) AS HUGEINT) * 1000 + c) FILTER (k = {k}) AS INTEGER) AS cluster_kmeans_{k}"


def _kmeans_sql(sizes: tuple[int, ...]) -> str:
    """CTEs pts and steps; the centres are the rows of the last step."""
    return f"""pts AS MATERIALIZED (
      SELECT *, CAST(floor(cust_lat * 1e6 + 0.5e0) AS BIGINT) AS lat, CAST(floor(cust_long * 1e6 + 0.5e0) AS BIGINT) AS lon,
        row_number() OVER (ORDER BY {q.score(42, ID)}, {ID}) - 1 AS place
      FROM pos WHERE cust_lat IS NOT NULL AND cust_long IS NOT NULL),
    steps(i, k, c, px, py) AS (
      SELECT 0, k, place, lat, lon FROM (VALUES {', '.join(f'({k})' for k in sizes)}) sizes(k) JOIN pts ON place < k
      UNION ALL
      SELECT i + 1, k, c, coalesce(CAST(sum(lat) FILTER (near) // count(*) FILTER (near) AS BIGINT), any_value(px)),
        coalesce(CAST(sum(lon) FILTER (near) // count(*) FILTER (near) AS BIGINT), any_value(py))
      FROM (SELECT s.*, p.lat, p.lon,
          row_number() OVER (PARTITION BY k, p.place ORDER BY (lat - px) * (lat - px) + (lon - py) * (lon - py), c) = 1 AS near
        FROM steps s, pts p WHERE s.i < {KMEANS_STEPS})
      GROUP BY i, k, c),
    kmeans AS (SELECT global_entity_id, {ID}, any_value(cust_lat) AS cust_lat, any_value(cust_long) AS cust_long,
      {', '.join(_kmeans_column(k) for k in sizes)}
      FROM pts, (SELECT * FROM steps WHERE i = {KMEANS_STEPS}) GROUP BY global_entity_id, {ID})"""


@query("geo_kmeans", f"WITH RECURSIVE {POSITIONS}, {_kmeans_sql(geo.KMEANS_SIZES)} SELECT * FROM kmeans")
def _(spark, sf):
    return geo.kmeans_clusters(positions(spark, sf), [ID], steps=KMEANS_STEPS)


@query(
    "geo_cluster_eval",
    f"""WITH RECURSIVE {SCORED}, pos AS (SELECT {q.KEYS}, lat AS cust_lat, lon AS cust_long FROM snap), {_kmeans_sql((10,))}
    SELECT cluster_kmeans_10, round(avg(kmeans.cust_lat), 6) AS cust_lat, round(avg(kmeans.cust_long), 6) AS cust_long,
      round(avg(score), 6) AS mean_score,
      CASE WHEN min({targets.GENERAL}) <> max({targets.GENERAL}) THEN round(count(*) FILTER ({targets.GENERAL} = 1 AND round_even(score, 0) = 1)
        / count(*) FILTER ({targets.GENERAL} = 1), 4) END AS recall
    FROM kmeans JOIN scored USING (global_entity_id, {ID}) GROUP BY cluster_kmeans_10""",
)
def _(spark, sf):
    from tidemark.plans.experiment import cluster_recall

    rows = durable(scored(spark, sf))
    placed = geo.kmeans_clusters(rows, [ID], sizes=(10,), steps=KMEANS_STEPS)
    return cluster_recall(rows, placed, list(KEYS), "cluster_kmeans_10", targets.GENERAL, "score")


@query(
    "geo_density_clusters",
    f"""WITH RECURSIVE {POSITIONS}, near AS (
      SELECT p.{ID} AS a, o.{ID} AS b FROM pos p JOIN pos o
        ON (o.cust_lat - p.cust_lat) * (o.cust_lat - p.cust_lat) + (o.cust_long - p.cust_long) * (o.cust_long - p.cust_long)
          <= 3e-2 * 3e-2),
    dense AS (SELECT a, count(*) AS hits FROM near GROUP BY a),
    core AS (SELECT a FROM dense WHERE hits >= 20),
    link AS (SELECT a, b FROM near WHERE a IN (FROM core) AND b IN (FROM core)),
    reach(a, root) AS (SELECT a, a FROM core UNION SELECT link.a, reach.root FROM reach JOIN link ON link.b = reach.a AND reach.root < link.a),
    label AS (SELECT a, min(root) AS cluster FROM reach GROUP BY a),
    big AS (SELECT cluster, max(hits) AS densest FROM label JOIN dense USING (a) GROUP BY cluster HAVING count(*) >= 30)
    SELECT pos.*, CASE WHEN cust_lat IS NOT NULL THEN coalesce(big.cluster, -1) END AS cluster,
      CASE WHEN cust_lat IS NOT NULL THEN round(coalesce(1 - hits / densest, 1), 9) END AS outlier_score
    FROM pos LEFT JOIN dense ON dense.a = {ID} LEFT JOIN label ON label.a = {ID} LEFT JOIN big ON big.cluster = label.cluster""",
)
def _(spark, sf):
    rows = geo.density_clusters(positions(spark, sf), ID, radius=0.03, min_samples=20, min_cluster_size=30)
    return rows.withColumn("outlier_score", F.round("outlier_score", 9))
