import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import geo
from tidemark.operators.graph import connected_components


def brute_counts(points, r):
    return {
        i: sum((a - x) * (a - x) + (b - y) * (b - y) <= r * r for _, a, b in points) for i, x, y in points
    }


@pytest.mark.parametrize("leaf", [3, 256])
def test_radius_counts_match_brute_force(spark, leaf):
    """A crowded spot, duplicates and exact distances; a small leaf forces several levels."""
    rng = random.Random(7)
    points = [(i, rng.gauss(0, 0.05), rng.gauss(0, 0.05)) for i in range(150)]
    points += [(200 + i, 0.5, 0.25) for i in range(40)]
    points += [(300, 0.75, 0.25), (301, 0.5, 0.5), (302, 0.25, 0.0), (303, -1.0, -1.0)]
    df = spark.createDataFrame([*points, (999, None, None)], "id long, cust_lat double, cust_long double")
    got = {r["id"]: r["density_count_radius_0.25"] for r in geo.radius_density(df, [0.25], leaf=leaf).collect()}
    assert got.pop(999) is None
    assert got == brute_counts(points, 0.25)


def brute_clusters(points, r, min_samples, min_size):
    near = {i: {j for j, a, b in points if (a - x) ** 2 + (b - y) ** 2 <= r * r} for i, x, y in points}
    core = {i for i in near if len(near[i]) >= min_samples}
    label, out = {}, {}
    for start in sorted(core):
        if start in label:
            continue
        todo = [start]
        while todo:
            i = todo.pop()
            if i not in label:
                label[i] = start
                todo += near[i] & core
    sizes = {c: sum(v == c for v in label.values()) for c in set(label.values())}
    for i, *_ in points:
        c = label.get(i)
        out[i] = c if c is not None and sizes[c] >= min_size else -1
    return out


@pytest.mark.parametrize("leaf", [4, 256])
def test_density_clusters_match_brute_force(spark, leaf):
    rng = random.Random(11)
    points = [(i, rng.gauss(0, 0.1), rng.gauss(0, 0.1)) for i in range(120)]
    points += [(200 + i, rng.gauss(2, 0.1), rng.gauss(2, 0.1)) for i in range(90)]
    points += [(400 + i, 5 + i * 0.05, 5.0) for i in range(40)]
    points += [(500 + i, rng.uniform(-3, 8), rng.uniform(-3, 8)) for i in range(40)]
    df = spark.createDataFrame(points, "id long, cust_lat double, cust_long double")
    rows = geo.density_clusters(df, "id", 0.15, 5, 20, leaf=leaf).collect()
    assert {r["id"]: r["cluster"] for r in rows} == brute_clusters(points, 0.15, 5, 20)
    assert all(0 <= r["outlier_score"] <= 1 for r in rows)


def test_components_of_a_long_path(spark):
    path = list(range(60))
    random.Random(5).shuffle(path)
    pairs = list(zip(path, path[1:]))
    edges = spark.createDataFrame(pairs + [(b, a) for a, b in pairs], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in [*path, 100]], "id long")
    got = {r["id"]: r["label"] for r in connected_components(nodes, edges).collect()}
    assert got == {**{i: 0 for i in path}, 100: 100}


def test_kmeans_labels(spark):
    df = spark.range(200).select("id", F.rand(1).alias("cust_lat"), F.rand(2).alias("cust_long"))
    out = geo.kmeans_clusters(df, ["id"], sizes=(3,), fit_rows=100)
    assert out.count() == 200
    assert {r[0] for r in out.select("cluster_kmeans_3").distinct().collect()} <= {0, 1, 2}


def test_no_pair_join_in_the_plan(spark):
    df = spark.range(500).select("id", F.rand(1).alias("cust_lat"), F.rand(2).alias("cust_long"))
    plan = geo.radius_density(df, [0.1])._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_several_minimum_sizes_from_one_run(spark):
    near = [(i, 10.0 + i * 1e-4, 20.0) for i in range(40)] + [(100 + i, 30.0 + i * 1e-4, 40.0) for i in range(12)] + [(200, None, 1.0)]
    df = spark.createDataFrame(near, "k long, cust_lat double, cust_long double")
    together = {r.k: r for r in geo.density_clusters(df, "k", 0.01, 5, [10, 30]).collect()}
    for size in (10, 30):
        alone = {r.k: (r.cluster, r.outlier_score) for r in geo.density_clusters(df, "k", 0.01, 5, size).collect()}
        assert alone == {k: (r[f"cluster_{size}"], r[f"outlier_score_{size}"]) for k, r in together.items()}
    assert together[100]["cluster_10"] == 100 and together[100]["cluster_30"] == -1 and together[200]["cluster_10"] is None


def test_several_radii_in_one_pass_with_a_hot_spot(spark):
    """A third of the points within a small spot, a third spread out, a third on one coordinate; two radii far apart."""
    rng = random.Random(3)
    points = [(i, 59 + rng.gauss(0, 0.002), 18 + rng.gauss(0, 0.002)) for i in range(200)]
    points += [(300 + i, 59 + rng.uniform(-0.3, 0.3), 18 + rng.uniform(-0.3, 0.3)) for i in range(200)]
    points += [(600 + i, 59.01, 18.01) for i in range(200)]
    df = spark.createDataFrame(points, "id long, cust_lat double, cust_long double")
    for leaf in (5, 128):
        rows = geo.radius_density(df, [0.003, 0.1], leaf=leaf).collect()
        for r in (0.003, 0.1):
            assert {x["id"]: x[f"density_count_radius_{r}"] for x in rows} == brute_counts(points, r)


def test_cells_are_asked_by_cells_around_them_only():
    for radius in (0.01, 0.03, 0.25, 1.0, 3.0):
        size = geo._base_size(radius)
        offsets = geo._offsets(radius, size)
        assert radius < size <= 2 * radius and len(offsets) == 9 and not any(inside for *_, inside in offsets)
        finer = geo._offsets(radius, size / 16)
        assert any(inside for *_, inside in finer) and len(finer) > len(offsets)


def test_kmeans_steps_against_plain_loops(spark):
    rng = random.Random(5)
    points = [(i, rng.choice([59.0, 59.2, 59.5]) + rng.gauss(0, 0.03), 18 + rng.gauss(0, 0.05)) for i in range(300)] + [(400 + i, -59.25, 18.5) for i in range(30)]
    df = spark.createDataFrame([*points, (999, None, 18.0)], "id long, cust_lat double, cust_long double")
    got = geo.kmeans_clusters(df.repartition(6), ["id"], sizes=(3, 7))
    again = geo.kmeans_clusters(df.repartition(1), ["id"], sizes=(7,))
    rows = {r.id: r for r in got.collect()}
    assert len(rows) == 330 and {r.id: r.cluster_kmeans_7 for r in again.collect()} == {i: r.cluster_kmeans_7 for i, r in rows.items()}
    whole = {i: (int((a * 1e6 + 0.5) // 1), int((b * 1e6 + 0.5) // 1)) for i, a, b in points}
    order = [r.id for r in df.filter("cust_lat IS NOT NULL").orderBy(geo.portable_hash(42, "id"), "id").collect()]
    for k in (3, 7):
        centres = [whole[i] for i in order[:k]]
        while True:
            label = {i: min(range(k), key=lambda c, p=p: ((p[0] - centres[c][0]) ** 2 + (p[1] - centres[c][1]) ** 2, c)) for i, p in whole.items()}
            moved = []
            for c in range(k):
                mine = [whole[i] for i in whole if label[i] == c]
                moved.append(tuple(sum(p[d] for p in mine) // len(mine) for d in (0, 1)) if mine else centres[c])
            if moved == centres:
                break
            centres = moved
        assert {i: r[f"cluster_kmeans_{k}"] for i, r in rows.items()} == label
