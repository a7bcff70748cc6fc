"""Geographic features: neighbours within a radius, clusters, population lookup.

Neighbour counting never emits point pairs. Points are collapsed to distinct coordinates and put in grid
cells, and cells ask cells, level by level:

* a cell wholly within the radius answers with its total (or is linked as it is),
* two small cells (at most CELL_LEAF coordinates) meet as lists and are compared in place,
* a pair with a crowded cell is split further, as cells of half the size, until one of the two applies.

So a crowded place costs work along the circle's rim, not the square of its population, and counts are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.hashing import portable_hash
from tidemark.operators.graph import connected_components
from tidemark.operators.lookup import skew_safe_lookup
from tidemark.operators.sampling import hash_sample
from tidemark.session import durable

CELL_LEAF = 128  # coordinates of a cell that meets others as a list
_MARGIN = 1e-9  # relative slack: anything this close to the rim is tested point by point


def _coordinates(df: DataFrame, x: str, y: str) -> DataFrame:
    """Distinct coordinates with their number of rows; an address shared by many rows is one point."""
    there = F.col(x).isNotNull() & F.col(y).isNotNull()
    return (
        df.filter(there)
        .groupBy(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
        .agg(F.count(F.lit(1)).alias("w"))
    )


def _in_grid(points: DataFrame, size: float) -> DataFrame:
    return points.select(
        "x", "y", "w", F.floor(F.col("x") / size).alias("cx"), F.floor(F.col("y") / size).alias("cy")
    )


def _base_size(radius: float) -> float:
    """The power of two above the radius (twice the radius at most): cell numbers of all levels are exact."""
    return 2.0 ** (math.floor(math.log2(radius)) + 1)


def _offsets(radius: float, size: float) -> list[tuple[int, int, bool]]:
    """(dx, dy, inside) of the cells that can hold points within `radius` of a point of cell (0, 0).

    inside: all pairs of points of the two cells are within the radius.
    """
    reach = int(radius / size) + 2
    out = []
    for dx in range(-reach, reach + 1):
        for dy in range(-reach, reach + 1):
            near = (max(abs(dx) - 1, 0) ** 2 + max(abs(dy) - 1, 0) ** 2) * size * size
            far = ((abs(dx) + 1) ** 2 + (abs(dy) + 1) ** 2) * size * size
            if near <= radius * radius * (1 + _MARGIN):
                out.append((dx, dy, far <= radius * radius * (1 - _MARGIN)))
    return out


def _by_radius(values: Sequence[float]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("ri") + 1)


def _cells(points: DataFrame, sizes: Sequence[float]) -> DataFrame:
    """The points once for each radius, with the numbers of their cells."""
    each = points.select("x", "y", "w", F.explode(F.sequence(F.lit(0), F.lit(len(sizes) - 1))).alias("ri"))
    size = _by_radius(sizes)
    return each.select("ri", "x", "y", "w", F.floor(F.col("x") / size).alias("cx"), F.floor(F.col("y") / size).alias("cy"))


_CELL = ("ri", "cx", "cy")
_HITS = "ri int, x double, y double, hits bigint"


def _tested(radii: Sequence[float]):
    """For each cell: its points, the total of the cells inside, and the points of the cells on the rim."""
    squares = [r * r for r in radii]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ri, inside = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            sides = []
            for column in batch.columns[2:]:
                flat = column.flatten()
                ends = np.r_[0, np.cumsum(pc.list_value_length(column).fill_null(0).to_numpy())]
                sides.append((ends, *(flat.field(i).to_numpy() for i in range(3))))
            (qe, qx, qy, _qw), (pe, px, py, pw) = sides
            hits = np.repeat(inside, np.diff(qe))
            for i in range(batch.num_rows):
                q, p = slice(qe[i], qe[i + 1]), slice(pe[i], pe[i + 1])
                dx, dy = px[p] - qx[q, None], py[p] - qy[q, None]
                hits[q] += (dx * dx + dy * dy <= squares[ri[i]]) @ pw[p]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ri, np.diff(qe))), pa.array(qx), pa.array(qy), pa.array(hits)], ["ri", "x", "y", "hits"])

    return run


def neighbour_counts(points: DataFrame, radii: Sequence[float], leaf: int = CELL_LEAF) -> DataFrame:
    """(ri, x, y, hits): rows within radii[ri] of each distinct coordinate, itself included; all radii in one pass.

    `points` = (x, y, w), stored, with unique coordinates. Cells ask cells, not points: whether two cells lie wholly
    within the radius, or may do so in part, follows from how far they are apart. Cells wholly within answer with their
    total. Cells of at most `leaf` coordinates on the rim meet as two short lists. Only pairs with a crowded cell go on
    to the next level, as cells of half the size, so a crowded place costs work along the rim. A cell is asked by as many
    cells as lie around it, however many points they hold.
    """
    sizes = [_base_size(r) for r in radii]
    offsets = [(i, *o) for i, (r, s) in enumerate(zip(radii, sizes, strict=True)) for o in _offsets(r, s)]
    around = points.sparkSession.createDataFrame(offsets, "ri int, dx bigint, dy bigint, inside boolean")  # nine for each radius, met by ri
    answers, asked = [], None
    while True:
        placed = _cells(points, sizes)
        counted = durable(placed.groupBy(*_CELL).agg(F.count(F.lit(1)).alias("m"), F.sum("w").alias("n")))
        crowded = not counted.filter(F.col("m") > leaf).isEmpty()
        if crowded:  # lists are gathered for the others only
            dim = counted.filter(F.col("m") > leaf).select(*_CELL, "m", F.lit(True).alias("crowded"))
            placed = skew_safe_lookup(placed, durable(dim), _CELL, "m").filter("crowded IS NULL")
        lists = placed.groupBy(*_CELL).agg(F.collect_list(F.struct("x", "y", "w")).alias("pts"))
        cells = durable(counted.join(lists, list(_CELL), "left")) if crowded else durable(lists.select(*_CELL, "pts", F.size("pts").cast("bigint").alias("m"), F.aggregate("pts", F.lit(0).cast("bigint"), lambda t, p: t + p["w"]).alias("n")))
        if asked is None:
            own = cells.select("ri", F.col("cx").alias("qx"), F.col("cy").alias("qy"), F.col("m").alias("qm")).join(F.broadcast(around), "ri")
            asked = own.select("ri", "qx", "qy", "qm", (F.col("qx") + F.col("dx")).alias("px"), (F.col("qy") + F.col("dy")).alias("py"), "inside")
        else:
            asked = asked.join(cells.select("ri", F.col("cx").alias("qx"), F.col("cy").alias("qy"), F.col("m").alias("qm")), ["ri", "qx", "qy"])
        others = cells.select("ri", F.col("cx").alias("px"), F.col("cy").alias("py"), F.col("m").alias("pm"), F.col("n").alias("pn"), F.col("pts").alias("ppts"))
        met = asked.join(others, ["ri", "px", "py"])
        open_ = ~F.col("inside") & ((F.col("qm") > leaf) | (F.col("pm") > leaf))
        if crowded:
            met = durable(met)
        rim = F.when(~F.col("inside") & ~open_, F.col("ppts"))
        answered = met.groupBy("ri", F.col("qx").alias("cx"), F.col("qy").alias("cy")).agg(
            F.coalesce(F.sum(F.when(F.col("inside"), F.col("pn"))), F.lit(0).cast("bigint")).alias("inside_n"),
            F.flatten(F.collect_list(rim)).alias("rim"),  # the offsets and `leaf` bound it
        )
        if crowded:
            answered = durable(answered)
        full = answered.join(cells.select(*_CELL, "pts", "m"), list(_CELL))
        answers.append(full.filter(F.col("m") <= leaf).select("ri", "inside_n", "pts", "rim").mapInArrow(_tested(radii), _HITS))
        if not crowded:
            break
        # What lies wholly within the radius of a crowded cell counts for all of its points.
        whole = full.filter((F.col("m") > leaf) & (F.col("inside_n") > 0)).select(*_CELL, "m", F.col("inside_n").alias("hits"))
        answers.append(skew_safe_lookup(_cells(points, sizes), durable(whole), _CELL, "m").filter("hits IS NOT NULL").select("ri", "x", "y", "hits"))
        sizes = [s / 2 for s in sizes]
        asked = met.filter(open_).select("ri", "qx", "qy", "px", "py")
        for c in ("qx", "qy", "px", "py"):
            asked = asked.select(*[o for o in asked.columns if o != c], F.explode(F.array(F.col(c) * 2, F.col(c) * 2 + 1)).alias(c))
        gap = [F.abs(F.col(f"p{a}") - F.col(f"q{a}")) for a in "xy"]
        near = sum(F.greatest(g - 1, F.lit(0)) * F.greatest(g - 1, F.lit(0)) for g in gap)
        far = sum((g + 1) * (g + 1) for g in gap)
        square = _by_radius([r * r / (s * s) for r, s in zip(radii, sizes, strict=True)])
        asked = durable(asked.filter(near <= square * (1 + _MARGIN)).withColumn("inside", far <= square * (1 - _MARGIN)))
    return reduce(DataFrame.unionByName, answers).groupBy("ri", "x", "y").agg(F.sum("hits").alias("hits"))


def coordinate_density(points: DataFrame, radius: float, leaf: int = CELL_LEAF) -> DataFrame:
    """(x, y, hits): rows within `radius` of each distinct coordinate, itself included."""
    return neighbour_counts(points, [radius], leaf).drop("ri")


def radius_density(df: DataFrame, radii: Sequence[float], x: str = "cust_lat", y: str = "cust_long",
                   leaf: int = CELL_LEAF) -> DataFrame:
    """Add `density_count_radius_<r>`: rows within r (Euclidean, self included). Missing coordinates give NULL."""
    points = durable(_coordinates(df, x, y))
    found = neighbour_counts(points, radii, leaf)
    wide = found.groupBy("x", "y").agg(*[F.sum(F.when(F.col("ri") == i, F.col("hits"))).alias(f"density_count_radius_{r}") for i, r in enumerate(radii)])
    dim = points.join(wide, ["x", "y"]).withColumnsRenamed({"x": x, "y": y})
    return skew_safe_lookup(df, durable(dim), [x, y], "w")


_PAIR = ("ax", "ay", "bx", "by")


def _any_within(radius: float):
    """Of pairs of cells with the points of both: those that hold points within the radius of each other."""
    square = radius * radius

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for column in batch.columns[4:]:
                flat = column.flatten()
                sides.append((np.r_[0, np.cumsum(pc.list_value_length(column).fill_null(0).to_numpy())], flat.field(0).to_numpy(), flat.field(1).to_numpy()))
            (qe, qx, qy), (pe, px, py) = sides
            hit = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                q, p = slice(qe[i], qe[i + 1]), slice(pe[i], pe[i + 1])
                dx, dy = px[p] - qx[q, None], py[p] - qy[q, None]
                hit[i] = (dx * dx + dy * dy <= square).any()
            yield pa.RecordBatch.from_arrays(batch.columns[:4], list(_PAIR)).filter(pa.array(hit))

    return run


def _linked_cells(points: DataFrame, radius: float, size: float, leaf: int) -> DataFrame:
    """(ax, ay, bx, by), may repeat: pairs of different cells that hold points within `radius` of each other, each one way.

    `points` = (x, y), stored, unique. Cells meet the cells around them as in `neighbour_counts`: pairs that lie wholly
    within the radius are linked as they are, short lists are compared, and pairs with a crowded cell go on as cells of
    half the size, unless they are linked already.
    """
    found, asked = [], None
    ahead = [(dx, dy, inside) for dx, dy, inside in _offsets(radius, size) if (dx, dy) > (0, 0)]
    steps = ", ".join(f"named_struct('dx', {dx}L, 'dy', {dy}L, 'inside', {str(inside).lower()})" for dx, dy, inside in ahead)
    while True:
        placed = points.select("x", "y", *[F.floor(F.col(c) / size).alias(f"c{c}") for c in "xy"])
        counted = durable(placed.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("m")))
        crowded = not counted.filter(F.col("m") > leaf).isEmpty()
        if crowded:
            dim = durable(counted.filter(F.col("m") > leaf).select("cx", "cy", "m", F.lit(True).alias("crowded")))
            placed = skew_safe_lookup(placed, dim, ["cx", "cy"], "m").filter("crowded IS NULL")
        lists = placed.groupBy("cx", "cy").agg(F.collect_list(F.struct("x", "y")).alias("pts"))
        cells = durable(counted.join(lists, ["cx", "cy"], "left"))
        own, others = (cells.select(F.col("cx").alias(f"{s}x"), F.col("cy").alias(f"{s}y"), F.col("m").alias(f"{s}m"), F.col("pts").alias(f"{s}pts")) for s in "qp")
        if asked is None:
            # A few dozen steps fan out; the points of the asking cell join in when its pairs are known to exist.
            fanned = counted.select("cx", "cy", F.explode(F.expr(f"array({steps})")).alias("to"))
            there = [F.col(f"c{c}") + F.col(f"to.d{c}") for c in "xy"]
            asked = fanned.select(F.col("cx").alias("ax"), F.col("cy").alias("ay"), there[0].alias("bx"), there[1].alias("by"),
                                  F.col("cx").alias("qx"), F.col("cy").alias("qy"), there[0].alias("px"), there[1].alias("py"), "to.inside")
        met = asked.join(others, ["px", "py"]).join(own, ["qx", "qy"])
        if crowded:
            met = durable(met)
        small = (F.col("qm") <= leaf) & (F.col("pm") <= leaf)
        whole = met.filter("inside").select(*_PAIR)
        tested = met.filter(~F.col("inside") & small).select(*_PAIR, "qpts", "ppts").mapInArrow(_any_within(radius), ", ".join(f"{c} bigint" for c in _PAIR))
        now = whole.unionByName(tested)
        if not crowded:
            found.append(now)
            return reduce(DataFrame.unionByName, found)
        now = durable(now.distinct())
        found.append(now)
        size /= 2
        asked = met.filter(~F.col("inside") & ~small).select(*_PAIR, "qx", "qy", "px", "py").join(now, list(_PAIR), "left_anti")
        asked = _halves(asked, radius, size)


def _halves(asked: DataFrame, radius: float, size: float) -> DataFrame:
    """Pairs of cells (qx, qy), (px, py) as all pairs of their halves of `size` that can hold points within the radius."""
    for c in ("qx", "qy", "px", "py"):
        asked = asked.select(*[o for o in asked.columns if o != c], F.explode(F.array(F.col(c) * 2, F.col(c) * 2 + 1)).alias(c))
    gap = [F.abs(F.col(f"p{a}") - F.col(f"q{a}")) for a in "xy"]
    near = sum(F.greatest(g - 1, F.lit(0)) * F.greatest(g - 1, F.lit(0)) for g in gap)
    far = sum((g + 1) * (g + 1) for g in gap)
    square = radius * radius / (size * size)
    return durable(asked.filter(near <= square * (1 + _MARGIN)).withColumn("inside", far <= square * (1 - _MARGIN)))


def _cell_id(cx: Column, cy: Column) -> Column:
    """Both indices in one long; fails loudly when the grid is too fine for 31 bits."""
    half = 2**31
    fits = (F.abs(cx) < half) & (F.abs(cy) < half)
    packed = cx * F.lit(2 * half) + cy
    return F.when(fits, packed).otherwise(F.raise_error(F.lit("grid index exceeds 31 bits")).cast("bigint"))


def density_clusters(df: DataFrame, key: str, radius: float, min_samples: int,
                     min_cluster_size: int | Sequence[int], x: str = "cust_lat", y: str = "cust_long", leaf: int = CELL_LEAF) -> DataFrame:
    """Fixed-radius density clusters.

    Core rows have at least `min_samples` rows within `radius` (themselves included); core rows within
    `radius` of each other share a cluster; everything else, and clusters below `min_cluster_size`, is noise.
    Adds `cluster` (smallest key of the cluster, -1 for noise) and `outlier_score` (1 - density / densest row
    of the cluster, 1 for noise). For several minimum sizes the columns end in `_<size>`; density, links and
    components are found once, only the last filter differs.

    Cells are small enough that all core rows of a cell belong together, so the graph is one of cells with at
    most a few dozen neighbours each, never one of rows.
    """
    points = durable(_coordinates(df, x, y))
    density = durable(points.join(coordinate_density(points, radius, leaf), ["x", "y"]))
    size = 2.0 ** math.floor(math.log2(radius / 2**0.5))  # all points of a cell are within the radius of each other
    core = durable(_in_grid(density.filter(F.col("hits") >= min_samples), size))
    linked = durable(_linked_cells(core, radius, size, leaf).select(
        _cell_id(F.col("ax"), F.col("ay")).alias("a"), _cell_id(F.col("bx"), F.col("by")).alias("b")
    ).distinct())
    edges = linked.unionByName(linked.select(F.col("b").alias("a"), F.col("a").alias("b")))
    cells = core.groupBy(_cell_id(F.col("cx"), F.col("cy")).alias("id")).agg(F.count(F.lit(1)).alias("m"))
    component = connected_components(cells.select("id"), edges)
    labelled = skew_safe_lookup(
        core.withColumn("id", _cell_id(F.col("cx"), F.col("cy"))), cells.join(component, "id"), ["id"], "m"
    )
    dim = density.join(labelled.select("x", "y", "label"), ["x", "y"], "left").select(
        F.col("x").alias(x), F.col("y").alias(y), "w", "hits", "label"
    )
    rows = durable(skew_safe_lookup(df, durable(dim), [x, y], "w"))
    clusters = (
        rows.filter(F.col("label").isNotNull())
        .groupBy("label")
        .agg(
            F.count(F.lit(1)).alias("members"),
            F.min(key).alias("cluster"),
            F.max("hits").alias("densest"),
        )
    )
    final = skew_safe_lookup(rows, durable(clusters.withColumn("size", F.col("members"))), ["label"], "members")
    placed = F.col(x).isNotNull() & F.col(y).isNotNull()
    out = []
    for least in [min_cluster_size] if isinstance(min_cluster_size, int) else min_cluster_size:
        suffix = "" if isinstance(min_cluster_size, int) else f"_{least}"
        large = F.col("size") >= least
        out.append(F.when(placed, F.coalesce(F.when(large, F.col("cluster")), F.lit(-1))).alias(f"cluster{suffix}"))
        score = F.when(large, 1 - F.col("hits") / F.col("densest"))
        out.append(F.when(placed, F.coalesce(score, F.lit(1.0))).alias(f"outlier_score{suffix}"))
    return final.select(*df.columns, *out)


KMEANS_SIZES = (10, 20, 50, 100)


MICRO = 1_000_000  # coordinates are compared in millionths of a degree
KMEANS_STEPS = 300
KMEANS_CELLS = 1 << 20  # distances held at a time


def _nearest(px: np.ndarray, py: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Number of the nearest centre of each point; the first of equally near ones."""
    out = np.zeros(len(px), np.int64)
    rows = max(1, KMEANS_CELLS // max(len(centres), 1))
    for at in range(0, len(px), rows):
        dx, dy = (v[at : at + rows, None] - centres[:, i] for i, v in enumerate((px, py)))
        out[at : at + rows] = (dx * dx + dy * dy).argmin(axis=1)
    return out


def kmeans_centres(points: DataFrame, seeds: Sequence[np.ndarray], steps: int = KMEANS_STEPS) -> list[np.ndarray]:
    """Lloyd steps for several sets of centres at once: one job a step adds up whole numbers by centre.

    `points` = (px, py, w) in whole numbers. Centres move to the rounded-down means of their points, so they are the same
    however the points are partitioned. A set rests once no centre moves; a centre without points stays.
    """
    centres, moving = [c.copy() for c in seeds], [len(c) > 0 for c in seeds]
    for _ in range(steps):
        if not any(moving):
            break
        asked = {i: c for i, (c, m) in enumerate(zip(centres, moving, strict=True)) if m}

        def sums(batches: Iterator[pa.RecordBatch], asked=asked) -> Iterator[pa.RecordBatch]:
            total = {i: np.zeros((3, len(c)), np.int64) for i, c in asked.items()}
            for batch in batches:
                px, py, w = (column.to_numpy() for column in batch.columns)
                for i, c in asked.items():
                    at = _nearest(px, py, c)
                    for row, value in zip(total[i], (px * w, py * w, w), strict=True):
                        np.add.at(row, at, value)
            parts = [(np.full(t.shape[1], i), np.arange(t.shape[1]), *t) for i, t in total.items()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], ["i", "c", "sx", "sy", "n"])

        # One row for each centre.
        found = points.select("px", "py", "w").mapInArrow(sums, "i bigint, c bigint, sx bigint, sy bigint, n bigint").groupBy("i", "c").agg(*[F.sum(v).alias(v) for v in ("sx", "sy", "n")]).filter("n > 0").toArrow()
        i, c, sx, sy, n = (found.column(v).to_numpy() for v in ("i", "c", "sx", "sy", "n"))
        for k in asked:
            moved = centres[k].copy()
            mine = i == k
            moved[c[mine], 0], moved[c[mine], 1] = sx[mine] // n[mine], sy[mine] // n[mine]
            moving[k] = not np.array_equal(moved, centres[k])
            centres[k] = moved
    return centres


def kmeans_clusters(df: DataFrame, keys: Sequence[str], sizes: Sequence[int] = KMEANS_SIZES,
                    fit_rows: int | None = None, x: str = "cust_lat", y: str = "cust_long",
                    seed: int = 42, steps: int = KMEANS_STEPS) -> DataFrame:
    """Add `cluster_kmeans_<k>`: centres are fitted on all placed rows, or on a hash sample of `fit_rows` of them.

    The first centres are the rows with the smallest key hashes; all sizes take their steps in the same jobs.
    """
    whole = [F.floor(F.col(c).cast("double") * MICRO + 0.5).cast("bigint") for c in (x, y)]
    placed = df.dropna(subset=[x, y])
    sample = placed if fit_rows is None else hash_sample(placed, keys, fit_rows, seed)
    sample = durable(sample.select(*keys, whole[0].alias("px"), whole[1].alias("py")))
    first = hash_sample(sample, keys, max(sizes), seed).orderBy(portable_hash(seed, *keys), *keys).select("px", "py").toArrow()  # one row for each centre
    first = np.stack([first.column(c).to_numpy() for c in ("px", "py")], axis=1)
    points = durable(sample.groupBy("px", "py").agg(F.count(F.lit(1)).alias("w")))
    centres = kmeans_centres(points, [first[:k] for k in sizes], steps)

    def cluster(own: np.ndarray) -> Column:
        @F.arrow_udf("int")
        def number(px: pa.Array, py: pa.Array) -> pa.Array:
            return pa.array(_nearest(px.to_numpy(zero_copy_only=False), py.to_numpy(zero_copy_only=False), own).astype(np.int32))

        return number(*whole)

    return placed.select("*", *[cluster(c).alias(f"cluster_kmeans_{k}") for k, c in zip(sizes, centres, strict=True)])


def cell_population(df: DataFrame, population: DataFrame, cell: str, lookup_cell: str = "h38_id") -> DataFrame:
    """Left lookup of the population of a row's grid cell; rows without a cell keep NULL."""
    load = df.filter(F.col(cell).isNotNull()).groupBy(cell).agg(F.count(F.lit(1)).alias("n"))
    dim = durable(load.join(population.withColumnRenamed(lookup_cell, cell), cell))
    return skew_safe_lookup(df, dim, [cell], "n")
