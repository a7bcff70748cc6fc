"""Histogram boosting of many models at once, continued from stored margins.

The rows are binned once and stored, each with its labels, roles and margins for all models. One Spark job a level then
serves every model that is still learning: tasks add up gradients by (model, node, feature, bin), sums meet by model and
group of features, and only the best split of each node comes back. Leaf values follow from the same sums, with both
penalties. A round costs `max_depth` small jobs however many models there are, so folds, seeds and targets share them.

A task does not look at each feature of a row. Features with few bins are stored as joint codes of up to CODES values; a
row is counted once for each code, and the sums by feature and bin follow from those by code, once for BLOCK rows. Rows
are stored PIECE at a time, code by code and model by model, so a level reads whole arrays and never a single row.

Trees since the last stored round are applied on the fly. Every STORE rounds the rows are written again with their new
margins, then the trees: a run that is killed goes on from the last round whose trees are there.

After every round the loss on the rows that stop the training is read in passing; a model ends `patience` rounds after
its best round and is cut back to it. Features are drawn for each tree. Gradients and losses are rounded to fixed small
units, so sums are whole numbers: trees do not depend on how the rows are partitioned (up to 2^28 rows at full scale).
"""

from __future__ import annotations

import functools
import json
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tidemark.operators.radix import coarse_limits
from tidemark.session import scratch_path

STORE = 8  # rounds between stored margins
SUMS = 1 << 20  # sums that one task puts together, about
CHUNK = 16  # features whose sums travel together
CODES = 1 << 10  # values of a joint code of features, at most (a feature with more bins has a code of its own)
PIECE = 1 << 12  # rows that are stored as one, at most
BLOCK = 3 << 14  # rows that a task counts together, about
DIGITS = 24  # binary digits of a gradient
SMALL_BYTES, LARGE_BYTES = 1 << 18, 1 << 26  # stored rows of a partition: at least, at most
WHOLE = 2.0**53  # whole numbers below it are exact
LEAST_HESSIAN = 1e-3
HESSIAN_UNIT = 2.0**-DIGITS
TRAINS, STOPS = 1, 2


@dataclass(frozen=True)
class Fit:
    """One model to learn: `role` is TRAINS for the rows it learns from, STOPS for those that end the training."""

    label: Column
    role: Column
    binary: bool
    params: object


@dataclass
class Tree:
    """A binary tree in heap order: children of node i are 2i+1 and 2i+2. Feature -1 marks a leaf."""

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        size = 2 ** (depth + 1) - 1
        return cls(np.full(size, -1, np.int32), np.zeros(size, np.int32), np.zeros(size))

    @property
    def depth(self) -> int:
        return (len(self.feature) + 1).bit_length() - 2

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The node that each row of bins ends in."""
        return self.ends(lambda f: bins[:, f], len(bins))

    def ends(self, column: Callable[[int], np.ndarray], rows: int) -> np.ndarray:
        """The same from the bins of one feature at a time: nodes are chosen from the leaves up, by bits of small numbers."""
        kind = np.min_scalar_type(len(self.feature))

        def end(node: int):
            f = int(self.feature[node])
            if f < 0:
                return kind.type(node)
            left, right = end(2 * node + 1), end(2 * node + 2)
            goes_right = np.negative((column(f) > int(self.bin[node])).view(np.uint8).astype(kind, copy=False))  # all bits or none
            return left ^ (goes_right & (left ^ right))

        return np.broadcast_to(end(0), rows)

    def used(self) -> set[int]:
        return set(self.feature[self.feature >= 0].tolist())


@dataclass
class Boosted:
    """A learned model: its trees, the bin edges of the features, and the loss after each round."""

    edges: list[np.ndarray]
    base: float
    binary: bool
    trees: list[Tree] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)

    @property
    def getNumTrees(self) -> int:  # noqa: N802  (as Spark ML models call it)
        return len(self.trees)

    @property
    def featureImportances(self):  # noqa: N802
        """How many splits use each feature."""
        counts = np.zeros(len(self.edges))
        for tree in self.trees:
            np.add.at(counts, tree.feature[tree.feature >= 0], 1.0)
        return Vectors.dense(counts.tolist())

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(self.edges)], axis=1).astype(np.uint8)

    def margins(self, bins: np.ndarray) -> np.ndarray:
        total, columns = np.full(len(bins), self.base), np.ascontiguousarray(bins.T)
        for tree in self.trees:
            total += tree.value[tree.ends(columns.__getitem__, len(bins))]
        return total

    def link(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-margin)) if self.binary else margin

    def scores(self, spark: SparkSession, features: Column) -> Column:
        """The model's score of a vector column."""
        shared = spark.sparkContext.broadcast(self)

        @F.arrow_udf("double")
        def score(x: pa.Array) -> pa.Array:
            model = shared.value
            return pa.array(model.link(model.margins(model.binned(matrix(x, len(model.edges))))))

        return score(vector_to_array(features))


def matrix(x: pa.Array, width: int) -> np.ndarray:
    return x.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def bin_edges(vectors: DataFrame, features: str, width: int, max_bins: int) -> list[np.ndarray]:
    """At most max_bins - 1 limits for each feature, by the quantiles of all rows."""
    values = vectors.select(vector_to_array(features).alias("x")).select(*[F.col("x")[i].alias(f"c{i}") for i in range(width)])
    return coarse_limits(values, values.columns, max_bins)


def _partitions(spark: SparkSession, size: int) -> int:
    fine, coarse = -(-size // SMALL_BYTES), -(-size // LARGE_BYTES)
    return max(1, min(fine, max(spark.sparkContext.defaultParallelism, coarse)))


STATE = "codes binary, labels binary, roles binary, margins binary"  # a row holds the rows of a piece, one array after another
KINDS = {"codes": "<u2", "labels": "<f8", "roles": "u1", "margins": "<f8"}
FACTS = "model int, total double, n bigint, lowest double, highest double"  # of the labels that a model learns from


def _piece(*arrays: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for a in arrays], list(KINDS))


def _pieces(batch: pa.RecordBatch, codes: int) -> Iterator[list[np.ndarray]]:
    """The matrices of each piece, a column for each row; margins are empty before the first round that stored some."""
    for row in zip(*(batch.column(c) for c in KINDS), strict=True):
        found = [np.frombuffer(v.as_buffer(), kind) for v, kind in zip(row, KINDS.values(), strict=True)]
        rows = len(found[0]) // codes
        yield [a.reshape(-1, rows) for a in found]


@dataclass(frozen=True)
class _Code:
    """Features counted as one: the code of a row is the sum of its bins times their steps."""

    features: tuple[int, ...]
    steps: tuple[int, ...]
    size: int

    def bins(self, feature: int) -> int:
        at = self.features.index(feature)
        return (*self.steps, self.size)[at + 1] // self.steps[at]

    def column(self, numbers: np.ndarray, feature: int) -> np.ndarray:
        """The bins of one feature."""
        at = self.features.index(feature)
        upper = numbers // np.uint16(self.steps[at])
        if at + 1 < len(self.features):
            bins = np.uint16(self.bins(feature))
            upper -= upper // bins * bins
        return upper.astype(np.uint8)


def _codes(edges: list[np.ndarray]) -> list[_Code]:
    """All features in joint codes, each put where it leaves the least room: the largest first."""
    sizes = [len(e) + 1 for e in edges]
    found: list[list[int]] = []
    totals: list[int] = []
    for f in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        room = [i for i, t in enumerate(totals) if t * sizes[f] <= CODES]
        if room:
            at = max(room, key=lambda i: (totals[i], -i))
            found[at].append(f)
            totals[at] *= sizes[f]
        else:
            found.append([f])
            totals.append(sizes[f])
    out = []
    for features, size in zip(found, totals, strict=True):
        steps = np.cumprod([1, *(sizes[f] for f in features[:-1])]).tolist()
        out.append(_Code(tuple(features), tuple(steps), size))
    return out


def _coded(bins: np.ndarray, codes: Sequence[_Code]) -> np.ndarray:
    return np.stack([sum(bins[:, f].astype("<u2") * np.uint16(step) for f, step in zip(c.features, c.steps, strict=True)) for c in codes], axis=1)


def _blocks(batches: Iterator[pa.RecordBatch], codes: int) -> Iterator[list[np.ndarray]]:
    """The matrices of the state for about BLOCK rows."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        for piece in _pieces(batch, codes):
            held.append(piece)
            if sum(h[0].shape[1] for h in held) >= BLOCK:
                yield [np.concatenate(c, axis=1) for c in zip(*held, strict=True)]
                held = []
    if held:
        yield [np.concatenate(c, axis=1) for c in zip(*held, strict=True)]


def _columns(coded: np.ndarray, codes: Sequence[_Code]) -> Callable[[int], np.ndarray]:
    """The bins of a feature, each made once."""
    place = {f: i for i, c in enumerate(codes) for f in c.features}
    return functools.cache(lambda f: codes[place[f]].column(coded[place[f]], f))


def _labels(fits: Sequence[Fit]) -> tuple[list[Column], list[int]]:
    """The different label columns, and which of them is each model's."""
    seen = {id(f.label): f.label for f in fits}
    return list(seen.values()), [list(seen).index(id(f.label)) for f in fits]


def _first_state(vectors: DataFrame, fits: Sequence[Fit], edges: list[np.ndarray], features: str) -> DataFrame:
    """Pieces without margins, and for each piece the facts of its labels."""
    codes, (label, own) = _codes(edges), _labels(fits)
    different = len(label)

    def piece(x: np.ndarray, labels: np.ndarray, roles: np.ndarray) -> pa.RecordBatch:
        facts = []
        for k, at in enumerate(own):
            y = labels[(roles[:, k] == TRAINS) & ~np.isnan(labels[:, at]), at]
            facts.append({"model": k, "total": float(y.sum()), "n": len(y), "lowest": float(y.min()) if len(y) else None, "highest": float(y.max()) if len(y) else None})
        rows = _piece(x.T, np.nan_to_num(labels, nan=0.0, posinf=np.inf, neginf=-np.inf).T, roles.T, np.zeros(0))
        kind = pa.list_(pa.struct([("model", pa.int32()), ("total", pa.float64()), ("n", pa.int64()), ("lowest", pa.float64()), ("highest", pa.float64())]))
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array([facts], kind)], [*KINDS, "facts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, held, many = Boosted(edges, 0.0, False), [], 0
        for batch in batches:
            if batch.num_rows:
                coded = _coded(model.binned(matrix(batch.column(0), len(edges))), codes)
                held.append([coded, matrix(batch.column(1), different).astype("<f8"), matrix(batch.column(2), len(own)).astype("u1")])
                many += batch.num_rows
            while many >= PIECE:
                x = [np.concatenate(c) for c in zip(*held, strict=True)]
                yield piece(*(c[:PIECE] for c in x))
                held, many = [[c[PIECE:] for c in x]], many - PIECE
        if many:
            yield piece(*(np.concatenate(c) for c in zip(*held, strict=True)))

    labels = F.array(*[y.cast("double") for y in label])
    role = F.array(*[F.coalesce(f.role.cast("int"), F.lit(0)) for f in fits])
    return vectors.select(vector_to_array(features).alias("x"), labels.alias("labels"), role.alias("roles")).mapInArrow(run, f"{STATE}, facts array<struct<{FACTS.replace(' ', ':').replace(',:', ',')}>>")


@dataclass
class _Growing:
    """A model while it learns."""

    model: Boosted
    params: object
    unit: float  # gradients are whole multiples of it
    label: int = 0  # which of the stored labels
    applied: int = 0  # trees that the stored margins include
    done: bool = False
    best: int = 0
    tree: Tree | None = None
    columns: np.ndarray | None = None
    open: list[int] = field(default_factory=list)  # nodes to split on this level

    @property
    def recent(self) -> list[Tree]:
        return self.model.trees[self.applied :]

    def start(self, round_: int) -> None:
        p, width = self.params, len(self.model.edges)
        rng = np.random.default_rng([p.seed, round_])
        self.columns = np.sort(rng.permutation(width)[: max(1, round(p.colsample * width))])
        self.tree, self.open = Tree.empty(p.max_depth), [0]


@dataclass
class _Level:
    """What a task has to know about a model on one level."""

    params: object
    base: float
    label: int
    binary: bool
    unit: float
    recent: list[Tree]
    tree: Tree | None
    columns: np.ndarray | None
    open: list[int]


def _gradients(y: np.ndarray, margin: np.ndarray, binary: bool, unit: float) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and hessian of each row, in whole units."""
    if binary:
        p = 1 / (1 + np.exp(-margin))
        return np.rint((p - y) / unit), np.rint(p * (1 - p) / HESSIAN_UNIT)
    return np.rint((margin - y) / unit), np.full(len(y), np.rint(1 / HESSIAN_UNIT))


def _losses(y: np.ndarray, margin: np.ndarray, binary: bool, unit: float) -> np.ndarray:
    """Loss of each row, in whole units."""
    if binary:
        return np.rint((np.logaddexp(0, margin) - y * margin) / unit)
    return np.rint((margin - y) ** 2 / (unit * unit * 2**DIGITS))


def _count(sums: np.ndarray, codes: Sequence[_Code], coded: np.ndarray, columns: np.ndarray, node: np.ndarray, rows: np.ndarray, gradient: np.ndarray, hessian: np.ndarray) -> None:
    """Add rows to the sums (gradient, hessian, rows) by open node, drawn feature and bin, by way of their codes."""
    at = {int(f): i for i, f in enumerate(columns)}
    nodes, wide, shift = sums.shape[1], max(c.size for c in codes), 2.0 ** len(rows).bit_length()
    joined = float(hessian.sum()) * shift + len(rows) < WHOLE  # hessians and rows fit into one number
    weights = (gradient, hessian * shift + 1) if joined else (gradient, hessian, np.ones(len(rows)))
    found = np.zeros((len(weights), *sums.shape[1:]))
    start = node * wide
    for code, numbers in zip(codes, coded, strict=True):
        if not any(f in at for f in code.features):
            continue
        cell = start + numbers.take(rows)
        rest = np.stack([np.bincount(cell, w, minlength=nodes * wide).reshape(nodes, wide)[:, : code.size] for w in weights])
        for f, step in zip(reversed(code.features), reversed(code.steps), strict=True):  # each feature is summed out in turn
            rest = rest.reshape(len(weights), nodes, -1, step)
            if f in at:
                found[:, :, at[f], : rest.shape[2]] = rest.sum(axis=3)
            rest = rest.sum(axis=2)
    if joined:
        upper = np.floor(found[1] / shift)
        sums += (found[0], upper, found[1] - upper * shift)
    else:
        sums += found


def _ends(column: Callable[[int], np.ndarray], rows: np.ndarray, many: int) -> Callable[[Tree], np.ndarray]:
    """The nodes that some of the rows of a block end in. Where they are few, only theirs are looked at."""
    if 4 * len(rows) < many:
        own = functools.cache(lambda f: column(f).take(rows))
        return lambda tree: tree.ends(own, len(rows))
    return lambda tree: tree.ends(column, many).take(rows)


def _job(state: DataFrame, growing: list[_Growing], losses: bool) -> list:
    """One level of all models that still learn: the best split of every open node, and (with `losses`) the losses."""
    active = [(k, _Level(g.params, g.model.base, g.label, g.model.binary, g.unit, g.recent, g.tree, g.columns, g.open)) for k, g in enumerate(growing) if not g.done]
    edges = growing[0].model.edges
    most_bins = max(len(e) for e in edges) + 1
    codes = _codes(edges)
    there = np.arange(most_bins) <= np.array([[len(e)] for e in edges])  # only these bins travel

    def histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working = active
        sums = {k: np.zeros((3, len(g.open), len(g.columns), most_bins)) for k, g in working if g.open}
        stops = {k: np.zeros(2) for k, _ in working}
        for coded, labels, roles, margins in _blocks(batches, len(codes)):
            column = _columns(coded, codes)
            for k, g in working:
                for role in (TRAINS, STOPS):
                    rows = np.flatnonzero(roles[k] == role)
                    if not len(rows) or (not losses if role == STOPS else not g.open):
                        continue
                    ends = _ends(column, rows, len(roles[k]))
                    y = labels[g.label].take(rows)
                    margin = margins[k].take(rows) if len(margins) else np.full(len(rows), g.base)
                    for tree in g.recent:
                        margin += tree.value.take(ends(tree))
                    if role == STOPS:
                        stops[k] += (_losses(y, margin, g.binary, g.unit).sum(), len(rows))
                        continue
                    gradient, hessian = _gradients(y, margin, g.binary, g.unit)
                    place = np.full(len(g.tree.feature), -1)
                    place[g.open] = np.arange(len(g.open))
                    node = place.take(ends(g.tree))
                    on = node >= 0
                    if not on.all():
                        node, rows, gradient, hessian = node[on], rows[on], gradient[on], hessian[on]
                    _count(sums[k], codes, coded, g.columns, node, rows, gradient, hessian)
        out: list[tuple[int, int, bytes]] = []
        for k, g in working:
            if losses:
                out.append((k, -1, stops[k].tobytes()))
            if g.open:
                out += [(k, c, sums[k][:, :, c : c + CHUNK][:, :, there[g.columns[c : c + CHUNK]]].tobytes()) for c in range(0, len(g.columns), CHUNK)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], ["model", "chunk", "sums"])

    def best_splits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for k, c, blob in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                part = np.frombuffer(blob)
                met[k, c] = met[k, c] + part if (k, c) in met else part
        working = dict(active)
        out = []
        for (k, c), part in met.items():
            if c < 0:
                out.append((k, -1, 0, 0, 0.0, [float(v) for v in part]))
                continue
            g = working[k]
            known = there[g.columns[c : c + CHUNK]]
            cube = np.zeros((3, len(g.open), *known.shape))
            cube[:, :, known] = part.reshape(3, len(g.open), -1)
            scaled = cube * np.array([g.unit, HESSIAN_UNIT, 1.0])[:, None, None, None]
            left = np.cumsum(scaled, axis=3)
            total = left[:, :, :1, -1:]
            left = left[:, :, :, :-1]
            right = total - left
            p = g.params
            gain = _strength(left[0], left[1], p) + _strength(right[0], right[1], p) - _strength(total[0], total[1], p)
            allowed = (np.minimum(left[2], right[2]) >= max(p.min_child_samples, 1)) & (np.minimum(left[1], right[1]) >= LEAST_HESSIAN)
            gain = np.where(allowed, gain, -np.inf)
            flat = gain.reshape(len(g.open), -1)
            at = flat.argmax(axis=1)
            for i in range(len(g.open)):
                f, b = divmod(int(at[i]), most_bins - 1)
                sides = [*left[:, i, f, b], *total[:, i, 0, 0]]
                out.append((k, g.open[i], int(g.columns[c + f]), b, float(flat[i, at[i]]), [float(v) for v in sides]))
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.float64()))
        columns = zip(*out, strict=True) if out else [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], ["model", "node", "feature", "bin", "gain", "sides"])

    cells = sum(3 * len(t.open) * len(t.columns) * most_bins for _, t in active if t.open)
    groups = max(1, min(-(-cells // SUMS), len(active) * -(-len(growing[0].model.edges) // CHUNK)))
    met = state.mapInArrow(histograms, "model int, chunk int, sums binary").repartition(groups, "model", "chunk")
    # One row for each open node and group of features: model metadata.
    return met.mapInArrow(best_splits, "model int, node int, feature int, bin int, gain double, sides array<double>").collect()


def _strength(gradient: np.ndarray, hessian: np.ndarray, params) -> np.ndarray:
    return np.maximum(np.abs(gradient) - params.l1, 0) ** 2 / (hessian + params.l2 + 1e-300)


def _leaf(gradient: float, hessian: float, params) -> float:
    """The step that lowers the loss most under both penalties, as far as the rate goes."""
    return -math.copysign(max(abs(gradient) - params.l1, 0.0), gradient) / (hessian + params.l2 + 1e-300) * params.learning_rate


def _grow(growing: list[_Growing], found: list) -> None:
    """Put the best splits of a level into the trees."""
    best: dict[tuple[int, int], tuple] = {}
    for row in found:
        if row.node < 0:
            continue
        key = (row.gain, -row.feature)
        if (row.model, row.node) not in best or key > best[row.model, row.node][0]:
            best[row.model, row.node] = (key, row)
    for k, g in enumerate(growing):
        if g.done:
            continue
        onward = []
        for node in g.open:
            gain, row = best[k, node][0][0], best[k, node][1]
            gl, hl, nl, gt, ht, nt = row.sides
            if node == 0:
                g.tree.value[0] = _leaf(gt, ht, g.params)
            if not gain > g.params.min_split_gain or not math.isfinite(gain):
                continue
            g.tree.feature[node], g.tree.bin[node] = row.feature, row.bin
            for child, (cg, ch, cn) in ((2 * node + 1, (gl, hl, nl)), (2 * node + 2, (gt - gl, ht - hl, nt - nl))):
                g.tree.value[child] = _leaf(cg, ch, g.params)
                if child < 2**g.params.max_depth - 1 and cn >= 2 * max(g.params.min_child_samples, 1):
                    onward.append(child)
        g.open = onward


def _note_losses(growing: list[_Growing], found: list) -> None:
    """Losses after the trees so far; models whose best round lies `patience` rounds back end."""
    for row in found:
        if row.node >= 0:
            continue
        g = growing[row.model]
        total, rows = row.sides
        if not rows or g.done:
            continue
        scale = HESSIAN_UNIT if g.model.binary else g.unit * g.unit * 2**DIGITS
        g.model.losses.append(total / rows * scale)
        g.best = min(range(len(g.model.losses)), key=lambda i: (g.model.losses[i], i))  # trees at the least loss
        if len(g.model.losses) - 1 - g.best >= g.params.patience:
            g.done = True


def _facts(first: DataFrame, fits: Sequence[Fit]) -> list[tuple[float, float]]:
    """First margin and unit of gradients of each model."""
    rows = first.select(F.inline("facts")).groupBy("model").agg(F.sum("total").alias("total"), F.sum("n").alias("n"), F.min("lowest").alias("a"), F.max("highest").alias("b"))
    found = {r.model: r for r in rows.collect()}  # one row for each model
    out = []
    for k, f in enumerate(fits):
        row = found[k]
        mean = float(np.float32(row.total / row.n if row.n else 0.0))  # few digits: the same however the rows were added up
        if f.binary:
            mean = min(max(mean, 1e-6), 1 - 1e-6)
            out.append((float(np.float32(math.log(mean / (1 - mean)))), HESSIAN_UNIT))
        else:
            reach = max((row.b or 0.0) - mean, mean - (row.a or 0.0), 1e-9)
            out.append((mean, 2.0 ** (math.ceil(math.log2(reach)) - DIGITS)))
    return out


def _advanced(state: DataFrame, growing: list[_Growing], spark: SparkSession) -> DataFrame:
    """The rows with the recent trees in their margins."""
    shared = spark.sparkContext.broadcast([(g.model.base, g.recent) for g in growing])
    codes = _codes(growing[0].model.edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for coded, labels, roles, margins in _pieces(batch, len(codes)):
                n, column = coded.shape[1], _columns(coded, codes)
                margins = margins.copy() if len(margins) else np.repeat([[base] for base, _ in shared.value], n, axis=1)
                for k, (_, trees) in enumerate(shared.value):
                    for tree in trees:
                        margins[k] += tree.value.take(tree.ends(column, n))
                yield _piece(coded, labels, roles, margins)

    return state.mapInArrow(run, STATE)


def _save_rows(path: str, round_: int, state: DataFrame) -> DataFrame:
    state.write.mode("overwrite").parquet(f"{path}/rows-{round_}")
    return state.sparkSession.read.schema(STATE).parquet(f"{path}/rows-{round_}")


def _save_trees(spark: SparkSession, path: str, round_: int, growing: list[_Growing], settings: str) -> None:
    """A round counts as stored once its trees are there, after its rows."""
    trees = json.dumps(
        [
            {
                "base": g.model.base, "unit": g.unit, "done": g.done, "best": g.best, "losses": g.model.losses,
                "trees": [[t.feature.tolist(), t.bin.tolist(), t.value.tolist()] for t in g.model.trees],
                "edges": [e.tolist() for e in g.model.edges] if k == 0 else None,
            }
            for k, g in enumerate(growing)
        ]
    )
    spark.createDataFrame([(round_, settings, trees)], "round int, settings string, trees string").coalesce(1).write.mode("overwrite").parquet(f"{path}/trees-{round_}")


def _restore(spark: SparkSession, path: str, fits: Sequence[Fit], settings: str) -> tuple[int, DataFrame, list[_Growing]] | None:
    """The last stored round."""
    found, round_ = None, 0
    while True:
        try:
            found = spark.read.schema("round int, settings string, trees string").parquet(f"{path}/trees-{round_}").first() or found
        except AnalysisException:
            break
        round_ += STORE
    if found is None:
        return None
    if found.settings != settings:
        raise ValueError(f"{path} holds a run with other settings")
    saved = json.loads(found.trees)
    edges = [np.array(e, float) for e in saved[0]["edges"]]
    growing = []
    for one, fit, label in zip(saved, fits, _labels(fits)[1], strict=True):
        trees = [Tree(np.array(f, np.int32), np.array(b, np.int32), np.array(v)) for f, b, v in one["trees"]]
        model = Boosted(edges, one["base"], fit.binary, trees, one["losses"])
        growing.append(_Growing(model, fit.params, one["unit"], label, len(trees), one["done"], one["best"]))
    return found["round"], spark.read.schema(STATE).parquet(f"{path}/rows-{found['round']}"), growing


def boost(vectors: DataFrame, fits: Sequence[Fit], features: str, path: str | None = None) -> list[Boosted]:
    """Learn all models of `fits` from the same rows. `vectors` is read several times, so it should be stored.

    With `path`, rounds are stored there and a run that was cut short goes on from its last stored round.
    """
    spark = vectors.sparkSession
    path = path or scratch_path(spark, "boosting")
    sizes = vectors.select(F.size(vector_to_array(features)).alias("n")).first()
    if sizes is None:
        return [Boosted([], 0.0, f.binary) for f in fits]
    settings = json.dumps([sizes.n, CODES, PIECE, [[f.binary, asdict(f.params)] for f in fits]], default=str)
    restored = _restore(spark, path, fits, settings)
    if restored is None:
        edges = bin_edges(vectors, features, sizes.n, max(f.params.max_bins for f in fits))
        first = _first_state(vectors, fits, edges, features)
        size = 2 * len(_codes(edges)) + 8 * len(_labels(fits)[0]) + 9 * len(fits)
        state = _save_rows(path, 0, first.repartition(_partitions(spark, vectors.count() * size)))
        facts = _facts(spark.read.schema(first.schema).parquet(f"{path}/rows-0"), fits)
        growing = [_Growing(Boosted(edges, base, f.binary), f.params, unit, label) for f, (base, unit), label in zip(fits, facts, _labels(fits)[1], strict=True)]
        _save_trees(spark, path, 0, growing, settings)
        round_ = 0
    else:
        round_, state, growing = restored
    while any(not g.done for g in growing):
        for g in growing:
            g.open = []
            if not g.done and round_ < g.params.n_estimators:
                g.start(round_)
        found = _job(state, growing, losses=True)
        _note_losses(growing, found)
        for g in growing:
            g.done = g.done or round_ >= g.params.n_estimators
            g.open = [] if g.done else g.open
        _grow(growing, [r for r in found if not growing[r.model].done])
        while any(g.open for g in growing if not g.done):
            _grow(growing, _job(state, growing, losses=False))
        for g in growing:
            if not g.done:
                if g.tree.feature[0] < 0:  # nothing left to split
                    g.done = True
                else:
                    g.model.trees.append(g.tree)
                g.tree = None
        round_ += 1
        if round_ % STORE == 0 and any(not g.done for g in growing):
            state = _save_rows(path, round_, _advanced(state, growing, spark))
            _save_trees(spark, path, round_, growing, settings)
            for g in growing:
                g.applied = len(g.model.trees)
    for g in growing:
        if g.model.losses:
            g.model.trees = g.model.trees[: g.best]
    return [g.model for g in growing]
