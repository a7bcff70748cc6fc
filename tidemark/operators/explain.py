"""Feature importances, permutation importance and sampled Shapley values."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.functions.hashing import portable_hash
from tidemark.operators.boosting import Boosted, Tree, matrix
from tidemark.operators.models import FEATURES, LABEL, score_column
from tidemark.operators.ordering import average_rank, dense_index
from tidemark.operators.sampling import hash_sample
from tidemark.session import durable


SHAPLEY_BLOCK = 1 << 10  # rows that meet their backgrounds together
PAIRS = 1 << 13  # pairs of rows looked at together
PATTERNS = 1 << 20  # patterns whose rows are counted together: 2^k for a leaf of k features, at least one leaf


def top_features(importance: DataFrame, value: str, n: int) -> DataFrame:
    """The n largest, ties by name."""
    return importance.orderBy(F.col(value).desc(), F.col("feature")).limit(n)


def feature_importance(spark: SparkSession, models: Sequence, names: Sequence[str]) -> DataFrame:
    """Importance per model (scaled to sum 1), their mean, and the position by mean, from 1.

    One row per feature of the model: model metadata, independent of the data size.
    """
    shares = []
    for m in models:
        values = [float(v) for v in m.featureImportances.toArray()]
        total = sum(values) or 1.0
        shares.append([v / total for v in values])
    means = [sum(s[i] for s in shares) / len(shares) for i in range(len(names))]
    order = sorted(range(len(names)), key=lambda i: (-means[i], names[i]))
    rows = [
        (position, names[i], *[s[i] for s in shares], means[i]) for position, i in enumerate(order, start=1)
    ]
    per_model = ", ".join(f"imp_{i} double" for i in range(len(shares)))
    return spark.createDataFrame(rows, f"position int, feature string, {per_model}, imp_mean double")


def permutation_importance(model, df: DataFrame, keys: Sequence[str], names: Sequence[str], n_iter: int = 1,
                           binary: bool = True, rank: bool = False, seed: int = 42) -> DataFrame:
    """Score drop when one feature is shuffled: accuracy for classifiers, r2 for regressors.

    Rows are numbered in key-hash order, which is a random order; in each iteration every feature reads its
    value from the row a hash-drawn distance further on, which is a permutation. Rows meet their partners in one
    equi-join, once for each iteration. Of models from `boosting`, only the trees that split on a feature are asked
    again when it switches, where the pair lies; other models get one vector for each feature, after the join.
    """
    indexed = durable(dense_index(df.select(*keys, LABEL, FEATURES), keys, portable_hash(seed, *keys)))
    n = indexed.count()
    base = indexed.select("__index", LABEL, vector_to_array(FEATURES).alias("x"))
    drawn = base.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_iter - 1))).alias("it"))
    shift = portable_hash(seed, F.lit("shift"), F.col("it").cast("string")) % max(n - 1, 1) + 1
    drawn = drawn.withColumn("partner", (F.col("__index") + shift) % n)
    partners = base.select(F.col("__index").alias("partner"), F.col("x").alias("other"))
    paired = drawn.join(partners, "partner")
    runs = durable((_runs_by_tree if isinstance(model, Boosted) else _runs_by_vector)(model, indexed, paired, len(names), binary))
    reference = runs.filter("f = -1").first()["quality"]
    lookup = F.array(*[F.lit(c) for c in names])
    drops = (
        runs.filter("f >= 0")
        .groupBy("f")
        .agg(
            F.avg(F.lit(reference) - F.col("quality")).alias("perm_imp"),
            F.stddev_pop(F.lit(reference) - F.col("quality")).alias("perm_imp_std"),
        )
        .select(F.element_at(lookup, F.col("f") + 1).alias("feature"), "perm_imp", "perm_imp_std")
    )
    return average_rank(durable(drops), "perm_imp", "perm_imp_rank") if rank else drops


def _runs_by_vector(model, indexed: DataFrame, paired: DataFrame, width: int, binary: bool) -> DataFrame:
    """(f, it, quality) with one whole vector for each switched feature."""
    shuffled = paired.select("*", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("f")).select(
        "f",
        "it",
        LABEL,
        array_to_vector(
            F.expr("transform(x, (v, i) -> IF(i = f, element_at(other, CAST(i + 1 AS INT)), v))")
        ).alias(FEATURES),
    )
    original = indexed.select(F.lit(-1).alias("f"), F.lit(0).alias("it"), LABEL, FEATURES)
    scored = score_column(model, shuffled.unionByName(original), "__score", binary)
    if binary:
        quality = F.avg((F.bround("__score").cast("int") == F.col(LABEL).cast("int")).cast("double"))
    else:
        y, p = F.col(LABEL), F.col("__score")
        quality = 1 - F.try_divide(F.sum((y - p) * (y - p)), F.var_pop(y) * F.count(y))
    return scored.groupBy("f", "it").agg(quality.alias("quality"))


def _runs_by_tree(model: Boosted, indexed: DataFrame, paired: DataFrame, width: int, binary: bool) -> DataFrame:
    """(f, it, quality): margins are kept by tree, and a switched feature rescores the trees that split on it."""
    asked = [[t for t, tree in enumerate(model.trees) if f in tree.used()] for f in range(width)]
    shared = indexed.sparkSession.sparkContext.broadcast((model, asked))

    def sums(y: np.ndarray, margin: np.ndarray, model: Boosted) -> float:
        score = model.link(margin)
        return float((np.rint(score) == y).sum()) if binary else float(((y - score) ** 2).sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, asked = shared.value
        met: dict[tuple[int, int], list[float]] = {}
        for batch in batches:
            its, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for it in np.unique(its):
                rows = np.flatnonzero(its == it)
                y = labels[rows]
                own, other = (np.asfortranarray(model.binned(matrix(batch.column(i).take(pa.array(rows)), width))) for i in (2, 3))
                by_tree = [tree.value[tree.nodes(own)] for tree in model.trees]
                margin = model.base + np.sum(by_tree, axis=0, initial=0.0) if by_tree else np.full(len(y), model.base)
                for f in [-1, *range(width)]:
                    if f >= 0 and asked[f]:
                        def switched(c: int, f=f, own=own, other=other) -> np.ndarray:
                            return (other if c == f else own)[:, c]

                        value = margin + sum(model.trees[t].value[model.trees[t].ends(switched, len(y))] - by_tree[t] for t in asked[f])
                    else:
                        value = margin
                    total = met.setdefault((f, int(it)), [0.0, 0.0, 0.0, 0.0])
                    total[0] += len(y)
                    total[1] += sums(y, value, model)
                    total[2] += float(y.sum())
                    total[3] += float((y * y).sum())
        columns = [[f for f, _ in met], [it for _, it in met], *([v[i] for v in met.values()] for i in range(4))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int32()] * 2 + [pa.float64()] * 4, strict=True)], ["f", "it", "n", "s", "y", "yy"])

    found = paired.select("it", F.col(LABEL).cast("double").alias("label"), "x", "other").mapInArrow(run, "f int, it int, n double, s double, y double, yy double")
    total = found.groupBy("f", "it").agg(*[F.sum(c).alias(c) for c in ("n", "s", "y", "yy")])
    spread = F.col("yy") - F.col("y") * F.col("y") / F.col("n")
    quality = F.col("s") / F.col("n") if binary else 1 - F.try_divide(F.col("s"), spread)
    return total.select("f", "it", quality.alias("quality"))


def useful_features(importance: DataFrame) -> DataFrame:
    return importance.filter(F.col("perm_imp") > 0)


def sampled_shapley(model, df: DataFrame, keys: Sequence[str], names: Sequence[str], rows: int | None = None,
                    orderings: int = 4, binary: bool = True, seed: int = 42) -> DataFrame:
    """Shapley values by random feature orderings, each against a background row; of all rows, or of `rows` sampled ones.

    For models of `boosting`, `tree_shapley` gives them without orderings.

    For one ordering, features switch one by one from the background row's value to the row's own value;
    the change of the score at each switch is that feature's contribution. Contributions of one ordering
    add up to score(row) - score(background row), so the averages add up to score(row) - mean background.
    Returns (keys..., feature, shap, score, base).
    """
    sample = df.select(*keys, FEATURES)
    if rows is not None:
        sample = hash_sample(sample, keys, rows, seed)
    sample = durable(dense_index(sample.select(*keys, vector_to_array(FEATURES).alias("x")), keys,
                                 portable_hash(seed + 1, *keys)))
    size = sample.count()
    width = len(names)
    fanned = sample.select("*", F.explode(F.sequence(F.lit(0), F.lit(orderings - 1))).alias("o"))
    step = portable_hash(seed, F.col("o").cast("string")) % max(size - 1, 1) + 1
    partners = sample.select(F.col("__index").alias("partner"), F.col("x").alias("b"))
    paired = fanned.withColumn("partner", (F.col("__index") + step) % size).join(partners, "partner")
    # random order per (row, ordering): features sorted by a hash
    drawn = F.transform(
        F.sequence(F.lit(0), F.lit(width - 1)),
        lambda i: F.struct(portable_hash(seed, *keys, F.col("o").cast("string"), i.cast("string")).alias("h"), i.alias("i")),
    )
    ordered = paired.select(
        *keys, "o", "x", "b", F.transform(F.array_sort(drawn), lambda s: s["i"].cast("int")).alias("order")
    )
    # place[i] = step at which feature i switches
    place = F.transform(
        F.array_sort(F.transform("order", lambda i, r: F.struct(i.alias("i"), r.alias("r")))), lambda s: s["r"]
    )
    steps = ordered.select("*", place.alias("place")).select("*", F.explode(F.sequence(F.lit(0), F.lit(width))).alias("k"))
    vectors = steps.select(
        *keys,
        "o",
        "k",
        F.when(F.col("k") > 0, F.element_at("order", F.greatest("k", F.lit(1)))).alias("switched"),
        F.when(F.col("k") < width, F.element_at("order", F.least(F.col("k") + 1, F.lit(width)))).alias("upcoming"),
        array_to_vector(F.expr("zip_with(arrays_zip(x, b), place, (v, r) -> IF(r < k, v.x, v.b))")).alias(FEATURES),
    )
    scored = score_column(model, vectors, "__score", binary)
    gains = scored.select(
        *keys,
        F.inline(
            F.array(
                F.struct(F.col("switched").alias("f"), F.col("__score").alias("gain")),
                F.struct(F.col("upcoming").alias("f"), (-F.col("__score")).alias("gain")),
            )
        ),
        F.when(F.col("k") == width, F.col("__score")).alias("at_row"),
        F.when(F.col("k") == 0, F.col("__score")).alias("at_base"),
    )
    per_feature = (
        gains.filter(F.col("f").isNotNull()).groupBy(*keys, "f").agg((F.sum("gain") / orderings).alias("shap"))
    )
    ends = gains.groupBy(*keys).agg(F.avg("at_row").alias("score"), F.avg("at_base").alias("base"))
    lookup = F.array(*[F.lit(c) for c in names])
    return per_feature.join(ends, list(keys)).select(
        *keys, F.element_at(lookup, F.col("f") + 1).alias("feature"), "shap", "score", "base"
    )


def leaf_paths(tree: Tree) -> list[tuple[float, np.ndarray, np.ndarray, np.ndarray]]:
    """(value, features, above, upto) of each leaf: a row reaches it if above < bin <= upto holds for all of its features."""
    out = []

    def walk(node: int, limits: dict[int, tuple[int, int]]) -> None:
        f = int(tree.feature[node])
        if f < 0:
            items = sorted(limits.items())
            out.append((float(tree.value[node]), *(np.array(c, np.int64) for c in ([i for i, _ in items], [a for _, (a, _) in items], [b for _, (_, b) in items]))))
            return
        low, high = limits.get(f, (-1, 255))
        cut = int(tree.bin[node])
        walk(2 * node + 1, limits | {f: (low, min(high, cut))})
        walk(2 * node + 2, limits | {f: (max(low, cut), high)})

    walk(0, {})
    return out


@functools.cache
def _weights() -> np.ndarray:
    """(s-1)! t! / (s+t)! at [s, t]."""
    return np.array([[math.factorial(max(s - 1, 0)) * math.factorial(t) / math.factorial(s + t) for t in range(33)] for s in range(33)])


def pair_contributions(model: Boosted, x: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact Shapley values of each row's margin against its own background row, by feature.

    A leaf counts for a mixture of both rows if it takes all features that only x satisfies (there are s of them) from
    x and all that only b satisfies (t) from b. Over all orderings that gives a feature of the first kind
    (s-1)! t! / (s+t)! of the leaf's value, and one of the second kind -s! (t-1)! / (s+t)!.
    """
    out, weight = np.zeros(x.shape), _weights()
    for tree in model.trees:
        for value, features, above, upto in leaf_paths(tree):
            if not len(features):
                continue
            of_x, of_b = ((above < r[:, features]) & (r[:, features] <= upto) for r in (x, b))
            reached = (of_x | of_b).all(axis=1)
            only_x, only_b = of_x & ~of_b & reached[:, None], of_b & ~of_x & reached[:, None]
            s, t = only_x.sum(axis=1), only_b.sum(axis=1)
            out[:, features] += value * (only_x * weight[s, t][:, None] - only_b * weight[t, s][:, None])
    return out


def leaf_contributions(value: float, counts: np.ndarray) -> np.ndarray:
    """What `pair_contributions` adds up to for one leaf over all rows counted, by feature of the leaf and pattern of the row.

    A pattern has a bit for each of the leaf's k features that a row satisfies; `counts` has the rows of each pattern.
    A row of pattern p reaches the leaf with the rows whose patterns hold all the bits that p lacks. Of these, rows of
    m bits leave s = k - m features to p, so their number by m is all that the weights ask for.
    """
    k, patterns = len(counts).bit_length() - 1, np.arange(len(counts))
    sizes, bits = np.bitwise_count(patterns).astype(int), np.arange(k + 1)[:, None]
    holding = np.where(sizes == bits, counts, 0)  # [m, a]: rows whose pattern has m bits, among them all of a
    for i in range(k):
        halves = holding.reshape(k + 1, -1, 2, 1 << i)
        halves[:, :, 0] += halves[:, :, 1]
    lacks = patterns[::-1]
    met, s, t, weight = holding[:, lacks], k - bits, sizes[lacks], _weights()
    out = np.tile(-(met * weight[t, s]).sum(axis=0), (k, 1))  # the features that the row lacks
    for i in range(k):
        has = np.flatnonzero(patterns >> i & 1)
        without = met[:, has] - holding[:, lacks[has] | 1 << i]
        out[i, has] = (without * weight[s, t[has]]).sum(axis=0)
    return value * out


def _leaf_groups(model: Boosted) -> list[list[tuple[float, np.ndarray, np.ndarray, np.ndarray]]]:
    """All leaves in their order, PATTERNS patterns at a time; one empty group without any."""
    groups, held = [[]], 0
    for leaf in (leaf for tree in model.trees for leaf in leaf_paths(tree)):
        many = 1 << len(leaf[1])
        if groups[-1] and held + many > PATTERNS:
            groups.append([])
            held = 0
        groups[-1].append(leaf)
        held += many
    return groups


def _patterns(leaf: tuple[float, np.ndarray, np.ndarray, np.ndarray], columns: np.ndarray) -> np.ndarray:
    """The pattern of each row (a column of `columns`) in a leaf: bit i tells whether it satisfies the i-th feature."""
    _value, features, above, upto = (c if i == 0 else c.tolist() for i, c in enumerate(leaf))
    out = np.zeros(columns.shape[1], np.min_scalar_type((1 << len(features)) - 1))
    for i, (f, low, high) in enumerate(zip(features, above, upto, strict=True)):
        inside = (columns[f] > low) & (columns[f] <= high)
        out |= inside.astype(out.dtype) << i
    return out


def _bins(batch: pa.RecordBatch) -> np.ndarray:
    """Stored bins, a column for each row."""
    bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8)
    return np.ascontiguousarray(bins.reshape(batch.num_rows, -1).T)


def _pattern_counts(state: DataFrame, leaves: Sequence[tuple]) -> list[np.ndarray]:
    """How many rows have each pattern of each leaf."""
    ends = np.cumsum([0, *(1 << len(leaf[1]) for leaf in leaves)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(ends[-1], np.int64)
        for batch in batches:
            if batch.num_rows:
                columns = _bins(batch)
                for leaf, first, end in zip(leaves, ends, ends[1:], strict=False):
                    counts[first:end] += np.bincount(_patterns(leaf, columns), minlength=end - first)
        there = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(counts[there])], ["pattern", "n"])

    found = state.select("bins").mapInArrow(run, "pattern int, n bigint").groupBy("pattern").agg(F.sum("n").alias("n"))
    met = found.toArrow()  # one row for each pattern: model metadata
    counts = np.zeros(ends[-1], np.int64)
    counts[met.column("pattern").to_numpy()] = met.column("n").to_numpy()
    return [counts[first:end] for first, end in zip(ends, ends[1:], strict=False)]


def _against_all(model: Boosted, sample: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """`tree_shapley` of each row against all others, without looking at pairs.

    What a leaf gives a row depends on the row's pattern alone, once the rows of each pattern are counted: one pass
    counts, one looks up, whatever the number of rows. Large models take more such passes, a group of leaves each.
    """
    width, shared = len(names), sample.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField("row", T.StructType([sample.schema[k] for k in keys])), *T.StructType.fromDDL("bins binary, score double").fields])
    summed = T.StructType([*schema.fields, *T.StructType.fromDDL("v array<double>").fields])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            if batch.num_rows:
                bins = model.binned(matrix(batch.column("x"), width))
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([r.tobytes() for r in bins], pa.binary()), pa.array(model.margins(bins))], schema.names)

    def added(state: DataFrame, leaves: Sequence[tuple], counts: Sequence[np.ndarray]) -> DataFrame:
        """The rows with what these leaves give them."""
        tables = sample.sparkSession.sparkContext.broadcast([(leaf, leaf_contributions(leaf[0], n)) for leaf, n in zip(leaves, counts, strict=True)])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                columns = _bins(batch)
                v = np.zeros(columns.shape)
                if "v" in batch.schema.names:
                    v += matrix(batch.column("v"), width).T
                for leaf, table in tables.value:
                    pattern = _patterns(leaf, columns).astype(np.intp)
                    for f, gain in zip(leaf[1], table, strict=True):
                        v[f] += gain.take(pattern)
                ends = pa.array(np.arange(batch.num_rows + 1) * width, pa.int32())
                lists = pa.ListArray.from_arrays(ends, pa.array(v.T.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in schema.names), lists], summed.names)

        return state.mapInArrow(run, summed)

    state = durable(sample.select(F.struct(*keys).alias("row"), vector_to_array(FEATURES).alias("x")).mapInArrow(binned, schema))
    size = state.count()
    repeated = not state.groupBy("row").count().filter("count > 1").isEmpty()
    total = model.base * size  # of all margins: what the leaves give the rows that reach them
    for leaves in _leaf_groups(model):
        counts = _pattern_counts(state, leaves)
        total += sum(leaf[0] * float(n[-1]) for leaf, n in zip(leaves, counts, strict=True))
        state = durable(added(state, leaves, counts))
    others = max(size - 1, 1)
    base = (F.lit(total) - F.col("score")) / others if size > 1 else F.col("score")
    long = state.select("row.*", "score", base.alias("base"), F.posexplode("v").alias("f", "v"))
    long = long.select(*keys, "f", (F.col("v") / others).alias("shap"), "score", "base")
    if repeated:
        long = long.groupBy(*keys, "f").agg(F.avg("shap").alias("shap"), F.max("score").alias("score"), F.avg("base").alias("base"))
    lookup = F.array(*[F.lit(c) for c in names])
    return long.select(*keys, F.element_at(lookup, F.col("f") + 1).alias("feature"), "shap", F.lit(0.0).alias("shap_se"), "score", "base")


def _distances(start: int, first: int, end: int, most: int) -> list[tuple[int, int]]:
    """The distances 1 + (start + o) % most for o in first .. end-1, as stretches of at most SHAPLEY_BLOCK."""
    out, o = [], first
    while o < end:
        low = (start + o) % most
        n = min(end - o, most - low, SHAPLEY_BLOCK)
        out.append((low + 1, low + 1 + n))
        o += n
    return out


def _block(index: Column) -> Column:
    return F.floor(index / SHAPLEY_BLOCK)


def tree_shapley(model: Boosted, df: DataFrame, keys: Sequence[str], names: Sequence[str], rows: int | None = None,
                 backgrounds: int | None = None, tolerance: float | None = None, seed: int = 42) -> DataFrame:
    """Shapley values of a boosted model's margin (log-odds for classifiers), with their standard error.

    Each row is compared with all other rows, so its values are exact and their error is 0; or with `backgrounds` drawn
    ones: against each, its values are exact, from the leaves alone, so only the choice is random. With `tolerance`, their number doubles until the mean standard error is
    at most that share of the mean absolute value, or every row has met every other.
    Returns (keys..., feature, shap, shap_se, score, base); per row, the values add up to score - base.
    """
    sample = df.select(*keys, FEATURES)
    if rows is not None:
        sample = hash_sample(sample, keys, rows, seed)
    if backgrounds is None:
        return _against_all(model, sample, keys, names)
    sample = durable(dense_index(sample.select(*keys, vector_to_array(FEATURES).alias("x")), keys, portable_hash(seed + 1, *keys)))
    size, width = sample.count(), len(names)
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField("row", T.StructType([sample.schema[k] for k in keys])), *T.StructType.fromDDL("n bigint, v array<double>, vv array<double>, base double, score double").fields])
    most = max(size - 1, 1)
    start = sample.select((portable_hash(seed, F.lit("first")) % most).alias("s")).first() if size else None
    repeated = not sample.groupBy(*keys).count().filter("count > 1").isEmpty()

    def run(_key, rows: pa.Table, others: pa.Table) -> pa.Table:
        model = shared.value
        rows, others = rows.combine_chunks(), others.combine_chunks().sort_by("__index")
        if not rows.num_rows:
            return schema_of.empty_table()
        x, b = (model.binned(matrix(t.column("x").combine_chunks(), width)) for t in (rows, others))
        own, there = rows.column("__index").to_numpy(), others.column("__index").to_numpy()
        base, (low, high) = model.margins(b), (rows.column(c)[0].as_py() for c in ("low", "high"))
        v, vv, bases = np.zeros(x.shape), np.zeros(x.shape), np.zeros(len(x))
        step = max(1, PAIRS // len(x))
        for at in range(low, high, step):
            shifts = np.arange(at, min(at + step, high))
            met = np.searchsorted(there, (own + shifts[:, None]) % size)
            values = pair_contributions(model, np.tile(x, (len(shifts), 1)), b[met.ravel()]).reshape(len(shifts), *x.shape)
            v += values.sum(axis=0)
            vv += (values * values).sum(axis=0)
            bases += base[met].sum(axis=0)
        ends = pa.array(np.arange(len(x) + 1) * width, pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(w.ravel())) for w in (v, vv)]
        return pa.Table.from_arrays([rows.column("row"), pa.array(np.full(len(x), high - low)), *lists, pa.array(bases), pa.array(model.margins(x))], schema_of.names)

    schema_of = to_arrow_schema(schema)

    def met(first: int, end: int) -> DataFrame:
        """Sums by row and feature over the backgrounds first .. end-1: rows a fixed distance further on.

        Distances follow one another, so a block of rows meets one or two blocks of others, whatever their number.
        """
        parts = _distances(start.s if start else 0, first, end, most)
        fanned = sample.withColumn("part", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(low).alias("low"), F.lit(high).alias("high")) for i, (low, high) in enumerate(parts)])))
        fanned = fanned.select(*keys, "x", "__index", F.col("part.i").alias("part"), F.col("part.low").cast("bigint").alias("low"), F.col("part.high").cast("bigint").alias("high"))
        rows = fanned.select("part", _block(F.col("__index")).alias("block"), F.struct(*keys).alias("row"), "__index", "x", "low", "high")
        # The rows that meet this one as their background: a stretch of at most SHAPLEY_BLOCK, maybe over the end.
        lowest, highest = (F.pmod(F.col("__index") - d, F.lit(max(size, 1))) for d in (F.col("high") - 1, F.col("low")))
        asking = F.when(lowest <= highest, F.array(_block(lowest), _block(highest))).otherwise(
            F.array(_block(lowest), F.lit((max(size, 1) - 1) // SHAPLEY_BLOCK).cast("bigint"), F.lit(0).cast("bigint"), _block(highest))
        )
        others = fanned.select("part", F.explode(F.array_distinct(asking)).alias("block"), "__index", "x")
        found = rows.groupBy("part", "block").cogroup(others.groupBy("part", "block")).applyInArrow(run, schema)
        long = found.select("row.*", "n", "base", "score", F.posexplode(F.arrays_zip("v", "vv")).alias("f", "sums"))
        long = long.select(*keys, "f", "n", "sums.v", "sums.vv", "base", "score")
        return added(long) if repeated or len(parts) > 1 else long

    def added(sums: DataFrame) -> DataFrame:
        return sums.groupBy(*keys, "f").agg(*[F.sum(c).alias(c) for c in ("n", "v", "vv", "base")], F.max("score").alias("score"))

    done = min(backgrounds, most)
    state = durable(met(0, done))
    mean = F.col("v") / F.col("n")
    spread = F.greatest(F.col("vv") - F.col("v") * mean, F.lit(0.0)) / F.greatest(F.col("n") - 1, F.lit(1))
    # The sample of backgrounds is drawn without replacement from `most` rows.
    error: Column = F.sqrt(spread / F.col("n") * (1 - F.col("n") / most))
    while tolerance is not None and done < most:
        now = state.agg(F.avg(error).alias("error"), F.avg(F.abs(mean)).alias("size")).first()
        if now.error is None or now.error <= tolerance * now.size:
            break
        end = min(2 * done, most)
        state = durable(added(state.unionByName(met(done, end))))
        done = end
    lookup = F.array(*[F.lit(c) for c in names])
    return state.select(*keys, F.element_at(lookup, F.col("f") + 1).alias("feature"), mean.alias("shap"), error.alias("shap_se"), "score", (F.col("base") / F.col("n")).alias("base"))


def shapley_summary(values: DataFrame, n: int = 20) -> DataFrame:
    """Features by mean absolute contribution."""
    means = values.groupBy("feature").agg(F.avg(F.abs("shap")).alias("mean_abs_shap"))
    return top_features(means, "mean_abs_shap", n)


def row_forces(values: DataFrame, n: int | None = None) -> DataFrame:
    """Contributions of one explained row by absolute size, with the average rank of ties."""
    one = durable(values.select("feature", F.col("shap").alias("importance"), F.abs("shap").alias("size")))
    ranked = average_rank(one, "size", "rank").drop("size")
    ordered = ranked.orderBy("rank", "feature")
    return ordered if n is None else ordered.limit(n)
