"""Hard negatives of anchor vectors, by threshold joins over an inverted index with norm bounds.

Vectors are scaled, rounded down to whole numbers and compared by inner product. For an anchor, its positives are the
best rows of the same label; for each positive, its hard negatives are the best rows of other labels whose score lies in
a window below the positive's.

Rows are dealt into shards of about SHARD_CELLS numbers; anchors visit shards in groups of ANCHORS, so a task is
bounded however many anchors or rows there are, and a label that holds a third of all rows is several shards. In a
shard, an inverted index is made of groups of dimensions, those of little weight first:

* the list of a group holds rows sorted by the norm of their dimensions up to that group. For a threshold t and an
  anchor q, dimensions of a row whose norm up to there is below t / |q| are not indexed: they cannot reach t alone.
  So each list is read only up to that norm, and a lower threshold reads further down the same lists;
* lists are read from the last group to the first and add up partial scores. A row is dropped as soon as its partial
  score and the product of the remaining norms stay below t. What is left gets its exact score.

A search starts with a high threshold and lowers it until its windows are full: `positives` rows of the anchor's label,
or `negatives` rows in the window of every positive, or until the threshold is the lowest that counts. Scores are exact
64-bit integers; norms have a margin for rounding. Shards return their own best, at most as many as are asked for,
and these are merged.

Cases: rows take no part whose label, id or vector is null, or whose vector is empty or holds a null or non-finite
component; zero vectors do. Only vectors of one length are compared. Rows that repeat an id are rows of their own, and
one may be a positive or negative of the other. Ties go to the smaller id. Fewer rows than asked for are all returned;
an anchor without positives, or a positive without rows in its window, returns none. A negative positive score has an
empty window. Empty tables give no rows; other columns are not read. Sums of products must fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import col
from tidemark.operators.lookup import skew_safe_lookup
from tidemark.session import durable

SHARD_CELLS = 1 << 19  # rows times dimensions of a shard
ANCHORS = 4096  # anchors that meet one copy of a shard, about
GROUP = 8  # dimensions of a list
HIGHEST = 0.9  # first threshold, as part of the largest score that norms allow
LOWER = 0.75  # each further threshold, as part of the one before
LOWEST = 0.05  # below this part everything is read
MARGIN = 1e-9


class NormIndex:
    """Inverted lists over groups of dimensions, each sorted by the norm up to that group, longest first."""

    def __init__(self, rows: np.ndarray) -> None:
        self.rows = rows
        order = np.argsort((rows.astype(np.float64) ** 2).sum(axis=0), kind="stable")
        self.groups = [order[at : at + GROUP] for at in range(0, rows.shape[1], GROUP)]
        squares = np.stack([(rows[:, g].astype(np.float64) ** 2).sum(axis=1) for g in self.groups])
        self.norms = np.sqrt(np.cumsum(squares, axis=0))  # by group and row: of all dimensions up to the group
        self.lists = np.argsort(-self.norms, axis=1, kind="stable").astype(np.int32)
        self.sorted_norms = np.take_along_axis(self.norms, self.lists.astype(np.int64), axis=1)
        self.values = [rows[np.ix_(lst, g)].astype(np.float64) for lst, g in zip(self.lists, self.groups, strict=True)]
        self.largest = float(self.norms[-1].max(initial=0.0))

    def above(self, query: np.ndarray, threshold: float, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows among `allowed` whose score is `threshold` or more, and their scores."""
        length = float(np.sqrt((query.astype(np.float64) ** 2).sum()))
        bound = threshold - MARGIN * (abs(threshold) + length * self.largest)
        if bound <= 0 or not length:
            found = np.flatnonzero(allowed)
        else:
            least = bound / length
            partial = np.zeros(len(self.rows))
            alive = allowed.copy()
            before = np.sqrt(np.cumsum([(query[g].astype(np.float64) ** 2).sum() for g in self.groups]))
            for at in range(len(self.groups) - 1, -1, -1):
                listed = int(np.searchsorted(-self.sorted_norms[at], -least, side="right"))
                if at == len(self.groups) - 1:
                    alive[self.lists[at, listed:]] = False  # too short to reach the threshold at all
                open_ = self.lists[at, :listed]
                on = alive[open_]
                open_ = open_[on]
                partial[open_] += self.values[at][:listed][on] @ query[self.groups[at]].astype(np.float64)
                if at:
                    lost = partial[open_] + before[at - 1] * self.norms[at - 1, open_] < bound
                    alive[open_[lost]] = False
            found = np.flatnonzero(alive)
        score = self.rows[found] @ query
        kept = score >= threshold
        return found[kept], score[kept]

    def lowered(self, query: np.ndarray, allowed: np.ndarray, floor: float, full: Callable[[np.ndarray, np.ndarray], bool], start: float | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores above the first threshold at which `full` holds, or above `floor`.

        Thresholds start at `start`, or at a part of what the norms allow, and shrink by one factor.
        """
        most = float(np.sqrt((query.astype(np.float64) ** 2).sum())) * self.largest
        threshold = HIGHEST * most if start is None else start
        while threshold > floor and threshold > LOWEST * most:
            found, score = self.above(query, threshold, allowed)
            if full(found, score):
                return found, score
            threshold *= LOWER
        return self.above(query, floor, allowed)


def prepared(vectors: DataFrame, vec_id: str, embedding: str, label: str, scale: int, anchor: Column) -> DataFrame:
    """(uid, id, label, vector, dim, anchor) of the rows that take part, stored; vectors as whole numbers."""
    rows = vectors.select(col(vec_id).cast("long").alias("id"), col(label).cast("long").alias("label"), col(embedding).cast("array<double>").alias("given"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    odd = F.exists("given", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("given").isNotNull() & (F.size("given") > 0) & ~odd)
    whole = F.transform("given", lambda x: F.floor(x * F.lit(scale)).cast("long"))
    return durable(fine.select(F.monotonically_increasing_id().alias("uid"), "id", "label", whole.alias("vector"), F.size("given").alias("dim"), "anchor"))


def _sharded(rows: DataFrame, by: list[str]) -> DataFrame:
    """`rows` with the number of shards of their group, of about SHARD_CELLS numbers each."""
    groups = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("weight"))
    dim = F.col("dim").cast("long")
    groups = groups.withColumn("shards", F.floor((F.col("weight") * dim + (SHARD_CELLS - 1)) / F.lit(SHARD_CELLS)))
    return skew_safe_lookup(rows, groups, by, "weight")


def _meet(rows: DataFrame, anchors: DataFrame, by: list[str], splits: int, run, schema: str) -> DataFrame:
    """Every anchor meets every shard of its group; `rows` and `anchors` have columns `by` and shards."""
    hashed = F.pmod(F.xxhash64("uid", F.lit("shard")), F.col("shards"))
    dealt = rows.select("*", hashed.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(splits - 1))).alias("split"))
    asked = anchors.select(
        *[F.col(c).alias(f"asked_{c}") for c in anchors.columns if c != "shards"],
        F.pmod(F.xxhash64("uid", F.lit("anchor")), F.lit(splits)).cast("int").alias("asked_split"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shards") - 1)).alias("asked_shard"),
    )
    keys = [*by, "shard", "split"]
    return dealt.drop("shards").groupBy(*keys).cogroup(asked.groupBy(*[f"asked_{k}" for k in keys])).applyInArrow(run, schema)


def _matrix(rows: pa.Table, vector: str = "vector") -> np.ndarray:
    return rows.column(vector).combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)


def _find_positives(count: int):
    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if rows.num_rows and asked.num_rows:
            index = NormIndex(_matrix(rows))
            ids, uids = rows.column("id").to_numpy(), rows.column("uid").to_numpy()
            for uid, query in zip(asked.column("asked_uid").to_pylist(), _matrix(asked, "asked_vector"), strict=True):
                allowed = uids != uid
                wanted = min(count, int(allowed.sum()))
                found, score = index.lowered(query, allowed, -np.inf, lambda found, _, wanted=wanted: len(found) >= wanted)
                best = np.lexsort((ids[found], -score))[:wanted]
                out.append((np.full(len(best), uid), uids[found[best]], ids[found[best]], score[best]))
        columns = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in (zip(*out, strict=True) if out else [()] * 4)]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("uid", "positive_uid", "positive_id", "score"), columns, strict=True)})

    return run


def _find_negatives(count: int, low: int, high: int, base: int):
    def window(positive: int) -> tuple[int, int]:
        """Least and greatest score s with low * positive <= base * s <= high * positive."""
        return -(-low * positive // base), high * positive // base

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if rows.num_rows and asked.num_rows:
            index = NormIndex(_matrix(rows))
            ids, labels = rows.column("id").to_numpy(), rows.column("label").to_numpy()
            for uid, label, scores, query in zip(*(asked.column(f"asked_{c}").to_pylist() for c in ("uid", "label", "scores")), _matrix(asked, "asked_vector"), strict=True):
                windows = {s: window(s) for s in scores}
                windows = {s: w for s, w in windows.items() if w[0] <= w[1]}
                if not windows:
                    continue

                def full(_found, score, windows=windows):
                    return all(np.count_nonzero((score >= a) & (score <= b)) >= count for a, b in windows.values())

                floor = min(a for a, _ in windows.values())
                start = HIGHEST * min(b for _, b in windows.values())
                found, score = index.lowered(query, labels != label, floor, full, start)
                order = np.lexsort((ids[found], -score))
                found, score = found[order], score[order]
                for s, (a, b) in windows.items():
                    best = np.flatnonzero((score >= a) & (score <= b))[:count]
                    out.append((np.full(len(best), uid), np.full(len(best), s), ids[found[best]], score[best]))
        columns = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in (zip(*out, strict=True) if out else [()] * 4)]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("uid", "positive_score", "negative_id", "negative_score"), columns, strict=True)})

    return run


def mine(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, base: int = 100, scale: int = 256,
         vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows where `anchor` holds.

    `low` and `high` bound a negative's score, in parts of `base` of the positive's.
    """
    rows = prepared(vectors, vec_id, embedding, label, scale, anchor)
    splits = max(1, -(-rows.filter("anchor").count() // ANCHORS))
    same = _sharded(rows.select("uid", "id", "label", "dim", "vector", "anchor"), ["dim", "label"])
    found = _meet(
        same.select("uid", "id", "dim", "label", "vector", "shards"), same.filter("anchor").select("uid", "dim", "label", "vector", "shards"),
        ["dim", "label"], splits, _find_positives(positives), "uid bigint, positive_uid bigint, positive_id bigint, score bigint",
    )
    place = F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("score"), "positive_id", "positive_uid"))
    chosen = durable(found.withColumn("place", place).filter(F.col("place") <= positives).drop("place"))
    all_rows = _sharded(rows.select("uid", "id", "label", "dim", "vector", "anchor"), ["dim"])
    scores = chosen.groupBy("uid").agg(F.collect_set("score").alias("scores"))  # `positives` numbers at most
    asked = all_rows.filter("anchor").join(scores, "uid").select("uid", "dim", "label", "vector", "scores", "shards")
    met = _meet(
        all_rows.select("id", "uid", "dim", "label", "vector", "shards"), asked,
        ["dim"], splits, _find_negatives(negatives, low, high, base), "uid bigint, positive_score bigint, negative_id bigint, negative_score bigint",
    )
    place = F.row_number().over(Window.partitionBy("uid", "positive_score").orderBy(F.desc("negative_score"), "negative_id"))
    ranked = met.withColumn("rank", place).filter(F.col("rank") <= negatives)
    pairs = chosen.withColumnRenamed("score", "positive_score").join(rows.filter("anchor").select("uid", F.col("id").alias("anchor_id")), "uid")
    return pairs.join(ranked, ["uid", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
