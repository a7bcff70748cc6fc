"""Nearest neighbours by inner product: a hierarchical navigable small-world graph for each shard.

Rows are dealt out to shards by the hash of their id, so equal vectors spread. A shard holds at most about SHARD_ROWS
rows. Inside, equal vectors are one node; the largest inner product becomes the smallest Euclidean distance by one
added dimension. The graph of each level links a node to the diverse ones of its nearest nodes, both ways, as one flat
array of neighbour numbers filled up with -1; the nodes of a level are a random part of those below. Shards are stored
as rows of flat arrays in the shared folder.

A search enters at the top, walks down greedily and explores the lowest level with a list of EF nodes; many queries
take their steps together. What is found is measured again in double precision on the original vectors, and the
results of all shards are merged.

Cases: vectors that are null, empty, zero or hold a null or non-finite component, and rows without id, take no part.
Of rows that repeat an id the one with the smallest vector counts. Only vectors of one length are compared. Ties go to
the smaller id; a vector shared by many ids is one node, and as many of its ids as asked for are returned. Fewer
candidates than asked for are all returned. Empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import col
from tidemark.session import durable

SHARDS = 12  # at least, so that a cluster has work for its cores
SHARD_ROWS = 1 << 16
QUERY_ROWS = 20_000  # queries that meet one copy of a shard's graph
LINKS = 16  # links that a node looks for; LINKS above and 3 * LINKS on the lowest level are stored
NEAREST = 48  # nearest nodes from which a node chooses its links
EF = 160
OPENED = 4  # nodes of a list that are opened in one step
QUERY_BLOCK = 256
PLAIN = 2 * LINKS  # up to so many nodes, all are linked


def valid(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    v = F.col("vector")
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(col(vec_id).cast("long").alias("id"), col(embedding).cast("array<double>").alias("vector"))
    return rows.filter(F.col("id").isNotNull() & v.isNotNull() & fine)


def levels_of(ids: np.ndarray) -> np.ndarray:
    """The top level of each node, drawn from its id."""
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    draw = ((mixed >> np.uint64(11)).astype(np.float64) + 1) / 2**53
    return np.minimum(-np.log(draw) / np.log(LINKS), 12).astype(np.int64)


def linked(points: np.ndarray, width: int) -> np.ndarray:
    """Neighbours of each point, -1 where there are fewer than `width`."""
    n = len(points)
    out = np.full((n, width), -1, np.int32)
    if n <= PLAIN:
        for i in range(n):
            others = np.delete(np.arange(n), i)[:width]
            out[i, : len(others)] = others
        return out
    square = (points**2).sum(axis=1)
    k = min(NEAREST, n - 1)
    forward = []
    for at in range(0, n, 512):
        block = points[at : at + 512]
        far = square[at : at + 512, None] + square - 2 * (block @ points.T)
        far[np.arange(len(block)), np.arange(at, at + len(block))] = np.inf
        near = np.argpartition(far, k - 1, axis=1)[:, :k]
        size = np.take_along_axis(far, near, axis=1)
        order = np.argsort(size, axis=1, kind="stable")
        near, size = np.take_along_axis(near, order, axis=1), np.take_along_axis(size, order, axis=1)
        found = points[near]
        norms = square[near]
        between = norms[:, :, None] + norms[:, None, :] - 2 * np.matmul(found, found.transpose(0, 2, 1))
        # A candidate closer to a chosen one than to the node is reached through that one.
        chosen = np.zeros(near.shape, bool)
        for j in range(k):
            shaded = (chosen & (between[:, j, :] < size[:, j, None])).any(axis=1)
            chosen[:, j] = ~shaded & (chosen.sum(axis=1) < LINKS)
        chosen[:, : LINKS // 2] = True  # and the very nearest in any case
        row, place = np.nonzero(chosen)
        forward.append(np.stack([row + at, near[row, place], place]))
    a, b, place = np.concatenate(forward, axis=1)
    pairs = np.concatenate([np.stack([a, b, place]), np.stack([b, a, place + NEAREST])], axis=1)
    pairs = pairs[:, np.lexsort((pairs[2], pairs[1], pairs[0]))]
    once = np.r_[True, (pairs[0, 1:] != pairs[0, :-1]) | (pairs[1, 1:] != pairs[1, :-1])]
    pairs = pairs[:, once]
    pairs = pairs[:, np.lexsort((pairs[2], pairs[0]))]  # own links first, then links back, nearest first
    begin = np.searchsorted(pairs[0], np.arange(n))
    slot = np.arange(pairs.shape[1]) - begin[pairs[0]]
    fits = slot < width
    out[pairs[0, fits], slot[fits]] = pairs[1, fits]
    return out


def build(rows: pa.Table) -> pa.Table:
    """One shard as a row of flat arrays."""
    ids = rows.column("id").to_numpy()
    dim = rows.column("dim")[0].as_py()
    vectors = rows.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) + 0.0
    order = np.lexsort((*vectors.T[::-1], ids))
    ids, vectors = ids[order], vectors[order]
    first = np.r_[True, ids[1:] != ids[:-1]]
    ids, vectors = ids[first], vectors[first]
    nodes, node_of = np.unique(vectors, axis=0, return_inverse=True)
    by_node = np.lexsort((ids, node_of.ravel()))
    counts = np.bincount(node_of.ravel(), minlength=len(nodes))
    members = ids[by_node]
    heads = members[np.cumsum(counts) - counts]
    order = np.argsort(-levels_of(heads), kind="stable")  # nodes of the upper levels first
    place = np.argsort(order)
    nodes, counts, levels = nodes[order], counts[order], levels_of(heads)[order]
    members = members[np.lexsort((members, np.repeat(place, np.bincount(node_of.ravel(), minlength=len(place)))))]
    square = (nodes**2).sum(axis=1)
    lifted = np.c_[nodes, np.sqrt(np.maximum(square.max() - square, 0))].astype(np.float32)
    graphs = [linked(lifted[: int((levels >= level).sum())], 3 * LINKS if level == 0 else LINKS) for level in range(int(levels.max()) + 1)]
    flat = np.concatenate([g.ravel() for g in graphs]).astype("<i4")
    sizes = np.array([len(g) for g in graphs], "<i4")
    return pa.table(
        {
            "dim": pa.array([dim], pa.int32()),
            "shard": pa.array([rows.column("shard")[0].as_py()], pa.int32()),
            "nodes": pa.array([nodes.astype("<f8").tobytes()], pa.binary()),
            "counts": pa.array([counts.astype("<i8").tobytes()], pa.binary()),
            "members": pa.array([members.astype("<i8").tobytes()], pa.binary()),
            "sizes": pa.array([sizes.tobytes()], pa.binary()),
            "neighbours": pa.array([flat.tobytes()], pa.binary()),
        }
    )


INDEX = "dim int, shard int, nodes binary, counts binary, members binary, sizes binary, neighbours binary"


def index(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The graph of every shard, stored. Every valid row is in it."""
    rows = valid(vectors, vec_id, embedding)
    shards = max(SHARDS, -(-rows.count() // SHARD_ROWS))
    dealt = rows.withColumns({"dim": F.size("vector"), "shard": F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")})
    return durable(dealt.groupBy("dim", "shard").applyInArrow(build, INDEX))


class Shard:
    def __init__(self, row: dict) -> None:
        self.vectors = np.frombuffer(row["nodes"], "<f8").reshape(-1, row["dim"])
        self.nodes = self.vectors.astype(np.float32)
        self.counts = np.frombuffer(row["counts"], "<i8")
        self.members = np.frombuffer(row["members"], "<i8")
        self.begin = np.cumsum(self.counts) - self.counts
        sizes = np.frombuffer(row["sizes"], "<i4")
        flat, at, self.graphs = np.frombuffer(row["neighbours"], "<i4"), 0, []
        for level, size in enumerate(sizes.tolist()):
            width = 3 * LINKS if level == 0 else LINKS
            self.graphs.append(flat[at : at + size * width].reshape(size, width))
            at += size * width

    def product(self, queries: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Inner products of each query with its own nodes; -inf for the empty places -1."""
        return np.where(at >= 0, np.einsum("qd,qkd->qk", queries, self.nodes[at]), -np.inf)

    def search(self, queries: np.ndarray, ef: int) -> np.ndarray:
        """Up to `ef` nodes for each query, -1 where there are fewer."""
        count = len(queries)
        here = np.zeros(count, np.int64)  # the first node is on the top level
        best = self.product(queries, here[:, None])[:, 0]
        for graph in self.graphs[:0:-1]:
            moving = np.arange(count)
            while len(moving):
                around = graph[here[moving]]
                value = self.product(queries[moving], around)
                step = value.argmax(axis=1)
                top = value[np.arange(len(moving)), step]
                better = top > best[moving]
                moving = moving[better]
                best[moving] = top[better]
                here[moving] = around[better, step[better]]
        ef = min(ef, len(self.nodes))
        seen = np.zeros((count, len(self.nodes)), bool)
        listed = np.full((count, ef), -1, np.int64)
        value = np.full((count, ef), -np.inf, np.float32)
        opened = np.zeros((count, ef), bool)
        listed[:, 0], value[:, 0] = here, best
        seen[np.arange(count), here] = True
        active = np.arange(count)
        while len(active):
            closed = np.where(opened[active] | (listed[active] < 0), -np.inf, value[active])
            pick = np.argsort(-closed, axis=1, kind="stable")[:, :OPENED]
            there = np.take_along_axis(closed, pick, axis=1) > -np.inf
            on = there.any(axis=1)
            active, pick, there = active[on], pick[on], there[on]
            if not len(active):
                break
            opened[active[:, None], pick] |= there
            around = np.where(there[:, :, None], self.graphs[0][np.maximum(listed[active[:, None], pick], 0)], -1).reshape(len(active), -1)
            around = np.sort(around, axis=1)
            around[:, 1:][around[:, 1:] == around[:, :-1]] = -1
            around = np.where((around >= 0) & ~seen[active[:, None], np.maximum(around, 0)], around, -1)
            row, place = np.nonzero(around >= 0)
            seen[active[row], around[row, place]] = True
            all_value = np.concatenate([value[active], self.product(queries[active], around)], axis=1)
            all_listed = np.concatenate([listed[active], around], axis=1)
            all_opened = np.concatenate([opened[active], np.zeros(around.shape, bool)], axis=1)
            order = np.argsort(-all_value, axis=1, kind="stable")[:, :ef]
            value[active] = np.take_along_axis(all_value, order, axis=1)
            listed[active] = np.where(value[active] > -np.inf, np.take_along_axis(all_listed, order, axis=1), -1)
            opened[active] = np.take_along_axis(all_opened, order, axis=1)
        return listed


def nearest(shard: Shard, query_ids: np.ndarray, queries: np.ndarray, k: int, ef: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query id, id, score: the k best ids of the shard for each query, its own id left out."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(queries), QUERY_BLOCK):
        block, names = queries[at : at + QUERY_BLOCK], query_ids[at : at + QUERY_BLOCK]
        found = shard.search(block.astype(np.float32), ef)
        row, place = np.nonzero(found >= 0)
        node = found[row, place]
        score = np.einsum("ij,ij->i", block[row], shard.vectors[node])
        taken = np.minimum(shard.counts[node], k + 1)  # the smallest ids of a node; one may be the query's own
        offset = np.arange(int(taken.sum())) - np.repeat(np.cumsum(taken) - taken, taken)
        row, score, ids = np.repeat(row, taken), np.repeat(score, taken), shard.members[np.repeat(shard.begin[node], taken) + offset]
        other = ids != names[row]
        row, score, ids = row[other], score[other], ids[other]
        order = np.lexsort((ids, -score, row))
        row, score, ids = row[order], score[order], ids[order]
        first = np.arange(len(row)) - np.searchsorted(row, row)
        kept = first < k
        out.append((names[row[kept]], ids[kept], score[kept]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def search(graphs: DataFrame, queries: DataFrame, k: int = 20, ef: int = EF) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of all shards for each row (id, vector) of `queries`."""
    splits = max(1, -(-queries.count() // QUERY_ROWS))
    part = F.pmod(F.xxhash64("id", F.lit("query")), F.lit(splits)).cast("int")
    shards = graphs.select(F.col("dim").alias("asked_dim"), F.col("shard").alias("asked_shard"))
    # One small row for each SHARD_ROWS vectors.
    asked = queries.select("id", "vector", F.size("vector").alias("asked_dim"), part.alias("asked_split")).join(F.broadcast(shards), "asked_dim")
    copies = graphs.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        shard = Shard(left.to_pylist()[0])
        vectors = right.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(right.num_rows, -1)
        names, ids, score = nearest(shard, right.column("id").to_numpy(), vectors, k, ef)
        return pa.table({"query_id": names, "vec_id": ids, "score": score})

    keys = ["asked_dim", "asked_shard", "asked_split"]
    found = copies.groupBy("dim", "shard", "split").cogroup(asked.groupBy(*keys)).applyInArrow(meet, "query_id bigint, vec_id bigint, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def queries_of(graphs: DataFrame, chosen: Callable[[Column], Column]) -> DataFrame:
    """(id, vector) of the indexed rows whose id is `chosen`, read from the index."""

    def unfold(batches):
        for batch in batches:
            for row in batch.to_pylist():
                counts = np.frombuffer(row["counts"], "<i8")
                vectors = np.frombuffer(row["nodes"], "<f8").reshape(-1, row["dim"])
                members = np.frombuffer(row["members"], "<i8")
                node = np.repeat(np.arange(len(counts)), counts)
                for at in range(0, len(members), 4096):
                    part = vectors[node[at : at + 4096]]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * row["dim"], pa.int32()), pa.array(part.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(members[at : at + 4096]), lists], ["id", "vector"])

    return graphs.select("dim", "nodes", "counts", "members").mapInArrow(unfold, "id bigint, vector array<double>").filter(chosen(F.col("id")))
