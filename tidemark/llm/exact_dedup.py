"""Exact deduplication by content sort.

Sampled splitters deal the rows out by (start of the text, its hash, id), so a run of equal texts is contiguous over
the whole order, and a hot text spreads over as many partitions as its rows need. Spark's external sort places equal
texts side by side in each partition; one streaming pass compares each whole text with its neighbour. Runs that touch
the first or last splitter group of a partition may go on in the next one: only these, two groups for each partition,
are merged by their text afterwards.

Cases: a null text equals the empty text. A null id stays only in a group without any other id. Rows repeated with the
same id are copies like others. An empty table gives no rows. Other columns pass through untouched, whatever their
names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import col, fresh
from tidemark.session import durable

LEAD = 24  # characters of the text that the splitters hold, so that a sample of splitters stays small


def _runs(names: tuple[str, ...], heads: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Stream over a sorted partition: number its runs and mark those in its first and last splitter group."""
    ident, key, lead, code, part, run, edge, edge_text, keep, size, sha = names

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = TaskContext.get().partitionId()
        last = None  # (key, lead, hash) of the row before
        number = -1  # of the current run
        open_rows: list[pa.RecordBatch] = []  # of the current splitter group
        first_group = True

        def ready(pieces: list[pa.RecordBatch], edges: np.ndarray | bool) -> pa.RecordBatch:
            rows = pa.Table.from_batches(pieces).combine_chunks().to_batches()[0]
            runs = rows.column(run).to_numpy()
            starts = np.flatnonzero(np.r_[True, runs[1:] != runs[:-1]])
            counts = np.diff(np.r_[starts, len(runs)])
            at_edge = np.broadcast_to(edges, len(runs))
            begins = np.zeros(len(runs), bool)
            begins[starts] = True
            columns = {n: rows.column(n) for n in rows.schema.names if n != key}
            if not heads:
                columns[keep] = rows.column(ident).take(pa.array(np.repeat(starts, counts)))
                columns[size] = pa.array(np.repeat(counts, counts))
                columns[sha] = pa.array(np.repeat(np.array([hashlib.sha256(t.encode()).hexdigest() for t in rows.column(key).take(pa.array(starts)).to_pylist()], object), counts))
            columns[part] = pa.array(np.full(len(runs), here, np.int32))
            columns[edge] = pa.array(at_edge)
            columns[edge_text] = rows.column(key).take(pa.array(np.arange(len(runs)), mask=~(begins & at_edge)))
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys, leads, codes = batch.column(key), batch.column(lead), batch.column(code).to_numpy()
            differs, regroups = np.ones(n, bool), np.ones(n, bool)
            if n > 1:
                differs[1:] = ~pc.equal(keys.slice(1), keys.slice(0, n - 1)).to_numpy(zero_copy_only=False)
                regroups[1:] = (codes[1:] != codes[:-1]) | ~pc.equal(leads.slice(1), leads.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            if last is not None:
                differs[0] = last[0] != keys[0].as_py()
                regroups[0] = last[1] != leads[0].as_py() or last[2] != codes[0]
            last = (keys[n - 1].as_py(), leads[n - 1].as_py(), codes[n - 1])
            numbers = number + np.cumsum(differs)
            number = int(numbers[-1])
            rows = pa.RecordBatch.from_pydict({c: batch.column(c) for c in batch.schema.names if c not in (lead, code)} | {run: pa.array(numbers)})
            chosen = np.flatnonzero(differs) if heads else np.arange(n)
            rows = rows.take(pa.array(chosen)) if heads else rows
            groups = np.cumsum(regroups)[chosen]  # 0: goes on with the group that is open
            newest = int(np.cumsum(regroups)[-1])
            cut = int(np.searchsorted(groups, newest)) if newest else 0
            if newest:
                done = [*open_rows, rows.slice(0, cut)]
                first = int(np.searchsorted(groups, 1)) + sum(r.num_rows for r in open_rows) if open_rows else int(np.searchsorted(groups, 2))
                total = sum(r.num_rows for r in done)
                if total:
                    yield ready(done, (np.arange(total) < first) & first_group)
                    first_group = False
                open_rows = []
            if rows.num_rows > cut:
                open_rows.append(rows.slice(cut))
        if open_rows:
            yield ready(open_rows, True)

    return stream


def _sorted(docs: DataFrame, doc_id: str, text: str, normalised: Column | None, keep: str, heads: bool, columns: list[str]) -> tuple[DataFrame, list[str]]:
    names = fresh(docs.columns, "__id", "__key", "__lead", "__hash", "__part", "__run", "__edge", "__edge_text", "__keep", "__size", "__sha")
    ident, key, lead, code, part, run, edge, edge_text, kept, size, sha = names
    order = F.asc_nulls_last(ident) if keep == "smallest" else F.desc_nulls_last(ident)
    content = F.coalesce((col(text) if normalised is None else normalised).cast("string"), F.lit(""))
    frame = docs.select(*[col(c) for c in columns], col(doc_id).alias(ident), content.alias(key))
    frame = frame.withColumns({lead: F.substring(key, 1, LEAD), code: F.xxhash64(key)})
    ordered = frame.repartitionByRange(lead, code, order).sortWithinPartitions(lead, code, key, order)
    carried = [f for f in frame.schema.fields if f.name not in (key, lead, code)]
    added = [T.StructField(run, T.LongType())]
    if not heads:
        added += [T.StructField(kept, frame.schema[ident].dataType), T.StructField(size, T.LongType()), T.StructField(sha, T.StringType())]
    added += [T.StructField(part, T.IntegerType()), T.StructField(edge, T.BooleanType()), T.StructField(edge_text, T.StringType())]
    return durable(ordered.mapInArrow(_runs(tuple(names), heads), T.StructType(carried + added))), names


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", normalised: Column | None = None, keep: str = "smallest") -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256.

    `keep` is "smallest" or "largest": the id of a group that stays. `normalised` is the text to compare, the text
    itself by default. Among rows that repeat the id that stays, all are marked kept; `drop_duplicates` keeps one.
    """
    rows, names = _sorted(docs, doc_id, text, normalised, keep, False, [])
    ident, _, _, _, part, run, _, edge_text, kept, size, sha = names
    best = F.min if keep == "smallest" else F.max
    edges = rows.filter(F.col(edge_text).isNotNull()).select(part, run, kept, size, edge_text)
    merged = edges.groupBy(edge_text).agg(best(kept).alias("whole_keep"), F.sum(size).alias("whole_size"))
    # Two splitter groups for each partition: the broadcast grows with the partitions, not with the rows.
    whole = edges.join(merged, edge_text).select(part, run, "whole_keep", "whole_size")
    keep_id = F.when(F.col("whole_size").isNull(), F.col(kept)).otherwise(F.col("whole_keep"))
    return rows.join(F.broadcast(whole), [part, run], "left").select(
        F.col(ident).alias("doc_id"),
        keep_id.alias("keep_id"),
        F.coalesce("whole_size", size).alias("group_size"),
        F.col(ident).eqNullSafe(keep_id).alias("kept"),
        F.col(sha).alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", normalised: Column | None = None, keep: str = "smallest") -> DataFrame:
    """The rows of `docs` with their columns, one of each group of equal texts."""
    rows, names = _sorted(docs, doc_id, text, normalised, keep, True, docs.columns)
    part, run, edge, edge_text = names[4], names[5], names[6], names[7]
    place = F.struct(part, run)
    edges = rows.filter(edge).select(part, run, edge_text)
    first = edges.groupBy(edge_text).agg(F.min(place).alias("__first"))
    later = edges.join(first, edge_text).filter(place != F.col("__first")).select(part, run)
    return rows.join(F.broadcast(later), [part, run], "left_anti").select(*[col(c) for c in docs.columns])
