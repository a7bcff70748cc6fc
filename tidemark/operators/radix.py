"""Exact quantiles of many columns at once by radix selection.

A double becomes a 64-bit whole number of the same order. Leading bits are counted for all columns in one scan; only
the prefixes that hold a wanted rank are looked at in the next scan, some bits deeper, until the values are known. No
value is shuffled or sorted: tasks send counts of prefixes, which Spark adds up before they travel, and what comes back
is bounded by the bits of a step. Once the open prefixes hold few rows in all, one scan takes all bits that are left.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.lookup import quoted

FIRST_BITS = 12  # sign and exponent
STEP_BITS = 14
FEW_ROWS = 1 << 20  # rows in open prefixes from which on one scan finishes
COARSE_BITS = 20
_MOST = np.int64(0x7FFFFFFFFFFFFFFF)


def order_key(x: np.ndarray) -> np.ndarray:
    """64-bit numbers in the order of the doubles; -0.0 as 0.0, NaN above everything."""
    bits = (np.where(np.isnan(x), np.nan, x) + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ _MOST, bits)


def key_value(key: np.ndarray) -> np.ndarray:
    return np.where(key < 0, key ^ _MOST, key).astype(np.int64).view(np.float64)


def prefix_counts(df: DataFrame, columns: Sequence[str], bits: int, done: int = 0, within: Mapping[int, np.ndarray] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """(prefixes, counts) of each column's non-null values, by their first `bits` bits, in order.

    With `within`, only values whose first `done` bits are among the given ones count.
    """
    rows = df.select(*[F.col(quoted(c)).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, np.ndarray, np.ndarray]] = []
            for i, column in enumerate(batch.columns):
                keys = order_key(column.drop_null().to_numpy(zero_copy_only=False))
                if within is not None:
                    open_ = within.get(i, np.zeros(0, np.int64))
                    keys = keys[np.isin(keys >> (64 - done), open_)] if done else keys
                if len(keys):
                    out.append((i, *np.unique(keys >> (64 - bits), return_counts=True)))
            if out:
                number = np.concatenate([np.full(len(p), i, np.int32) for i, p, _ in out])
                yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(np.concatenate([p for _, p, _ in out])), pa.array(np.concatenate([n for _, _, n in out]).astype(np.int64))], ["c", "prefix", "n"])

    found = rows.mapInArrow(run, "c int, prefix bigint, n bigint").groupBy("c", "prefix").agg(F.sum("n").alias("n")).toArrow()
    number, prefix, n = (found.column(c).to_numpy() for c in ("c", "prefix", "n"))
    order = np.lexsort((prefix, number))
    number, prefix, n = number[order], prefix[order], n[order]
    cuts = np.searchsorted(number, np.arange(len(columns) + 1))
    return [(prefix[a:b], n[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def order_statistics(df: DataFrame, wanted: Mapping[str, Sequence[float]]) -> dict[str, list[float | None]]:
    """Quantiles of each column, interpolated linearly between neighbours; None where a column has no value.

    Reads `df` two to five times, the columns asked for only.
    """
    columns = list(wanted)
    bits = FIRST_BITS
    counts = prefix_counts(df, columns, bits)
    totals = [int(n.sum()) for _, n in counts]
    ranks = [sorted({r for p in wanted[c] for r in (math.floor(p * (t - 1)), math.ceil(p * (t - 1)))}) if t else [] for c, t in zip(columns, totals, strict=True)]
    before = [{} for _ in columns]  # by open prefix: values below it
    where: list[dict[int, int]] = [{} for _ in columns]  # by rank: the prefix it lies in

    def place(i: int, starts: dict[int, int]) -> int:
        """Find each rank among the prefixes of column i; the number of rows in the prefixes that hold one."""
        prefix, n = counts[i]
        if not ranks[i]:
            return 0
        parent = prefix >> (bits - done) if done else np.zeros(len(prefix), np.int64)
        first = np.r_[True, parent[1:] != parent[:-1]]
        below = np.cumsum(n) - n
        below = below - below[first][np.cumsum(first) - 1] + np.array([starts[int(p)] for p in parent])
        at = np.searchsorted(below, ranks[i], side="right") - 1
        where[i] = {r: int(prefix[j]) for r, j in zip(ranks[i], at, strict=True)}
        before[i] = {int(prefix[j]): int(below[j]) for j in at}
        return int(n[np.unique(at)].sum())

    done = 0
    rows = sum(place(i, {0: 0}) for i in range(len(columns)))
    while bits < 64 and any(where):
        done, bits = bits, 64 if rows <= FEW_ROWS else min(64, bits + STEP_BITS)
        open_ = {i: np.array(sorted(b), np.int64) for i, b in enumerate(before) if b}
        counts = prefix_counts(df, columns, bits, done, open_)
        rows = sum(place(i, before[i]) for i in range(len(columns)))
    out: dict[str, list[float | None]] = {}
    for i, c in enumerate(columns):
        values = {r: float(key_value(np.array([k], np.int64))[0]) for r, k in where[i].items()}
        out[c] = []
        for p in wanted[c]:
            position = p * (totals[i] - 1)
            low, high = (values.get(f(position)) if totals[i] else None for f in (math.floor, math.ceil))
            out[c].append(None if low is None else low + (high - low) * (position - math.floor(position)))
    return out


def coarse_limits(df: DataFrame, columns: Sequence[str], parts: int) -> list[np.ndarray]:
    """At most parts - 1 limits for each column that cut its values into about equal parts, from one scan.

    A limit is the greatest double with some first COARSE_BITS bits, so equal values never fall apart and the limits do
    not depend on how the rows are partitioned.
    """
    out = []
    for prefix, n in prefix_counts(df, columns, COARSE_BITS):
        if not len(prefix):
            out.append(np.zeros(0))
            continue
        upto = np.cumsum(n)
        at = np.unique(np.searchsorted(upto, upto[-1] * np.arange(1, parts) / parts))
        at = at[at < len(prefix) - 1]  # nothing lies above the last one
        out.append(key_value(((prefix[at] + 1) << (64 - COARSE_BITS)) - 1))
    return out
