import math

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import hard_negatives
from tidemark.llm.hard_negatives import NormIndex, mine

SCHEMA = "vec_id bigint, embedding array<double>, label int, uid string, shard int, score int"


def brute(rows, anchor, positives=5, negatives=5, low=80, high=100, base=100, scale=256):
    fine = [(i, [math.floor(scale * x) for x in v], c) for i, v, c in rows if i is not None and c is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (i, v, c) in enumerate(fine):
        if not anchor(i):
            continue
        scored = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), j, d) for k, (j, w, d) in enumerate(fine) if k != at and len(w) == len(v)))
        for s, j, _ in [r for r in scored if r[2] == c][:positives]:
            window = [(t, k) for t, k, d in scored if d != c and low * -s <= base * -t <= high * -s][:negatives]
            out += [(i, j, rank, k, -s, -t) for rank, (t, k) in enumerate(window, 1)]
    return sorted(out)


def run(spark, rows, modulus=10, **how):
    frame = spark.createDataFrame([(*r, "u", 1, 2) for r in rows], SCHEMA).repartition(4)
    return sorted(tuple(r) for r in mine(frame, F.col("vec_id") % modulus == 0, **how).collect())


def planted(n=600, dim=20, seed=5):
    """A third of the rows is one vector, some groups are tight, the rest is spread out."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    hot = rng.normal(size=dim).round(2).tolist()
    rows = []
    for i in range(n):
        v = hot if i % 3 == 0 else (centres[i % 6] + 0.02 * rng.normal(size=dim)).tolist() if i % 3 == 1 else (rng.normal(size=dim) * rng.uniform(0.01, 2)).tolist()
        rows.append((i, v, int(rng.integers(0, 4)) if i % 5 else 9))
    return rows


ODD = [(1000, None, 1), (1010, [], 1), (1020, [0.0] * 20, 1), (1030, [float("nan")] * 20, 2), (1040, [None] * 20, 2), (1050, [float("inf")] * 20, 2), (None, [5.0] * 20, 1),
       (1060, [1.0] * 20, None), (1070, [0.5] * 20, 77), (1080, [0.5, 0.5], 1), (1081, [0.5, 0.4], 1), (1082, [0.45, 0.5], 2), (20, [-0.5] * 20, 9), (20, [-0.5] * 20, 9), (1090, [-1.0] * 20, 3)]


def test_against_brute_force(spark, monkeypatch):
    rows = planted() + ODD
    want = brute(rows, lambda i: i % 10 == 0)
    assert run(spark, rows) == want and len(want) > 500
    monkeypatch.setattr(hard_negatives, "SHARD_CELLS", 1000)  # many shards, several groups of anchors
    monkeypatch.setattr(hard_negatives, "ANCHORS", 20)
    assert run(spark, rows) == want
    assert run(spark, rows, positives=2, negatives=7, low=30, high=95, scale=100) == brute(rows, lambda i: i % 10 == 0, 2, 7, 30, 95, 100, 100)


def test_few_rows_and_empty_table(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.1], 1), (2, [0.9, 0.0], 2), (10, [1.0, 1.0], 3)]
    assert run(spark, rows) == brute(rows, lambda i: i % 10 == 0) != []
    assert run(spark, []) == [] and run(spark, rows[1:3]) == []


def test_index_finds_all_rows_above_a_threshold_and_reads_less_for_higher_ones():
    rng = np.random.default_rng(8)
    rows = np.floor(rng.normal(size=(3000, 50)) * 40 * rng.uniform(0.2, 2, (3000, 1))).astype(np.int64)
    index = NormIndex(rows)
    everything = np.ones(len(rows), bool)
    for query in rows[:20]:
        score = rows @ query
        for threshold in (score.max(), 60_000.0, 20_000.0, 1.0, 0.0, -5_000.0, -math.inf):
            found, value = index.above(query, threshold, everything)
            assert found.tolist() == np.flatnonzero(score >= threshold).tolist() and np.array_equal(value, score[found])
    read = [sum(int((index.sorted_norms[g] >= t).sum()) for g in range(len(index.groups))) for t in (50.0, 200.0, 400.0)]
    assert read[0] > read[1] > read[2]
