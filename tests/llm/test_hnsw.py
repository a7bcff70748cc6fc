import numpy as np

from tidemark.llm import hnsw
from tidemark.llm.common import table


def brute(rows, k=20, modulus=20):
    """rows: (id, vector). The exact answer."""
    ids = np.array([i for i, _ in rows])
    vectors = np.array([v for _, v in rows], float)
    out = {}
    for q in np.flatnonzero(ids % modulus == 0):
        score = vectors @ vectors[q]
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[i]), float(score[i])) for i in order]
    return out


def answers(graphs, k=20):
    got = {}
    for r in hnsw.search(graphs, hnsw.queries_of(graphs, lambda i: i % 20 == 0), k).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    return got


def recall(got, want):
    return sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in w}) for q, w in want.items()) / sum(map(len, want.values()))


def test_recall_on_embeddings(spark, sf):
    vectors = table(spark, sf.replace("0.001", "0.1"), "embeddings")
    want = brute([(r.vec_id, r.embedding) for r in vectors.collect()])
    got = answers(hnsw.index(vectors))
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert recall(got, want) > 0.98
    for q, rows in got.items():
        exact = dict(want[q])
        assert all(abs(s - exact[i]) < 1e-12 for i, s in rows if i in exact)


def test_recall_of_one_large_shard():
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(6000, 24)) * rng.uniform(0.5, 2, (6000, 1))
    import pyarrow as pa

    rows = pa.table({"id": np.arange(6000), "dim": pa.array([24] * 6000, pa.int32()), "shard": pa.array([0] * 6000, pa.int32()), "vector": vectors.tolist()})
    shard = hnsw.Shard(hnsw.build(rows).to_pylist()[0])
    assert len(shard.graphs) > 2
    names = np.arange(0, 6000, 20)
    q, ids, _ = hnsw.nearest(shard, names, vectors[names], 20, hnsw.EF)
    got = {}
    for a, b in zip(q.tolist(), ids.tolist(), strict=True):
        got.setdefault(a, []).append((b, 0.0))
    assert recall(got, brute(list(enumerate(vectors)))) > 0.95


def test_hot_vector_ties_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [1.0, 2.0, 2.0]) for i in range(300)] + [(i, rng.normal(size=3).tolist()) for i in range(300, 500)]
    odd = [(1000, None), (1020, [0.0, 0.0, 0.0]), (1040, [float("nan"), 1.0, 1.0]), (1060, [1.0, None, 1.0]), (1080, []), (None, [9.0, 9.0, 9.0]), (40, [1.0, 2.0, 2.0]), (1100, [float("inf"), 0.0, 1.0]), (1120, [1.0])]
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows + odd], "vec_id bigint, embedding array<double>, score int")
    want = brute(rows)
    got = answers(hnsw.index(frame))
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
    assert hnsw.search(hnsw.index(frame.limit(0)), hnsw.queries_of(hnsw.index(frame.limit(0)), lambda i: i % 20 == 0)).count() == 0


def test_fewer_candidates_than_asked_for(spark):
    frame = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(7)], "vec_id bigint, embedding array<double>")
    got = answers(hnsw.index(frame))
    assert [i for i, _ in got[0]] == [1, 2, 3, 4, 5, 6]
