import random

from pyspark.sql import functions as F

from tidemark.llm import packing
from tidemark.llm.common import table


def slow_pack(sizes, conflicts, capacity):
    """Look at every bin for every item. conflicts: sets of labels."""
    bins, out, clock = [], [], 0
    for size, labels in zip(sizes, conflicts, strict=True):
        fitting = [(room, since, k) for k, (room, since, held) in enumerate(bins) if room >= size and not held & labels]
        if fitting:
            room, _, k = min(fitting)
            held = bins[k][2]
        else:
            k, room, held = len(bins), capacity, set()
            bins.append(None)
        clock += 1
        bins[k] = (room - size, clock, held | labels)
        out.append((k, capacity - room))
    return out


def test_pack_against_all_bins():
    rng = random.Random(11)
    for capacity, n in ((10, 80), (100, 300), (64, 400)):
        sources = [rng.choice(["a", "a", "a", "b", "c", "d", None]) for _ in range(n)]
        clusters = [rng.choice([1, *range(2, n)]) for _ in range(n)]
        sizes = sorted((rng.randrange(1, capacity + 1) if rng.random() < 0.5 else rng.randrange(1, 2 + capacity // 8) for _ in range(n)), reverse=True)
        bits = packing.bitmaps(sources, clusters)
        number, offset = packing.pack(sizes, bits, capacity)
        labels = [({f"s{s}"} if s else set()) | {c} for s, c in zip(sources, clusters, strict=True)]
        assert list(zip(number, offset, strict=True)) == slow_pack(sizes, labels, capacity)


def test_documents(spark, sf):
    docs = table(spark, sf, "documents")
    rows = packing.best_fit(docs).join(docs.select("doc_id", "source", "text"), "doc_id").collect()
    size = {}
    bins = {}
    for r in rows:
        size[r.doc_id] = size.get(r.doc_id, 0) + r.length
        bins.setdefault((r.shard, r.bin), []).append(r)
    assert size == {r.doc_id: len(r.text.encode()) + 1 for r in docs.collect()}
    for members in bins.values():
        members.sort(key=lambda r: r.position)
        assert [r.position for r in members] == [sum(x.length for x in members[:k]) for k in range(len(members))]
        assert sum(r.length for r in members) <= packing.CAPACITY
        assert len({r.source for r in members}) == len({r.text for r in members}) == len(members)


def test_rows_with_one_id_or_none_spread_over_shards(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ITEMS", 100)
    for id_ in (None, 5):
        docs = spark.range(3000).select(F.lit(id_).cast("bigint").alias("doc_id"), F.lit("same").alias("text"), F.lit("s").alias("source"))
        sizes = [r["count"] for r in packing.best_fit(docs).groupBy("shard").count().collect()]
        assert sum(sizes) == 3000 and max(sizes) < 200


def test_shards_cost_few_bins(spark, sf):
    docs = table(spark, sf.replace("0.001", "0.1"), "documents")
    got = packing.best_fit(docs)
    bins = got.select("shard", "bin").distinct().count()
    rows = docs.select(F.octet_length(F.coalesce("text", F.lit(""))).alias("n"), "doc_id", "source", F.xxhash64("text").alias("c")).collect()
    rows.sort(key=lambda r: (-(r.n + 1 - r.n // packing.CAPACITY * packing.CAPACITY), r.doc_id))
    left = [r.n + 1 - r.n // packing.CAPACITY * packing.CAPACITY for r in rows]
    numbers, _ = packing.pack(left, packing.bitmaps([r.source for r in rows], [r.c for r in rows]), packing.CAPACITY)
    one_shard = max(numbers) + 1 + sum(r.n // packing.CAPACITY for r in rows)
    assert bins <= 1.002 * one_shard


def test_hot_source_and_odd_rows(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text"), F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("source"))
    rows = packing.best_fit(docs, capacity=300)
    assert rows.count() == 4000
    together = rows.join(docs, "doc_id").groupBy("shard", "bin").agg(F.sum(F.when(F.col("source") == "hot", 1).otherwise(0)).alias("hot"), F.sum("length").alias("used"), (F.count("*") - F.countDistinct("text")).alias("copies"))
    assert tuple(together.agg(F.max("hot"), F.max("used") <= 300, F.max("copies")).first()) == (1, True, 0)
    odd = spark.createDataFrame([(1, None, None, 0), (1, None, None, 0), (None, "y" * 100_000, "s", 0), (3, "", "s", 0)], "doc_id bigint, text string, source string, length int")
    got = packing.best_fit(odd).collect()
    assert sum(r.length for r in got if r.doc_id is None) == 100_001 and sorted(r.doc_id for r in got if r.doc_id is not None) == [1, 1, 3]
    assert len({(r.shard, r.bin) for r in got if r.doc_id is not None}) == 3
    assert packing.best_fit(odd.limit(0)).count() == 0
