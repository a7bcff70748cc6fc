import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import quality
from tidemark.llm.common import remainder, table


def slow_score(net, text):
    data = (text or "").encode()
    chunks = max(1, -(-len(data) // quality.BLOCK) - 1)
    padded = np.frombuffer(data.ljust((chunks + 1) * quality.BLOCK, b"\0"), np.uint8)
    best = np.full(quality.FILTERS, -np.inf)
    for c in range(chunks):
        lo, hi = c * quality.BLOCK, (c + 2) * quality.BLOCK
        again = max(sum(1 for i in range(lo, hi) if i >= g and padded[i] and padded[i] == padded[i - g]) for g in range(1, quality.LAGS + 1)) / (hi - lo)
        seen = net.embedding[padded[lo:hi]].reshape(2, -1)
        best = np.maximum(best, seen[0] @ net.filters[0] + seen[1] @ net.filters[1] + again * net.repeats + net.bias)
    return 1 / (1 + np.exp(-(np.tanh(best) @ net.mix + net.offset)))


def test_scores_against_plain_loop():
    rng = np.random.default_rng(2)
    texts = ["", "a", "word " * 30, "x" * 31, "y" * 32, "z" * 33, "the quick brown fox !! " * 9 + "é\0\0\0"]
    net = quality.train(["good text here", "BAD!! TEXT!!", "fine words", "BAD!! NO!!"] * 10, np.array([1, 0, 1, 0] * 10))
    texts += ["".join(map(chr, rng.integers(32, 300, rng.integers(1, 200)))) for _ in range(20)]
    assert np.allclose(net.score(texts), [slow_score(net, t) for t in texts], atol=1e-5)
    assert np.allclose(net.score([None]), net.score([""]))


def test_labels_of_one_kind_and_none():
    assert quality.train([], np.array([])).score(["a", ""]).tolist() == [0.5, 0.5]
    assert quality.train(["a", "b"], np.array([1, 1])).score(["a"])[0] > 0.999
    assert quality.train(["a", "b"], np.array([0, 0])).score(["a"])[0] < 0.001


def test_held_out_accuracy(spark, sf):
    where = sf.replace("0.001", "0.1")
    docs, labels = table(spark, where, "documents"), table(spark, where, "labels")
    held_out = remainder("doc_id", 5) == 0
    net = quality.fit(docs, labels, ~held_out)
    judged = docs.join(labels.filter(held_out), "doc_id")
    rows = quality.score(judged, net, keep=[F.col("doc_id"), F.col("quality")]).select("quality", (F.col("score") >= 0.3).alias("kept")).collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert np.mean(good) > 0.995 and np.mean(bad) < 0.15


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "ok", 0), (1, "ok", 0), (None, None, 0), (2, "", 0)], "doc_id bigint, text string, score int")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (None, 1), (3, None)], "doc_id bigint, quality int")
    net = quality.fit(docs, labels, F.lit(True))
    assert quality.score(docs, net, keep=[F.col("doc_id")]).count() == 4
    assert quality.score(docs.limit(0), quality.fit(docs.limit(0), labels.limit(0), F.lit(True)), keep=[F.col("doc_id")]).count() == 0


def test_very_long_labelled_texts_do_not_crowd_out_others(spark, monkeypatch):
    length = F.when(F.col("id") % 3 == 0, 11 << 20).when(F.col("id") % 3 == 1, 9 << 20).otherwise(40)
    docs = spark.range(12).select(F.col("id").alias("doc_id"), F.repeat(F.lit("y"), length.cast("int")).alias("text"))
    labels = spark.range(12).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("quality"))
    learned = []
    monkeypatch.setattr(quality, "train", lambda texts, values: learned.extend(zip(map(len, texts), values, strict=True)))
    quality.fit(docs, labels, F.lit(True))
    assert sorted(n for n, _ in learned) == [40] * 4 + [9 << 20] and {v for n, v in learned if n == 40} == {0, 1}
