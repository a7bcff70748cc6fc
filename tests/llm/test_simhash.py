import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import simhash
from tidemark.llm.common import table


def slow_fingerprint(text):
    words, word = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\x0b\x0c\r":
            words, word = words + [word] if word else words, ""
        else:
            word += c.lower() if "A" <= c <= "Z" else c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows):
    """rows: (id, unsigned fingerprint)."""
    label = {i: i for i, _ in rows}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in rows:
        for j, b in rows:
            if i < j and (a ^ b).bit_count() <= 4:
                x, y = sorted((root(i), root(j)))
                label[y] = x
    return {i: root(i) for i in label}


def test_fingerprints(spark):
    texts = ["", None, "One", "a b c", "a b c d", "É é A\tb\x0bC  d\r\ne\x1cf", "x " * 50_000, "w1 w2 w3 w4 w5 w6 w7", " \n "]
    for t in texts:
        assert simhash.fingerprint(t) % 2**64 == slow_fingerprint(t)
    hashed = spark.createDataFrame([("a b c d",)], "s string").select(F.xxhash64("s")).first()[0]
    assert simhash.fingerprint("A b C d") == hashed


def test_links_of_planted_fingerprints(spark):
    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(300)]
    for k in range(300):
        base = fps[rng.randrange(len(fps))]
        for b in rng.sample(range(64), rng.randrange(1, 7)):
            base ^= 1 << b
        fps.append(base)
    rows = [(k, f) for k, f in enumerate(dict.fromkeys(fps))]
    frame = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for _, f in rows], "fp bigint")
    found = [(a % 2**64, b % 2**64) for a, b in simhash.links(frame).distinct().collect()]
    assert all((a ^ b).bit_count() <= 64 for a, b in found)
    index = {f: k for k, f in rows}
    want = slow_components(rows)
    got = {k: k for k, _ in rows}

    def root(x):
        while got[x] != x:
            x = got[x]
        return x

    for a, b in found:
        x, y = sorted((root(index[a]), root(index[b])))
        got[y] = x
    assert {k: root(k) for k in got} == want


def test_components_of_documents(spark, sf):
    docs = table(spark, sf, "documents")
    rows = simhash.components(docs).collect()
    texts = dict(docs.select("doc_id", "text").collect())
    fps = {i: slow_fingerprint(t) if len(t) < 6000 else simhash.fingerprint(t) % 2**64 for i, t in texts.items()}
    want = slow_components(sorted(fps.items()))
    assert {r.doc_id: (r.fp % 2**64, r.component_id) for r in rows} == {i: (f, want[i]) for i, f in fps.items()}


def test_edge_cases(spark):
    docs = spark.createDataFrame([(5, None, 1), (3, "", 2), (9, "p q r s t", 3), (8, "P Q r s t", 4), (8, "P Q r s t", 4), (None, "p q r s t", 5)], "doc_id bigint, text string, fp int")
    got = {(r.doc_id, r.component_id) for r in simhash.components(docs).collect()}
    assert got == {(5, 3), (3, 3), (9, 8), (8, 8), (None, 8)}
    left = simhash.one_of_each(docs)
    assert left.columns == docs.columns and sorted((r.doc_id or 0, r.fp) for r in left.collect()) == [(0, 5), (3, 2), (8, 4), (8, 4)]
    assert simhash.components(docs.limit(0)).count() == 0


def test_parts_shrink_as_their_number_grows(spark, monkeypatch):
    rng = random.Random(4)
    fps = [rng.getrandbits(64) for _ in range(4000)]
    fps += [f ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for f in fps[:500]]
    fps += [fps[0] ^ 1 << i ^ 1 << j for i in range(64) for j in range(i)]  # a hot group of distinct fingerprints
    frame = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in set(fps)], "fp bigint").cache()
    monkeypatch.setattr(simhash, "PART_ROWS", 60)
    bits = simhash.part_bits_for(frame, 2)
    reached = np.unique(simhash.classes(simhash.ball(2), simhash.groups_of_bits(bits)))
    assert bits > 12 and len(reached) < 0.02 * 2**bits
    assert len(np.unique(simhash.classes(simhash.ball(2), simhash.groups_of_bits(8)))) == 37
    monkeypatch.setattr(simhash, "PART_BITS", range(8, 9))
    monkeypatch.setattr(simhash, "ROUND", 1 << 14)
    label = {f: f for f in set(fps)}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in simhash.links(frame).distinct().collect():
        x, y = sorted((root(a % 2**64), root(b % 2**64)))
        label[y] = x
    assert all(root(f) == root(fps[0]) for f in fps[4500:])
    assert all(root(a) == root(b) for a, b in zip(fps[:500], fps[4000:4500], strict=True))
    assert len({root(f) for f in label}) == 4000
