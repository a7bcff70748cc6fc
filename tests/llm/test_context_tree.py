import math
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import context_tree as ct
from tidemark.llm.common import remainder, table


def slow_tokens(text):
    return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def slow_base(rows, learns):
    counts = Counter()
    for i, t in rows:
        if learns(i):
            counts.update([*slow_tokens(t), None])
    n, v = sum(counts.values()), len(counts)
    return n, {i: (sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in [*slow_tokens(t), None]), sum(counts[w] > 0 for w in [*slow_tokens(t), None])) for i, t in rows}


class SlowTree:
    """Context-tree weighting by recursion over exact contexts, one bit at a time."""

    def __init__(self, texts):
        data = [b"".join(ct.tokens(t)) for t in texts]
        histogram = np.bincount(np.frombuffer(b"".join(data), np.uint8), minlength=256)
        self.class_of = ct.classes_of(histogram)
        self.counts = defaultdict(lambda: [0, 0])
        self.children = defaultdict(set)
        for d in data:
            symbols = [0] * ct.DEPTH + self.class_of[np.frombuffer(d, np.uint8)].tolist()
            for i in range(ct.DEPTH, len(symbols)):
                for depth in range(ct.DEPTH + 1):
                    context, node = tuple(symbols[i - depth : i]), 1
                    for shift in range(ct.BITS - 1, -1, -1):
                        bit = symbols[i] >> shift & 1
                        self.counts[context, node][bit] += 1
                        if depth < ct.DEPTH:
                            self.children[context, node].add(tuple(symbols[i - depth - 1 : i]))
                        node = 2 * node + bit
        self.memo = {}
        inside = {b: histogram[b] + 0.5 for b in range(256) if self.class_of[b] == ct.OTHER}
        self.other = {b: x / sum(inside.values()) for b, x in inside.items()}

    def block(self, context, node):
        key = context, node
        if key not in self.memo:
            a, b = self.counts[key]
            own = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
            if len(context) == ct.DEPTH:
                self.memo[key] = own, own
            else:
                self.memo[key] = own, np.logaddexp(own, sum(self.block(c, node)[1] for c in self.children[key])) - math.log(2)
        return self.memo[key]

    def one(self, context, node):
        """Probability of a one, mixed from the deepest context up."""
        p = 0.5
        for depth in range(ct.DEPTH, -1, -1):
            c = context[len(context) - depth :]
            if (c, node) not in self.counts:
                continue
            a, b = self.counts[c, node]
            own, block = self.block(c, node)
            share = 1.0 if depth == ct.DEPTH else math.exp(own - math.log(2) - block)
            p = share * (b + 0.5) / (a + b + 1) + (1 - share) * p
        return p

    def score(self, text):
        d = b"".join(ct.tokens(text))
        symbols, total = [0] * ct.DEPTH + self.class_of[np.frombuffer(d, np.uint8)].tolist(), 0.0
        for i, byte in zip(range(ct.DEPTH, len(symbols)), d, strict=True):
            node = 1
            for shift in range(ct.BITS - 1, -1, -1):
                bit, p = symbols[i] >> shift & 1, self.one(tuple(symbols[i - ct.DEPTH : i]), node)
                total += math.log10(p if bit else 1 - p)
                node = 2 * node + bit
            if symbols[i] == ct.OTHER:
                total += math.log10(self.other[byte])
        return total


TEXTS = ["the cat sat on the mat", "The dog sat", "", None, "a b a b abba", "über ÄÖ the", "the the the end", "x" * 40]


def test_against_recursion(spark):
    docs = spark.createDataFrame([(i, t, 0.0) for i, t in enumerate(TEXTS)] + [(2, "", 0.0), (None, "zzz new", 1.0)], "doc_id bigint, text string, score double").repartition(3)
    got = ct.score(docs, F.coalesce(F.col("doc_id") < 6, F.lit(False))).collect()
    slow = SlowTree([*TEXTS[:6], ""])
    n, base = slow_base([*enumerate(TEXTS), (2.0, ""), (9, "zzz new")], lambda i: i < 6)
    assert len(got) == 10
    for r in got:
        text = TEXTS[r.doc_id] if r.doc_id is not None else "zzz new"
        assert r.train_tokens == n and r.n_tokens == len(slow_tokens(text)) + 1
        want, known = base[9 if r.doc_id is None else r.doc_id]
        assert abs(r.base_score - want) < 1e-9 and r.n_known == known
        assert r.held_out == (r.doc_id is None or r.doc_id >= 6)
        assert abs(r.score - slow.score(text)) < 1e-6 * max(1, abs(r.score))


def test_probabilities_add_up():
    rng = np.random.default_rng(0)
    histogram = np.arange(256)  # every class has a byte
    class_of = ct.classes_of(histogram)
    data = rng.integers(0, 256, 3000, dtype=np.uint8) % np.uint8(97)
    grams, counts = np.unique(ct.grams(class_of[data]).astype(np.int64), return_counts=True)
    cells4 = ct.bucket(grams >> ct.BITS) << ct.BITS | grams & ct.OTHER
    contexts, row = np.unique(grams >> ct.BITS, return_inverse=True)
    tree = ct.build(grams & (ct.CLASSES**4 - 1), counts, cells4, counts, contexts, np.bincount(row, counts), class_of, histogram)
    for at in (0, 100, 2000):
        seen, strange = data[at : at + 4].tobytes(), rng.integers(0, 256, 4, dtype=np.uint8).tobytes()
        for context in (seen, strange, strange[:3] + seen[3:], strange[:2] + seen[2:]):
            each = [tree.score(np.frombuffer(context + bytes([b]), np.uint8))[0] for b in range(256)]
            assert abs((10 ** np.array(each)).sum() - 1) < 1e-9


def test_documents(spark, sf):
    docs = table(spark, sf, "documents")
    rows = ct.score(docs, remainder("doc_id", 7) != 2).collect()
    import zlib

    n, base = slow_base(docs.select("doc_id", "text").collect(), lambda i: zlib.crc32(str(i).encode()) % 7 != 2)
    assert len(rows) == len(base)
    for r in rows:
        assert r.train_tokens == n and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert abs(r.base_score - base[r.doc_id][0]) < 1e-6 and r.n_known == base[r.doc_id][1] and r.score < 0
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > 1.25 * sum(r.base_score for r in held)  # close to a word model that knows all its words
    assert ct.score(docs.limit(0), F.lit(True)).count() == 0
    assert [r.base_score for r in ct.score(docs.limit(3), F.lit(False)).collect()] == [0.0, 0.0, 0.0]
