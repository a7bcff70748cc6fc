import math
import re

from tidemark.llm import lexical


def brute(docs, items, k=10, b=90):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    held = [(i, cut(t)) for i, t in docs]
    held = [(i, w) for i, w in held if w]
    n_docs, n_terms = len(held), sum(len(w) for _, w in held)
    out = []
    for item, text in items:
        rows = []
        for i, words in held:
            score = 0
            for term in set(cut(text)):
                tf, df = words.count(term), sum(term in w for _, w in held)
                m = 100 - b + b * len(words) * n_docs // n_terms
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * (1000000000 * tf // (1000 * tf + 8 * m))
            if score > 0:
                rows.append((-score, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(rows, key=lambda r: r[:2] + (r[2] or 0,))[:k], 1)]
    return sorted(out, key=str)


DOCS = [(1, "The cat sat. the CAT!"), (2, "a dog, a cat\nand a mouse"), (3, None), (4, ""), (5, "!!! --"), (6, "Ärger über Straße 42"), (7, "ärger Ärger"), (None, "cat mouse"),
        (9, "cat mouse"), (8, "cat mouse"), (8, "cat mouse"), (10, "x" * 50_000 + " cat " + "filler words " * 60_000), (11, "語 日本 cat_1")]
ITEMS = [(1, "the cat and the mouse"), (2, None), (3, "nothing like it"), (4, "Ärger 42"), (5, ""), (5, "dog"), (6, "cat"), (None, "日本 1"), (7, "x" * 50_000)]


def run(spark, docs, items, **how):
    docs = spark.createDataFrame([(i, t, 7, "n") for i, t in docs], "doc_id bigint, text string, score int, item_id string").repartition(3)
    items = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, doc_id int")
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in lexical.search(docs, items, **how).collect()), key=str)


def test_against_brute_force(spark):
    assert run(spark, DOCS, ITEMS) == brute(DOCS, ITEMS)
    assert run(spark, DOCS, ITEMS, k=2, b=40) == brute(DOCS, ITEMS, 2, 40)


def test_small_blocks_and_steps_change_nothing(spark, monkeypatch):
    want = run(spark, DOCS, ITEMS)
    monkeypatch.setattr(lexical, "BLOCK", 40)
    assert run(spark, DOCS, ITEMS[:5]) == brute(DOCS, ITEMS[:5])
    monkeypatch.undo()
    monkeypatch.setattr(lexical, "STEPS", 2)
    monkeypatch.setattr(lexical, "CELLS", 3)
    monkeypatch.setattr(lexical, "SLICE", 16)
    assert run(spark, DOCS, ITEMS) == want


def test_many_equal_scores(spark):
    docs = [(i, "hot line") for i in range(900, 0, -1)] + [(i, f"word{i} line") for i in range(1000, 1500)]
    assert run(spark, docs, [(1, "hot")]) == [(1, r, r, s) for (_, r, _, s) in run(spark, docs, [(1, "hot")])]
    assert run(spark, docs, [(1, "hot line word1200")]) == brute(docs, [(1, "hot line word1200")])


def test_empty_tables(spark):
    assert run(spark, [], ITEMS) == [] and run(spark, DOCS, []) == [] and run(spark, DOCS, [(1, "!!")]) == []
