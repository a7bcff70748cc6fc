import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import langid
from tidemark.llm.common import remainder, table


def folded(text):
    out = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    return " ".join(out.split())


def longest_pieces(sample, text):
    """Pieces of a greedy parse of `text` into the longest substrings of `sample`, anew after each stretch."""
    count = 0
    for at in range(0, len(text), langid.STRETCH):
        part, i = text[at : at + langid.STRETCH], 0
        while i < len(part):
            j = i + 1
            while j <= len(part) and part[i:j] in sample:
                j += 1
            i, count = max(j - 1, i + 1), count + 1
    return count


def test_pieces_against_brute_force():
    rng = random.Random(5)
    sample = {"aa": ["".join(rng.choice("abcd ") for _ in range(300)), "abba"], "bb": ["".join(rng.choice("abce  ") for _ in range(200))]}
    model = langid.learn({k: [langid.folded([t])[0] for t in v] for k, v in sample.items()})
    joined = {k: "".join(folded(t) + " " for t in v) for k, v in sample.items()}
    texts = ["".join(rng.choice("abcdez .1\n") for _ in range(rng.randrange(0, 80))) for _ in range(200)] + ["ab" * 3000, "", "é" * 2100]
    counts, lengths = langid.pieces(model, texts)
    for k, text in enumerate(texts):
        assert lengths[k] == len(folded(text))
        assert counts[k].tolist() == [longest_pieces(joined[x], folded(text)) for x in ("aa", "bb")]


def test_languages_of_very_many_letters():
    rng = random.Random(3)
    letters = [chr(0x4E00 + i) for i in range(3000)]
    words = ["".join(rng.choices(letters, k=2)) for _ in range(4000)]
    texts = ["".join(rng.choice(words) for _ in range(100)) for _ in range(120)]
    sample = {"aa": ["".join(rng.choice("abcd ") for _ in range(3000))], "zz": texts[:100]}
    model = langid.learn({k: [langid.folded([t])[0] for t in v] for k, v in sample.items()})
    joined = {k: "".join(folded(t) + " " for t in v) for k, v in sample.items()}
    asked = [*texts[100:], "ab" + texts[0][:50] + "ca d", "\u3042" * 5 + texts[1]]
    counts, _ = langid.pieces(model, asked)
    assert counts.tolist() == [[longest_pieces(joined[x], folded(t)) for x in ("aa", "zz")] for t in asked]
    names, _, mean, usual, _ = langid.predict(model, texts[100:])
    assert set(names) == {"zz"} and (mean > 0.6 * usual).all()


def test_sixty_languages_of_alphabets_of_their_own():
    rng = random.Random(4)
    sample = {f"l{i:02}": ["".join(rng.choice([chr(0x4E00 + 30 * i + j) for j in range(30)]) for _ in range(9000))] for i in range(60)}
    model = langid.learn({k: [langid.folded([t])[0] for t in v] for k, v in sample.items()})
    names = langid.predict(model, [v[0][:40] for v in sample.values()])[0]
    assert names == model.languages and len(names) == 60
    assert sum(a.nbytes for a in (model.table, model.listed, model.targets, model.local, model.anew)) < 220 << 20


def test_special_texts():
    model = langid.learn({"x": [langid.folded(["one two three"])[0]]})
    names, score, *_ = langid.predict(model, [None, "", "12 !", "two", "Ünknown"])
    assert names == ["und", "und", "und", "x", "x"] and score.tolist() == [0, 0, 0, 1, 1]
    nothing = langid.learn({})
    assert langid.predict(nothing, ["a", None])[0] == ["und", "und"]
    assert np.all(langid.predict(nothing, ["a"])[1] == 0)


def test_held_out_accuracy(spark, sf):
    docs = table(spark, sf.replace("0.001", "0.01"), "documents")
    held_out = remainder("doc_id", 3) == 1
    model = langid.fit(docs.filter(~held_out))
    rows = langid.identify(docs, model, keep=[F.col("doc_id"), F.col("lang"), held_out.alias("held_out")])
    assert rows.count() == docs.count()
    got = rows.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert got[0] > 0.98 and 0 <= got[1] and got[2] <= 1


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "ein haus", "de", 1.0), (1, "ein haus", "de", 1.0), (None, "a house", "en", 2.0), (4, None, None, 3.0)], "doc_id bigint, text string, lang string, score double")
    rows = langid.identify(docs, langid.fit(docs), keep=[F.col("doc_id")]).collect()
    assert sorted((r.doc_id or 0, r.lang_pred) for r in rows) == [(0, "en"), (1, "de"), (1, "de"), (4, "und")]
    assert langid.identify(docs.limit(0), langid.fit(docs.limit(0)), keep=[F.col("doc_id")]).count() == 0
