from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import common_lines
from tidemark.llm.common_lines import PerfectHash, drop_common_lines

BLANKS = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def brute(rows, min_docs, min_chars):
    held = Counter(k for _, t in rows for k in {key(line) for line in (t or "").split("\n")})
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [line for line in lines if len(key(line)) < min_chars or held[key(line)] < min_docs]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


def odd_rows():
    rows = [(i, f"Shared HEADER \n own line {i}\n\n\tshared footer\x0b\nÄ only here {i % 7}") for i in range(30)]
    rows += [(100 + i, "copy of one text\nwith two lines") for i in range(40)]
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, "  SHARED header"), (None, "shared header\r\nx"), (None, None), (100, "copy of one text\nwith two lines")]
    rows += [(300, "ab\n" * 50_000 + "shared footer\n" + "long " * 100_000), (301, "ab\nÄÖ\nä"), (302, "AB"), (303, " ab"), (304, "Shared header ")]
    return rows


def result(spark, rows, **how):
    # columns whose names clash with those used inside
    docs = spark.createDataFrame([(i, t, 1, "k", 2.0) for i, t in rows], "doc_id bigint, text string, N_LINES int, text_key string, `__salt` double").repartition(5)
    left, n_lines, n_dropped = drop_common_lines(docs, **how)
    assert left.columns == [*docs.columns, n_lines, n_dropped] and (n_lines, n_dropped) == ("_n_lines", "n_dropped")
    assert {tuple(r) for r in left.select("N_LINES", "text_key", "__salt").distinct().collect()} <= {(1, "k", 2.0)}
    return sorted(((r.doc_id, r[n_lines], r[n_dropped], r.text) for r in left.collect()), key=str)


@pytest.mark.parametrize(("min_docs", "min_chars"), [(10, 1), (2, 3), (31, 1), (300, 1)])
def test_against_brute_force(spark, min_docs, min_chars):
    assert result(spark, odd_rows(), min_docs=min_docs, min_chars=min_chars) == brute(odd_rows(), min_docs, min_chars)


def test_busy_shards_answer_in_parts(spark, monkeypatch):
    for name, value in (("PROBES", 8), ("SHARD_KEYS", 4), ("LEAST_SHARDS", 1), ("SMALL_ANSWER", 1), ("SLICE", 64)):
        monkeypatch.setattr(common_lines, name, value)
    rows = [r for r in odd_rows() if r[0] != 300]
    assert result(spark, rows, min_docs=10) == brute(rows, 10, 1)


def test_empty_table(spark):
    assert result(spark, []) == []
    assert result(spark, [(1, None)]) == [(1, 1, 0, "")]


def test_a_hot_line_in_every_document(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("Hot\nline "), F.col("id") % 3900).alias("text"))
    left, n_lines, n_dropped = drop_common_lines(docs.repartition(8), min_docs=2)
    assert left.agg(F.sum(n_lines), F.sum(n_dropped), F.count("*")).first()[:] == (8000, 4000 + 200, 4000)
    assert left.filter("text = concat('line ', doc_id % 3900)").count() == 3800 and left.filter("text = ''").count() == 200


def test_perfect_hash_numbers_are_one_to_one():
    rng = np.random.default_rng(3)
    both = np.unique(rng.integers(0, 2**63, (50_000, 2), dtype=np.int64).view(np.uint64), axis=0)
    hard = np.array([[i, i] for i in range(9)], np.uint64)  # one place on every level
    for keys in (both, both[:1], both[:0], np.concatenate([both, hard])):
        numbers = PerfectHash.of(keys)
        assert sorted(numbers.number(keys).tolist()) == list(range(len(keys)))
    assert numbers.bits.size / len(keys) < 3.2
    stored = PerfectHash(numbers.sizes, numbers.words, numbers.rest)
    assert np.array_equal(stored.number(keys), numbers.number(keys))
