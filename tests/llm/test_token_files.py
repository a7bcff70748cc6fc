import zlib

import numpy as np
from tokenizers import Tokenizer

from tidemark.llm import token_files
from tidemark.llm.bpe import VOCABULARY
from tidemark.llm.common import table
from tidemark.llm.pretokens import pretokens
from tidemark.session import scratch_path


def test_code_round_trip():
    rng = np.random.default_rng(8)
    for n in (0, 1, 3, 4, 5, 1000):
        ranks = (rng.integers(0, 1 << 32, n, dtype=np.uint64) >> rng.integers(0, 32, n).astype(np.uint64)).astype(np.uint32)
        control, data = token_files.pack(ranks)
        assert len(control) == -(-n // 4)
        assert token_files.unpack(control, data, n).tolist() == ranks.tolist()
    assert len(token_files.pack(np.array([0, 255, 256, 65536], np.uint32))[1]) == 1 + 1 + 2 + 3


def test_files_of_documents(spark, sf):
    docs = table(spark, sf, "documents")
    library = Tokenizer.from_file(VOCABULARY)
    out = scratch_path(spark, "test-tokens")
    token_files.write(docs.repartition(5), out)
    got = token_files.read(spark, out).collect()
    start, want = 0, []
    for row in docs.orderBy("doc_id").collect():
        ids = np.array([*library.encode(row.text or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((row.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in got) == want
    names = [f.split("part-")[1][:5] for f in spark.read.parquet(f"{out}/documents").inputFiles()]
    stored = [r.doc_id for n in sorted(names) for r in spark.read.parquet(f"{out}/documents/part-{n}*").collect()]
    assert stored == sorted(stored)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(7, "b b", 0), (7, "b b", 0), (None, "x", 0), (2, None, 0), (1, "a<|endoftext|>", 0)], "doc_id bigint, text string, tokens int")
    out = scratch_path(spark, "test-tokens")
    token_files.write(docs, out)
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in token_files.read(spark, out).collect())
    assert got == [(0, None, 2), (2, 1, 3), (5, 2, 1), (6, 7, 3), (9, 7, 3)]
    out = scratch_path(spark, "test-tokens")
    token_files.write(docs.limit(0), out)
    assert token_files.read(spark, out).count() == 0


def test_words_together_are_encoded_as_alone():
    library = Tokenizer.from_file(VOCABULARY)
    text = " the 12 !? <|the\n\n   x's don't é 日本 ́x\t |> endoftext ½" + "".join(f" {'ab' * i} {i}" for i in range(1, 2500))
    words = pretokens([text])[0].unique().to_pylist()
    coded = token_files.encode_words(VOCABULARY, words, {})
    assert [np.frombuffer(c, "<u4").tolist() for c in coded] == [library.encode(w.decode(), add_special_tokens=False).ids for w in words]
