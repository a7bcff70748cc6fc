"""Token ids in binary files: frequency-ranked ids in a byte-aligned code of variable length.

All ids of the corpus are counted and ranked by their count, so the most frequent 256 take one byte. A rank is stored
in one to four data bytes; the lengths, two bits each, lie apart in control bytes, four to a byte. A file is Parquet
with one row for each document in ascending doc_id order: doc_id, tokens, control, data, the number of the file and the
tokens before the row in its file. Decoding looks the lengths up in a table by control byte and gathers the data bytes,
all in numpy. The ranking is a file of its own beside them.

Texts are encoded by the tokenizers library, each different pre-token once in a worker.

Cases: null and empty texts hold the end id alone. Ids that tie in count are ranked by id. Rows repeated with one
doc_id are written one after another, shorter first, in the order of their ids as bytes; their starts follow that
order. A null doc_id comes first. An empty table gives empty files and no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from tidemark.llm.bpe import VOCABULARY, encode_texts, forget, remembered, vocabulary
from tidemark.llm.common import col, slices
from tidemark.session import scratch_path

END_ID = 0
SLICE = 2 << 20  # bytes of ids coded at a time
TEXTS = 8 << 20  # bytes of text encoded at a time: a word that recurs in them is looked up once
TOGETHER = 2000  # words that the library encodes in one text
#: Lengths of the four codes of each control byte.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1


@functools.cache
def library(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


def encode_new(path: str, words: list[bytes], known: dict[bytes, bytes]) -> None:
    """Let the library encode words.

    Words that begin with a blank and a sign are written in one text: the library cuts it into just these words.
    """
    texts = [w.decode("utf-8", "surrogatepass") for w in words]
    together = [len(t) > 1 and t[0] == " " and not t[1].isspace() for t in texts]
    joint = list(itertools.compress(range(len(words)), together))
    parts = [joint[at : at + TOGETHER] for at in range(0, len(joint), TOGETHER)]
    token_bytes = vocabulary(path).sizes
    for part, coded in zip(parts, library(path).encode_batch_fast(["".join([texts[i] for i in p]) for p in parts], add_special_tokens=False), strict=True):
        ids = np.array(coded.ids, "<u4")
        reached = np.cumsum(token_bytes[ids])
        wanted = np.cumsum([len(words[i]) for i in part])
        ends = np.searchsorted(reached, wanted)
        if not np.array_equal(reached[np.minimum(ends, len(ids) - 1)], wanted):
            raise ValueError("the library cuts pre-tokens in another way")
        data, ends = ids.tobytes(), (4 * (ends + 1)).tolist()
        known.update(zip([words[i] for i in part], (data[a:b] for a, b in zip([0, *ends], ends, strict=False)), strict=True))
    others = [i for i, joins in enumerate(together) if not joins]
    for i, coded in zip(others, library(path).encode_batch_fast([texts[i] for i in others], add_special_tokens=False), strict=True):
        known[words[i]] = np.array(coded.ids, "<u4").tobytes()


def encode_words(path: str, words: list[bytes], known: dict[bytes, bytes]) -> list[bytes]:
    """The ids of each of these different words by the library; `known` remembers."""
    encode_new(path, [w for w in words if w not in known], known)
    out = [known[w] for w in words]
    forget(known)
    return out


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of a sequence of ranks below 2 ** 32."""
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    padded[: len(ranks)] = size - 1
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    spread = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control.tobytes(), spread[np.arange(4) < size[:, None]].tobytes()


def unpack(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The ranks again."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:count]
    spread = np.zeros((count, 4), np.uint8)
    spread[np.arange(4) < size[:, None]] = np.frombuffer(data, np.uint8)
    return spread.view("<u4").ravel()


def write(docs: DataFrame, out: str, doc_id: str = "doc_id", text: str = "text", path: str = VOCABULARY, end_id: int = END_ID) -> None:
    """Encode every row and write `out`/ranking and `out`/documents."""
    rows = docs.select(col(doc_id).alias("doc_id"), col(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    vocabulary_size = max(len(vocabulary(path).bytes), end_id + 1)
    narrow = "<u2" if vocabulary_size <= 1 << 16 else "<u4"
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, known = vocabulary(path), remembered(f"library {path}")
        counts, ids_of = np.zeros(vocabulary_size, np.int64), None
        for batch in slices(batches, 1, TEXTS):
            ids = [np.frombuffer(i + end, "<u4") for i in encode_texts(vocab, batch.column(1).to_pylist(), functools.partial(encode_words, path), known)]
            counts += np.bincount(np.concatenate(ids), minlength=vocabulary_size)
            ids_of = batch.schema.field(0).type
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([i.astype(narrow).tobytes() for i in ids], pa.binary()), pa.nulls(len(ids), pa.binary())], ["doc_id", "ids", "counts"])
        if ids_of is not None:  # one more row for each task, with what it counted
            yield pa.RecordBatch.from_pydict({"doc_id": pa.nulls(1, ids_of), "ids": pa.nulls(1, pa.binary()), "counts": pa.array([counts.tobytes()], pa.binary())})

    spark, kept = docs.sparkSession, scratch_path(docs.sparkSession, "ids")
    rows.mapInArrow(encode, f"doc_id {kind}, ids binary, counts binary").write.option("compression", "zstd").parquet(kept)
    encoded = spark.read.parquet(kept)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for counts in batch.column(0).to_pylist():
                n = np.frombuffer(counts, np.int64)
                used = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used])], ["id", "n"])

    # One row for each id of the vocabulary at most.
    total = encoded.filter("counts IS NOT NULL").select("counts").mapInArrow(counted, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    total.coalesce(1).write.parquet(f"{out}/ranking")
    by_rank = ranking(spark, out)
    rank_of = np.zeros(vocabulary_size, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, total = TaskContext.get().partitionId(), 0
        for batch in slices(batches, 1, SLICE):
            ids = [np.frombuffer(i, narrow) for i in batch.column(1).to_pylist()]
            packed = [pack(rank_of[i]) for i in ids]
            tokens = np.array([len(i) for i in ids], np.int64)
            before = total + np.cumsum(tokens) - tokens
            total += int(tokens.sum())
            columns = [pa.array(tokens), pa.array([c for c, _ in packed], pa.binary()), pa.array([d for _, d in packed], pa.binary()), pa.array(np.full(len(ids), number, np.int32)), pa.array(before)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "tokens", "control", "data", "file", "before"])

    length = F.octet_length("ids")
    ordered = encoded.filter("ids IS NOT NULL").select("doc_id", "ids").repartitionByRange("doc_id", length).sortWithinPartitions("doc_id", length, "ids")
    written = ordered.mapInArrow(code, f"doc_id {kind}, tokens bigint, control binary, data binary, file int, before bigint")
    written.write.option("compression", "zstd").parquet(f"{out}/documents")


def ranking(spark: SparkSession, out: str) -> np.ndarray:
    """Ids in the order of their ranks; as many as the vocabulary has at most."""
    rows = spark.read.parquet(f"{out}/ranking").toPandas()
    return rows.sort_values(["n", "id"], ascending=[False, True])["id"].to_numpy(np.int64)


def read(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document: ids as little-endian 32-bit integers."""
    by_rank = ranking(spark, out).astype("<u4")
    files = spark.read.parquet(f"{out}/documents")
    totals = files.groupBy("file").agg(F.sum("tokens").alias("total"))
    # One row for each file.
    offsets = totals.select("file", (F.sum("total").over(Window.orderBy("file")) - F.col("total")).alias("offset"))
    placed = files.join(F.broadcast(offsets), "file").select("doc_id", (F.col("offset") + F.col("before")).alias("start"), "tokens", "control", "data")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4, SLICE):
            coded = zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True)
            ids = [by_rank[unpack(control, data, n)].tobytes() for n, control, data in coded]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return placed.mapInArrow(decode, f"doc_id {files.schema['doc_id'].dataType.simpleString()}, start bigint, n_tokens bigint, ids binary")
