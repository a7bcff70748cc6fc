"""Ranked lexical search turned round: the items are the index, the documents stream through it.

The items to search for become an inverted index, from each term to the items that hold it, and are broadcast in
blocks of about BLOCK bytes of text, however many items there are. One pass over the documents keeps, for each of
them, its length and the counts of those of its terms that any item holds. From that table come the number of
documents, the number of terms and the document frequencies; then each document's counts run through the index, the
scores of its items add up, and every task keeps the best `k` documents of each item. Tasks return these at most, and
they are merged item by item. No document meets a document, and no posting list of a frequent term is ever gathered.

Scores are whole numbers of 64 bits, so order of addition cannot matter.

Cases: null and empty texts (or those without a term) are no documents; as items they find nothing. Texts of any length
are read whole, a slice at a time. Rows that repeat a doc_id are documents of their own, and so are rows that repeat an
item. Equal scores go by ascending doc_id, documents without id last. Empty tables give no rows. Other columns, also
ones with names that are used here, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import col, slices
from tidemark.session import durable

BLOCK = 8 << 20  # bytes of item text in one broadcast
SLICE = 8 << 20  # bytes of text handled at a time
CELLS = 1 << 21  # scores held at a time
STEPS = 1 << 21  # additions done at a time
NO_ID = np.iinfo(np.int64).max

# A-Z become a-z, every other ASCII character that is no letter or digit a blank. Bytes of other characters stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Items:
    """Inverted index of one block of items."""

    def __init__(self, ids: list, texts: list[str | None]) -> None:
        self.ids = ids
        self.numbers: dict[bytes, int] = {}
        holders: list[list[int]] = []
        for item, text in enumerate(texts):
            for term in sorted(set(terms(text))):
                number = self.numbers.setdefault(term, len(holders))
                if number == len(holders):
                    holders.append([])
                holders[number].append(item)
        self.sizes = np.array([len(h) for h in holders], np.int64)
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.items = np.array([i for h in holders for i in h], np.int64)


def term_counts(docs: DataFrame, index, doc_id: str, text: str) -> DataFrame:
    """(id, length, terms, counts) of every document with a term: how often it holds each term of the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = index.value.numbers
        for batch in slices(batches, 1, SLICE):
            words = [terms(t) for t in batch.column(1).to_pylist()]
            length = np.fromiter(map(len, words), np.int64, len(words))
            found = np.fromiter((n for w in words for n in map(numbers.get, w, repeat(-1))), np.int64, int(length.sum()))
            owner = np.repeat(np.arange(len(words)), length)[found >= 0]
            pair, count = np.unique(owner * max(len(numbers), 1) + found[found >= 0], return_counts=True)
            owner, found = np.divmod(pair, max(len(numbers), 1))
            ends = np.searchsorted(owner, np.arange(len(words) + 1)).astype("<i4") * 4
            held = [pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(v.astype("<u4").tobytes())]) for v in (found, count)]
            rows = pa.RecordBatch.from_arrays([batch.column(0).fill_null(NO_ID), pa.array(length), *held], ["id", "length", "terms", "counts"])
            yield rows.filter(pa.array(length > 0))

    return docs.select(col(doc_id).cast("long").alias("id"), col(text).cast("string").alias("text")).mapInArrow(
        run, "id bigint, length bigint, terms binary, counts binary"
    )


def _flat(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").astype(np.int64)


def document_frequencies(counted: DataFrame, n_terms: int) -> np.ndarray:
    """How many documents hold each term of the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(n_terms, np.int64)
        for batch in batches:
            held += np.bincount(_flat(batch.column(0)), minlength=n_terms)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], ["term", "df"])

    # One row for each term of a block of items at most.
    found = counted.select("terms").mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(n_terms, np.int64)
    out[found.column("term").to_numpy()] = found.column("df").to_numpy()
    return out


class Best:
    """The `k` best documents of each item so far: highest score first, then smallest id."""

    def __init__(self, n_items: int, k: int) -> None:
        self.k = k
        self.item, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.zeros(n_items, np.int64)  # score of the k-th document of an item, 0 while there are fewer
        self.last = np.full(n_items, -1, np.int64)  # and its id

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        """`scores` by document and item."""
        better = (scores > self.least) | ((scores == self.least) & (ids[:, None] < self.last) & (scores > 0))
        row, item = np.nonzero(better)
        if not len(row):
            return
        item = np.concatenate([self.item, item])
        score = np.concatenate([self.score, scores[better]])
        ids = np.concatenate([self.id, ids[row]])
        order = np.lexsort((ids, -score, item))
        item, score, ids = item[order], score[order], ids[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        kept = place < self.k
        full = place == self.k - 1
        self.least[item[full]], self.last[item[full]] = score[full], ids[full]
        self.item, self.score, self.id = item[kept], score[kept], ids[kept]


def best_documents(counted: DataFrame, index, weights: np.ndarray, n_docs: int, n_terms: int, k: int, b: int) -> DataFrame:
    """(item, id, score): for each task, its `k` best documents of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = index.value
        n_items = len(items.ids)
        best = Best(n_items, k)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            norm = np.array([100 - b + b * n * n_docs // n_terms for n in batch.column(1).to_pylist()], np.int64)
            size = np.diff(np.frombuffer(batch.column(2).buffers()[1], "<i4")[batch.column(2).offset :][: len(ids) + 1]) // 4
            owner = np.repeat(np.arange(len(ids)), size)
            found, tf = _flat(batch.column(2)), _flat(batch.column(3))
            value = weights[found] * (1000000000 * tf // (1000 * tf + 8 * norm[owner]))
            steps = np.r_[0, np.cumsum(np.bincount(owner, weights=items.sizes[found], minlength=len(ids)).astype(np.int64))]
            ends = np.searchsorted(owner, np.arange(len(ids) + 1))
            start = 0
            while start < len(ids):
                stop = int(np.searchsorted(steps, steps[start] + STEPS, side="right")) - 1
                stop = max(start + 1, min(stop, start + max(1, CELLS // n_items)))
                part = slice(ends[start], ends[stop])
                held = items.sizes[found[part]]
                offset = np.arange(int(held.sum())) - np.repeat(np.cumsum(held) - held, held)
                item = items.items[np.repeat(items.begin[found[part]], held) + offset]
                scores = np.zeros((stop - start) * n_items, np.int64)
                np.add.at(scores, np.repeat(owner[part] - start, held) * n_items + item, np.repeat(value[part], held))
                best.add(ids[start:stop], scores.reshape(-1, n_items))
                start = stop
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (best.item, best.id, best.score)], ["item", "id", "score"])

    return counted.mapInArrow(run, "item bigint, id bigint, score bigint")


def _search_block(docs: DataFrame, ids: list, texts: list, kind: str, k: int, b: int, doc_id: str, text: str) -> DataFrame | None:
    spark = docs.sparkSession
    items = Items(ids, texts)
    if not items.numbers:
        return None
    index = spark.sparkContext.broadcast(items)  # about BLOCK bytes of text
    counted = durable(term_counts(docs, index, doc_id, text))
    n_docs, n_terms = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    if not n_docs:
        return None
    df = document_frequencies(counted, len(items.numbers))
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    found = best_documents(counted, index, weights, n_docs, n_terms, k, b)
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "id"))
    ranked = found.withColumn("rank", place).filter(F.col("rank") <= k)
    names = spark.createDataFrame(list(enumerate(ids)), f"item bigint, item_id {kind}")  # one row for each item of the block
    return ranked.join(F.broadcast(names), "item").select(
        "item_id", "rank", F.when(F.col("id") != F.lit(int(NO_ID)), F.col("id")).alias("doc_id"), "score"
    )


def search(docs: DataFrame, items: DataFrame, k: int = 10, b: int = 90, doc_id: str = "doc_id", text: str = "text",
           item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the `k` best documents for each row of `items`. `b` is the weight of the length, of 100."""
    kind = items.schema[item_id].dataType.simpleString()
    asked = items.select(col(item_id).alias("id"), col(item_text).cast("string").alias("text")).filter("text IS NOT NULL")
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    blocks = -(-size // BLOCK)
    of_block = F.pmod(F.xxhash64("id", "text"), F.lit(max(blocks, 1)))
    found = []
    for block in range(blocks):
        rows = asked.filter(of_block == block).orderBy("id", "text").collect()  # BLOCK bytes on average
        part = _search_block(docs, [r.id for r in rows], [r.text for r in rows], kind, k, b, doc_id, text)
        found += [part] if part is not None else []
    if found:
        return reduce(DataFrame.union, found)
    return docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
