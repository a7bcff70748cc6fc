"""Language-model scoring by context-tree weighting, beside a unigram word baseline.

Texts are sequences of tokens: lower-cased (A-Z) words cut at ASCII blanks, then one end. The model codes the bytes of
each word and one blank, and one line feed for the end, so it and the baseline give probabilities to the same things.

The context tree has the last DEPTH symbols as contexts. A byte is coded as a class of six bits (the 62 most frequent
bytes of the training text, the line feed, and one class for all others, in which the byte itself follows), each bit by
its own tree. Every node holds a Krichevsky-Trofimov estimate of its bit; a node's block probability is half its own
estimate and half the product of its children, which gives the weights with which all depths are mixed. Contexts up to
three symbols have nodes of their own. The deepest contexts are dealt into BUCKETS nodes by a hash, which keeps the
table below a fixed size whatever the corpus: contexts that share a bucket share its counts (their block probability
counts for each by its share of the rows), and the probabilities still add up to one.

What is counted grows with the corpus: every task counts its own contexts and words, and the counts are added up by
Spark. Words are looked up for chunks of text: the distinct words of a chunk meet the counts in an equi-join, and the
answers come back to their chunk. Only the finished tables are broadcast, of at most 2 ** 18 contexts and BUCKETS rows.

Cases: a null text is the empty text, whose only token is the end. Without training rows every baseline token has
probability one, and the model gives each bit one half. Repeated rows and null ids give a row each; an empty table
gives none; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import col, slices
from tidemark.session import durable

DEPTH = 4
BITS = 6
CLASSES = 1 << BITS
OTHER = CLASSES - 1  # class of the bytes without a class of their own
BUCKET_BITS = 18
BUCKETS = 1 << BUCKET_BITS
SPREAD = 2654435761  # an odd multiplier; the high bits of the product choose the bucket
CHUNK = 16 << 20  # bytes of text whose words are looked up together
STEP = 1 << 16  # positions scored at a time
ROWS = 1 << 12  # contexts whose tables the driver works on at a time
END, BLANK = b"\n", b" "


def tokens(text: str | None) -> list[bytes]:
    """Words with their blank, then the end."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, the six ASCII blanks
    return [*[w + BLANK for w in words], END]


def chunks(docs: DataFrame, learns: Column, doc_id: str, text: str) -> DataFrame:
    """Stored chunks of documents: their tokens as numbers of the distinct tokens of the chunk, compressed."""
    rows = docs.select(col(doc_id).alias("doc_id"), learns.alias("learns"), col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, number = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []
        for piece in slices(batches, 2, CHUNK // 4):
            held.append(piece)
            if sum(p.column(2).nbytes for p in held) >= CHUNK:
                yield _chunk(held, f"{where}-{number}")
                held, number = [], number + 1
        if held:
            yield _chunk(held, f"{where}-{number}")

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"chunk string, ids array<{kind}>, learns array<boolean>, lengths array<int>, tokens binary, words array<binary>, counts array<bigint>, bytes binary"
    return durable(rows.mapInArrow(run, schema))


def _chunk(pieces: list[pa.RecordBatch], name: str) -> pa.RecordBatch:
    numbers: dict[bytes, int] = {}
    flat, lengths, learning = [], [], []
    for piece in pieces:
        for learns, text in zip(piece.column(1).to_pylist(), piece.column(2).to_pylist(), strict=True):
            words = tokens(text)
            for w in words:
                if w not in numbers:
                    numbers[w] = len(numbers)
            flat.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
            lengths.append(len(words))
            learning.append(bool(learns))
    all_tokens = np.concatenate(flat)
    counts = np.bincount(all_tokens[np.repeat(learning, lengths)], minlength=len(numbers))
    words = list(numbers)
    weight = np.repeat(counts, [len(w) for w in words])
    histogram = np.bincount(np.frombuffer(b"".join(words), np.uint8), weight, 256).astype("<i8")
    ids = pa.concat_arrays([p.column(0) for p in pieces])
    columns = {
        "chunk": pa.array([name]),
        "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
        "learns": pa.array([learning], pa.list_(pa.bool_())),
        "lengths": pa.array([lengths], pa.list_(pa.int32())),
        "tokens": pa.array([zstandard.compress(all_tokens.astype("<i4").tobytes())], pa.binary()),
        "words": pa.array([words], pa.list_(pa.binary())),
        "counts": pa.array([counts.tolist()], pa.list_(pa.int64())),
        "bytes": pa.array([histogram.tobytes()], pa.binary()),
    }
    return pa.RecordBatch.from_pydict(columns)


def classes_of(histogram: np.ndarray) -> np.ndarray:
    """The class of each byte: 0 for the line feed, then the most frequent ones, then OTHER."""
    out = np.full(256, OTHER, np.uint8)
    order = [b for b in np.argsort(-histogram, kind="stable").tolist() if b != END[0] and histogram[b]]
    for i, b in enumerate(order[: OTHER - 1]):
        out[b] = i + 1
    out[END[0]] = 0
    return out


def coded(words: list[bytes], numbers: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of documents one after another, DEPTH line feeds before each, and which document each byte belongs to (-1 there)."""
    parts, sizes, at = [], [], 0
    for n in lengths.tolist():
        data = b"".join(map(words.__getitem__, numbers[at : at + n].tolist()))
        parts += [END * DEPTH, data]
        sizes.append(len(data))
        at += n
    owner = np.full(sum(sizes) + DEPTH * len(sizes), -1, np.int64)
    ends = np.cumsum(np.array(sizes, np.int64) + DEPTH)
    for k, (end, size) in enumerate(zip(ends.tolist(), sizes, strict=True)):
        owner[end - size : end] = k
    return np.frombuffer(b"".join(parts), np.uint8), owner


def grams(symbols: np.ndarray) -> np.ndarray:
    """For each position from DEPTH on: the classes of the last DEPTH symbols and its own, six bits each."""
    wide = symbols.astype(np.uint32)
    n = len(wide) - DEPTH
    out = wide[:n].copy()
    for k in range(1, DEPTH + 1):
        out = out << np.uint32(BITS) | wide[k : k + n]
    return out


def documents_of(row: dict, budget: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of documents of about `budget` tokens: first, last + 1, their tokens and their lengths."""
    numbers, lengths = np.frombuffer(zstandard.decompress(row["tokens"]), "<i4"), np.array(row["lengths"], np.int64)
    ends = np.cumsum(lengths)
    first = 0
    while first < len(lengths):
        start = int(ends[first] - lengths[first])
        last = max(first + 1, int(np.searchsorted(ends, start + budget, side="right")))
        yield first, last, numbers[start : int(ends[last - 1])], lengths[first:last]
        first = last


def count_contexts(stored: DataFrame, class_of: np.ndarray) -> DataFrame:
    """(gram, n): how often each class follows each context in the training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                learns = np.array(row["learns"], bool)
                for first, last, numbers, lengths in documents_of(row, 200_000):
                    taken = learns[first:last]
                    data, owner = coded(row["words"], numbers[np.repeat(taken, lengths)], lengths[taken])
                    if len(data):
                        new, n = np.unique(grams(class_of[data])[owner[DEPTH:] >= 0], return_counts=True)
                        keys, inverse = np.unique(np.concatenate([keys, new]), return_inverse=True)
                        counts = np.bincount(inverse, np.concatenate([counts, n]), len(keys)).astype(np.int64)
        if len(keys):
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), pa.array(counts)], ["gram", "n"])

    parts = stored.select("learns", "lengths", "tokens", "words").mapInArrow(run, "gram int, n bigint")
    return parts.groupBy("gram").agg(F.sum("n").alias("n"))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after seven steps up; good to 1e-12 for x >= 0.5."""
    x = np.asarray(x, np.float64)
    product = np.ones_like(x)
    for k in range(7):
        product *= x + k
    z = x + 7
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - np.log(product)


def nodes(symbol_counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per context: zeros and ones of the binary nodes 1 .. CLASSES - 1 (column 0 is not used)."""
    heap = np.zeros((len(symbol_counts), 2 * CLASSES))
    heap[:, CLASSES:] = symbol_counts
    for i in range(CLASSES - 1, 0, -1):
        heap[:, i] = heap[:, 2 * i] + heap[:, 2 * i + 1]
    zeros, ones = heap[:, 0::2].copy(), heap[:, 1::2].copy()
    zeros[:, 0] = ones[:, 0] = 0
    return zeros, ones


def log_block(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of a block with so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1) - np.log(np.pi)


def estimates(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per context and node: logarithm of the block probability, and the estimate of a one. Some rows at a time."""
    block, one = np.empty((len(counts), CLASSES)), np.empty((len(counts), CLASSES))
    for at in range(0, len(counts), ROWS):
        zeros, ones = nodes(counts[at : at + ROWS])
        block[at : at + ROWS] = log_block(zeros, ones)
        one[at : at + ROWS] = (ones + 0.5) / (zeros + ones + 1)
    return block, one


@dataclass
class Tree:
    """Probability of a one at each binary node: base[row3] + rest[row3] * deep[row4]."""

    class_of: np.ndarray
    row3: np.ndarray  # context of three symbols to its row
    base: np.ndarray
    rest: np.ndarray
    row4: np.ndarray  # bucket to its row
    deep: np.ndarray
    log_other: np.ndarray  # log10 probability of each byte within its class

    def score(self, data: np.ndarray) -> np.ndarray:
        """log10 probability of each byte from position DEPTH on."""
        every = grams(self.class_of[data])
        out = self.log_other[data[DEPTH:]]
        for at in range(0, len(every), STEP):
            gram = every[at : at + STEP].astype(np.int64)
            symbol, context = gram & OTHER, gram >> BITS
            shallow = self.row3[context & (CLASSES**3 - 1)].astype(np.int64) * CLASSES
            bottom = self.row4[bucket(context)].astype(np.int64) * CLASSES
            node = np.ones(len(gram), np.int64)
            chance = np.ones(len(gram))
            for shift in range(BITS - 1, -1, -1):
                bit = symbol >> shift & 1
                one = self.base[shallow + node] + self.rest[shallow + node] * self.deep[bottom + node]
                chance *= np.where(bit == 1, one, 1 - one)
                node = 2 * node + bit
            out[at : at + STEP] += np.log10(chance)
        return out


def bucket(context: np.ndarray) -> np.ndarray:
    return (context * SPREAD & 0xFFFFFFFF) >> (32 - BUCKET_BITS)


def dense(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From (context, class) cells: the contexts and their counts by class."""
    contexts, row = np.unique(keys >> BITS, return_inverse=True)
    counts = np.zeros((len(contexts), CLASSES))
    np.add.at(counts, (row, keys & OTHER), n)
    return contexts, counts


def build(cells3: np.ndarray, n3: np.ndarray, cells4: np.ndarray, n4: np.ndarray, contexts4: np.ndarray, total4: np.ndarray, class_of: np.ndarray, histogram: np.ndarray) -> Tree:
    """Weights from the leaves up, then the mixture of depths 0 to 3 from the root down."""
    buckets, counts4 = dense(cells4, n4)
    log_w4, deep = estimates(counts4)
    deep = np.concatenate([deep, np.full((1, CLASSES), 0.5)])  # last row: a bucket without counts
    in_bucket = counts4.sum(axis=1)
    del counts4
    row4 = np.full(BUCKETS, len(buckets), np.int32)
    row4[buckets] = np.arange(len(buckets))

    contexts, counts = [None] * 4, [None] * 4
    contexts[3], counts[3] = dense(cells3, n3)
    for d in (2, 1, 0):
        contexts[d], row = np.unique(contexts[d + 1] & (CLASSES**d - 1), return_inverse=True)
        counts[d] = np.zeros((len(contexts[d]), CLASSES))
        np.add.at(counts[d], row, counts[d + 1])

    own_row = row4[bucket(contexts4)]
    share = total4 / in_bucket[own_row] if len(contexts4) else np.zeros(0)
    below = np.zeros((len(contexts[3]), CLASSES))
    parent = np.searchsorted(contexts[3], contexts4 & (CLASSES**3 - 1))
    for at in range(0, len(contexts4), ROWS):
        part = slice(at, at + ROWS)
        np.add.at(below, parent[part], log_w4[own_row[part]] * share[part, None])
    del log_w4
    weight, estimate = [None] * 4, [None] * 4
    for d in (3, 2, 1, 0):
        own, estimate[d] = estimates(counts[d])
        block = np.logaddexp(own, below) - np.log(2)
        weight[d] = np.exp(own - np.log(2) - block)
        if d:
            below = np.zeros((len(contexts[d - 1]), CLASSES))
            np.add.at(below, np.searchsorted(contexts[d - 1], contexts[d] & (CLASSES ** (d - 1) - 1)), block)

    # Rows: contexts of three symbols that were seen, then for the others their longest seen end, of two, one, none.
    base, rest = np.zeros((1, CLASSES)), np.ones((1, CLASSES))
    bases, rests, number = [np.full((1, CLASSES), 0.5)], [np.zeros((1, CLASSES))], 1  # row 0: nothing was seen at all
    every = np.arange(CLASSES**3)
    row3 = np.zeros(CLASSES**3, np.int32)
    for d in range(4):
        if not len(contexts[d]):
            break
        if d:
            up = np.searchsorted(contexts[d - 1], contexts[d] & (CLASSES ** (d - 1) - 1))
            base, rest = base[up], rest[up]
        base, rest = base + rest * weight[d] * estimate[d], rest * (1 - weight[d])
        end = every & (CLASSES**d - 1)
        at = np.minimum(np.searchsorted(contexts[d], end), len(contexts[d]) - 1)
        row3 = np.where(contexts[d][at] == end, number + at, row3).astype(np.int32)
        bases.append(base if d == 3 else base + rest / 2)  # below a context that was never seen, each bit has one half
        rests.append(rest if d == 3 else np.zeros_like(rest))
        number += len(contexts[d])
    inside = np.where(class_of == OTHER, histogram + 0.5, 1.0)
    log_other = np.where(class_of == OTHER, np.log10(inside / max(inside[class_of == OTHER].sum(), 1e-300)), 0.0)
    return Tree(class_of, row3, np.concatenate(bases).ravel(), np.concatenate(rests).ravel(), row4, deep.ravel(), log_other)


def train(stored: DataFrame) -> Tree:
    """The tree of the training texts of stored chunks."""

    def histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                total += np.frombuffer(data, "<i8")
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(total)], ["byte", "n"])

    histogram = np.zeros(256)
    for row in stored.select("bytes").mapInArrow(histograms, "byte bigint, n bigint").groupBy("byte").agg(F.sum("n").alias("n")).collect():  # 256 rows
        histogram[row.byte] = row.n
    class_of = classes_of(histogram)
    counted = durable(count_contexts(stored, class_of))
    context = F.shiftright("gram", BITS).cast("long")
    into = F.shiftright((context * SPREAD).bitwiseAND(F.lit(0xFFFFFFFF)), 32 - BUCKET_BITS)
    kind = F.col("gram").bitwiseAND(OTHER)

    def cells(key: Column) -> tuple[np.ndarray, np.ndarray]:
        """At most 2 ** 24 cells, whatever the corpus."""
        table = counted.groupBy(key.cast("long").alias("cell")).agg(F.sum("n").alias("n")).toArrow()
        return table.column("cell").to_numpy(), table.column("n").to_numpy()

    contexts4, total4 = cells(context)
    return build(*cells(F.col("gram").bitwiseAND(CLASSES**4 - 1)), *cells(into * CLASSES + kind), contexts4, total4, class_of, histogram)


def score(docs: DataFrame, learns: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For every row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. `learns` marks the training rows."""
    stored = chunks(docs, learns, doc_id, text)
    seen = stored.select("chunk", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "pair")).select("chunk", "place", F.col("pair.words").alias("word"), F.col("pair.counts").alias("n"))
    counts = durable(seen.groupBy("word").agg(F.sum("n").alias("c")))
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum((F.col("c") > 0).cast("long")), F.lit(0))).first()
    found = seen.select("chunk", "place", "word").join(counts, "word").select(F.col("chunk").alias("of"), "place", "c")
    tree = docs.sparkSession.sparkContext.broadcast(train(stored))  # bounded by the classes and BUCKETS

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, rows = [], {"held_out": [], "n_tokens": [], "n_known": [], "train_tokens": [], "base_score": [], "score": []}
        for k in range(left.num_rows):
            row = {c: left.column(c)[k].as_py() for c in ("learns", "lengths", "tokens", "words")}
            ids.append(left.column("ids").combine_chunks()[k].values)
            known = np.zeros(len(row["words"]), np.int64)
            known[right.column("place").to_numpy()] = right.column("c").to_numpy()
            logs = np.log10((known + 1) / (total + distinct + 1))
            for first, last, numbers, lengths in documents_of(row, 200_000):
                starts = np.cumsum(lengths) - lengths
                rows["held_out"] += [not x for x in row["learns"][first:last]]
                rows["n_tokens"] += lengths.tolist()
                rows["n_known"] += np.add.reduceat((known[numbers] > 0).astype(np.int64), starts).tolist()
                rows["base_score"] += np.add.reduceat(logs[numbers], starts).tolist()
                data, owner = coded(row["words"], numbers, lengths)
                inside = owner[DEPTH:] >= 0
                rows["score"] += np.bincount(owner[DEPTH:][inside], tree.value.score(data)[inside], len(lengths)).tolist()
        rows["train_tokens"] = [total] * len(rows["score"])
        return pa.table({"doc_id": pa.concat_arrays(ids)} | rows)

    id_kind = docs.select(col(doc_id)).schema[0].dataType.simpleString()
    schema = f"doc_id {id_kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    texts = stored.select("chunk", "ids", "learns", "lengths", "tokens", "words")
    return texts.groupBy("chunk").cogroup(found.groupBy("of")).applyInArrow(run, schema)
