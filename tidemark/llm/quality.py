"""Quality classifier: a byte-level convolutional network in numpy.

A text is cut into overlapping chunks of two blocks of BLOCK bytes, one block apart, the last one filled up with zeros.
Learned filters see the learned embedding of each byte of a chunk and how far the chunk repeats itself (the largest
share of its bytes that equal the byte some fixed distance before, over all distances up to LAGS). Each filter takes
its maximum over all chunks of the text; these maxima are combined into one probability. Every byte of every text is
scored; texts lie one after another in one buffer, so long and short ones cost the same for each byte.

Training draws FIT_ROWS labelled rows by the hash of their id and learns from whole texts up to FIT_BYTES bytes in all: in
the order of the draw, very long texts last, passing over a text that does not fit. These are the only bounds, and they
do not touch scoring.

Cases: null and empty texts are scored as one chunk of zeros. Without labels every score is 0.5, with labels of one
kind every score is that label. Repeated rows and null ids give a row each (null ids never learn); an empty table gives
none; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import col, slices

FIT_ROWS = 3000
FIT_BYTES = 10 << 20
FIT_SHARE = 64  # texts over FIT_BYTES / FIT_SHARE come after all others
BLOCK, WIDTH, FILTERS, LAGS = 16, 6, 24, 32
GAP = LAGS // BLOCK  # blocks of zeros between texts, so that no byte looks back into the text before
EPOCHS, BATCH, RATE, DECAY = 10, 32, 0.01, 1e-4
SLICE = 2 << 20


def laid_out(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes in blocks; the first block of each chunk; the first chunk of each text."""
    coded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.fromiter(map(len, coded), np.int64, len(coded))
    chunks = np.maximum(1, -(-sizes // BLOCK) - 1)
    begins = GAP + np.cumsum(chunks + 1 + GAP) - (chunks + 1 + GAP)
    total = GAP + int((chunks + 1 + GAP).sum())
    blocks = np.zeros(total * BLOCK, np.uint8)
    for data, at in zip(coded, (begins * BLOCK).tolist(), strict=True):
        blocks[at : at + len(data)] = np.frombuffer(data, np.uint8)
    firsts = np.cumsum(chunks) - chunks
    start = np.repeat(begins - firsts, chunks) + np.arange(int(chunks.sum()))
    return blocks.reshape(-1, BLOCK), start, firsts


def repetition(blocks: np.ndarray) -> np.ndarray:
    """For each block and the next: the largest share of bytes that equal the byte a fixed distance before."""
    flat, best = blocks.ravel(), np.zeros(len(blocks) - 1, np.uint8)
    for lag in range(1, LAGS + 1):
        same = np.zeros(len(flat), bool)
        same[lag:] = (flat[lag:] == flat[:-lag]) & (flat[lag:] > 0)
        count = np.bitwise_count(np.packbits(same).view(np.uint16))
        np.maximum(best, count[:-1] + count[1:], out=best)
    return np.r_[best / np.float32(2 * BLOCK), np.float32(0)].astype(np.float32)


@dataclass
class Network:
    embedding: np.ndarray  # 256 x WIDTH
    filters: np.ndarray  # 2 blocks x (BLOCK * WIDTH) x FILTERS
    repeats: np.ndarray  # weight of the repetition for each filter
    bias: np.ndarray
    mix: np.ndarray
    offset: float

    def maxima(self, blocks: np.ndarray, start: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Largest response of each filter in each text, the responses of all chunks, and the repetition of each."""
        seen = self.embedding[blocks].reshape(len(blocks), -1)
        both = seen @ np.concatenate(list(self.filters), axis=1)
        again = repetition(blocks)[start]
        response = both[start, :FILTERS] + both[start + 1, FILTERS:] + again[:, None] * self.repeats + self.bias
        return np.maximum.reduceat(response, firsts, axis=0), response, again

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        top = self.maxima(*laid_out(texts))[0]
        return 1 / (1 + np.exp(-np.clip(np.tanh(top).astype(np.float64) @ self.mix + self.offset, -60, 60)))


def train(texts: list[str], labels: np.ndarray) -> Network:
    """Gradient steps (Adam) on the log loss of whole texts."""
    rng = np.random.default_rng(5)
    shape = BLOCK * WIDTH
    slope = np.repeat(rng.normal(0, 0.3, (1, WIDTH, FILTERS)), 2 * BLOCK, axis=0).reshape(2, shape, FILTERS) / BLOCK
    net = Network(
        rng.normal(0, 0.5, (256, WIDTH)).astype(np.float32),
        (slope + rng.normal(0, 0.02, slope.shape)).astype(np.float32),
        rng.normal(0, 0.5, FILTERS).astype(np.float32),
        np.zeros(FILTERS, np.float32),
        rng.normal(0, 0.3, FILTERS),
        0.0,
    )
    share = labels.mean() if len(labels) else 0.5
    if len(labels) == 0 or share in (0.0, 1.0):
        net.mix[:] = 0
        net.offset = float("inf") * (1 if share == 1 else -1) if share in (0.0, 1.0) and len(labels) else 0.0
        return net
    net.offset = float(np.log(share / (1 - share)))
    names = ("embedding", "filters", "repeats", "bias", "mix", "offset")
    first = {k: np.zeros_like(np.asarray(getattr(net, k), np.float64)) for k in names}
    second = {k: v.copy() for k, v in first.items()}
    sizes = np.array([len(t) for t in texts])
    steps = 0
    for epoch in range(EPOCHS):
        order = np.argsort(sizes + rng.normal(0, 400, len(texts)), kind="stable")  # texts of like length together
        batches = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
        rate = RATE * (1 - epoch / EPOCHS)
        for k in rng.permutation(len(batches)).tolist():
            chosen = batches[k]
            blocks, start, firsts = laid_out([texts[i] for i in chosen])
            top, response, again = net.maxima(blocks, start, firsts)
            ends = np.r_[firsts[1:], len(start)]
            where = np.stack([a + response[a:b].argmax(axis=0) for a, b in zip(firsts, ends, strict=True)])
            hidden = np.tanh(top)
            error = 1 / (1 + np.exp(-np.clip(hidden @ net.mix + net.offset, -60, 60))) - labels[chosen]
            down = (error[:, None] * net.mix * (1 - hidden**2) / len(chosen)).astype(np.float32)
            grad = {"mix": hidden.T @ error / len(chosen), "offset": error.mean(), "bias": down.sum(axis=0), "repeats": (down * again[where]).sum(axis=0)}
            grad["embedding"] = np.zeros((256, WIDTH))
            grad["filters"] = np.zeros_like(net.filters)
            for half in (0, 1):
                data = blocks[start[where] + half]  # text x filter x BLOCK bytes
                grad["filters"][half] = np.einsum("tf,tfw->wf", down, net.embedding[data].reshape(*where.shape, -1))
                back = (down[:, :, None] * net.filters[half].T).reshape(-1, WIDTH)  # one row for each byte of data
                for w in range(WIDTH):
                    grad["embedding"][:, w] += np.bincount(data.ravel(), back[:, w], 256)
            steps += 1
            for name in names:
                value = np.asarray(getattr(net, name), np.float64)
                g = np.asarray(grad[name], np.float64) + (DECAY * value if name in ("filters", "mix") else 0)
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g**2
                step = rate * (first[name] / (1 - 0.9**steps)) / (np.sqrt(second[name] / (1 - 0.999**steps)) + 1e-8)
                new = value - step
                setattr(net, name, float(new) if name == "offset" else new.astype(np.asarray(getattr(net, name)).dtype))
    return net


def fit(docs: DataFrame, labels: DataFrame, learns: Column, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Network:
    """Train on the labelled rows of `docs` for which `learns` (a condition on the label rows) holds."""
    draw = F.xxhash64(col(doc_id).cast("string"), F.lit("quality"))
    marked = labels.filter(learns).select(col(doc_id).alias("__id"), col(label).cast("double").alias("__label"), draw.alias("__draw"))
    chosen = marked.filter("__label IN (0, 1) AND __id IS NOT NULL").orderBy("__draw", "__id", "__label").limit(FIT_ROWS)
    rows = docs.select(col(doc_id).alias("__id"), F.coalesce(col(text).cast("string"), F.lit("")).alias("__text")).join(F.broadcast(chosen), "__id")
    bytes_ = F.octet_length("__text")
    rows = rows.filter(bytes_ <= FIT_BYTES).withColumn("__long", bytes_ > FIT_BYTES // FIT_SHARE)
    texts: list[str] = []
    values: list[float] = []
    held = 0
    for row in rows.orderBy("__long", "__draw", "__id", "__label").toLocalIterator():
        size = len(row["__text"].encode())
        if held + size <= FIT_BYTES:  # one that does not fit is passed over
            held += size
            texts.append(row["__text"])
            values.append(row["__label"])
    return train(texts, np.array(values))


def score(docs: DataFrame, net: Network, text: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """The columns `keep` of every row, with its score."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a fixed number of weights
    rows = docs.select(col(text).cast("string").alias("text"), F.struct(*keep).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0, SLICE):
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(shared.value.score(batch.column(0).to_pylist()))], ["row", "score"])

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, score double").select("row.*", "score")
