"""Best-fit packing of documents into training sequences, under conflicts.

A document of n bytes takes n + 1 places (an end mark). Whole sequences are cut off a document longer than CAPACITY
and fill bins of their own; what is left over, or a whole shorter document, is an item. Items go, largest first, into
the bin with the least room that still holds them and conflicts with none of its items: two items conflict when they
are of one source or copies of one text. Without such a bin a new one is opened.

Items are dealt into shards of about SHARD_ITEMS by the hash of their id and their place among the stored items, so a hot
source, a large group of copies or many rows with one id or none spread evenly, and each shard is packed in one task. A shard keeps its bins in a tree over their room. Each bin
carries bitmaps of its sources and its clusters; each node of the tree carries what all bins below have in common, so
the search for the next bin in order passes over whole subtrees that conflict, until the tightest compatible bin.

Cases: a null or empty text is an item of one place. Items without a source conflict with none for that. Of equal
sizes the smaller id comes first; rows that repeat an id are items of their own, and as copies they never share a bin.
Null ids come last. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import col
from tidemark.session import durable

CAPACITY = 8192
SHARD_ITEMS = 8192


class Bins:
    """Bins in order of their room, with a tree over the rooms 0 .. capacity."""

    def __init__(self, capacity: int) -> None:
        self.width = 1 << capacity.bit_length()
        self.common = [-1] * (2 * self.width)  # bits that all bins below share; -1 (all bits): no bin below
        self.at: dict[int, list[tuple[int, int]]] = {}  # room to its bins (bitmap, number), oldest first

    def _refresh(self, room: int) -> None:
        shared = -1
        for bits, _ in self.at.get(room, ()):
            shared &= bits
        k = room + self.width
        self.common[k] = shared
        while k > 1:
            k >>= 1
            self.common[k] = self.common[2 * k] & self.common[2 * k + 1]

    def _open(self, k: int, item: int) -> bool:
        """Whether a bin below node k may take the item."""
        return self.common[k] != -1 and not self.common[k] & item

    def tightest(self, size: int, item: int) -> int | None:
        """Least room of at least `size` with a bin that shares no bit with `item`."""
        k = size + self.width
        while True:
            if self._open(k, item):
                while k < self.width:
                    k = 2 * k if self._open(2 * k, item) else 2 * k + 1
                    if not self._open(k, item):
                        break
                if k >= self.width and any(not bits & item for bits, _ in self.at.get(k - self.width, ())):
                    return k - self.width
            while k & 1:  # on to the next subtree on the right
                k >>= 1
            if not k:
                return None
            k += 1

    def take(self, room: int, item: int) -> tuple[int, int]:
        """Remove the oldest bin of that room without conflict: its bits and its number."""
        bins = self.at[room]
        place = next(i for i, (bits, _) in enumerate(bins) if not bits & item)
        out = bins.pop(place)
        if not bins:
            del self.at[room]
        self._refresh(room)
        return out

    def put(self, room: int, bits: int, number: int) -> None:
        self.at.setdefault(room, []).append((bits, number))
        self._refresh(room)


def bitmaps(sources: Iterable[str | None], clusters: Iterable[int]) -> list[int]:
    """One bit for the source and, where the shard has more copies of the text, one for the cluster."""
    sources, clusters = list(sources), list(clusters)
    values, counts = np.unique(np.array(clusters, np.int64), return_counts=True)
    bit = {("source", s): 1 << i for i, s in enumerate(sorted({s for s in sources if s is not None}))}
    known = len(bit)
    bit |= {("cluster", c): 1 << (known + i) for i, c in enumerate(values[counts > 1].tolist())}
    return [bit.get(("source", s), 0) | bit.get(("cluster", c), 0) for s, c in zip(sources, clusters, strict=True)]


def pack(sizes: list[int], items: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each item; the items come in packing order."""
    bins, used, out, offsets = Bins(capacity), 0, [], []
    for size, item in zip(sizes, items, strict=True):
        room = bins.tightest(size, item)
        if room is None:
            bits, number, room = 0, used, capacity
            used += 1
        else:
            bits, number = bins.take(room, item)
        out.append(number)
        offsets.append(capacity - room)
        bins.put(room - size, bits | item, number)
    return out, offsets


def best_fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, shard, bin, position, length: where each piece of each document lies.

    `position` counts places from the start of the bin. Pieces of a document are numbered from 0; all but the last fill
    their bins. Bins are numbered in each shard, those of whole pieces first.
    """
    content = F.coalesce(col(text).cast("string"), F.lit(""))
    rows = docs.select(col(doc_id).alias("doc_id"), col(source).cast("string").alias("source"), (F.octet_length(content) + 1).alias("size"), F.xxhash64(content).alias("cluster"))
    rows = durable(rows.withColumn("place", F.monotonically_increasing_id()))  # stored: a repeated task deals alike
    shards = max(1, -(-rows.count() // SHARD_ITEMS))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "place", F.lit("shard")), F.lit(shards)).cast("int")).drop("place")

    def run(table: pa.Table) -> pa.Table:
        size = table.column("size").to_numpy().astype(np.int64)
        ids = table.column("doc_id").combine_chunks()
        whole = (size - 1) // capacity  # full pieces; the last one is never empty
        left = size - whole * capacity
        by_id = np.empty(len(ids), np.int64)
        by_id[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
        cluster = table.column("cluster").to_numpy()
        order = np.lexsort((cluster, by_id, -left))
        sources = table.column("source").to_pylist()
        bits = bitmaps([sources[i] for i in order], cluster[order])
        number, offset = pack(left[order].tolist(), bits, capacity)
        full = np.repeat(np.arange(len(ids)), whole)
        piece = np.arange(len(full)) - np.repeat(np.cumsum(whole) - whole, whole)
        row = np.concatenate([full, order])
        return pa.table(
            {
                "doc_id": ids.take(pa.array(row)),
                "piece": pa.array(np.concatenate([piece, whole[order]]), pa.int64()),
                "shard": pa.array(np.full(len(row), table.column("shard")[0].as_py()), pa.int32()),
                "bin": pa.array(np.concatenate([np.arange(len(full)), len(full) + np.array(number, np.int64)]), pa.int64()),
                "position": pa.array(np.concatenate([np.zeros(len(full), np.int64), np.array(offset, np.int64)]), pa.int64()),
                "length": pa.array(np.concatenate([np.full(len(full), capacity), left[order]]), pa.int64()),
            }
        )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return dealt.groupBy("shard").applyInArrow(run, f"doc_id {kind}, piece bigint, shard int, bin bigint, position bigint, length bigint")
