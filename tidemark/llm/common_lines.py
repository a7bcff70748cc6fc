"""Lines that many documents share are dropped, by a sharded minimal perfect hash over all distinct lines.

1. Each document is read once: its text key (MD5) and the 16-byte digests (XXH3) of its distinct line keys are stored.
2. Digests are counted, first inside each task, and the distinct ones are dealt into shards of about SHARD_KEYS.
3. Each shard becomes a minimal perfect hash: levels of bit arrays, in which a digest owns the first bit that it has to
   itself, and ranks number the owned bits. Two flat arrays follow these numbers: a fingerprint of 32 bits and the
   count of documents, in one byte where `min_docs` fits (counts stop there). Shards are rows of a stored table.
4. No line meets a line: the digests of many documents go, as one block, to the shard that numbers them, are looked up
   in its arrays all at once, and only those of lines to drop come back, by text key. A shard that is asked more than
   PROBES times answers in several tasks, each with a copy of its arrays, so one line in every document is no hot spot.
5. Documents meet the digests to drop by their text key; texts that make up 1/1000 of all rows or more (and drop
   SMALL_ANSWER lines at most) by a broadcast, so that a hot text does not pile up. Only texts with lines to drop are
   split again.

Digests have 128 bits. A digest that was counted is always found. One that was not (other documents than those counted
may be asked) is taken for a counted one with a chance of 2^-32.

Cases: a null or empty text is one empty line and comes back as an empty text. Keys shorter than `min_chars` code points
are never dropped. A key counts once for each document; rows that repeat an id, or a whole row, are documents of their
own. Null ids are ids like any other. Very long texts are read whole. An empty table gives no rows. All columns stay, and
the added ones are named so that they clash with none.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import col, fresh, slices
from tidemark.operators.lookup import HOT_PARTS, skew_safe_lookup
from tidemark.session import durable

SHARD_KEYS = 1 << 18  # distinct lines in a shard
LEAST_SHARDS = 8
PROBES = 1 << 20  # look-ups in one task
SMALL_ANSWER = 4096
SLICE = 8 << 20  # bytes of text handled at a time
LEVELS = 64  # bit arrays of a shard at most; each holds about 0.4 of what is left


def line_key(line: bytes) -> bytes:
    """Blanks of ASCII stripped at both ends, A-Z lower-cased."""
    return line.strip(b" \t\n\x0b\x0c\r").lower()


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "surrogatepass")) >= min_chars)


def digests(text: bytes, min_chars: int) -> set[bytes]:
    """The digests of the distinct keys of a text."""
    digest = xxhash.xxh3_128_digest
    return {digest(key) for key in set(map(line_key, text.split(b"\n"))) if _long_enough(key, min_chars)}


def line_digests(texts: DataFrame, min_chars: int) -> DataFrame:
    """(text_key, digests) of every row of (text_key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, SLICE):
            found = [b"".join(digests(t, min_chars)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["text_key", "digests"])

    return texts.mapInArrow(run, "text_key binary, digests binary")


def halves(blob: bytes) -> np.ndarray:
    """Digests as rows of two unsigned numbers."""
    return np.frombuffer(blob, ">u8").reshape(-1, 2).astype(np.uint64)


def document_counts(found: DataFrame) -> DataFrame:
    """(hi, lo, docs) of every distinct digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: Counter[bytes] = Counter()
            for blob in batch.column(0).to_pylist():
                held.update(blob[i : i + 16] for i in range(0, len(blob), 16))
            both = halves(b"".join(held)).view(np.int64)
            counts = np.fromiter(held.values(), np.int64, len(held))
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(counts)], ["hi", "lo", "docs"])

    rows = found.select("digests").mapInArrow(run, "hi bigint, lo bigint, docs bigint")
    return rows.groupBy("hi", "lo").agg(F.sum("docs").alias("docs"))


def _place(lo: np.ndarray, level: int, size: int) -> np.ndarray:
    """The bit of each digest on a level of `size` bits."""
    mixed = lo ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((mixed ^ (mixed >> np.uint64(32))) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Numbers 0 .. n-1 for n distinct digests, from bit arrays alone."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray, rest: np.ndarray) -> None:
        self.sizes, self.words, self.rest = sizes, words, rest
        self.bits = np.unpackbits(words.view(np.uint8), bitorder="little") if len(words) else np.zeros(0, np.uint8)
        self.rank = np.cumsum(self.bits, dtype=np.int64) - self.bits

    @classmethod
    def of(cls, both: np.ndarray) -> PerfectHash:
        sizes, arrays, left = [], [], both
        for level in range(LEVELS):
            if not len(left):
                break
            size = -(-len(left) // 64) * 64
            at = _place(left[:, 1] ^ left[:, 0], level, size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            arrays.append(np.packbits(alone, bitorder="little"))
            left = left[~alone[at]]
        # What no level told apart is kept as it is, in order; with 64 levels this stays empty but for planted digests.
        order = np.lexsort((left[:, 1], left[:, 0]))
        words = np.concatenate([np.zeros(0, np.uint8), *arrays]).view(np.uint64)
        return cls(np.array(sizes, np.int64), words, left[order])

    def number(self, both: np.ndarray) -> np.ndarray:
        """The number of each digest, -1 where none can be its own."""
        out = np.full(len(both), -1, np.int64)
        open_, base = np.arange(len(both)), 0
        for level, size in enumerate(self.sizes.tolist()):
            at = base + _place(both[open_, 1] ^ both[open_, 0], level, size)
            own = self.bits[at] == 1
            out[open_[own]] = self.rank[at[own]]
            open_ = open_[~own]
            base += size
        if len(self.rest) and len(open_):
            total = int(self.bits.sum())
            known = {tuple(pair): total + i for i, pair in enumerate(self.rest.tolist())}
            out[open_] = [known.get(tuple(pair), -1) for pair in both[open_].tolist()]
        return out


INDEX = "shard bigint, lookups bigint, sizes binary, words binary, rest binary, fingerprints binary, counts binary"


def _build(min_docs: int):
    kind = "u1" if min_docs < 256 else "<u4"
    most = np.iinfo(kind).max

    def run(rows: pa.Table) -> pa.Table:
        both = np.stack([rows.column(c).to_numpy() for c in ("hi", "lo")], axis=1).view(np.uint64)
        docs = rows.column("docs").to_numpy()
        numbers = PerfectHash.of(both)
        at = numbers.number(both)
        fingerprints, counts = np.zeros(len(both), "<u4"), np.zeros(len(both), kind)
        fingerprints[at] = (both[:, 0] & np.uint64(0xFFFFFFFF)).astype("<u4")
        counts[at] = np.minimum(docs, most).astype(kind)
        blobs = [numbers.sizes.astype("<i8"), numbers.words, np.ascontiguousarray(numbers.rest), fingerprints, counts]
        out = {"shard": pa.array([rows.column("shard")[0].as_py()], pa.int64()), "lookups": pa.array([int(docs.sum())], pa.int64())}
        return pa.table(out | {n: pa.array([b.tobytes()], pa.binary()) for n, b in zip(("sizes", "words", "rest", "fingerprints", "counts"), blobs, strict=True)})

    return run


def index(counts: DataFrame, min_docs: int) -> tuple[DataFrame, int]:
    """The shards as a stored table, and their number."""
    shards = max(LEAST_SHARDS, -(-counts.count() // SHARD_KEYS))
    dealt = counts.withColumn("shard", F.pmod("hi", F.lit(shards)))
    return durable(dealt.groupBy("shard").applyInArrow(_build(min_docs), INDEX)), shards


class Shard:
    """The arrays of one shard, ready for look-ups."""

    def __init__(self, row: dict, min_docs: int) -> None:
        self.hash = PerfectHash(np.frombuffer(row["sizes"], "<i8"), np.frombuffer(row["words"], np.uint64), np.frombuffer(row["rest"], np.uint64).reshape(-1, 2))
        self.fingerprints = np.frombuffer(row["fingerprints"], "<u4")
        self.counts = np.frombuffer(row["counts"], "u1" if min_docs < 256 else "<u4")

    def documents(self, both: np.ndarray) -> np.ndarray:
        """How many documents hold each digest, as far as the array counts; 0 if none."""
        at = self.hash.number(both)
        known = (at >= 0) & (self.fingerprints[np.maximum(at, 0)] == (both[:, 0] & np.uint64(0xFFFFFFFF)))
        return np.where(known, self.counts[np.maximum(at, 0)], 0)


def _blocks(found: DataFrame, shards: int, parts: dict[int, int]) -> DataFrame:
    """(shard, part, texts, digests): all look-ups of a slice of documents in one shard, one text key for each digest.

    The part of a text follows from its key, so copies of a text ask one task, and are asked once by a slice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, SLICE):
            once = dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            keys = np.frombuffer(b"".join(once), ">u8").reshape(-1, 2)
            both = halves(b"".join(once.values()))
            owner = np.repeat(np.arange(len(once)), [len(v) // 16 for v in once.values()])
            shard = both[:, 0].view(np.int64) % shards
            copies = np.ones(shards, np.int64)
            for s, n in parts.items():
                copies[s] = n
            part = (keys[owner, 0].astype(np.uint64) % copies[shard].astype(np.uint64)).astype(np.int64)
            order = np.lexsort((part, shard))
            shard, part, owner, both = shard[order], part[order], owner[order], both[order]
            starts = np.flatnonzero(np.r_[len(shard) > 0, (shard[1:] != shard[:-1]) | (part[1:] != part[:-1])])
            ends = np.r_[starts[1:], len(shard)]
            blobs = [(keys[owner[a:b]].tobytes(), both[a:b].astype(">u8").tobytes()) for a, b in zip(starts, ends, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard[starts]), pa.array(part[starts]), pa.array([t for t, _ in blobs], pa.binary()), pa.array([d for _, d in blobs], pa.binary())],
                ["shard", "part", "texts", "digests"],
            )

    return found.mapInArrow(run, "shard bigint, part bigint, texts binary, digests binary")


def _probe(min_docs: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, dropped = [], []
        if left.num_rows and right.num_rows:
            shard = Shard(left.to_pylist()[0], min_docs)
            asked = np.concatenate([np.frombuffer(b"".join(right.column(c).to_pylist()), "V16") for c in ("texts", "digests")]).reshape(2, -1)
            both = np.frombuffer(asked[1].tobytes(), ">u8").reshape(-1, 2).astype(np.uint64)
            some = shard.documents(both) >= min_docs
            by_text: dict[bytes, set[bytes]] = {}
            for key, line in zip(asked[0][some].tolist(), asked[1][some].tolist(), strict=True):
                by_text.setdefault(key, set()).add(line)
            keys, dropped = list(by_text), [b"".join(lines) for lines in by_text.values()]
        return pa.table({"text_key": pa.array(keys, pa.binary()), "dropped": pa.array(dropped, pa.binary())})

    return run


def lines_to_drop(found: DataFrame, min_docs: int) -> DataFrame:
    """(text_key, dropped, lines): blobs of digests of the lines of a text that `min_docs` documents or more hold."""
    shards_table, shards = index(durable(document_counts(found)), min_docs)
    # One entry at most for PROBES lines of the whole corpus.
    busy = {r.shard: -(-r.lookups // PROBES) for r in shards_table.filter(F.col("lookups") > PROBES).select("shard", "lookups").collect()}
    asked = _blocks(found, shards, busy)
    parts = -F.floor(-F.col("lookups") / F.lit(PROBES))
    copies = shards_table.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(parts, F.lit(1)) - 1)))
    answers = copies.groupBy("shard", "part").cogroup(asked.groupBy("shard", "part")).applyInArrow(_probe(min_docs), "text_key binary, dropped binary")
    return answers.groupBy("text_key").agg(F.collect_list("dropped").alias("dropped"), (F.sum(F.octet_length("dropped")) / 16).cast("bigint").alias("lines"))


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, text: str = "text") -> tuple[DataFrame, str, str]:
    """`docs` with the lines of `text` gone that `min_docs` documents or more hold, and the names of two columns beside:

    the number of lines before and the number dropped, n_lines and n_dropped where these names are free.
    """
    n_lines, n_dropped = fresh(docs.columns, "n_lines", "n_dropped")
    content = F.coalesce(col(text).cast("string"), F.lit("")).cast("binary")
    others = [col(c) for c in docs.columns if c != text]
    rows = docs.select(F.struct(*others, F.lit(True).alias("there")).alias("given"), content.alias("body"), F.unhex(F.md5(content)).alias("text_key"))
    found = durable(line_digests(rows.select("text_key", F.col("body").alias("text")), min_chars))
    drop = lines_to_drop(found.filter(F.octet_length("digests") > 0), min_docs)
    copies = found.groupBy("text_key").agg(F.count(F.lit(1)).alias("members"))
    hot = F.col("members") * HOT_PARTS >= F.lit(found.count())
    # Hot texts without lines to drop are answered too. A text of many dropped lines never goes into the broadcast.
    weight = F.when(F.coalesce("lines", F.lit(0)) <= SMALL_ANSWER, F.col("members"))
    answers = copies.join(drop, "text_key", "left").filter(F.col("dropped").isNotNull() | hot)
    met = skew_safe_lookup(rows, durable(answers.select("text_key", "dropped", weight.alias("members"))), ["text_key"], "members")
    schema = T.StructType([met.schema["given"], *T.StructType.fromDDL("text string, n_lines bigint, n_dropped bigint").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, SLICE):
            kept, before, gone = [], [], []
            for body, blobs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                lines = body.count(b"\n") + 1
                rest, left = body, lines
                if blobs:
                    joined = b"".join(blobs)
                    bad = {joined[i : i + 16] for i in range(0, len(joined), 16)}
                    stay = [line for line in body.split(b"\n") if xxhash.xxh3_128_digest(line_key(line)) not in bad]
                    rest, left = b"\n".join(stay), len(stay)
                kept.append(rest)
                before.append(lines)
                gone.append(lines - left)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(before, pa.int64()), pa.array(gone, pa.int64())],
                ["given", "text", "n_lines", "n_dropped"],
            )

    out = met.select("given", "body", "dropped").mapInArrow(run, schema)
    columns = [F.col("text").alias(c) if c == text else F.col("given").getField(c).alias(c) for c in docs.columns]
    return out.select(*columns, F.col("n_lines").alias(n_lines), F.col("n_dropped").alias(n_dropped)), n_lines, n_dropped
