"""Near duplicates: SimHash fingerprints linked by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2r bits share a fingerprint within r bits of both. Every distinct fingerprint
therefore emits all variants within r bits, the variants are dealt out, and fingerprints that meet on one variant are
linked. The part of a variant is linear in its bits: the 64 bits form m groups, and the m parities number the part. So
which variants of a fingerprint fall into a part follows from the fingerprint and the part alone: the shuffle carries
the fingerprint once for each part where it has variants, and the task of that part spells them out. Flipping a bit
changes one parity, so for r = 2 that is 1 + m + m(m-1)/2 of the 2^m parts, and a part shrinks as m grows: 14 % of the
fingerprints at m = 8, 1.9 % at 12, 0.2 % at 16. m grows until the largest part holds about PART_ROWS. No variant is
left out. In a part equal variants lie side by side after a sort; meeting pairs are verified by their bit distance and
joined up, so a part returns at most one link for each fingerprint, however large a group of near copies is.

Cases: a null or empty text has fingerprint zero, which is linked like any other. Rows repeated with one id share its
fingerprint. A null id takes part but is never the smallest one, unless all ids of its component are null. An empty
table gives no rows. Other columns are not read by `components`, and pass through `one_of_each`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import col, fresh, slices
from tidemark.operators.graph import connected_components
from tidemark.operators.lookup import skew_safe_lookup
from tidemark.session import durable

BITS = 64
PART_BITS = range(8, 21)  # 2^8 parts for variants; more once a part would hold over PART_ROWS fingerprints
PART_ROWS = 1 << 18
SKEW = 4  # a part may hold so many times PART_ROWS where fingerprints lie unevenly
ROUND = 1 << 21  # variants spelled out at a time in a task
SLICE = 8 << 20  # bytes of text handled at a time


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """SimHash of the word shingles of a text, signed."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, the six ASCII blanks
    if not words:
        return 0
    if len(words) <= shingle:
        return int(np.array(xxhash.xxh64_intdigest(b" ".join(words), seed), np.uint64).view(np.int64))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[: -shingle] + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """(id, fp) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, SLICE):
            values = [fingerprint(t, shingle, seed) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.int64())], ["id", "fp"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(col(doc_id).alias("id"), col(text).cast("string").alias("text")).mapInArrow(run, f"id {kind}, fp bigint")


def ball(radius: int) -> np.ndarray:
    """All masks of at most `radius` bits."""
    masks = [0]
    for k in range(1, radius + 1):
        masks += [sum(1 << b for b in bits) for bits in combinations(range(BITS), k)]
    return np.array(masks, np.uint64)


def parities(count: int) -> np.ndarray:
    """`count` fixed masks over all bits; their parities split the variants of a part further."""
    return np.frombuffer(np.random.default_rng(64).bytes(8 * BITS), np.uint64)[:count]


def groups_of_bits(count: int) -> np.ndarray:
    """`count` masks that share no bit and cover all; the parities of a fingerprint over them number its part."""
    return np.array([sum(1 << b for b in range(j, BITS, count)) for j in range(count)], np.uint64)


def classes(values: np.ndarray, masks: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values), np.int64)
    for j, m in enumerate(masks):
        out |= (np.bitwise_count(values & m).astype(np.int64) & 1) << j
    return out


def join_up(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index connected to each of n indices by the links a-b."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while not np.array_equal(onward := label[label], label):
            label = onward
        if np.array_equal(before, label):
            return label


def meet(radius: int, part_bits: int) -> Callable[[pa.Table], pa.Table]:
    """For the fingerprints of one part: (fp, other), one link for each one that meets others."""
    distance = 2 * radius

    def run(rows: pa.Table) -> pa.Table:
        part = rows.column("part")[0].as_py()
        fps = np.unique(rows.column("fp").to_numpy()).view(np.uint64)
        masks = ball(radius)
        own, of_mask = classes(fps, groups_of_bits(part_bits)), classes(masks, groups_of_bits(part_bits))
        extra = int(np.bincount(of_mask, minlength=1 << part_bits)[own ^ part].sum() // ROUND).bit_length()
        own |= classes(fps, parities(extra)) << part_bits
        of_mask |= classes(masks, parities(extra)) << part_bits
        order, mask_order = np.argsort(own, kind="stable"), np.argsort(of_mask, kind="stable")
        kinds, at = np.unique(own[order], return_index=True)
        groups = dict(zip(kinds.tolist(), np.split(order, at[1:]), strict=True))
        kinds, at = np.unique(of_mask[mask_order], return_index=True)
        by_class = dict(zip(kinds.tolist(), np.split(masks[mask_order], at[1:]), strict=True))
        label = np.arange(len(fps))
        for step in range(1 << extra):
            target = part | step << part_bits
            variants, owners = [], []
            for kind, members in groups.items():
                flips = by_class.get(kind ^ target)
                if flips is not None:
                    variants.append((fps[members, None] ^ flips).ravel())
                    owners.append(np.repeat(members, len(flips)))
            if not variants:
                continue
            met, owner = np.concatenate(variants), np.concatenate(owners)
            by_value = np.argsort(met, kind="stable")
            met, owner = met[by_value], owner[by_value]
            same = np.flatnonzero(met[1:] == met[:-1])
            a, b = label[owner[same]], label[owner[same + 1]]
            open_ = (np.bitwise_count(fps[owner[same]] ^ fps[owner[same + 1]]) <= distance) & (a != b)
            if open_.any():
                pairs = np.unique(a[open_] * len(fps) + b[open_])
                label = join_up(len(fps), pairs // len(fps), pairs % len(fps))[label]
        linked = np.flatnonzero(label != np.arange(len(fps)))
        return pa.table({"fp": fps[linked].view(np.int64), "other": fps[label[linked]].view(np.int64)})

    return run


def part_of(fp: Column, part_bits: int) -> Column:
    terms = [F.shiftleft((F.bit_count(fp.bitwiseAND(F.lit(int(m.view(np.int64))))) % 2).cast("long"), j) for j, m in enumerate(groups_of_bits(part_bits))]
    out = terms[0]
    for t in terms[1:]:
        out = out.bitwiseOR(t)
    return out


def part_bits_for(fps: DataFrame, radius: int) -> int:
    """Fewest part bits at which the average part holds PART_ROWS fingerprints and the largest SKEW times as many."""
    total = fps.count()
    for bits in PART_BITS:
        reached = np.unique(classes(ball(radius), groups_of_bits(bits)))
        if total * len(reached) > PART_ROWS << bits:
            continue
        if total <= SKEW * PART_ROWS:
            return bits
        found = fps.groupBy(part_of(F.col("fp"), bits).alias("part")).count().toArrow()  # 2^bits rows at most
        own = np.zeros(1 << bits, np.int64)
        own[found.column("part").to_numpy()] = found.column("count").to_numpy()
        held = sum(own[np.arange(1 << bits) ^ shift] for shift in reached.tolist())
        if held.max() <= SKEW * PART_ROWS:
            return bits
    return PART_BITS[-1]


def links(fps: DataFrame, distance: int = 4) -> DataFrame:
    """(fp, other): links that join all distinct fingerprints of column fp within `distance` bits (an even number)."""
    radius = distance // 2
    if distance % 2:
        raise ValueError("the radius is half the distance, which must be even")
    part_bits = part_bits_for(fps, radius)
    reached = np.unique(classes(ball(radius), groups_of_bits(part_bits))).tolist()
    sent = fps.select("fp", F.explode(F.array(*[F.lit(int(x)).cast("long") for x in reached])).alias("shift")).select(
        "fp", part_of(F.col("fp"), part_bits).bitwiseXOR(F.col("shift")).alias("part")
    )
    return sent.groupBy("part").applyInArrow(meet(radius, part_bits), "fp bigint, other bigint")


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = 4, shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id) for every row; component_id is the smallest id that links lead to."""
    rows = durable(fingerprints(docs, doc_id, text, shingle, seed))
    nodes = durable(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("members")))
    found = durable(links(nodes.select("fp"), distance).distinct())
    both = found.select(F.col("fp").alias("a"), F.col("other").alias("b"))
    both = both.union(both.select("b", "a"))
    label = connected_components(both.select(F.col("a").alias("id")).distinct(), both)
    named = nodes.join(label.withColumnRenamed("id", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("weight"))
    named = skew_safe_lookup(named.select("fp", "label", "members"), least, ["label"], "weight")
    return skew_safe_lookup(rows, named.select("fp", "component_id", "members"), ["fp"], "members").select(
        F.col("id").alias("doc_id"), "fp", "component_id"
    )


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = 4) -> DataFrame:
    """The rows of `docs` whose id is the smallest of its component (all rows that repeat that id), and rows without id."""
    [name] = fresh(docs.columns, "__stays")
    stay = components(docs, doc_id, text, distance).filter("doc_id = component_id").select(F.col("doc_id").alias(name)).distinct()
    rows = docs.join(stay, col(doc_id) == F.col(name), "left_semi")
    return rows.unionByName(docs.filter(col(doc_id).isNull()))
