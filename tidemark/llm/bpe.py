"""Byte-pair encoding by a segment tree over the ranks of neighbouring pairs, and decoding.

Every word (pre-token) has a tree whose leaves are the ranks of its pairs; the root is the lowest rank and, among
equals, the leftmost. Merging there changes three leaves, each updated along its path to the root. Many words take
their steps together: trees of one width are rows of an array. Words already encoded are remembered in each worker.

Cases: null and empty texts have no ids and decode to the empty text. Added tokens are recognised inside texts, as the
vocabulary file asks. Repeated rows and null ids give a row each. An empty table gives no rows; other columns are not
read. Texts of any length are encoded whole: one very long word takes one merge at a time, each in logarithmic time.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame

from tidemark.llm.common import col, slices
from tidemark.llm.pretokens import pretokens

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
SLICE = 2 << 20  # bytes of text encoded at a time
REMEMBERED = 1_000_000  # words a worker remembers; beyond, it forgets the older half
CELLS = 1 << 22  # tree cells stepped together
NEVER = np.int64(1) << 62
MIX = np.uint64(0x9E3779B97F4A7C15)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in vocabulary files of this kind."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class Vocabulary:
    """Merges, ids and token bytes of a byte-level vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        ids, added = spec["model"]["vocab"], spec["added_tokens"]
        if any(t[flag] for t in added for flag in ("single_word", "lstrip", "rstrip", "normalized")) or spec["normalizer"] or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{path}: not a plain byte-level vocabulary")
        letters = byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        self.first = np.array([ids[c] for c in letters], np.int64)
        self.added = {t["content"]: t["id"] for t in added}
        self.split = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if added else None
        self.bytes: list[bytes] = [b""] * (max([*ids.values(), *self.added.values()]) + 1)
        for token, i in [*ids.items(), *self.added.items()]:
            self.bytes[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        self.sizes = np.fromiter(map(len, self.bytes), np.int64, len(self.bytes))
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs], np.uint64)
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int64)
        bits = max(8, (8 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.slots = np.full(1 << bits, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.ranks = np.full(1 << bits, NEVER)
        self.probes = 1
        for rank, (key, slot) in enumerate(zip(keys.tolist(), (keys * MIX >> self.shift).tolist(), strict=True)):
            probes = 1
            while self.ranks[slot] != NEVER and self.slots[slot] != key:
                slot, probes = (slot + 1) & ((1 << bits) - 1), probes + 1
            if self.ranks[slot] == NEVER:
                self.slots[slot], self.ranks[slot] = key, rank
            self.probes = max(self.probes, probes)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, NEVER where they do not merge."""
        key = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        slot = (key * MIX >> self.shift).astype(np.int64)
        out = np.full(len(key), NEVER)
        for _ in range(self.probes):
            hit = self.slots[slot] == key
            out[hit] = self.ranks[slot[hit]]
            slot = (slot + 1) & (len(self.slots) - 1)
        return out

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian 32-bit integers."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        out: list[bytes] = [b""] * len(words)
        for i in np.flatnonzero(sizes == 1).tolist():
            out[i] = int(self.first[words[i][0]]).to_bytes(4, "little")
        widths = np.where(sizes > 1, 1 << np.ceil(np.log2(np.maximum(sizes - 1, 1))).astype(np.int64), 0)
        for width in np.unique(widths[widths > 0]).tolist():
            members = np.flatnonzero(widths == width)
            step = max(1, CELLS // (2 * width))
            for at in range(0, len(members), step):
                chosen = members[at : at + step]
                for i, ids in zip(chosen.tolist(), self._merge([words[i] for i in chosen.tolist()], sizes[chosen], width), strict=True):
                    out[i] = ids
        return out

    def _merge(self, words: list[bytes], sizes: np.ndarray, width: int) -> list[bytes]:
        n, places = len(words), width + 2
        held = np.arange(places) < sizes[:, None]
        ids = np.zeros((n, places), np.int64)
        ids[held] = self.first[np.frombuffer(b"".join(words), np.uint8)]
        after = np.broadcast_to(np.arange(1, places + 1), (n, places)).copy()
        before = np.broadcast_to(np.arange(-1, places - 1), (n, places)).copy()
        tree = np.full((n, 2 * width), NEVER)
        row, place = np.nonzero(held[:, 1 : width + 1])
        rank = self.rank(ids[row, place], ids[row, place + 1])
        tree[row, width + place] = np.where(rank == NEVER, NEVER, rank * width + place)
        level = width
        while level > 1:
            level //= 2
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        tree, ids, after, before, alive = tree.ravel(), ids.ravel(), after.ravel(), before.ravel(), held.ravel()
        live = np.arange(n)
        while True:
            root = tree[live * (2 * width) + 1]
            going = root < NEVER
            if not going.any():
                break
            if not going.all():
                live, root = live[going], root[going]
            base, trunk, size = live * places, live * (2 * width), sizes[live]
            rank, p = root // width, root % width
            q = after[base + p]
            r = after[base + q]
            o = before[base + p]
            new = self.merged[rank]
            ids[base + p] = new
            after[base + p] = r
            alive[base + q] = False
            before[base + r] = p  # the last place of a row is spare
            value = np.where(r < size, self.rank(new, ids[base + r]), NEVER)
            outer = np.where(o >= 0, self.rank(ids[base + np.maximum(o, 0)], new), NEVER)
            # Three point updates; a leaf beyond the tree or before the word falls back on the leaf at p.
            at = np.stack([np.where(q < width, q, p), p, np.where(o >= 0, o, p)]) + width + trunk
            tree[at[0]] = NEVER
            tree[at[2]] = np.where(outer == NEVER, NEVER, outer * width + o)
            tree[at[1]] = np.where(value == NEVER, NEVER, value * width + p)
            at -= trunk
            for _ in range(width.bit_length() - 1):
                at >>= 1
                below = 2 * at + trunk
                tree[at + trunk] = np.minimum(tree[below], tree[below + 1])
        held = alive.reshape(n, places)
        flat = ids[alive].astype("<u4").tobytes()
        ends = (4 * np.cumsum(held.sum(axis=1))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def encode_words(self, words: list[bytes], known: dict[bytes, bytes]) -> list[bytes]:
        """The ids of each of these different words; `known` remembers."""
        new = [w for w in words if w not in known]
        known.update(zip(new, self.merge(new), strict=True))
        out = [known[w] for w in words]
        forget(known)
        return out

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def forget(known: dict[bytes, bytes]) -> None:
    if len(known) > REMEMBERED:
        for word in list(itertools.islice(known, len(known) // 2)):
            del known[word]


@functools.cache
def remembered(use: str) -> dict[bytes, bytes]:
    """Words encoded by this Python worker so far, over all its tasks."""
    return {}


def encode_texts(vocab: Vocabulary, texts: list[str | None], encode_words: Callable[[list[bytes], dict[bytes, bytes]], list[bytes]], known: dict[bytes, bytes]) -> list[bytes]:
    """The ids of whole texts as little-endian 32-bit integers, added tokens included.

    `encode_words` is asked once for each different word of these texts.
    """
    pieces: list[str] = []
    layout: list[list[int]] = []  # of each text: piece numbers, or -1 - id for an added token
    for text in texts:
        cut = vocab.split.split(text or "") if vocab.split and text else [text or ""]
        row = []
        for i, piece in enumerate(cut):
            if i % 2:
                row.append(-1 - vocab.added[piece])
            elif piece:
                row.append(len(pieces))
                pieces.append(piece)
        layout.append(row)
    words, counts = pretokens(pieces)
    different = words.dictionary_encode()
    coded = pa.array(encode_words(different.dictionary.to_pylist(), known), pa.large_binary()).take(different.indices)
    _, offsets, data = coded.buffers()  # the ids of all words, one after another
    ends = np.frombuffer(offsets, np.int64, len(coded) + 1)[np.r_[0, np.cumsum(counts)]].tolist() if len(coded) else [0] * (len(pieces) + 1)
    flat = memoryview(data or b"")
    joined = [flat[a:b] for a, b in zip(ends, ends[1:], strict=False)]
    return [b"".join(joined[k] if k >= 0 else (-1 - k).to_bytes(4, "little") for k in row) for row in layout]


def encode_decode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids, decoded) for every row: ids as little-endian 32-bit integers, and the text they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, known = vocabulary(path), remembered(path)
        for batch in slices(batches, 1, SLICE):
            ids = encode_texts(vocab, batch.column(1).to_pylist(), vocab.encode_words, known)
            decoded = [vocab.decode(np.frombuffer(i, "<u4")) for i in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    return _rows(docs, doc_id, text).mapInArrow(run, f"{_id_field(docs, doc_id)}, ids binary, decoded string")


def _id_field(docs: DataFrame, doc_id: str) -> str:
    return f"doc_id {docs.select(col(doc_id)).schema[0].dataType.simpleString()}"


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(col(doc_id).alias("doc_id"), col(text).cast("string").alias("text"))
