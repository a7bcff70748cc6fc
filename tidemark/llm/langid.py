"""Language identification by cross-parsing entropy.

A suffix automaton holds a bounded sample of labelled text of each language. A text is parsed into the longest pieces
that occur in that sample; the more pieces, the farther the language. The number of pieces times the logarithm of the
sample's length, for each letter or gap of the text, is the cross entropy; the language with the least wins.

The automata are unfolded into one table over the SYMBOLS most frequent letters of each language, in which a missing
transition already holds the state after starting the next piece and a mark. Transitions by a language's other letters
lie in one sorted list. Many stretches of text then walk through all automata together, one look-up for each symbol. A
letter that a language's sample lacks ends a piece in that language alone. A piece also ends after every STRETCH symbols, so a long text is as many stretches and no task waits for one.

Learning takes rows with a non-null language, chosen by the hash of their id, until SAMPLE symbols of a language are
there (all of them, if fewer), for the LANGUAGES most frequent languages; beyond 8 languages the samples share TOTAL
symbols evenly. These bounds do not touch scoring. How long pieces usually are in a language is learned by parsing one
half of its sample by the other.

Cases: a null text or one without a letter gets `und` and score 0; so does every text when nothing could be learned.
With one learned language its texts get score 1. Ties go to the language first in order. Repeated rows and null ids
give a row each; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import col, slices

SAMPLE = 50_000  # symbols of labelled text for each language
SAMPLE_ROWS = 400  # rows of a language looked at to find them
TOTAL = 400_000  # symbols of all languages
LANGUAGES = 400  # most frequent languages that are learned
SYMBOLS = 60  # most frequent letters of a language, which have a place in the table
STRETCH = 1024
SLICE = 2 << 20  # bytes of text parsed at a time
UNDETERMINED = "und"
GAP, RARE, LISTED = 0, 1, -1  # symbols: anything but a letter; a letter the sample lacks; a letter beyond the table
MARK = 1 << 30


def folded(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased letters of all texts, each gap between them a zero, and the length of each text.

    Gaps at the ends of a text are left out, so a text without a letter has length zero.
    """
    lowered = [(t or "").lower() for t in texts]
    lengths = np.fromiter(map(len, lowered), np.int64, len(texts))
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), lengths)
    is_letter = letters()[codes]
    keep = is_letter.copy()
    if len(codes):
        keep[1:] |= is_letter[:-1] & (owner[1:] == owner[:-1])  # the first sign of a gap stands for it
    codes = np.where(is_letter, codes, 0)[keep]
    owner = owner[keep]
    last = np.ones(len(codes), bool)
    last[:-1] = owner[1:] != owner[:-1]
    inside = ~(last & (codes == 0))
    return codes[inside], np.bincount(owner[inside], minlength=len(texts))


_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        here = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = here
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[here] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[here] = copy
        last = here
    return moves


def usual_piece(codes: list[int]) -> float:
    """Mean length of the pieces of the second half, parsed by the first."""
    half = len(codes) // 2
    moves, state, count = suffix_automaton(codes[:half]), 0, 0
    for c in codes[half:]:
        if not state or c not in moves[state]:
            state, count = 0, count + 1
        state = moves[state].get(c, 0)
    return (len(codes) - half) / max(count, 1)


@dataclass
class Model:
    languages: list[str]
    points: np.ndarray  # code points of all samples in order, 0 (a gap) first
    local: np.ndarray  # symbol of each of these points in each language; the last row is for all other letters
    table: np.ndarray  # next row offset by (row offset + symbol), MARK where a new piece starts
    starts: np.ndarray  # row offset of each language's start
    listed: np.ndarray  # row offset * number of points + point, in order: transitions beyond the table
    targets: np.ndarray  # their next row offsets
    anew: np.ndarray  # row offset after a new piece that starts with the point, by point and language; with MARK
    costs: np.ndarray  # logarithm of each sample's length
    usual: np.ndarray  # usual mean length of a piece in each language


def learn(samples: dict[str, list[np.ndarray]]) -> Model:
    """samples: the folded texts of each language."""
    languages = sorted(k for k, v in samples.items() if sum(map(len, v)))
    points = np.unique(np.concatenate([np.zeros(1, np.uint32), *[t for k in languages for t in samples[k]]]))
    local = np.full((len(points) + 1, len(languages)), RARE, np.int32)
    anew = np.zeros((len(points), len(languages)), np.int32)
    tables, starts, keys, targets, costs, usual, base = [], [], [], [], [], [], 0
    share = min(SAMPLE, TOTAL // max(len(languages), 1))
    for k, language in enumerate(languages):
        codes = np.concatenate([np.r_[np.searchsorted(points, t), 0] for t in samples[language]])[:share]
        counts = np.bincount(codes, minlength=len(points))
        counts[0] = 0
        own = np.flatnonzero(counts)
        own = own[np.lexsort((own, -counts[own]))]
        chosen, others = own[:SYMBOLS], own[SYMBOLS:]
        width = len(chosen) + 2
        local[0, k], local[chosen, k], local[others, k] = GAP, np.arange(2, width), LISTED
        symbol = local[:, k]
        moves = suffix_automaton(codes.tolist())
        rows = np.full((len(moves) + 1, width), -1, np.int64)
        for state, to in enumerate(moves):
            for point, target in to.items():
                if symbol[point] != LISTED:
                    rows[state, symbol[point]] = target
                else:
                    keys.append((base + state * width) * len(points) + point)
                    targets.append(base + target * width)
        fresh = np.where(rows[0] >= 0, rows[0], len(moves)) | MARK  # a new piece; the last row: no piece is open
        rows = np.where(rows >= 0, rows, fresh)
        rows[-1] = fresh
        rows = np.where(rows >= MARK, ((rows - MARK) * width + base) | MARK, rows * width + base)
        anew[others, k] = [(base + moves[0][point] * width) | MARK for point in others.tolist()]
        tables.append(rows.ravel().astype(np.int32))
        starts.append(base + len(moves) * width)
        costs.append(math.log2(len(codes) + 1))
        usual.append(usual_piece(codes.tolist()))
        base += rows.size
    order = np.argsort(np.array(keys, np.int64))
    listed, aims = np.array(keys, np.int64)[order], np.array(targets, np.int32)[order]
    table = np.concatenate([np.zeros(0, np.int32), *tables])
    return Model(languages, points, local, table, np.array(starts, np.int64), listed, aims, anew, np.array(costs), np.array(usual))


def step_on(model: Model, state: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Where each stretch is in each language after its next point, with MARK where a piece starts."""
    symbol = model.local[point]
    to = model.table[state + np.maximum(symbol, 0)]
    row, language = np.nonzero(symbol == LISTED) if len(model.listed) else (None, None)
    if row is not None and len(row):
        key = state[row, language] * len(model.points) + point[row]
        at = np.minimum(np.searchsorted(model.listed, key), len(model.listed) - 1)
        to[row, language] = np.where(model.listed[at] == key, model.targets[at], model.anew[point[row], language])
    return to


def pieces(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Number of pieces by text and language, and the symbols of each text."""
    codes, lengths = folded(texts)
    at = np.minimum(np.searchsorted(model.points, codes), len(model.points) - 1)
    symbols = np.where(model.points[at] == codes, at, len(model.points))
    counts = -(-lengths // STRETCH)
    owner = np.repeat(np.arange(len(texts)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)  # stretch of its text
    start = np.repeat(np.cumsum(lengths) - lengths, counts) + nth * STRETCH
    size = np.minimum(lengths[owner] - nth * STRETCH, STRETCH)
    order = np.argsort(-size, kind="stable")  # longest first: those that go on are a prefix
    owner, start, size = owner[order], start[order], size[order]
    found = np.zeros((len(owner), len(model.languages)), np.int64)
    state = np.broadcast_to(model.starts, found.shape).copy()
    for step in range(int(size.max(initial=0))):
        n = int(np.searchsorted(-size, -step))  # stretches of more than `step` symbols
        to = step_on(model, state[:n], symbols[start[:n] + step])
        found[:n] += to >> 30
        state[:n] = to & (MARK - 1)
    total = np.zeros((len(texts), len(model.languages)), np.int64)
    np.add.at(total, owner, found)
    return total, lengths


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Language, score, mean length of a piece, its usual length in the language, and number of symbols of each text."""
    if not model.languages:
        none = np.zeros(len(texts))
        return [UNDETERMINED] * len(texts), none, none, none, none.astype(np.int64)
    counts, lengths = pieces(model, texts)
    bits = counts * model.costs / np.maximum(lengths, 1)[:, None]
    best = np.argmin(bits, axis=1)
    rows = np.arange(len(texts))
    least = bits[rows, best]
    others = bits.copy()
    others[rows, best] = np.inf
    second = others.min(axis=1)
    score = np.where(np.isinf(second), 1.0, 1 - least / np.maximum(second, 1e-300))
    known = lengths > 0
    names = [model.languages[b] if k else UNDETERMINED for b, k in zip(best.tolist(), known.tolist(), strict=True)]
    return names, np.where(known, np.clip(score, 0, 1), 0.0), lengths / np.maximum(counts[rows, best], 1), model.usual[best], lengths


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model:
    """Learn the languages of `docs`: SAMPLE symbols of each, from at most SAMPLE_ROWS rows; equal texts count once."""
    labelled = docs.select(col(key).cast("string").alias("key"), col(lang).cast("string").alias("lang"), col(text).cast("string").alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    draw = F.pmod(F.xxhash64(F.coalesce("key", F.lit("")), "lang"), F.lit(1 << 30)) / float(1 << 30)
    # The hash threshold alone bounds the rows of a language in expectation; the window only cuts what is left over.
    near = labelled.withColumn("draw", draw).join(F.broadcast(counts), "lang").filter(F.col("draw") * F.col("n") <= 2 * SAMPLE_ROWS)
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "key", F.length("text")))
    samples: dict[str, list[np.ndarray]] = {}
    held: dict[str, int] = {}
    seen: set[tuple[str, str]] = set()
    for row in near.withColumn("place", place).filter(F.col("place") <= SAMPLE_ROWS).orderBy("lang", "place").select("lang", F.substring("text", 1, SAMPLE).alias("text")).toLocalIterator():
        if held.get(row.lang, 0) < SAMPLE and (row.lang, row.text) not in seen:
            seen.add((row.lang, row.text))
            part = folded([row.text])[0]
            samples.setdefault(row.lang, []).append(part)
            held[row.lang] = held.get(row.lang, 0) + len(part) + 1
    return learn(samples)


def identify(docs: DataFrame, model: Model, text: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """The columns `keep` of every row, with lang_pred, score, mean_piece, usual_piece and symbols."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # at most 2 * TOTAL rows of SYMBOLS + 2 numbers
    rows = docs.select(col(text).cast("string").alias("text"), F.struct(*keep).alias("row"))
    schema = f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double, mean_piece double, usual_piece double, symbols bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0, SLICE):
            names, *numbers = predict(shared.value, batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(names, pa.string()), *map(pa.array, numbers)], ["row", "lang_pred", "score", "mean_piece", "usual_piece", "symbols"])

    return rows.mapInArrow(run, schema).select("row.*", "lang_pred", "score", "mean_piece", "usual_piece", "symbols")
