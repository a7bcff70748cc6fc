"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.lookup import quoted


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")


def col(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col(quoted(name))


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo `modulus` (NULL id: the empty string)."""
    return F.crc32(F.coalesce(col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """Column names that clash with none of `taken` (Spark compares names without case)."""
    used = {t.lower() for t in taken}
    out = []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


def slices(batches: Iterator[pa.RecordBatch], text: int, limit: int) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces whose column number `text` holds about `limit` bytes (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = batch.column(text).nbytes
        if size <= limit:
            yield batch
            continue
        lengths = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(lengths):
            if i > start and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)


def hash_sample(df: DataFrame, key: Column, rows: int, total: int) -> DataFrame:
    """About `rows` of `total` rows, chosen by the hash of `key`: the same rows on any cluster."""
    share = min(1.0, rows / max(total, 1))
    return df.filter(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
