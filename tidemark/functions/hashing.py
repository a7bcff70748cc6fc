"""Reproducible randomness: every draw is a function of (seed, key), never of partition order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_RANGE = 4294967296  # 2 ** 32


def portable_hash(seed: int | str | Column, *keys: Column | str) -> Column:
    """First 32 bits of md5("seed:key[:key...]") as a bigint in [0, 2**32)."""
    parts = [seed if isinstance(seed, Column) else F.lit(str(seed))]
    parts += [F.col(k) if isinstance(k, str) else k for k in keys]
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def uniform(seed: int | str | Column, *keys: Column | str) -> Column:
    """Uniform double in [0, 1)."""
    return portable_hash(seed, *keys) / F.lit(float(HASH_RANGE))


def noise_score(seed: int, *keys: Column | str) -> Column:
    """Uniform score with four decimals in [0.0001, 0.9999]."""
    return (portable_hash(seed, *keys) % 9999 + 1) / F.lit(10000.0)
