"""Splits, folds and samples as functions of (seed, key): no shuffle, same answer on any partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.hashing import portable_hash, uniform
from tidemark.operators.lookup import quoted, skew_safe_lookup
from tidemark.session import durable


def _split_seed(seed: int) -> str:
    """Splits draw from a stream of their own: a sample with the same seed is independent of them."""
    return f"split{seed}"


def split_label(keys: Sequence[str], seed: int = 42, valid_share: float = 0.2) -> Column:
    return F.when(uniform(_split_seed(seed), *keys) < valid_share, "valid").otherwise("train")


def split(df: DataFrame, keys: Sequence[str], seed: int = 42, valid_share: float = 0.2) -> DataFrame:
    """train / valid by key hash; every stratum is split in the same proportion in expectation."""
    return df.withColumn("split", split_label(keys, seed, valid_share))


BUCKETS = 1 << 16  # equal parts of the hash range; counts of these find where a sample ends


def _bucketed(df: DataFrame, keys: Sequence[str], seed: int | str) -> DataFrame:
    hashed = portable_hash(seed, *keys)
    return df.select("*", hashed.alias("__hash"), F.shiftright(hashed, 16).alias("__bucket"))


def split_exact(df: DataFrame, keys: Sequence[str], stratum: str, seed: int = 42,
                valid_share: float = 0.2) -> DataFrame:
    """Exactly round(share * n) rows of each stratum (half up) go to validation: those with the smallest hashes.

    Counts of hash buckets tell in which bucket of a stratum the validation part ends. Only the rows of that bucket
    are ranked; all others are decided where they are. Reads its input twice.
    """
    marked = _bucketed(df, keys, _split_seed(seed))
    counts = durable(marked.groupBy(stratum, "__bucket").agg(F.count(F.lit(1)).alias("__n")))
    group = Window.partitionBy(stratum)
    upto = F.sum("__n").over(group.orderBy("__bucket"))
    placed = counts.select(stratum, "__bucket", "__n", upto.alias("__upto"), F.sum("__n").over(group).alias("__total"))
    quota = F.floor(F.col("__total") * valid_share + 0.5)
    # One row for each stratum, with the whole buckets that fit into its quota.
    ends = placed.withColumn("__quota", quota).groupBy(stratum).agg(
        F.first("__total").alias("__total"),
        F.min(F.when(F.col("__upto") >= F.col("__quota"), F.col("__bucket"))).alias("__end"),
        (F.first("__quota") - F.coalesce(F.max(F.when(F.col("__upto") < F.col("__quota"), F.col("__upto"))), F.lit(0))).alias("__open"),
    )
    known = ends.filter(F.col(stratum).isNotNull())
    looked_up = skew_safe_lookup(marked, known, [stratum], "__total")
    missing = ends.filter(F.col(stratum).isNull()).select("__end", "__open").first()
    if missing is not None:
        for c in ("__end", "__open"):
            looked_up = looked_up.withColumn(c, F.when(F.col(stratum).isNull(), F.lit(missing[c])).otherwise(F.col(c)))
    at_end = F.col("__bucket") == F.col("__end")
    place = F.row_number().over(Window.partitionBy(stratum).orderBy("__hash", *keys))
    decided = looked_up.filter(~at_end).withColumn("__valid", F.col("__bucket") < F.col("__end"))
    ranked = looked_up.filter(at_end).withColumn("__valid", place <= F.col("__open"))
    label = F.when(F.col("__valid"), "valid").otherwise("train").alias("split")
    return decided.unionByName(ranked).select(*map(quoted, df.columns), label)


def assign_folds(df: DataFrame, keys: Sequence[str], folds: int = 5, seed: int = 41) -> DataFrame:
    return df.withColumn("fold", (portable_hash(seed, *keys) % folds).cast("int"))


def undersample(df: DataFrame, target: str, keys: Sequence[str], fraction: float = 0.07, seed: int = 2) -> DataFrame:
    """All positives and a fraction of the negatives, in one pass."""
    return df.filter((F.col(target) == 1) | ((F.col(target) == 0) & (uniform(seed, *keys) < fraction)))


def hash_sample(df: DataFrame, keys: Sequence[str], rows: int, seed: int = 42) -> DataFrame:
    """Exactly `rows` rows (all, if there are fewer): those with the smallest key hashes.

    Counts of hash buckets tell where the sample ends; whole buckets before it are filtered where they lie, and only
    the last one is ordered. Reads its input twice.
    """
    marked = _bucketed(df, keys, seed)
    counts = marked.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before, end = 0, BUCKETS
    for bucket, n in sorted(counts.collect()):  # BUCKETS rows at most
        if before + n > rows:
            end = bucket
            break
        before += n
    whole = marked.filter(F.col("__bucket") < end)
    last = marked.filter(F.col("__bucket") == end).orderBy("__hash", *keys).limit(rows - before)
    return whole.unionByName(last).select(*map(quoted, df.columns))


def simulated_samples(df: DataFrame, target: str, keys: Sequence[str], seeds: int = 30,
                      fraction: float = 0.07) -> DataFrame:
    """Undersampled copies for seeds 0..seeds-1 side by side; the row fan-out is filtered in the same stage."""
    fanned = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))).alias("seed"))
    drawn = uniform(F.col("seed"), *keys) < fraction
    return fanned.filter((F.col(target) == 1) | ((F.col(target) == 0) & drawn))


IMBALANCE_STEPS = tuple(i / 100 for i in range(1, 11))


def imbalance_sweep(df: DataFrame, target: str, keys: Sequence[str], fractions: Sequence[float] = IMBALANCE_STEPS,
                    seed: int = 0) -> DataFrame:
    """Class counts and ratio after undersampling, one row per fraction; one pass over the data."""
    u = uniform(seed, *keys)
    negatives = [F.count(F.when((F.col(target) == 0) & (u < f), 1)).alias(f"n{i}") for i, f in enumerate(fractions)]
    counted = df.agg(F.count(F.when(F.col(target) == 1, 1)).alias("pos"), *negatives)
    rows = F.array(
        *[F.struct(F.lit(f).alias("fraction"), F.col(f"n{i}").alias("negatives")) for i, f in enumerate(fractions)]
    )
    return counted.select(F.col("pos").alias("positives"), F.inline(rows)).select(
        "fraction",
        "negatives",
        "positives",
        F.round(F.try_divide(F.col("positives").cast("double"), F.col("positives") + F.col("negatives")), 6).alias(
            "positive_share"
        ),
    )
