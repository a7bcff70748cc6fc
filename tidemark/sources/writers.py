"""Writing: plain and partitioned parquet, and the published tables of a scoring run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def save(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("compression", "snappy").parquet(path)


def save_partitioned(df: DataFrame, path: str, partitions: Sequence[str] = ("entity", "date"),
                     sort_by: str | None = None) -> None:
    """`.../entity=E/date=D/` parquet; re-running a day replaces only its own partitions.

    With `sort_by`, rows are range-partitioned on (partition columns, key): files hold disjoint key ranges
    and a partition value with a third of the data still spreads over many tasks.
    """
    if sort_by is not None:
        order = [*partitions, sort_by]
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "snappy")
        .partitionBy(*partitions)
        .parquet(path)
    )


def prediction_export(df: DataFrame, key: str = "analytical_customer_id", extra: Sequence[Column] = ()) -> DataFrame:
    """Key, sorted targets and sorted final scores; fractional columns as float."""
    targets = sorted(c for c in df.columns if c.startswith("target"))
    scores = sorted(c for c in df.columns if c.startswith("preds") and c.endswith("final"))
    types = dict(df.dtypes)

    def published(name: str) -> Column:
        keep = name == "target_acquisition_qc_general_0_1" or name.startswith("target_acquisition_dmart")
        return F.col(name) if keep and types[name] in ("int", "bigint") else F.col(name).cast("float").alias(name)

    return df.select(*extra, key, *[published(c) for c in [*targets, *scores]])
