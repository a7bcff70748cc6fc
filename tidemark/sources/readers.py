"""Reading: parquet, SQL text or files with named parameters, typed casts, date and number repair."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.tables import load

__all__ = ["load", "read_query", "apply_schema", "parse_dates", "coerce_numeric", "read_lookup_csv", "scan_in_list"]

# Source type names and the engine types they become (fixed values).
SOURCE_TYPES = {
    "INT64": T.LongType(),
    "INTEGER": T.LongType(),
    "FLOAT64": T.DoubleType(),
    "FLOAT": T.DoubleType(),
    "NUMERIC": T.DoubleType(),
    "BIGNUMERIC": T.DoubleType(),
    "STRING": T.StringType(),
    "DATE": T.DateType(),
    "TIMESTAMP": T.TimestampNTZType(),
}


def read_query(spark: SparkSession, query: str, args: Mapping[str, object] | None = None,
               dates: Iterable[str] | None = None) -> DataFrame:
    """Run SQL given as text or as the path of a `.sql` file. Named parameters are bound, not pasted."""
    text = Path(query).read_text() if query.endswith(".sql") else query
    df = spark.sql(text, args=dict(args or {}))
    return df if dates is None else parse_dates(df, list(dates))


def apply_schema(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Cast columns to the engine type of their declared source type; an unknown type is a plan-time error."""
    unknown = {name: kind for name, kind in mapping.items() if kind not in SOURCE_TYPES}
    if unknown:
        raise ValueError(f"no engine type for {unknown}")
    return df.select(
        *[F.col(c).cast(SOURCE_TYPES[mapping[c]]).alias(c) if c in mapping else F.col(c) for c in df.columns]
    )


def _convert_whole_columns(df: DataFrame, converted: dict[str, Column]) -> DataFrame:
    """Replace each column by its converted form only if no value is lost; one aggregate decides for all."""
    if not converted:
        return df
    lost = df.agg(
        *[F.count(F.when(F.col(c).isNotNull() & new.isNull(), 1)).alias(c) for c, new in converted.items()]
    ).first()
    return df.select(*[converted[c].alias(c) if c in converted and lost[c] == 0 else F.col(c) for c in df.columns])


def _text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def parse_dates(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Text to zone-free timestamps: the named columns, or all whose name contains "date"."""
    text = _text_columns(df)
    wanted = [c for c in text if "date" in c] if columns is None else [c for c in columns if c in text]
    out = _convert_whole_columns(df, {c: F.col(c).try_cast("timestamp_ntz") for c in wanted})
    zoned = [
        f.name
        for f in out.schema.fields
        if isinstance(f.dataType, T.TimestampType) and (columns is None or f.name in columns)
    ]
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in zoned}) if zoned else out


def coerce_numeric(df: DataFrame, keys: Iterable[str] = ()) -> DataFrame:
    """Text columns whose every value reads as a number become doubles; key columns are left alone."""
    keys = set(keys)
    return _convert_whole_columns(
        df, {c: F.col(c).try_cast("double") for c in _text_columns(df) if c not in keys}
    )


def read_lookup_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def scan_in_list(df: DataFrame, column: str, values: Iterable[object], casts: Mapping[str, str]) -> DataFrame:
    """Rows whose column is in the list, projected to the cast columns."""
    return df.filter(F.col(column).isin(*values)).select(*[F.col(c).cast(t).alias(c) for c, t in casts.items()])
