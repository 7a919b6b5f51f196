"""CSV with declared types, and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.relational import type_string


def read_csv(spark: SparkSession, path: str, types: dict[str, str], na: str = "NA") -> DataFrame:
    """The named columns of CSV files with a header, each by its type; all other columns are skipped.

    A column that isn't there is null. ``na`` and the empty text are null. Values that don't fit are null, as a file of
    a million rows isn't given up for one of them.
    """
    raw = spark.read.csv(path, header=True, inferSchema=False, nullValue=na, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    have = set(raw.columns)
    return raw.select(*((F.col(f"`{c}`").try_cast(t) if c in have else F.lit(None).cast(t)).alias(c) for c, t in types.items()))


def read_csv_inferred(spark: SparkSession, path: str) -> DataFrame:
    """CSV files with a header and types by looking at all values; costs a pass more than declared types."""
    return spark.read.csv(path, header=True, inferSchema=True, nullValue="NA")


def read_csv_types(spark: SparkSession, path: str, code: str) -> DataFrame:
    """CSV files with a header and a compact type string, a letter a column."""
    names = spark.read.csv(path, header=True, inferSchema=False).columns
    schema = type_string(code, names)
    return read_csv(spark, path, {f.name: f.dataType.simpleString() for f in schema})


def write_csv(df: DataFrame, path: str) -> None:
    """Many part files with a header; nulls as NA. Nested columns must be flattened before."""
    df.write.mode("overwrite").csv(path, header=True, nullValue="NA", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def append(df: DataFrame, path: str, like: T.StructType | None = None) -> None:
    """Adds rows to a Parquet table; with ``like`` the columns are matched to its schema by name, and must all be there."""
    df = df if like is None else df.select(*(F.col(f.name).cast(f.dataType) for f in like))
    df.write.mode("append").parquet(path)


def overwrite(df: DataFrame, path: str, by: list[str] = [], sort: list[str] = []) -> None:  # noqa: B006
    """Replaces a Parquet table; ``by`` partitions its folders, ``sort`` orders rows within files so that scans can skip."""
    w = df.sortWithinPartitions(*sort) if sort else df
    (w.write.partitionBy(*by) if by else w.write).mode("overwrite").parquet(path)


def snapshot(df: DataFrame, path: str, sort: list[str] = []) -> DataFrame:  # noqa: B006
    """A materialized view: drops what was there, writes the rows and reads them back."""
    overwrite(df, path, sort=sort)
    return df.sparkSession.read.parquet(path)
