"""Shared pieces of the operators: word columns, tables in the shared folder, size-checked broadcasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, run_dir, ship  # noqa: F401  for the operators

#: Rows of at most a few dozen bytes that may be broadcast: about 16 MB.
BROADCAST_ROWS = 250_000
#: The same for tables whose rows have no bound: their summed bytes.
BROADCAST_BYTES = 16_000_000


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only if the counted ``rows`` keep it under the bound; else leave a shuffled join."""
    return F.broadcast(df) if rows <= limit else df


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null gives none."""
    flat = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.array_remove(F.split(flat, " "), "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
