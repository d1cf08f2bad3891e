"""Operators over ordered rows inside a group: fill-down, look-ahead, occurrence numbers, keep-first and keep-last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fill_down(df: DataFrame, column: str, by: list[str], order: list[str], name: str) -> DataFrame:
    """df with the last non-null value of column up to each row of its group."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(column, ignorenulls=True).over(w))


def look_ahead(df: DataFrame, column: str, by: list[str], order: list[str], steps: int = 2) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.select("*", *[F.lead(column, k).over(w).alias(f"next_{k}") for k in range(1, steps + 1)])


def occurrence(df: DataFrame, by: list[str], order: list[str], name: str = "occurrence") -> DataFrame:
    """df with the number of the row among those of its key, from 1."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def keep_first(df: DataFrame, key: list[str], order: Column) -> DataFrame:
    """The row of each key that comes first; one aggregation with partial results, so a hot key is reduced where it is read."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("r_")).select(*key, "r_.*").select(*df.columns)


def keep_last(df: DataFrame, key: list[str], order: Column) -> DataFrame:
    """The row of each key that comes last, and how many there were (n_rows)."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("r_"), F.count("*").alias("n_rows")).select(*key, "r_.*", "n_rows")
