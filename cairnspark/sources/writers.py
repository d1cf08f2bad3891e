"""Writers. Frames are written by the executors; only one-row metadata passes through the driver."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] = (), single: bool = False) -> None:
    """single: one file, for deliverables of the size of the entity dimension."""
    out = (df.coalesce(1) if single else df).write.mode("overwrite")
    if partition_by:
        out = out.partitionBy(*partition_by)
    out.option("header", True).csv(path) if fmt == "csv" else out.format(fmt).save(path)


def write_json_row(df: DataFrame, path: str) -> None:
    """A one-row frame as a JSON document."""
    rows = df.select(F.to_json(F.struct("*")).alias("json")).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{len(rows)} rows; a metadata document has one")
    df.sparkSession.createDataFrame([(json.dumps(json.loads(rows[0].json), indent=2, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def wide(cells: DataFrame, indicators: list[str], key: list[str] = ("id",), with_status: bool = True) -> DataFrame:
    """One row for each entity: every indicator's value and, beside it, its status."""
    aggs = [F.first("value").alias("value")] + ([F.first("status").alias("status")] if with_status else [])
    out = cells.groupBy(*key).pivot("indicator", indicators).agg(*aggs)
    if not with_status:
        return out.select(*key, *indicators)
    return out.select(*key, *[c for i in indicators for c in (F.col(f"`{i}_value`").alias(i), F.col(f"`{i}_status`").alias(f"{i}__status"))])


def blank_missing(df: DataFrame) -> DataFrame:
    """All columns as strings, nulls as empty ones; for CSV deliverables only."""
    return df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns])


def first_rows(df: DataFrame, order: list[Column | str], n: int) -> DataFrame:
    """The first n rows of a stated order, for reports."""
    return df.orderBy(*order).limit(n)
