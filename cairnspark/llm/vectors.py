"""Vectors packed in blocks: one row holds the ids and the matrix of many vectors, so shuffles move few, dense rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, trimmed

BLOCK_SCHEMA = "dim int, first_id long, n int, ids binary, data binary"


def valid_vectors(rows: DataFrame, id_col: str, vector_col: str, drop_zero: bool = False) -> DataFrame:
    """(id long, vector array<double>) of the vectors that take part.

    A vector that is null, empty, or holds a null or non-finite component, and a row without id, take no part; with
    ``drop_zero`` neither does a vector of zeros. An id that stands on several rows counts once, with its smallest vector.
    """
    v = F.col("vector")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    out = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    out = out.where(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~bad)
    if drop_zero:
        out = out.where(F.exists(v, lambda x: x != 0))
    return out.groupBy("id").agg(F.min("vector").alias("vector"))


def pack(vectors: DataFrame, keep: Column | None = None) -> DataFrame:
    """(dim, first_id, n, ids, data): vectors of one length in blocks of at most an Arrow batch; data is float64, row by row."""
    prepare(vectors.sparkSession)
    src = vectors if keep is None else vectors.where(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            lists = batch.column(1)
            off = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False)
            dims = np.diff(off)
            out = []
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                data = flat[(off[at][:, None] + np.arange(d)).reshape(-1)]
                out.append((int(d), int(ids[at[0]]), len(at), ids[at].astype(np.int64).tobytes(), data.astype(np.float64).tobytes()))
            if out:
                kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["dim", "first_id", "n", "ids", "data"])

    return src.select("id", "vector").mapInArrow(trimmed(run), BLOCK_SCHEMA)


def unpack(ids, data, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, matrix) of several blocks of one length."""
    a = np.frombuffer(b"".join(ids), np.int64)
    return a, np.frombuffer(b"".join(data), np.float64).reshape(len(a), dim)
