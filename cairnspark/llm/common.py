"""Shared pieces of the llm operators: table access, the shared scratch folder, byte-level NumPy helpers.

Every operator reads its tables through Spark (never with open()), cuts lineage only with tables written to the
folder named in ``spark.checkpoint.dir``, and works on Arrow batches in slices of bounded size.
"""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Text bytes that one vectorised step handles; a longer document is a slice of its own.
SLICE_BYTES = 1 << 19
#: Rows in an Arrow batch handed to Python.
BATCH_ROWS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Arrow batches small enough that long documents do not pile up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


#: What empties each cache that an operator keeps in a Python worker from task to task.
CACHES: dict[str, Callable[[], None]] = {}


def trimmed(run, keeps: str = ""):
    """run, before which the Python worker drops other operators' caches, and after which it gives free memory back: idle workers stay alive beside those of the next stage.

    keeps: name of the cache that run uses.
    """

    def mapped(batches):
        from cairnspark.llm import common  # the worker's own: what is pickled with this function is a copy

        for name, drop in common.CACHES.items():
            if name != keeps:
                drop()
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            libc = ctypes.CDLL(None)
            if hasattr(libc, "malloc_trim"):
                libc.malloc_trim(0)

    return mapped


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only on one machine whose session names none (tests)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="cairnspark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_made: list[str] = []


def materialise(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """df written as Parquet to the shared folder and read back: lineage ends there and survives lost executors.

    The shuffle files of the write go when it is done.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/t-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Deletes, at its end, the tables that were materialised inside it and are not kept. Only what a plan still to run does not read may go."""

    def __init__(self, spark: SparkSession):
        self.spark, self.kept = spark, set()

    def __enter__(self) -> Scratch:
        self.start = len(_made)
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        """df, whose files stay."""
        self.kept |= {f.rpartition("/")[0].rpartition("/t-")[2] for f in df.inputFiles()}
        return df

    def __exit__(self, *error) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        stay = []
        for path in _made[self.start :]:
            if path.rpartition("/t-")[2] in self.kept:
                stay.append(path)
            else:
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(conf).delete(p, True)
        _made[self.start :] = stay


def text_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes as uint8, offsets as int64) of a string or binary column; a null counts as empty.

    The offsets have one entry more than the column has rows.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of rows with at most ``limit`` bytes together, or of one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Odd multiplier of the polynomial rolling hash modulo 2^64, and its inverse.
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 1 << 22:
            _powers[base] = have
    return have[:n]


_rng = np.random.default_rng(20240607)
#: A random 64-bit value for each byte.
BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def prefix_hash(data: np.ndarray, code: np.ndarray = BYTE_CODE) -> np.ndarray:
    """P with P[i] = sum over j < i of code[data[j]] * BASE^j modulo 2^64."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(code[data] * powers(BASE, len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end), independent of where they stand."""
    n = len(prefix)
    return mix64((prefix[end] - prefix[start]) * powers(BASE_INV, n)[start] + (end - start).astype(np.uint64))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Lower-cases A-Z and leaves all other bytes alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word ``[^\\x20\\x09-\\x0D]+``; words end with their row."""
    n = len(data)
    if not n:
        e = np.zeros(0, np.int64)
        return e, e, e
    inside = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True  # a row's first byte, and the end
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values, and the length as last entry."""
    n = len(sorted_keys)
    if not n:
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1, [n]])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    edges: (a long, b long), undirected, loops allowed. Returns (id long, component long) for every id in a proper
    edge: component is the smallest id of its component. Each round is a shuffle with map-side combining; a hub's
    neighbours are never gathered in a list, only joined to the minimum of its group. Rounds grow with the logarithm of the
    component's size.
    """
    from pyspark.sql import functions as F

    with Scratch(edges.sparkSession) as scratch:
        cur = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        before = None
        for _ in range(max_rounds):
            # large star: every larger neighbour of a goes to the least of a and its neighbours
            both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
            large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
            # small star: all smaller neighbours of a, and a itself, go to the least of them
            least = large.groupBy("a").agg(F.min("b").alias("m"))
            small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            cur = materialise(small.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
            # a star forest is the fixpoint: the edges stay as they are
            state = tuple(cur.agg(F.count("*"), F.sum(F.col("b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("a", "b"))).first())
            if state == before:
                break
            before = state
        else:
            raise RuntimeError("components did not settle")
        scratch.keep(cur)
    named = cur.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return named.union(named.select("component", "component").distinct())
