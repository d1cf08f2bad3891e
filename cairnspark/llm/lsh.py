"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each table cuts ``m`` Gaussian projections into cells of width ``w``; a bucket is a vector of cells. A query visits its own
bucket and then perturbed ones in the order of their estimated chance of success, which falls with the sum of squared distances from the
query's projection to the boundaries crossed. That order is taken from one template of perturbation sets over the expected
sorted distances, mapped through each query's own order. What the tables' buckets hold is merged, and exact
distances rank it.

Every vector is indexed in every table. Index rows are sharded by bucket, and every bucket is dealt over ``splits`` parts
(more, the larger the table), so a bucket that holds a third of all vectors is split. A query
for which the buckets hold fewer than k vectors is searched again exactly.

More projections in a key cost recall unless the table's neighbours are close, so their number is not told by the table's size alone:
a sample of the queries is searched exactly, and the longest key is taken whose visited buckets hold the sample's true
neighbours often enough. If no key does, all queries are searched exactly.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, mix64, powers, table, trimmed
from .vectors import pack, unpack, valid_vectors

#: Tables; width of a cell in units of the vectors' mean length; buckets visited in each table for each projection in its key.
TABLES, WIDTH, PROBES = 12, 2.0, 100
#: Recall that the sample must show, queries in it, and standard errors it must show it by.
RECALL, SAMPLE, ERRORS = 0.9, 128, 3
#: Vectors of one bucket that a task may hold for each split.
SPLIT_ROWS = 100_000


def projections(n: int) -> int:
    """The most projections that make a bucket: enough that one holds about 16 of n evenly spread vectors."""
    return max(2, int(np.ceil(np.log2(max(2.0, n / 16)))))


class Hasher:
    def __init__(self, dim: int, m: int, spread: float):
        rng = np.random.default_rng([dim, m, 11])
        self.a = rng.standard_normal((dim, TABLES * m)) / spread
        self.b = rng.uniform(0, WIDTH, TABLES * m)
        self.m = m
        self.salt = mix64(np.arange(1, TABLES + 1, dtype=np.uint64))

    def project(self, x: np.ndarray) -> np.ndarray:
        """(vectors, tables, m) projections in cells' widths."""
        return ((x @ self.a + self.b) / WIDTH).reshape(len(x), TABLES, self.m)

    def key(self, cells: np.ndarray) -> np.ndarray:
        """64-bit keys of (..., m) whole cells; the table goes in apart."""
        return mix64((cells.astype(np.int64).astype(np.uint64) * powers(0xD6E8FEB86659FD93, self.m + 1)[1:]).sum(axis=-1, dtype=np.uint64))


def template(m: int, count: int) -> list[tuple[int, ...]]:
    """The first ``count`` perturbation sets, as ranks among the 2m sorted boundary distances, by expected score; no set crosses
    both boundaries of a projection (ranks r and 2m - 1 - r are the two of one)."""
    j = np.arange(1, 2 * m + 1)
    score = np.where(j <= m, j * (j + 1) / (4 * (m + 1) * (m + 2)), 1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2)))
    out: list[tuple[int, ...]] = [()]
    heap = [(float(score[0]), (0,))]
    while heap and len(out) < count:
        s, a = heapq.heappop(heap)
        if len({min(r, 2 * m - 1 - r) for r in a}) == len(a):
            out.append(a)
        last = a[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (s - score[last] + score[last + 1], (*a[:-1], last + 1)))  # shift
            heapq.heappush(heap, (s + score[last + 1], (*a, last + 1)))  # expand
    return out


def probe_keys(h: Hasher, x: np.ndarray, count: int) -> np.ndarray:
    """(vectors, tables, probes) bucket keys in visiting order."""
    m = h.m
    f = h.project(x)
    cell = np.floor(f)
    frac = f - cell
    dist = np.concatenate([frac, 1 - frac], axis=2)  # to the lower, then to the upper boundary
    order = np.argsort(dist, axis=2)
    # pair rank r with rank 2m - 1 - r: sorted distances of the two boundaries of a projection add up to one, so they mirror
    sets = template(m, count)
    out = np.empty((len(x), TABLES, len(sets)), np.uint64)
    mult = powers(0xD6E8FEB86659FD93, m + 1)[1:]
    base = (cell.astype(np.int64).astype(np.uint64) * mult).sum(axis=2, dtype=np.uint64)
    move = np.where(order < m, np.uint64(0) - mult[order % m], mult[order % m])  # what crossing the r-th boundary adds to the key's sum
    for p, a in enumerate(sets):
        out[:, :, p] = base + (move[:, :, list(a)].sum(axis=2, dtype=np.uint64) if a else np.uint64(0))
    return mix64(out)


def sampled_recall(pairs: pd.DataFrame, m: int, spread: float, count: int) -> np.ndarray:
    """Share of each query's neighbours that stand in a bucket it visits. pairs: (query_id, q, x), vectors of a query and of one true neighbour."""
    hit = np.zeros(len(pairs))
    for dim, at in pairs.groupby(pairs["q"].str.len()).indices.items():
        h = Hasher(int(dim), m, spread)
        ids, first, of = np.unique(pairs["query_id"].to_numpy()[at], return_index=True, return_inverse=True)
        asked = np.sort(probe_keys(h, np.stack(pairs["q"].to_numpy()[at[first]]), count), axis=2)
        held = h.key(np.floor(h.project(np.stack(pairs["x"].to_numpy()[at]))))
        for n, (i, row) in enumerate(zip(at, of)):
            spot = [min(int(np.searchsorted(asked[row, t], held[n, t])), asked.shape[2] - 1) for t in range(TABLES)]
            hit[i] = (asked[row, np.arange(TABLES), spot] == held[n]).any()
    return pd.Series(hit).groupby(pairs["query_id"].to_numpy()).mean().to_numpy()


def calibrated(vectors: DataFrame, is_query: Column, k: int, n: int, nq: int, spread: float, probes: int) -> int:
    """The most projections, up to projections(n), with which a sample of the queries shows RECALL; 0 if none does."""
    sample = materialise(vectors.where(is_query).orderBy(F.xxhash64("id"), "id").limit(SAMPLE))
    near = materialise(exact_nearest(vectors, sample, k, n).select("query_id", F.col("vec_id").alias("id")))
    found = vectors.join(F.broadcast(near), "id").select("query_id", F.col("vector").alias("x"))
    pairs = found.join(F.broadcast(sample.select(F.col("id").alias("query_id"), F.col("vector").alias("q"))), "query_id").toPandas()
    if not len(pairs):
        return 0
    for m in range(projections(n), 0, -1):
        share = sampled_recall(pairs, m, spread, probes * m)
        # a sample of all queries has no error
        if share.mean() - ERRORS * share.std() * np.sqrt((1 - min(1.0, len(share) / nq)) / len(share)) >= RECALL:
            return m
    return 0


def search(vectors: DataFrame, is_query: Column, k: int, probes: int = PROBES) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found, by Euclidean distance, ties to the smaller id.

    vectors: (id, vector array<double>) of valid vectors; those of different lengths never meet. All others, if there are fewer than k. No queries or an
    empty table: no rows.
    """
    vectors = materialise(vectors)
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    n, nq, spread = vectors.agg(F.count("*"), F.count_if(is_query), F.avg(norm)).first()
    if not nq:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    spread = float(spread or 1.0) or 1.0
    m, splits = calibrated(vectors, is_query, k, n, nq, spread, probes), max(1, -(-n // SPLIT_ROWS))
    if not m:
        return exact_nearest(vectors, vectors.where(is_query), k, n)
    shards, visits = 2 * TABLES, probes * m

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, _, _, ids, data in zip(*(c.to_pylist() for c in batch.columns)):
                vid, x = unpack([ids], [data], dim)
                h = Hasher(dim, m, spread)
                keys = h.key(np.floor(h.project(x))) ^ h.salt
                shard = (keys % np.uint64(shards)).astype(np.int64)
                part = (mix64(vid.astype(np.uint64)) % np.uint64(splits)).astype(np.int64)
                cells = shard * splits + part[:, None]
                out = []
                for c in np.unique(cells):
                    row, t = np.nonzero(cells == c)
                    rows, inverse = np.unique(row, return_inverse=True)
                    out.append((int(c), dim, False, vid[rows].tobytes(), x[rows].tobytes(), keys[row, t].tobytes(), inverse.astype(np.int32).tobytes()))
                yield blobs(out)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, _, _, ids, data in zip(*(c.to_pylist() for c in batch.columns)):
                all_ids, all_x = unpack([ids], [data], dim)
                h = Hasher(dim, m, spread)
                for a in range(0, len(all_ids), 100):
                    vid, x = all_ids[a : a + 100], all_x[a : a + 100]
                    keys = probe_keys(h, x, visits) ^ h.salt[None, :, None]
                    shard = (keys % np.uint64(shards)).astype(np.int64)
                    out = []
                    for s in range(shards):
                        row, t, p = np.nonzero(shard == s)
                        for part in range(splits if len(row) else 0):
                            out.append((s * splits + part, dim, True, vid.tobytes(), x.tobytes(), keys[row, t, p].tobytes(), row.astype(np.int32).tobytes()))
                    yield blobs(out)

    def blobs(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        names = ["cell", "dim", "query", "ids", "data", "keys", "rows"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)] if out else [pa.array([], t) for t in kinds], names)

    def look(pdf: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        asked, held = pdf[pdf["query"]], pdf[~pdf["query"]]
        if not len(asked) or not len(held):
            return none
        dim = int(pdf["dim"].iloc[0])
        vid, x = unpack(held["ids"], held["data"], dim)
        at = np.cumsum([0, *(len(b) // 8 for b in held["ids"])])
        key = np.frombuffer(b"".join(held["keys"]), np.uint64)
        row = np.concatenate([np.frombuffer(b, np.int32) + o for b, o in zip(held["rows"], at)])
        order = np.argsort(key, kind="stable")
        key, row = key[order], row[order]
        out = []
        for ids, data, keys, rows in zip(asked["ids"], asked["data"], asked["keys"], asked["rows"]):
            qid, q = unpack([ids], [data], dim)
            want, of = np.frombuffer(keys, np.uint64), np.frombuffer(rows, np.int32)
            lo, hi = np.searchsorted(key, want, "left"), np.searchsorted(key, want, "right")
            hit = hi > lo
            lo, hi, of = lo[hit], hi[hit], of[hit]
            o = np.argsort(of, kind="stable")
            lo, hi, of = lo[o], hi[o], of[o]
            ends = np.searchsorted(of, np.arange(len(qid) + 1))
            for i in range(len(qid)):
                a, b = ends[i], ends[i + 1]
                if a == b:
                    continue
                lens = hi[a:b] - lo[a:b]
                spots = np.repeat(lo[a:b] - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(lens.sum())
                c = np.unique(row[spots])
                c = c[vid[c] != qid[i]]
                if not len(c):
                    continue
                d = np.sqrt(((x[c] - q[i]) ** 2).sum(axis=1))
                best = np.lexsort((vid[c], d))[:k]
                out.append((np.full(len(best), qid[i]), vid[c[best]], d[best]))
        if not out:
            return none
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), (np.concatenate(c) for c in zip(*out)))))

    schema = "cell long, dim int, query boolean, ids binary, data binary, keys binary, rows binary"
    both = pack(vectors).mapInArrow(trimmed(index), schema).unionByName(pack(vectors, is_query).mapInArrow(trimmed(ask), schema))
    near = both.groupBy("cell", "dim").applyInPandas(look, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = near.dropDuplicates(["query_id", "vec_id"]).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    found = materialise(ranked.select("query_id", "rank", "vec_id", "score"))
    # too few found: search these queries exactly
    others = vectors.groupBy(F.size("vector").alias("dim")).agg((F.count("*") - 1).alias("others"))
    asked = vectors.where(is_query).select("id", F.size("vector").alias("dim"))
    have = found.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("have"))
    short = asked.join(F.broadcast(others), "dim").join(have, "id", "left").where(F.coalesce("have", F.lit(0)) < F.least(F.lit(k), "others")).select("id")
    short = materialise(short)
    if short.isEmpty():
        return found
    exact = exact_nearest(vectors, vectors.join(short, "id", "left_semi"), k, n)
    return found.join(short.withColumnRenamed("id", "query_id"), "query_id", "left_anti").unionByName(exact)


def exact_nearest(vectors: DataFrame, queries: DataFrame, k: int, n: int, slab: int = 16_000) -> DataFrame:
    """The k nearest of each query by a scan of all vectors, slab by slab."""
    slabs = max(1, -(-n // slab))
    cand = pack(vectors).select(F.lit(False).alias("query"), "*", F.pmod(F.xxhash64("first_id"), F.lit(slabs)).alias("slab"))
    ask = pack(queries).select(F.lit(True).alias("query"), "*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slabs - 1).cast("long"))).alias("slab"))

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        asked, held = pdf[pdf["query"]], pdf[~pdf["query"]]
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(asked) and len(held):
            dim = int(pdf["dim"].iloc[0])
            qid, q = unpack(asked["ids"], asked["data"], dim)
            vid, x = unpack(held["ids"], held["data"], dim)
            for i in range(len(qid)):
                d = np.sqrt(((x - q[i]) ** 2).sum(axis=1))
                d[vid == qid[i]] = np.inf
                best = np.lexsort((vid, d))[: k + 1]
                best = best[vid[best] != qid[i]][:k]
                out.append((np.full(len(best), qid[i]), vid[best], d[best]))
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), (np.concatenate(c) for c in zip(*out)))))

    near = cand.unionByName(ask).groupBy("dim", "slab").applyInPandas(scan, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, rank, vec_id, score): the 10 nearest found of every hundredth vector. Vectors that are null, zero, or not finite take no part."""
    vectors = valid_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", drop_zero=True)
    return search(vectors, F.col("id") % 100 == 0, 10)
