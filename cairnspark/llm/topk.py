"""Exact top-k inner products without random access.

Every dimension of a slab of candidates is a sorted list, read from its high end by queries with a positive weight and from its
low end by those with a negative one, step by step in depth. A candidate's score lies between a lower bound (the sum of its entries
that were read, and the far end of each list for the rest) and an upper bound (that sum, and the list's frontier for the
rest). Candidates whose upper bound is below the k-th best lower bound are outsiders. A query stops reading when few others are left; these
get their final scores. A step adds what it reads to the sums of all its queries and candidates at once, as matrix products.

Queries and candidates meet in a grid of (query block x candidate slab) tasks of bounded size; each returns its k best, and the
best of these are the answer.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table
from .vectors import pack, unpack, valid_vectors

#: Queries in a block and candidates in a slab of the grid, and candidates whose bounds are held at a time.
QUERY_BLOCK, SLAB, AT_A_TIME = 2000, 16_000, 2000
#: Depths at which reading may stop, as shares of the lists.
DEPTHS = (0.5, 0.75, 0.9)
#: Relative error of a sum of doubles, with room to spare.
ERROR = 2.0**-44


def final(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of q with those of x, whole numbers held as doubles; they must fit a long."""
    bound = (np.abs(q) * np.abs(x)).sum(axis=1).max(initial=0)
    if bound < 2**52:
        return np.einsum("ij,ij->i", q, x).astype(np.int64)
    if bound < 2**62 and max(np.abs(q).max(), np.abs(x).max()) < 2**62:
        return np.einsum("ij,ij->i", q.astype(np.int64), x.astype(np.int64))
    out = [sum(int(a) * int(b) for a, b in zip(p, r)) for p, r in zip(q.tolist(), x.tolist())]
    if any(abs(s) >= 1 << 63 for s in out):
        raise OverflowError("a score does not fit a long")
    return np.array(out, np.int64)


def nra(q: np.ndarray, x: np.ndarray, k: int, own: np.ndarray, depths: tuple[float, ...] = DEPTHS, step: int = AT_A_TIME):
    """(query row, candidate row, score) of at least each query's k best (all, if fewer); integer-valued float64 matrices.

    own[i]: row of x that is query i itself, or -1.
    """
    nq, nx = len(q), len(x)
    order = np.argsort(x, axis=0, kind="stable")  # the lists, ascending; read from either end
    rank = np.empty(x.shape, np.int32)
    np.put_along_axis(rank, order, np.arange(nx, dtype=np.int32)[:, None], axis=0)
    ends = np.take_along_axis(x, order[[0, -1]], axis=0) if nx else x
    signed = np.hstack([np.maximum(q, 0), np.minimum(q, 0)])
    slack = ERROR * (np.abs(q) @ np.abs(x).max(axis=0, initial=0))  # of a query's sums
    top = np.full((nq, k), -np.inf)  # the k best scores so far, ascending
    found = []
    for a in range(0, nx, step):
        b = min(nx, a + step)
        block, place = x[a:b], rank[a:b]
        floor = top[:, 0].copy()
        alive = np.ones((nq, b - a), bool)
        seen = np.zeros((nq, b - a))
        reading, before = np.arange(nq), 0
        for share in depths:
            depth = max(before, int(nx * share))
            # what this step reads of each list, from the high end and from the low end
            high = (place >= nx - depth) & (place < nx - before)
            low = (place < depth) & (place >= before)
            s = signed[reading]
            seen[reading] += s @ np.hstack([np.where(high, block, 0), np.where(low, block, 0)]).T
            shut = np.hstack([place < nx - depth, place >= depth])  # not read yet
            frontier = np.concatenate([np.take_along_axis(x, order[[nx - max(1, depth)]], axis=0)[0], np.take_along_axis(x, order[[max(1, depth) - 1]], axis=0)[0]])
            upper = seen[reading] + s @ np.where(shut, frontier, 0).T
            if b - a > k + 1:  # one of the rows may be the query's own
                worst = seen[reading] + s @ np.where(shut, np.concatenate([ends[0], ends[1]]), 0).T
                floor[reading] = np.maximum(floor[reading], np.partition(worst, b - a - k - 1, axis=1)[:, b - a - k - 1] - slack[reading])
            alive[reading] = upper >= (floor - slack)[reading, None]
            reading, before = reading[alive[reading].sum(axis=1) > 4 * k], depth
            if not len(reading):
                break
        i, j = np.nonzero(alive)
        keep = own[i] != j + a
        i, j = i[keep], j[keep]
        score = np.concatenate([np.zeros(0, np.int64), *(final(q[i[n : n + 200_000]], block[j[n : n + 200_000]]) for n in range(0, len(i), 200_000))])
        better = score >= np.nextafter(top[i, 0], -np.inf)
        i, j, score = i[better], j[better], score[better]
        found.append((i, j + a, score))
        by = np.lexsort((score, i))
        cut = np.searchsorted(i[by], np.arange(nq + 1))
        for n in np.flatnonzero(np.diff(cut)):
            new = score[by[cut[n] : cut[n + 1]]][-k:]
            top[n] = np.sort(np.concatenate([top[n], new.astype(np.float64)]))[-k:]
    i, j, score = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    keep = score >= np.nextafter(top[i, 0], -np.inf)
    return i[keep], j[keep], score[keep].astype(np.int64)


def exact_topk(vectors: DataFrame, is_query: Column, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k best other vectors by inner product, ties to the smaller id.

    vectors: (id, vector) with whole numbers, as of ``valid_vectors``; is_query: which of them are queries. Vectors meet only
    those of their own length. Fewer than k others: all of them. No queries or an empty table: no rows.
    """
    n, nq = vectors.agg(F.count("*"), F.count_if(is_query)).first()
    slabs, blocks = max(1, -(-n // SLAB)), max(1, -(-nq // QUERY_BLOCK))
    part = F.pmod(F.xxhash64("first_id"), F.lit(slabs))
    cand = pack(vectors).select(F.lit(False).alias("query"), "*", part.alias("slab"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    ask = pack(vectors, is_query).select(F.lit(True).alias("query"), "*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slabs - 1).cast("long"))).alias("slab"), F.pmod(F.xxhash64("first_id"), F.lit(blocks)).cast("int").alias("block"))

    def cell(pdf: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({c: np.zeros(0, np.int64) for c in ("query_id", "vec_id", "score")})
        ask_, cand_ = pdf[pdf["query"]], pdf[~pdf["query"]]
        if not len(ask_) or not len(cand_):
            return none
        dim = int(pdf["dim"].iloc[0])
        qid, q = unpack(ask_["ids"], ask_["data"], dim)
        vid, x = unpack(cand_["ids"], cand_["data"], dim)
        order = np.argsort(vid)
        at = np.minimum(np.searchsorted(vid[order], qid), len(vid) - 1)
        own = np.where(vid[order][at] == qid, order[at], -1)
        out = []
        for a in range(0, len(qid), QUERY_BLOCK):
            i, j, score = nra(q[a : a + QUERY_BLOCK], x, k, own[a : a + QUERY_BLOCK])
            o = np.lexsort((vid[j], -score, i))
            i, j, score = i[o], j[o], score[o]
            keep = np.arange(len(i)) - np.searchsorted(i, i) < k
            out.append(pd.DataFrame({"query_id": qid[i[keep] + a], "vec_id": vid[j[keep]], "score": score[keep]}))
        return pd.concat(out) if out else none

    near = cand.unionByName(ask).groupBy("dim", "slab", "block").applyInPandas(cell, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, rank, vec_id, score): the 20 largest integer inner products of every twentieth vector. Vectors that are null, empty, or not finite take no part."""
    rows = valid_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    # doubles from 2^53 on are whole numbers
    scaled = F.transform("vector", lambda x: F.when(F.abs(x) < float(1 << 46), F.floor(x * 64.0).cast("double")).otherwise(x * 64.0))
    return exact_topk(rows.select("id", scaled.alias("vector")), F.col("id") % 20 == 0, 20)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
