"""Hard negatives by exact inner products, with bounds in a rotated basis.

The vectors' second moments are summed up by Spark; their eigenvectors are an orthogonal basis in which the leading components carry most of every product. A rotation leaves
products as they are. Products are summed over the leading components first; what is left of one is at most the product of the norms of both remainders (Cauchy and Schwarz), plus what
rounding can add. Pairs that cannot qualify by that bound are discarded, and reading stops when few are left; these are verified by products of whole numbers, so no result depends
on the basis or on rounding.

Queries and candidates meet in a grid of (block of queries x slab of candidates) tasks of bounded size. There are two passes: the best rows of an anchor's own label, and
then, inside the windows of scores that these open, the best rows of other labels.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, prepare, table, trimmed
from .topk import final

#: Queries in a block and candidates in a slab of the grid, and of each how many a task's matrices hold at a time.
QUERY_BLOCK, SLAB, QUERY_TILE, TILE = 16_384, 8192, 1000, 2000
#: Shares of the components after which bounds are looked at; the last is all of them.
LEADING = (0.25, 0.5, 1.0)
#: Pairs that one step of the verification holds.
PAIRS = 100_000


def valid_rows(rows: DataFrame, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """(id long, label long, vector array<double>) of the rows that take part.

    A null id, a null label, a null or empty vector, or one with a null or non-finite component takes no part. An id that stands on several rows counts once, with its
    smallest vector (of equal ones the smallest label).
    """
    v = F.col("vector")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    out = rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    out = out.where(F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~bad)
    return out.groupBy("id").agg(F.min(F.struct("vector", "label")).alias("r")).select("id", "r.label", "r.vector")


def whole(vector: str, factor: float) -> Column:
    """floor(factor * x) of each component; doubles from 2^53 on are whole numbers as they are."""
    return F.transform(vector, lambda x: F.when(F.abs(x) < float(1 << 44), F.floor(x * factor).cast("double")).otherwise(x * factor))


def _matrix(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, all components one after the other) of a list column."""
    off = lists.offsets.to_numpy()
    return np.diff(off), lists.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]]


def rotations(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each length of vectors, an orthogonal basis by falling eigenvalue of the sum of outer products of the unit vectors. Sums are made by task and added up by Spark."""
    prepare(vectors.sparkSession)

    def run(batches):
        grams: dict[int, np.ndarray] = {}
        for batch in batches:
            dims, flat = _matrix(batch.column(0))
            starts = np.concatenate([[0], np.cumsum(dims)])[:-1]
            for d in np.unique(dims).tolist():
                x = flat[starts[dims == d][:, None] + np.arange(d)]
                top = np.abs(x).max(axis=1, keepdims=True)
                x = x / np.where(top > 0, top, 1)
                x /= np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)
                grams[d] = grams.get(d, 0.0) + x.T @ x
        for d, g in grams.items():
            i, j = np.triu_indices(d)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), d, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(g[i, j])], ["dim", "i", "j", "v"])

    sums = vectors.select("vector").mapInArrow(trimmed(run), "dim int, i int, j int, v double").groupBy("dim", "i", "j").agg(F.sum("v").alias("v")).toPandas()
    out = {}
    for d, part in sums.groupby("dim"):
        g = np.zeros((d, d))
        g[part["i"], part["j"]] = g[part["j"], part["i"]] = part["v"]
        out[int(d)] = np.ascontiguousarray(np.linalg.eigh(g)[1][:, ::-1])
    return out


class Rotated:
    """Rows of whole numbers, beside them in the basis, and the norms of what is left of them after each number of components."""

    def __init__(self, rows: np.ndarray, basis: np.ndarray):
        self.whole, self.turned = rows, rows @ basis
        n, d = rows.shape
        self.norm = np.sqrt((rows * rows).sum(axis=1)) if n else np.zeros(0)
        self.left = np.zeros((n, d + 1))
        self.left[:, :d] = np.sqrt(np.cumsum(self.turned[:, ::-1] ** 2, axis=1))[:, ::-1]

    def __getitem__(self, part: slice) -> Rotated:
        out = object.__new__(Rotated)
        for name in ("whole", "turned", "norm", "left"):
            setattr(out, name, getattr(self, name)[part])
        return out

    def __len__(self) -> int:
        return len(self.whole)


def bounds(q: Rotated, x: Rotated, shares: tuple[float, ...] = LEADING):
    """(lower, upper) of all products after each share of the components: the partial product, less and plus the bound of the remainder and of rounding."""
    d, at = q.whole.shape[1], 0
    got = np.zeros((len(q), len(x)))
    # the basis, both rotations and the sum err by a few d units of the last place of the product of the norms; so do the remainders
    slack = (16 * d + 64) * 2.0**-53 * np.outer(q.norm, x.norm)
    for share in shares:
        to = max(at, min(d, round(d * share)))
        got += q.turned[:, at:to] @ x.turned[:, at:to].T
        at = to
        rest = np.outer(q.left[:, at], x.left[:, at]) + slack
        yield got - rest, got + rest


def _kth(score: np.ndarray, ok: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest score of each row among those that are ok; minus infinity where there are fewer."""
    if score.shape[1] < k:
        return np.full(len(score), -np.inf)
    return np.partition(np.where(ok, score, -np.inf), score.shape[1] - k, axis=1)[:, score.shape[1] - k]


def _verified(q: Rotated, x: Rotated, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *(final(q.whole[i[n : n + PAIRS]], x.whole[j[n : n + PAIRS]]) for n in range(0, len(i), PAIRS))])


def _first(group: np.ndarray, score: np.ndarray, ident: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first of each group, by falling score, then by id."""
    o = np.lexsort((ident, -score, group))
    g = group[o]
    return o[np.arange(len(g)) - np.searchsorted(g, g) < k]


def best_of_label(q: Rotated, q_id, q_label, x: Rotated, x_id, x_label, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, score) of each query's k best other candidates of its own label; ties to the smaller id."""
    found = [np.zeros(0, np.int64)] * 3
    floor = np.full(len(q), -np.inf)
    for a in range(0, len(x), TILE):
        part, ident = x[a : a + TILE], x_id[a : a + TILE]
        may = (q_label[:, None] == x_label[None, a : a + TILE]) & (q_id[:, None] != ident[None, :])
        for lower, upper in bounds(q, part):
            floor = np.maximum(floor, _kth(lower, may, k))
            may &= upper >= floor[:, None]
            if may.sum() <= 2 * k * len(q):
                break
        i, j = np.nonzero(may)
        new = (i, j + a, _verified(q, part, i, j))
        i, j, score = (np.concatenate(c) for c in zip(found, new))
        keep = _first(i, score, x_id[j], k)
        found = [i[keep], j[keep], score[keep]]
        n = np.bincount(found[0], minlength=len(q))
        worst = np.full(len(q), np.inf)
        np.minimum.at(worst, found[0], found[2].astype(np.float64))
        floor = np.where(n >= k, np.maximum(floor, np.nextafter(worst, -np.inf)), floor)
    return found[0], found[1], found[2]


def best_in_windows(q: Rotated, q_label, low: np.ndarray, high: np.ndarray, x: Rotated, x_id, x_label, k: int):
    """(query row, window, candidate row, score) of the k best candidates of other labels with low <= score <= high, for each window (column) of each query."""
    found = [np.zeros(0, np.int64)] * 4
    n_windows = low.shape[1]
    # doubles around the whole numbers, and inside them; an empty window has low > high
    a_, b_ = low.astype(np.float64), high.astype(np.float64)
    lo, hi, lo_sure, hi_sure = np.nextafter(a_, -np.inf), np.nextafter(b_, np.inf), np.nextafter(a_, np.inf), np.nextafter(b_, -np.inf)
    for bound, never in ((lo, np.inf), (hi, -np.inf), (lo_sure, np.inf), (hi_sure, -np.inf)):
        bound[low > high] = never
    floor = np.full(low.shape, -np.inf)
    for a in range(0, len(x), TILE):
        part = x[a : a + TILE]
        may = q_label[:, None] != x_label[None, a : a + TILE]
        for lower, upper in bounds(q, part):
            some = np.zeros_like(may)
            for w in range(n_windows):
                sure = may & (lower >= lo_sure[:, w, None]) & (upper <= hi_sure[:, w, None])
                floor[:, w] = np.maximum(floor[:, w], _kth(lower, sure, k))
                some |= may & (upper >= np.maximum(lo[:, w], floor[:, w])[:, None]) & (lower <= hi[:, w, None])
            may = some
            if may.sum() <= 2 * k * n_windows * len(q):
                break
        i, j = np.nonzero(may)
        score = _verified(q, part, i, j)
        for w in range(n_windows):
            ok = (score >= low[i, w]) & (score <= high[i, w])
            new = (i[ok], np.full(ok.sum(), w, np.int64), j[ok] + a, score[ok])
            found = [np.concatenate(c) for c in zip(found, new)]
        keep = _first(found[0] * n_windows + found[1], found[3], x_id[found[2]], k)
        found = [c[keep] for c in found]
        worst, n = np.full(low.shape, np.inf), np.zeros(low.shape, np.int64)
        np.minimum.at(worst, (found[0], found[1]), found[3].astype(np.float64))
        np.add.at(n, (found[0], found[1]), 1)
        floor = np.where(n >= k, np.maximum(floor, np.nextafter(worst, -np.inf)), floor)
    return found


_BLOCK = "dim int, slab int, ids binary, labels binary, data binary, extra binary"


def _blocks(vectors: DataFrame, slab: Column) -> DataFrame:
    """Vectors of one length and slab in blocks of at most an Arrow batch. extra: an array<long> column of one length, packed too."""

    def run(batches):
        for batch in batches:
            ids, labels, slabs = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(3))
            dims, flat = _matrix(batch.column(3))
            extra_len, extra = _matrix(batch.column(4))
            starts = np.concatenate([[0], np.cumsum(dims)])[:-1]
            extra = extra.reshape(len(ids), -1) if len(ids) and extra_len[0] else np.zeros((len(ids), 0), np.int64)
            key = dims.astype(np.int64) << 32 | slabs
            for k in np.unique(key).tolist():
                at = np.flatnonzero(key == k)
                d = k >> 32
                row = (d, k & 0xFFFFFFFF, ids[at].tobytes(), labels[at].tobytes(), flat[starts[at][:, None] + np.arange(d)].astype(np.float64).tobytes(), extra[at].astype(np.int64).tobytes())
                kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 4)
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], ["dim", "slab", "ids", "labels", "data", "extra"])

    extra = F.col("extra") if "extra" in vectors.columns else F.array().cast("array<long>")
    dealt = vectors.select("id", "label", slab.cast("int").alias("slab"), "vector", extra.alias("extra")).repartition("slab")
    return dealt.mapInArrow(trimmed(run), _BLOCK)


def _grid(ask: DataFrame, vectors: DataFrame, n_ask: int, n: int, cell, schema: str) -> DataFrame:
    """cell(queries, candidates) for every block of ask and slab of vectors: a candidate is sent to each block of queries, a query to each slab."""
    slabs, blocks = max(1, -(-n // SLAB)), max(1, -(-n_ask // QUERY_BLOCK))
    hashed = lambda m: F.pmod(F.xxhash64("id"), F.lit(m))
    right = _blocks(vectors, hashed(slabs)).select(F.lit(False).alias("query"), "*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    left = _blocks(ask, hashed(blocks)).withColumnRenamed("slab", "block").select(F.lit(True).alias("query"), "*", F.explode(F.sequence(F.lit(0), F.lit(slabs - 1))).alias("slab"))
    names = [f.split()[0] for f in schema.split(", ")]

    def arrays(blocks_: pd.DataFrame, dim: int) -> tuple[np.ndarray, ...]:
        """(ids, labels, matrix, extra) of all blocks."""
        ids, labels, extra = (np.frombuffer(b"".join(blocks_[c]), np.int64) for c in ("ids", "labels", "extra"))
        return ids, labels, np.frombuffer(b"".join(blocks_["data"]), np.float64).reshape(-1, dim), extra.reshape(len(ids), -1) if len(ids) else extra

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        dim = int(pdf["dim"].iloc[0])
        q, x = arrays(pdf[pdf["query"]], dim), arrays(pdf[~pdf["query"]], dim)
        got = [cell(dim, tuple(c[a : a + QUERY_TILE] for c in q), x) for a in range(0, len(q[0]), QUERY_TILE)] if len(x[0]) else []
        return pd.concat([pd.DataFrame({c: np.zeros(0, np.int64) for c in names}), *(pd.DataFrame(dict(zip(names, g))) for g in got)])

    return left.unionByName(right).groupBy("dim", "slab", "block").applyInPandas(run, schema)


def mine(vectors: DataFrame, is_anchor: Column, n_positives: int, k: int, low: tuple[int, int] = (50, 100), high: tuple[int, int] = (95, 100)) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives of every anchor and positive.

    vectors: (id, label, vector) of whole numbers, one row an id; is_anchor: which are anchors. An anchor's positives are its ``n_positives`` best other rows of its label. The negatives of an anchor
    and a positive are the ``k`` best rows of other labels with low * positive <= negative <= high * positive (fractions); a window without a row gives none, as does every
    negative positive score. Higher inner products come first, ties by smaller id. Vectors meet only those of their own length. A product that fits no long is an error. Without
    anchors, or on an empty table, there are no rows.
    """
    spark = vectors.sparkSession
    vectors = materialise(vectors)
    bases = spark.sparkContext.broadcast(rotations(vectors))  # of the size of the square of the vectors' length
    n, n_ask = vectors.agg(F.count("*"), F.count_if(is_anchor)).first()
    anchors = vectors.where(is_anchor)

    def positives(dim, q, x):
        basis = bases.value[dim]
        i, j, score = best_of_label(Rotated(q[2], basis), q[0], q[1], Rotated(x[2], basis), x[0], x[1], n_positives)
        return q[0][i], x[0][j], score

    near = _grid(anchors, vectors, n_ask, n, positives, "anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    near = materialise(near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n_positives))
    # the positives beside their anchor, a fixed number of places; a place without one has a count of zero
    each = near.groupBy("anchor_id").agg(*[F.max(F.when(F.col("place") == p, F.col(c))).alias(f"{c}_{p}") for p in range(1, n_positives + 1) for c in ("positive_id", "positive_score")])
    cells = [F.coalesce(c, F.lit(0)) for p in range(1, n_positives + 1) for c in (F.col(f"positive_id_{p}").isNotNull().cast("long"), F.col(f"positive_id_{p}"), F.col(f"positive_score_{p}"))]
    ask = anchors.join(each, anchors["id"] == each["anchor_id"]).select("id", "label", "vector", F.array(*cells).alias("extra"))

    def part(score: np.ndarray, share: tuple[int, int], up: bool) -> np.ndarray:
        """score * share, rounded up or down, without leaving 64 bits."""
        a, b = share
        whole_, rest = score // b, score % b
        return whole_ * a + (-(-rest * a // b) if up else rest * a // b)

    def negatives(dim, q, x):
        basis = bases.value[dim]
        there, ident, score = (q[3].reshape(len(q[0]), -1, 3)[:, :, c] for c in range(3))
        lo, hi = part(score, low, True), part(score, high, False)
        lo, hi = np.where(there == 1, lo, 1), np.where(there == 1, hi, 0)
        i, w, j, s = best_in_windows(Rotated(q[2], basis), q[1], lo, hi, Rotated(x[2], basis), x[0], x[1], k)
        return q[0][i], ident[i, w], x[0][j], score[i, w], s

    hard = _grid(ask, vectors, n_ask, n, negatives, "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = hard.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every fiftieth vector: 5 positives, 3 negatives each, labels of every seventh vector moved by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = valid_rows(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", moved)
    return mine(rows.select("id", "label", whole("vector", 256.0).alias("vector")), F.col("id") % 50 == 0, 5, 3)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS same, CAST(list_inner_product(CAST(a.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0
), pos AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM p WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), r AS (
  SELECT pos.anchor_id, positive_id, positive_score, p.vec_id AS negative_id, p.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY pos.anchor_id, positive_id ORDER BY p.score DESC, p.vec_id) AS INTEGER) AS rank
  FROM pos JOIN p ON p.anchor_id = pos.anchor_id AND NOT p.same WHERE 50 * positive_score <= 100 * p.score AND 100 * p.score <= 95 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM r WHERE rank <= 3
"""
