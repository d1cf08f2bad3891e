"""Ranks of entities over many draws of weights, without a row for each draw and entity.

Entities are dealt to blocks and scored block by block, for a block of draws at a time, as matrices. The task that ranks one bucket of scores for one block of draws gets the pillar scores of the entities that
may be in it, once for all these draws (which lie near each other), and scores them again; where scores come with the entities, it gets those, sorted and as small differences. What comes back is, in the order of
scores, how many of the bucket are not higher, as packed differences: no id, draw or score is sent with a cell, since the block scores its entities again and knows the order. That is about a byte
for each draw and entity. Buckets are cut, draw by draw, at quantiles of a bounded sample of entities, which decides only how evenly work is spread; exact counts of every bucket are the offsets, so ranks are
exact however many entities there are. A block then has all ranks of its entities side by side, and gives their histograms or statistics.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stable import stable

#: Cells (draws x entities) that are worked on at a time and that a bucket's task has, entities that a bucket should hold, most buckets, and entities of the sample that cuts buckets.
CELLS, BUCKET, BUCKETS, SAMPLE = 4_000_000, 20_000, 64, 4096
#: Ranks that a block may hold, and blocks there should be at least. The more entities in a block, the less its ranks differ from one to the next.
HELD, BLOCKS = 72_000_000, 64


def _scores(x: np.ndarray, w: np.ndarray, lam: float, digits: int) -> np.ndarray:
    """Entities x draws, in units of the last digit. x: pillar scores, the dampener last, absent ones 0; w: draws x drivers."""
    out = np.empty((len(x), len(w)), np.int64)
    some = max(1, 32_768 // max(1, len(w)))  # rows that stay in the processor's cache
    for a in range(0, len(x), some):
        y, s = x[a : a + some], np.zeros((len(x[a : a + some]), len(w)))
        for k in range(w.shape[1]):
            s += y[:, k, None] * w[:, k]
        out[a : a + some] = np.rint((s - lam * y[:, -1, None]) * 10.0**digits)
    return out


def _packed(v: np.ndarray, counts: np.ndarray) -> tuple[bytes, int, bytes]:
    """Ascending runs of counts[k] numbers each: (first of each run, bytes of a difference, differences: all first bytes, all second ones, .., as Huffman codes)."""
    first = (np.cumsum(counts) - counts)[counts > 0]
    d = np.diff(v, prepend=0)
    d[first] = 0
    width = next(b for b in (1, 2, 4, 8) if b == 8 or not len(d) or d.max() < 1 << 8 * b)
    code = zlib.compressobj(1, zlib.DEFLATED, -15, 9, zlib.Z_RLE)
    return v[first].tobytes(), width, code.compress(d.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()) + code.flush()


def _unpacked(base: bytes, width: int, diffs: bytes, counts: np.ndarray) -> np.ndarray:
    d = np.frombuffer(zlib.decompress(diffs, -15), np.uint8).reshape(width, -1)
    v = np.cumsum(np.ascontiguousarray(d.T).view(f"<u{width}").ravel().astype(np.int64))
    some = counts[counts > 0]
    first = np.cumsum(some) - some
    return v + np.repeat(np.frombuffer(base, np.int64) - v[first], some)


def _by_block(pillars: DataFrame, draws: DataFrame, lam: float, dampener: str, digits: int, bucket: int, read, schema: str, mirrored: bool = False) -> DataFrame:
    """read(ids, ranks: entities x draws, number of all entities) of each block of entities, a frame of ``schema``.

    pillars: (id, pillar, score); draws: (draw, pillar, weight), the driver's own small table. A draw's score is the weighted sum of the pillars that are there, less lam times the dampener, rounded to ``digits``. An
    entity without any weighted pillar takes no part. mirrored: behind the draws come the same ones again, ranked from the lowest score on. Memory: a task holds CELLS cells and what belongs to them.
    """
    weight: dict[int, dict[str, float]] = {}
    for d, p, x in draws.collect():
        weight.setdefault(d, {})[p] = x
    names = sorted({p for w in weight.values() for p in w} - {dampener})
    w = np.array([[weight[d].get(p, 0.0) for p in names] for d in sorted(weight)]).reshape(len(weight), len(names))
    if not mirrored and len(names) > 1:  # draws of like weights side by side, in strips; what is read does not depend on their order
        strips = max(1, int(np.sqrt(len(w) / 200)))
        w = w[np.lexsort((w[:, 1], np.argsort(np.argsort(w[:, 0])) * strips // max(1, len(w))))]
    wide = pillars.groupBy("id").pivot("pillar", [*names, dampener]).agg(F.first("score"))
    there = F.coalesce(*[F.col(f"`{p}`") for p in names]).isNotNull() if names else F.lit(False)
    rows = stable(wide.where(there).select("id", F.array(*[F.coalesce(F.col(f"`{p}`"), F.lit(0.0)).cast("double") for p in [*names, dampener]]).alias("x")))
    sign = np.concatenate([np.ones(len(w), np.int64), np.full(len(w), -1)])
    both = np.concatenate([w, w]) if mirrored else w
    return _ranked(rows, lambda x, p, q: _scores(x, both[p:q], lam, digits) * sign[p:q], len(both), bucket, read, schema, True)


def _ranked(rows: DataFrame, score, draws: int, bucket: int, read, schema: str, again: bool = False) -> DataFrame:
    """As ``_by_block``, of evaluated rows (id, x: array<double>): score(x: entities x numbers, p, q) are the whole-number scores, entities x draws, of draws p to q.

    again: x is short, and buckets get it in place of scores.
    """
    n = rows.count()
    n_buckets = min(BUCKETS, max(1, -(-n // bucket)))
    cuts = np.zeros((draws, 0), np.int64)
    if n_buckets > 1:
        sample = np.array([r.x for r in rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("x").collect()])
        cuts = np.floor(np.quantile(score(sample, 0, draws), np.arange(1, n_buckets) / n_buckets, axis=0)).astype(np.int64).T.copy()
    step = max(1, min(250, CELLS // max(1, -(-n // n_buckets))))
    blocks = [(a, min(a + step, draws)) for a in range(0, draws, step)]
    part = max(1, CELLS // max(1, draws))
    size = max(1, min(HELD // max(1, draws), max(part, n // BLOCKS)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-n // size)))).cast("int"))

    def counts_of(s: np.ndarray, a: int) -> np.ndarray:
        """Buckets x draws: how many of each sorted column are in each bucket."""
        edge = np.stack([np.searchsorted(s[:, k], cuts[a + k], "right") for k in range(s.shape[1])], 1)
        return np.diff(edge, axis=0, prepend=0, append=len(s))

    def regrouped(counts: np.ndarray) -> np.ndarray:
        """Where each cell, bucket by bucket and in it draw by draw, stands in the columns laid end to end."""
        of = np.repeat(np.tile(np.arange(len(counts), dtype=np.uint16), counts.shape[1]), counts.T.ravel())
        return np.argsort(of, kind="stable")

    def bucket_of(s: np.ndarray, a: int) -> np.ndarray:
        return np.stack([np.searchsorted(cuts[a + k], v).astype(np.uint8) for k, v in enumerate(np.ascontiguousarray(s.T))], 1)

    inside = np.zeros((n_buckets, draws), np.int64)

    def counted(batches):
        total = np.zeros((n_buckets, draws), np.int64)
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), float)
            for a, b in blocks:
                of = bucket_of(score(x, a, b), a) + np.arange(b - a, dtype=np.int64) * n_buckets
                total[:, a:b] += np.bincount(of.ravel(), minlength=n_buckets * (b - a)).reshape(b - a, n_buckets).T
        c, d = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(d), pa.array(total[c, d])], ["bucket", "draw", "n"])

    for r in rows.select("x").mapInArrow(counted, "bucket long, draw long, n long").groupBy("bucket", "draw").agg(F.sum("n").alias("n")).collect():  # BUCKETS x draws at most
        inside[r.bucket, r.draw] = r.n
    width = len(rows.select("x").first().x) if again and n else 0
    shared = rows.sparkSession.sparkContext.broadcast(inside[::-1].cumsum(axis=0)[::-1])  # in this bucket and all higher ones
    head = ["block", "number", "bucket", "base", "width", "diffs"]
    kinds = "block int, number int, bucket int, base binary, width int, diffs binary"

    def scored(pdf: pd.DataFrame) -> pd.DataFrame:
        x, out = np.array(pdf["x"].tolist(), float), []
        for number, (a, b) in enumerate(blocks):
            if again:
                ends = [(of.min(axis=1), of.max(axis=1)) for of in (bucket_of(score(x[p : p + 2 * part], a, b), a) for p in range(0, len(x), 2 * part))]
                lo, hi = (np.concatenate(e) for e in zip(*ends))
                for c in range(n_buckets):
                    inside_ = (lo <= c) & (c <= hi)
                    if inside_.any():
                        out.append((int(pdf["block"].iloc[0]), number, c, b"", 0, x[inside_].tobytes(), b""))
                continue
            s = np.sort(score(x, a, b), axis=0)
            counts = counts_of(s, a)
            v, edge = s.T.ravel()[regrouped(counts)], np.concatenate([[0], np.cumsum(counts.sum(axis=1))])
            for c in np.flatnonzero(np.diff(edge)).tolist():
                out.append((int(pdf["block"].iloc[0]), number, c, *_packed(v[edge[c] : edge[c + 1]], counts[c]), counts[c].astype("<u4").tobytes()))
        return pd.DataFrame(out, columns=[*head, "counts"])

    def rescored(x: bytes, number: int, c: int) -> tuple[np.ndarray, np.ndarray]:
        """(scores in bucket c, draw by draw, how many of each draw)."""
        a, b = blocks[number]
        s = np.ascontiguousarray(score(np.frombuffer(x).reshape(-1, width), a, b).T)
        own = np.ones(s.shape, bool)
        if c > 0:
            own &= s > cuts[a:b, c - 1 : c]
        if c < n_buckets - 1:
            own &= s <= cuts[a:b, c : c + 1]
        return s[own], own.sum(axis=1)

    def ranked(pdf: pd.DataFrame) -> pd.DataFrame:
        if again:
            got = [rescored(x, int(m), int(c)) for x, m, c in zip(pdf["diffs"], pdf["number"], pdf["bucket"])]
            pdf, keys, counts = pdf[[len(k) > 0 for k, _ in got]], [k for k, _ in got if len(k)], [c for k, c in got if len(k)]
            if not keys:
                return pd.DataFrame(columns=head)
        else:
            counts = [np.frombuffer(c, "<u4").astype(np.int64) for c in pdf["counts"]]
            keys = [_unpacked(*p, c) for *p, c in zip(pdf["base"], pdf["width"], pdf["diffs"], counts)]
        lo = min(int(k.min()) for k in keys)
        span = max(int(k.max()) for k in keys) - lo + 1
        draw = np.arange(len(counts[0]))
        keys = [np.sort(k - lo + span * np.repeat(draw, c)) for k, c in zip(keys, counts)]
        order = np.sort(np.concatenate(keys))
        begin = np.searchsorted(order, span * draw)
        back = [_packed(np.searchsorted(order, k, "right") - np.repeat(begin, c), c) for k, c in zip(keys, counts)]
        return pd.DataFrame([(*h, *p) for h, p in zip(zip(pdf["block"], pdf["number"], pdf["bucket"]), back)], columns=head)

    def finished(own: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        x = np.array(own["x"].tolist(), float)
        ranks = np.empty((len(x), draws), np.int32)
        piece = {(m, c): p for m, c, *p in zip(back["number"], back["bucket"], back["base"], back["width"], back["diffs"])}
        for number, (a, b) in enumerate(blocks):
            s = np.ascontiguousarray(score(x, a, b).T)
            order = np.argsort(s, axis=1)
            counts = counts_of(np.take_along_axis(s, order, axis=1).T, a)
            found = [shared.value[c, a:b].repeat(counts[c]) - _unpacked(*piece[number, c], counts[c]) + 1 for c in range(n_buckets) if counts[c].any()]
            flat = np.empty(len(x) * (b - a), np.int32)
            flat[regrouped(counts)] = np.concatenate(found)
            np.put_along_axis(s, order, flat.reshape(b - a, len(x)), axis=1)
            ranks[:, a:b] = s.T
        ids = own["id"].to_numpy()
        return pd.concat([read(ids[p : p + part], ranks[p : p + part], n) for p in range(0, len(x), part)], ignore_index=True)

    packed = rows.groupBy("block").applyInPandas(scored, kinds + ", counts binary")
    returned = packed.groupBy("number", "bucket").applyInPandas(ranked, kinds)
    return rows.groupBy("block").cogroup(returned.groupBy("block")).applyInPandas(finished, schema)


def rank_histograms(pillars: DataFrame, draws: DataFrame, lam: float, dampener: str, digits: int = 9, bucket: int = BUCKET) -> DataFrame:
    """(id, draws, entities, ranks): over all draws, an entity's ranks (1 is the highest score, ties share the smallest) as array<struct<rank long, n int>> in order of rank.

    Arguments as of ``_by_block``. No entities or no draws: no rows.
    """

    def read(ids: np.ndarray, ranks: np.ndarray, n: int) -> pd.DataFrame:
        rows = []
        for i, r in zip(ids.tolist(), ranks):
            v, k = np.unique(r, return_counts=True)
            rows.append((i, ranks.shape[1], n, v.astype(np.int64), k.astype(np.int32)))
        return pd.DataFrame(rows, columns=["id", "draws", "entities", "rank", "n"])

    h = _by_block(pillars, draws, lam, dampener, digits, bucket, read, "id long, draws int, entities long, rank array<long>, n array<int>")
    zipped = F.transform(F.arrays_zip("rank", "n"), lambda z: F.struct(z["rank"].alias("rank"), z["n"].alias("n")))
    return h.where("draws > 0").select("id", "draws", "entities", zipped.alias("ranks"))


def rank_statistics(pillars: DataFrame, draws: DataFrame, lam: float, dampener: str, digits: int = 9, top: tuple[int, ...] = (10, 20), percentiles: dict[str, float] | None = None, positions: tuple[float, ...] = (), bucket: int = BUCKET) -> DataFrame:
    """The columns of ``stability``, without a histogram in between; for each of ``positions`` also pos<k>, the rank at int(p * draws) of the sorted ones; percentiles: others than those, by name."""
    read, schema = _statistics(top, percentiles, positions)
    return _by_block(pillars, draws, lam, dampener, digits, bucket, read, schema).withColumn("label", _label())


def score_statistics(scores: DataFrame, draws: int, digits: int = 9, bucket: int = BUCKET) -> DataFrame:
    """The columns of ``rank_statistics``, of scores that come with the entities. scores: (id, x: array<double> of an entity's scores in the draws, of ``digits`` decimals)."""
    read, schema = _statistics((10, 20), None, ())
    whole = lambda x, p, q: np.rint(x[:, p:q] * 10.0**digits).astype(np.int64)
    return _ranked(stable(scores.select("id", "x")), whole, draws, bucket, read, schema).withColumn("label", _label())


def agreement(pillars: DataFrame, draws: DataFrame, base: dict[str, float], lam: float, dampener: str, digits: int = 9, top: int = 20, bucket: int = BUCKET) -> DataFrame:
    """(draw, spearman, top_overlap): each draw's ranking against that of the weights ``base``, ties sharing their average rank; top_overlap: how many of the base's first ``top`` are among the draw's, in percent.

    A block gives its sums for each draw; arguments as of ``_by_block``.
    """
    spark, names = pillars.sparkSession, sorted(r.draw for r in draws.select("draw").distinct().collect())
    own = max(names, default=-1) + 1
    every = draws.select("draw", "pillar", "weight").unionByName(spark.createDataFrame([(own, p, x) for p, x in base.items()], "draw int, pillar string, weight double"))
    sums = ["xx", "yy", "xy", "both", "top"]

    def read(ids: np.ndarray, ranks: np.ndarray, n: int) -> pd.DataFrame:
        down, up = ranks[:, : len(names) + 1].astype(np.int64), ranks[:, len(names) + 1 :]
        mid = (down - up) / 2.0  # the average rank less the mean of all
        x, y, first = mid[:, :-1], mid[:, -1:], down[:, -1:] <= top
        out = (x * x).sum(axis=0), np.repeat((y * y).sum(), x.shape[1]), (x * y).sum(axis=0), ((down[:, :-1] <= top) & first).sum(axis=0), np.repeat(first.sum(), x.shape[1])
        return pd.DataFrame({"draw": names, **dict(zip(sums, (c.astype(float) for c in out)))})

    parts = _by_block(pillars, every, lam, dampener, digits, bucket, read, "draw int, " + ", ".join(f"{c} double" for c in sums), mirrored=True)
    t = parts.groupBy("draw").agg(*[F.sum(c).alias(c) for c in sums])
    spearman = F.col("xy") / F.nullif(F.sqrt("xx") * F.sqrt("yy"), F.lit(0.0))
    return t.select("draw", spearman.alias("spearman"), (100.0 * F.col("both") / F.nullif(F.col("top"), F.lit(0.0))).alias("top_overlap"))


def _statistics(top: tuple[int, ...], percentiles: dict[str, float] | None, positions: tuple[float, ...]) -> tuple:
    """(read, schema) of ``rank_statistics``."""
    shares = {"median_rank": 0.5, "p025": 0.025, "p05": 0.05, "p95": 0.95, "p975": 0.975, **(percentiles or {})}
    cuts = (0.8, 0.5, 0.2)

    def read(ids: np.ndarray, ranks: np.ndarray, n: int) -> pd.DataFrame:
        r, m = np.sort(ranks, axis=1), ranks.shape[1]
        out = {"id": ids, "mean_rank": r.mean(axis=1), "std_rank": r.std(axis=1), "best": r[:, 0].astype(np.int64), "worst": r[:, -1].astype(np.int64)}
        for name, p in shares.items():
            h = p * (m - 1)
            lo, hi = r[:, int(np.floor(h))].astype(float), r[:, int(np.ceil(h))].astype(float)
            out[name] = lo + (hi - lo) * (h - np.floor(h))
        for k, p in enumerate(positions):
            out[f"pos{k}"] = r[:, min(m - 1, int(p * m))].astype(np.int64)
        share = lambda most: 100.0 * (r <= most).sum(axis=1) / m
        out |= {f"top{t}_pct": share(t) for t in top}
        within = [share(n - np.ceil(c * (n - 1))) for c in cuts]
        for k, s in enumerate((within[0], within[1] - within[0], within[2] - within[1], 100.0 - within[2]), 1):
            out[f"tier{k}_pct"] = s
        return pd.DataFrame(out)

    doubles = [*shares, *[f"top{t}_pct" for t in top], *[f"tier{k}_pct" for k in (1, 2, 3, 4)]]
    schema = "id long, mean_rank double, std_rank double, best long, worst long, " + "".join(f"pos{k} long, " for k in range(len(positions))) + ", ".join(f"{c} double" for c in doubles)
    return read, schema


def _label() -> Column:
    return F.when(F.col("std_rank") <= 2, "VERY STABLE").when(F.col("std_rank") <= 5, "STABLE").when(F.col("std_rank") <= 10, "MODERATE").otherwise("VOLATILE")


def _total(f) -> Column:
    """The sum of f(rank, n) over a histogram."""
    return F.aggregate("ranks", F.lit(0.0), lambda s, x: s + f(x["rank"], x["n"]).cast("double"))


def percentile(p: float) -> Column:
    """Of the ranks, with linear interpolation."""
    h = F.lit(float(p)) * (F.col("draws") - 1)

    def at(k: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("v"))
        step = lambda s, x: F.struct((s["seen"] + x["n"]).alias("seen"), F.when(s["v"].isNull() & (s["seen"] + x["n"] > k), x["rank"]).otherwise(s["v"]).alias("v"))
        return F.aggregate("ranks", start, step, lambda s: s["v"])

    return at(F.floor(h)) + (at(F.ceil(h)) - at(F.floor(h))) * (h - F.floor(h))


def stability(histograms: DataFrame, top: tuple[int, ...] = (10, 20), cuts: tuple[float, float, float] = (0.8, 0.5, 0.2)) -> DataFrame:
    """(id, mean_rank, median_rank, std_rank, p025, p05, p95, p975, best, worst, top shares, tier shares in percent, label) of each entity.

    Tiers: scores from the draw's quantile ``cuts`` on, which is a rank of n - ceil(cut * (n - 1)) or better.
    """
    h = histograms.withColumn("mean_rank", _total(lambda r, n: r * n) / F.col("draws"))
    std = F.sqrt(_total(lambda r, n: n * (r - F.col("mean_rank")) * (r - F.col("mean_rank"))) / F.col("draws"))
    share = lambda most: 100.0 * _total(lambda r, n: F.when(r <= most, n).otherwise(0)) / F.col("draws")
    last = [F.col("entities") - F.ceil(F.lit(c) * (F.col("entities") - 1)) for c in cuts]
    within = [share(c) for c in last]
    tiers = [within[0], within[1] - within[0], within[2] - within[1], 100.0 - within[2]]
    out = h.select(
        "id", "mean_rank", percentile(0.5).alias("median_rank"), std.alias("std_rank"), *[percentile(p).alias(k) for k, p in (("p025", 0.025), ("p05", 0.05), ("p95", 0.95), ("p975", 0.975))],
        F.col("ranks")[0]["rank"].alias("best"), F.element_at("ranks", -1)["rank"].alias("worst"), *[share(t).alias(f"top{t}_pct") for t in top], *[t.alias(f"tier{k}_pct") for k, t in enumerate(tiers, 1)],
    )
    return out.withColumn("label", _label())
