"""How much rankings move: perturbed weights, model variants, left-out pillars, imputation noise.

Draws are made on the driver from a seed (draws x pillars numbers) and broadcast; scores of all draws come from one pass over
the pillar scores.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keyed import normal
from .concordance import kendall
from .order import quantiles, with_rank
from .stable import stable


def lognormal_draws(weights: dict[str, float], n: int, sigma: float = 0.2, seed: int = 42) -> list[tuple[int, str, float]]:
    """(draw, pillar, weight): w * exp(N(0, sigma)), made to sum to one."""
    rng, names = np.random.RandomState(seed), list(weights)
    w = np.array([weights[k] for k in names]) * np.exp(rng.normal(0.0, sigma, (n, len(names))))
    w /= w.sum(axis=1, keepdims=True)
    return [(d, p, float(w[d, k])) for d in range(n) for k, p in enumerate(names)]


def uniform_draws(weights: dict[str, float], n: int, share: float, seed: int = 42) -> list[tuple[int, str, float]]:
    rng, names = np.random.RandomState(seed), list(weights)
    w = np.array([weights[k] for k in names]) * rng.uniform(1 - share, 1 + share, (n, len(names)))
    w /= w.sum(axis=1, keepdims=True)
    return [(d, p, float(w[d, k])) for d in range(n) for k, p in enumerate(names)]


def gauss_draws(weights: dict[str, float], n: int, sigma: float = 0.15, seed: int = 42) -> list[tuple[int, str, float]]:
    """Draws of the standard library's generator: max(w * (1 + gauss), 0), made to sum to one."""
    rng, out = random.Random(seed), []
    for d in range(n):
        w = {p: max(0.0, x * (1.0 + rng.gauss(0.0, sigma))) for p, x in weights.items()}
        total = sum(w.values()) or 1.0
        out += [(d, p, x / total) for p, x in w.items()]
    return out


def draws_frame(spark: SparkSession, draws: list[tuple[int, str, float]]) -> DataFrame:
    return spark.createDataFrame(draws, "draw int, pillar string, weight double")


def draw_scores(pillars: DataFrame, draws: DataFrame, lam: float, dampener: str) -> DataFrame:
    """(draw, id, score) of every draw; an entity without any driver pillar has none.

    Pillar scores are laid side by side once; each draw is then an expression over one row, so nothing is summed across rows.
    draws: (draw, pillar, weight), the driver's own small table.
    """
    weight: dict[int, dict[str, float]] = {}
    for d, p, w in draws.collect():
        weight.setdefault(d, {})[p] = w
    names = sorted({p for w in weight.values() for p in w} - {dampener})
    table = pillars.sparkSession.createDataFrame([(d, [w.get(p, 0.0) for p in names]) for d, w in weight.items()], "draw int, w array<double>")
    wide = pillars.groupBy("id").pivot("pillar", [*names, dampener]).agg(F.first("score"))
    present = F.lit(False)
    for p in names:
        present = present | F.col(f"`{p}`").isNotNull()
    score = sum((F.coalesce(F.col(f"`{p}`") * F.col("w")[k], F.lit(0.0)) for k, p in enumerate(names)), F.lit(0.0))
    x = wide.where(present).crossJoin(F.broadcast(table))
    return x.select("draw", "id", (score - lam * F.coalesce(F.col(f"`{dampener}`"), F.lit(0.0))).alias("score"))


def draw_ranks(scores: DataFrame, digits: int = 9) -> DataFrame:
    """(draw, id, score, rank), ranked draw by draw in buckets of scores, so that no draw's entities are one task's. For many draws see ``rank_histograms``, which makes no row for each draw and entity."""
    return with_rank(stable(scores.withColumn("score", F.round("score", digits))), "score", by=["draw"])


def stability(ranks: DataFrame, top: tuple[int, int] = (10, 20)) -> DataFrame:
    """(id, mean, median, std, p05, p95, best, worst, top shares in percent, label) of an entity's ranks over the draws.

    An entity has as many ranks as there are draws, so exact percentiles are cheap.
    """
    agg = ranks.groupBy("id").agg(
        F.avg("rank").alias("mean_rank"), F.percentile("rank", 0.5).alias("median_rank"), F.stddev_pop("rank").alias("std_rank"),
        F.percentile("rank", 0.05).alias("p05"), F.percentile("rank", 0.95).alias("p95"), F.min("rank").alias("best"), F.max("rank").alias("worst"),
        *[(100.0 * F.avg((F.col("rank") <= n).cast("double"))).alias(f"top{n}_pct") for n in top],
    )
    label = F.when(F.col("std_rank") <= 2, "VERY STABLE").when(F.col("std_rank") <= 5, "STABLE").when(F.col("std_rank") <= 10, "MODERATE").otherwise("VOLATILE")
    return agg.withColumn("label", label)


def draw_agreement(ranks: DataFrame, base: DataFrame, top: int = 20, tau: bool = False) -> DataFrame:
    """(draw, spearman, top_overlap[, tau]): each draw's ranking against the base's; with ``tau``, Kendall's of the scores too. base: (id, score)."""
    b = base.where(F.col("score").isNotNull()).select("id", F.col("score").alias("b_"))
    both = x = ranks.join(b, "id")
    x = with_rank(with_rank(stable(x), "score", "ra", ["draw"], ties="average"), "b_", "rb", ["draw"], ties="average")
    x = with_rank(stable(x), "b_", "br", ["draw"])
    in_both = F.count_if((F.col("rank") <= top) & (F.col("br") <= top))
    out = x.groupBy("draw").agg(F.corr("ra", "rb").alias("spearman"), (100.0 * in_both / F.nullif(F.count_if(F.col("br") <= top), F.lit(0))).alias("top_overlap"))
    return out.join(kendall(both, "score", "b_", ["draw"]).select("draw", "tau"), "draw", "left") if tau else out


def rank_spread(ranks: DataFrame, by: str = "id") -> DataFrame:
    """(id, spread, mean, median, p05, p95, robustness) over long (variant, id, rank)."""
    agg = ranks.groupBy(by).agg(
        F.count("*").alias("variants"), (F.max("rank") - F.min("rank")).alias("spread"), F.avg("rank").alias("mean_rank"), F.percentile("rank", 0.5).alias("median_rank"),
        F.percentile("rank", 0.05).alias("p05"), F.percentile("rank", 0.95).alias("p95"),
    )
    return agg.withColumn("robustness", F.when(F.col("spread") <= 5, "ROBUST").when(F.col("spread") <= 20, "MODERATE").otherwise("SENSITIVE"))


def without_each(pillars: DataFrame, weights: DataFrame, lam: float, dampener: str) -> DataFrame:
    """(variant, id, score): the composite without each driver pillar in turn, weights renormalised; one pass over the scores."""
    left_out = weights.select(F.col("pillar").alias("out_"))
    grid = weights.crossJoin(left_out).where("pillar <> out_")
    grid = grid.withColumn("weight", F.col("weight") / F.sum("weight").over(Window.partitionBy("out_")))
    s = pillars.join(F.broadcast(grid), "pillar").groupBy("out_", "id").agg(F.sum(F.col("weight") * F.col("score")).alias("driver"))
    damp = pillars.where(F.col("pillar") == dampener).groupBy("id").agg(F.max("score").alias("damp"))
    return s.join(damp, "id", "left").select(F.col("out_").alias("variant"), "id", (F.col("driver") - lam * F.coalesce("damp", F.lit(0.0))).alias("score"))


def imputation_noise(fact: DataFrame, draws: int, sigma: dict[str, float], indicators: list[str], seed: int = 42, digits: int = 6) -> DataFrame:
    """(draw, id, grp, indicator, norm): normalised cells with noise by status, clipped to 0-100.

    fact: (id, grp, indicator, norm, status), whole-number ids. The noise of a cell is a normal deviate that its draw, id and place in ``indicators`` decide, together with the seed.
    """
    spark = fact.sparkSession
    d = spark.range(draws).select(F.col("id").cast("int").alias("draw"))
    place = F.array_position(F.array(*[F.lit(i) for i in indicators]), F.col("indicator")) - 1
    x = fact.crossJoin(F.broadcast(d))
    key = (F.col("id").cast("long") * len(indicators) + place) * draws + F.col("draw")
    s = F.lit(0.0)
    for status, value in sigma.items():
        s = F.when(F.col("status").startswith(status), F.lit(value)).otherwise(s)
    noisy = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("norm") + F.when(s > 0, normal(key, seed) * s).otherwise(0.0)))
    return x.select("draw", "id", "grp", "indicator", F.round(noisy, digits).alias("norm"))


def noisy_scores(fact: DataFrame, pillars: dict[str, str], draws: int, sigma: dict[str, float], indicators: list[str], weights: dict[str, float], lam: float, dampener: str, seed: int = 42, digits: int = 9) -> DataFrame:
    """(id, x): an entity's composites in all draws, in their order, under the noise of ``imputation_noise``: equal weights in a pillar, ``weights`` of the drivers, less lam times the dampener's mean.

    fact: as of ``imputation_noise``; pillars: of each indicator. An entity's cells are laid side by side once, and nothing of a draw is shuffled. An entity without a score has no row.
    """
    wide = fact.groupBy("id").pivot("indicator", indicators).agg(F.first("norm").alias("norm"), F.first("status").alias("status"))
    dampened = F.coalesce(*[F.col(f"`{i}_norm`") for i in indicators if pillars[i] == dampener]).isNotNull()
    x = wide.where(dampened).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    cells: dict[str, list] = {}
    for place, name in enumerate(indicators):
        s = F.lit(0.0)
        for status, value in sigma.items():
            s = F.when(F.col(f"`{name}_status`").startswith(status), F.lit(value)).otherwise(s)
        key = (F.col("id").cast("long") * len(indicators) + place) * draws + F.col("draw")
        norm = F.col(f"`{name}_norm`")
        noisy = F.greatest(F.lit(0.0), F.least(F.lit(100.0), norm + F.when(s > 0, normal(key, seed) * s).otherwise(0.0)))
        cells.setdefault(pillars[name], []).append((norm.isNotNull(), F.round(noisy, 6)))
    mean = {p: sum((F.when(there, c).otherwise(0.0) for there, c in cs), F.lit(0.0)) / F.nullif(sum((there.cast("int") for there, _ in cs), F.lit(0)), F.lit(0)) for p, cs in cells.items()}
    driver = sum((F.coalesce(w * mean[p], F.lit(0.0)) for p, w in weights.items() if p in mean), F.lit(0.0))
    x = x.select("id", "draw", F.round(driver - lam * mean[dampener], digits).alias("score"))
    return x.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("draw", "score"))), lambda c: c["score"]).alias("x"))


def tier_shares(ranks: DataFrame, cuts: tuple[float, float, float] = (0.8, 0.5, 0.2)) -> DataFrame:
    """(id, tier1_pct .. tier4_pct): how often each draw's quantile tiers hold an entity. ranks: (draw, id, score)."""
    q = quantiles(ranks, "score", {"a": cuts[0], "b": cuts[1], "c": cuts[2]}, ["draw"])
    x = ranks.join(F.broadcast(q), "draw")
    s = F.col("score")
    tier = F.when(s >= F.col("a"), 1).when(s >= F.col("b"), 2).when(s >= F.col("c"), 3).otherwise(4)
    return x.withColumn("t", tier).groupBy("id").agg(*[(100.0 * F.avg((F.col("t") == k).cast("double"))).alias(f"tier{k}_pct") for k in (1, 2, 3, 4)])


def positional_percentiles(ranks: DataFrame, draws: int) -> DataFrame:
    """(id, mean_rank, p05, p95, top1_pct): the ranks at positions int(0.05 n) and int(0.95 n) of an entity's sorted ranks, and how often it is first."""
    x = ranks.groupBy("id").agg(F.sort_array(F.collect_list("rank")).alias("r"), F.avg("rank").alias("mean_rank"), (100.0 * F.avg((F.col("rank") == 1).cast("double"))).alias("top1_pct"))
    at = lambda p: F.col("r")[min(draws - 1, int(p * draws))]
    return x.select("id", "mean_rank", at(0.05).alias("p05"), at(0.95).alias("p95"), "top1_pct")
