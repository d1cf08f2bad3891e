"""Pillar and composite scores, ranks and tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import rounded
from .order import quantiles, with_rank
from .stable import stable


def pillar_scores(norm: DataFrame, weights: DataFrame, renormalise: bool = False, value: str = "norm", digits: int | None = None) -> DataFrame:
    """(id, pillar, score): weighted sum of normalised indicators; ``renormalise`` divides by the weight of those present (none present: null). digits: see ``rounded``.

    weights: (pillar, indicator, weight); broadcast, one row for each indicator.
    """
    x = norm.select("id", "indicator", F.col(value).alias("x")).join(F.broadcast(weights.select("pillar", "indicator", "weight")), "indicator")
    w = F.when(F.col("x").isNotNull(), F.col("weight"))
    total = F.sum(F.col("weight") * F.col("x"))
    score = total / F.nullif(F.sum(w), F.lit(0.0)) if renormalise else total
    return x.groupBy("id", "pillar").agg(score.alias("score")).withColumn("score", rounded(F.col("score"), digits))


def equal_pillar_scores(norm: DataFrame, pillars: DataFrame, value: str = "norm") -> DataFrame:
    x = norm.join(F.broadcast(pillars.select("indicator", "pillar")), "indicator")
    return x.groupBy("id", "pillar").agg(F.avg(value).alias("score"))


def composite(pillars: DataFrame, weights: DataFrame, lam: float, dampener: str, clamp: bool = False, renormalise: bool = False, digits: int | None = None) -> DataFrame:
    """(id, driver, penalty, score, geometric, coverage): drivers' weighted sum minus lam times the dampener's score.

    weights: (pillar, weight) of the drivers. geometric: product of (score + 1)^weight, times max(1 - lam * dampener / 100, 0). coverage:
    share of driver pillars present, in percent. ``renormalise`` spreads the weight of absent pillars over the rest. digits: decimals that driver, penalty, score and geometric are rounded
    to, the score from the rounded driver and penalty (see ``rounded``).
    """
    x = pillars.join(F.broadcast(weights.select("pillar", "weight")), "pillar", "left")
    s, w = F.col("score"), F.when(F.col("score").isNotNull(), F.col("weight"))
    damp = F.coalesce(F.max(F.when(F.col("pillar") == dampener, s)), F.lit(0.0))
    share = F.sum(w) if renormalise else F.lit(1.0)
    agg = x.groupBy("id").agg(
        (F.sum(F.col("weight") * s) / F.nullif(share, F.lit(0.0))).alias("driver"),
        (F.lit(lam) * damp).alias("penalty"),
        (F.exp(F.sum(F.col("weight") * F.ln(s + 1.0)) / F.nullif(share, F.lit(0.0))) * F.greatest(1.0 - F.lit(lam) * damp / 100.0, F.lit(0.0))).alias("geometric"),
        (100.0 * F.count(w) / F.nullif(F.count("weight"), F.lit(0))).alias("coverage"),
    )
    for c in ("driver", "penalty", "geometric"):
        agg = agg.withColumn(c, rounded(F.col(c), digits))
    raw: Column = F.col("driver") - F.col("penalty")
    return agg.withColumn("score", rounded(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)) if clamp else raw, digits))


def ranks_and_tiers(scores: DataFrame, group: str | None = "grp", cuts: tuple[float, float, float] = (0.8, 0.5, 0.2), value: str = "score") -> DataFrame:
    """scores with rank, group_rank (ties share the smallest) and tier by quantile cuts."""
    out = with_rank(scores, value, "rank")
    if group:
        out = with_rank(out, value, "group_rank", [group])
    q = quantiles(scores, value, {"q_hi": cuts[0], "q_mid": cuts[1], "q_lo": cuts[2]})
    v = F.col(value)
    tier = F.when(v >= F.col("q_hi"), "TIER 1").when(v >= F.col("q_mid"), "TIER 2").when(v >= F.col("q_lo"), "TIER 3").when(v.isNotNull(), "TIER 4")
    return out.crossJoin(F.broadcast(q)).withColumn("tier", tier).drop("q_hi", "q_mid", "q_lo")


def quartile_tiers(scores: DataFrame, value: str = "score") -> DataFrame:
    """scores with tier by (rank - 1) / n: quarters of the ranking, best first."""
    ranked = with_rank(scores, value, "rank_")
    n = scores.where(F.col(value).isNotNull()).agg(F.count("*").alias("n_"))
    share = (F.col("rank_") - 1) / F.col("n_")
    tier = F.when(share < 0.25, "Q1").when(share < 0.5, "Q2").when(share < 0.75, "Q3").when(share.isNotNull(), "Q4")
    return ranked.crossJoin(F.broadcast(n)).withColumn("tier", tier).drop("rank_", "n_")


def coverage_report(pillars: DataFrame, weights: DataFrame, lam: float, dampener: str, tiers: tuple[str, ...] = ("TIER 1", "TIER 2", "TIER 3", "TIER 4"), unscored: str = "UNSCORED") -> DataFrame:
    """(id, score, coverage_pct, global_coverage_pct, dampener_applied, pillar_weights, tier) of every entity, by the drivers it has.

    pillars: (id, pillar, score), absent scores null; weights: (pillar, weight) of all pillars, the dampener's included. The weights of the drivers an entity has are made to sum to one; ``pillar_weights`` holds them, and the
    dampener's as -lam where it takes part. The score, less lam times the dampener's, is clamped to 0-100. coverage_pct: the weight of the drivers it has; global_coverage_pct: of the pillars that
    any entity has, the dampener included. Tiers are quarters of the ranking, equal scores together. An entity without a driver has no score.
    """
    drivers = weights.where(F.col("pillar") != dampener).select("pillar", "weight")
    x = pillars.join(F.broadcast(drivers), "pillar", "left")
    has, w = F.col("score").isNotNull(), F.when(F.col("score").isNotNull(), F.col("weight"))
    damp = F.max(F.when((F.col("pillar") == dampener) & has, F.col("score")))
    each = x.groupBy("id").agg(
        F.sum(w).alias("own_"), F.sum(w * F.col("score")).alias("sum_"), damp.alias("damp_"),
        F.sort_array(F.collect_list(F.when(w.isNotNull(), F.struct("pillar", "weight")))).alias("parts_"),  # at most as many as there are pillars
    )
    scored = F.col("own_") > 0
    raw = F.col("sum_") / F.nullif(F.col("own_"), F.lit(0.0)) - lam * F.coalesce("damp_", F.lit(0.0))
    parts = F.transform("parts_", lambda p: F.struct(p["pillar"].alias("key"), (p["weight"] / F.col("own_")).alias("value")))
    dampened = F.array(F.struct(F.lit(dampener).alias("key"), F.lit(-float(lam)).alias("value")))
    every = F.map_from_entries(F.when(F.col("damp_").isNotNull(), F.concat(parts, dampened)).otherwise(parts))
    known = pillars.where("score is not null").select("pillar").distinct().join(F.broadcast(weights), "pillar").agg((100.0 * F.sum("weight")).alias("global_coverage_pct"))
    out = each.crossJoin(F.broadcast(known)).select(
        "id", F.when(scored, F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw))).alias("score"), (100.0 * F.coalesce("own_", F.lit(0.0))).alias("coverage_pct"), "global_coverage_pct",
        (lam * F.col("damp_")).alias("dampener_applied"), F.when(scored, every).alias("pillar_weights"),
    )
    named = F.create_map(*[F.lit(v) for kv in zip(("Q1", "Q2", "Q3", "Q4"), tiers) for v in kv])
    return quartile_tiers(stable(out)).withColumn("tier", F.coalesce(F.try_element_at(named, F.col("tier")), F.lit(unscored)))
