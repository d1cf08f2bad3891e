"""Normalisation of a long fact table (id, grp, indicator, value) to a common scale, indicator by indicator.

Statistics are one row for each indicator and are broadcast; the fact itself is never shuffled for min-max and z-scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import rounded
from .order import quantiles, with_rank

NEGATIVE = "NEGATIVE"


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def minmax(fact: DataFrame, directions: DataFrame, missing: str = "neutral", value: str = "value", name: str = "norm", epsilon: float = 0.0, digits: int | None = None) -> DataFrame:
    """fact with ``name``: 0-100 by the indicator's range, inverted for NEGATIVE ones.

    directions: (indicator, direction). missing: 'neutral' gives 50 to a null, 'propagate' keeps it. A zero range gives 50. With
    ``epsilon`` the range is widened by it and never counts as zero. digits: decimals that the result is rounded to, exactly and half to even (none: unrounded).
    """
    stats = fact.groupBy("indicator").agg(F.min(value).alias("lo_"), F.max(value).alias("hi_"))
    both = fact.join(F.broadcast(stats.join(directions.select("indicator", "direction"), "indicator", "left")), "indicator")
    v, lo, hi = F.col(value), F.col("lo_"), F.col("hi_")
    up = (v - lo) / (hi - lo + F.lit(epsilon)) * 100.0 if epsilon else F.when(hi == lo, F.lit(50.0)).otherwise((v - lo) / F.nullif(hi - lo, F.lit(0.0)) * 100.0)
    down = F.when((hi == lo) & F.lit(not epsilon), F.lit(50.0)).otherwise(100.0 - up)
    scaled = F.when(F.col("direction") == NEGATIVE, down).otherwise(up)
    out = F.when(v.isNull(), F.lit(50.0) if missing == "neutral" else F.lit(None).cast("double")).otherwise(scaled)
    return both.withColumn(name, rounded(out, digits)).drop("lo_", "hi_", "direction")


def robust_iqr(fact: DataFrame, directions: DataFrame, value: str = "value", name: str = "norm") -> DataFrame:
    """(x - median) / IQR (an IQR of zero counts as 1), then min-max."""
    q = quantiles(fact, value, {"q1": 0.25, "q2": 0.5, "q3": 0.75}, ["indicator"])
    iqr = F.when(F.col("q3") - F.col("q1") <= 0, F.lit(1.0)).otherwise(F.col("q3") - F.col("q1"))
    z = fact.join(F.broadcast(q), "indicator").withColumn("z_", (F.col(value) - F.col("q2")) / iqr).drop("q1", "q2", "q3")
    return minmax(z, directions, value="z_", name=name).drop("z_")


def percentile_rank(fact: DataFrame, directions: DataFrame, value: str = "value", name: str = "norm") -> DataFrame:
    """Average rank / n * 100, ascending; descending for NEGATIVE indicators. A null stays null."""
    ranked = with_rank(with_rank(fact, value, "up_", ["indicator"], False, "percent"), value, "down_", ["indicator"], True, "percent")
    out = ranked.join(F.broadcast(directions.select("indicator", "direction")), "indicator", "left")
    return out.withColumn(name, F.when(F.col("direction") == NEGATIVE, F.col("down_")).otherwise(F.col("up_"))).drop("up_", "down_", "direction")


def winsorised(fact: DataFrame, directions: DataFrame, lo: float = 0.05, hi: float = 0.95, value: str = "value", name: str = "norm") -> DataFrame:
    """Min-max of values clipped to two quantiles."""
    q = quantiles(fact, value, {"w_lo": lo, "w_hi": hi}, ["indicator"])
    clipped = F.when(F.col(value).isNotNull(), F.greatest("w_lo", F.least("w_hi", F.col(value))))
    w = fact.join(F.broadcast(q), "indicator").withColumn("w_", clipped).drop("w_lo", "w_hi")
    return minmax(w, directions, value="w_", name=name).drop("w_")


def zscore(fact: DataFrame, value: str = "value", name: str = "norm") -> DataFrame:
    """(x - mean) / population standard deviation; null where that is zero."""
    s = fact.groupBy("indicator").agg(F.avg(value).alias("m_"), F.stddev_pop(value).alias("s_"))
    z = (F.col(value) - F.col("m_")) / F.nullif(F.col("s_"), F.lit(0.0))
    return fact.join(F.broadcast(s), "indicator").withColumn(name, z).drop("m_", "s_")
