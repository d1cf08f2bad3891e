"""The index from end to end, over any long fact table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import impute, lineage, normalise, quality, score, sensitivity
from ..operators import weights as w
from ..operators.stable import stable
from ..sources.config import IndexConfig


@dataclass(frozen=True)
class Index:
    """Frames of one run. cells: every value with its provenance and norm; scores: one row for each entity, ranked; the others audit them."""

    cells: DataFrame
    indicator_weights: DataFrame
    pillars: DataFrame
    scores: DataFrame
    stability: DataFrame
    provenance: DataFrame
    gates: DataFrame


def build(fact: DataFrame, config: IndexConfig, edges: DataFrame | None = None, missing: str = "neutral") -> Index:
    """fact: (id, grp, indicator, value[, covariate]); edges: (child, parent).

    Inheritance comes first, then group means, then (with a covariate) nearest neighbours among observed cells. Then min-max, entropy
    weights inside pillars, pillar scores, the composite with its dampener, ranks and tiers, and Monte Carlo stability. Frames that two branches read are
    written once to the shared folder.
    """
    spark = fact.sparkSession
    names = config.indicator_frame(spark)
    fact = fact.withColumn("value", F.nanvl(F.col("value").cast("double"), F.lit(None).cast("double"))).join(F.broadcast(names.select("indicator")), "indicator", "left_semi")
    inherited = None
    if edges is not None:
        inherited = stable(lineage.inherit(fact.select("id", "indicator", "value"), edges))
        fact = fact.drop("value").join(inherited.select("id", "indicator", "value"), ["id", "indicator"])
    fact = stable(fact)
    filled = impute.cascade(fact) if "covariate" in fact.columns else impute.group_mean(fact)
    if inherited is not None:
        own = inherited.select("id", "indicator", F.col("status").alias("inherited_"))
        filled = filled.join(own, ["id", "indicator"]).withColumn("status", impute.merge_status(F.col("inherited_"), F.col("status"))).drop("inherited_")
    cells = stable(normalise.minmax(filled, names, missing=missing))
    own = cells.join(F.broadcast(names.select("indicator", "pillar")), "indicator")
    indicator_weights = stable(w.entropy(own))
    pillars = stable(score.pillar_scores(cells, indicator_weights, renormalise=missing == "propagate").withColumn("score", F.round("score", 9)))
    total = score.composite(pillars, config.weight_frame(spark), config.lam, config.dampener, renormalise=missing == "propagate")
    group = fact.groupBy("id").agg(F.min("grp").alias("grp"))
    total = stable(total.join(group, "id").withColumn("score", F.round("score", 9)))
    scores = score.ranks_and_tiers(total, cuts=config.cuts)
    draws = sensitivity.draws_frame(spark, sensitivity.lognormal_draws(config.weights, config.draws, config.sigma, config.seed))
    stability = sensitivity.stability(sensitivity.draw_ranks(sensitivity.draw_scores(pillars, draws, config.lam, config.dampener)))
    checks = quality.gate("norms in range", cells, (F.min("norm") >= 0) & (F.max("norm") <= 100), F.max("norm"))
    checks = checks.union(quality.gate("one row for each cell", cells.groupBy("id", "indicator").agg(F.count("*").alias("n")), F.max("n") == 1, F.max("n")))
    checks = checks.union(quality.gate("every entity scored", total, F.count("*") == F.count("score"), F.count("score")))
    residual = F.max(F.abs(F.col("driver") - F.col("penalty") - F.col("score")))
    checks = checks.union(quality.gate("score is driver less penalty", total, residual <= 2e-4, residual))
    return Index(cells, indicator_weights, pillars, scores, stability, quality.provenance(cells, ["id"]), checks)
