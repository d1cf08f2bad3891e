"""Inheritance along parent-child edges of any depth, by pointer doubling.

Each round, an entity without value takes its pointer's value or, if that has none, its pointer's pointer: after r rounds it has seen 2^r
ancestors, so ``max_depth`` generations need log2(max_depth) joins, each written once to the shared folder. Entities on a cycle
without value stay without.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stable import stable


def inherit(values: DataFrame, edges: DataFrame, max_depth: int = 64) -> DataFrame:
    """(id, indicator, value, status): values as observed, or inherited from the nearest ancestor that has one.

    values: (id, indicator, value), one row for each cell wanted; edges: (child, parent), a child has one parent (the smallest, if several).
    status: OBSERVED, INHERITED_FROM_<parent of the entity>, or MISSING.
    """
    parent = edges.groupBy(F.col("child").alias("id")).agg(F.min("parent").alias("parent"))
    base = values.join(parent, "id", "left").select("id", "indicator", "value", F.col("parent").alias("up"), F.col("parent").alias("parent"))
    # an ancestor may have no row of its own for an indicator: it passes on its parent's
    # (indicators are the model's own short list; parents grow with the entities)
    wanted = parent.select(F.col("parent").alias("id")).distinct().crossJoin(F.broadcast(values.select("indicator").distinct()))
    extra = wanted.join(base.select("id", "indicator"), ["id", "indicator"], "left_anti").join(parent, "id", "left")
    cur = base.withColumn("own", F.lit(True)).unionByName(extra.select("id", "indicator", F.lit(None).cast("double").alias("value"), F.col("parent").alias("up"), "parent", F.lit(False).alias("own")))
    cur = cur.withColumn("found", F.col("value"))
    for _ in range(max(1, math.ceil(math.log2(max_depth + 1)))):
        at = cur.select(F.col("id").alias("up"), "indicator", F.col("found").alias("up_found"), F.col("up").alias("up_up"))
        open_ = F.col("found").isNull()
        nxt = cur.join(at, ["up", "indicator"], "left").select(
            "id", "indicator", "value", "parent", "own",
            F.coalesce("found", "up_found").alias("found"),
            F.when(open_ & F.col("up_found").isNull(), F.col("up_up")).otherwise(F.col("up")).alias("up"),
        )
        cur = stable(nxt)  # two readers of each round would double the plan with every round
    status = F.when(F.col("value").isNotNull(), "OBSERVED").when(F.col("found").isNotNull(), F.concat(F.lit("INHERITED_FROM_"), F.col("parent").cast("string"))).otherwise("MISSING")
    return cur.where("own").select("id", "indicator", F.col("found").alias("value"), status.alias("status"))
