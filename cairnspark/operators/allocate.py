"""Totals of groups dealt to their members by weight, in whole units that add up to the last one.

Weights become whole numbers first, so all sums and quotients are exact and no result depends on the order of rows. Each member gets its quota rounded down; the units that this leaves go to the largest
remainders. Remainders are ranked by buckets and offsets, so a group of any size is no single task's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keyed import normal
from .order import row_numbers
from .stable import stable

#: Units of a weight that count: weights are whole multiples of one over this.
GRAIN = 1_000_000


def allocate(totals: DataFrame, members: DataFrame, sigma: float = 0.0, seed: int = 42) -> DataFrame:
    """(id, grp, weight, units): each group's total as whole units of its members, in proportion to their weights.

    totals: (grp, total), whole numbers from 0 on, one row a group; members: (id, grp, weight), ids without repeats. With ``sigma`` each weight is first multiplied by exp(sigma * z), z a normal
    deviate that the id and the seed decide; group totals stay as they are. A null or negative weight counts as none. The units of a group add up to its total, unless all its weights are
    zero: then all are null, as they are in a group without total. Equal remainders: the smaller id first. total * weight * GRAIN must have at most 38 digits.
    """
    w = F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0))
    if sigma:
        w = w * F.exp(sigma * normal(F.col("id"), seed))
    grains = F.round(w * float(GRAIN)).cast("decimal(20,0)")
    own = stable(members.select("id", "grp", grains.alias("w_")))
    sums = own.groupBy("grp").agg(F.sum("w_").cast("decimal(22,0)").alias("all_"))
    both = own.join(totals.select("grp", F.col("total").cast("decimal(16,0)").alias("total_")), "grp", "left").join(sums, "grp", "left")
    product = (F.col("total_") * F.col("w_")).cast("decimal(38,0)")
    there = F.nullif(F.col("all_"), F.lit(0).cast("decimal(22,0)"))
    dealt = both.withColumn("units_", F.expr("bigint(0)")).withColumn("product_", product).withColumn("all_", there)
    dealt = stable(dealt.select("id", "grp", "w_", "total_", F.expr("cast(floor((product_ - product_ % all_) / all_) as decimal(16,0))").alias("base_"), F.expr("product_ % all_").alias("rest_")))
    left = dealt.groupBy("grp").agg((F.max("total_") - F.sum("base_")).cast("long").alias("left_"))
    # the place of a remainder from the largest on: in ascending order of its negative
    placed = row_numbers(dealt.where("rest_ is not null").withColumn("less_", -F.col("rest_")), "less_", [F.col("id")], "place_", ["grp"]).select("id", "place_")
    out = dealt.join(left, "grp", "left").join(placed, "id", "left")
    units = (F.col("base_") + F.when(F.col("place_") <= F.col("left_"), 1).otherwise(0)).cast("long")
    return out.select("id", "grp", (F.col("w_").cast("double") / float(GRAIN)).alias("weight"), units.alias("units"))
