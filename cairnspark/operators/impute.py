"""Gap filling with provenance: group means, nearest neighbours on a covariate, trends, and the cascades of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import row_numbers
from .stable import stable

OBSERVED, TREND, GROUP_MEAN, NEIGHBOURS, MISSING = "OBSERVED", "IMPUTED_TREND", "IMPUTED_GROUP_MEAN", "IMPUTED_KNN", "MISSING"


def group_mean(fact: DataFrame, fallback: float | None = None, digits: int | None = None) -> DataFrame:
    """fact (id, grp, indicator, value) with nulls filled by their group's mean of the indicator (``fallback`` if it has none) and a ``status``.

    The means are aggregated first and joined: groups x indicators rows, so a large group is not gathered.
    """
    means = fact.groupBy("grp", "indicator").agg(F.avg("value").alias("mean_"))
    m: Column = F.col("mean_") if digits is None else F.round("mean_", digits)
    filled = F.coalesce("value", m, F.lit(fallback)) if fallback is not None else F.coalesce("value", m)
    status = F.when(F.col("value").isNotNull(), OBSERVED).when(filled.isNotNull(), GROUP_MEAN).otherwise(MISSING)
    return fact.join(means, ["grp", "indicator"], "left").withColumn("status", status).withColumn("value", filled).drop("mean_")


def nearest(fact: DataFrame, k: int = 5, donors: Column | None = None, covariate: str = "covariate") -> DataFrame:
    """(id, indicator, knn): mean over the k donors nearest on the covariate, for each cell without value.

    fact: (id, indicator, value, covariate). Ties go to the smaller id. Donors are cells with value and covariate (and ``donors``). A cell without
    covariate gets nothing. Donors are numbered along the covariate; the k nearest of a cell are among its k left and k right
    neighbours by number, which an equi-join fetches, so no cell meets all donors.
    """
    cov = F.col(covariate)
    ok = F.col("value").isNotNull() & cov.isNotNull()
    don = fact.where(ok if donors is None else ok & donors).select("id", "indicator", "value", cov.alias("c"))
    targets = fact.where(F.col("value").isNull() & cov.isNotNull()).select("id", "indicator", cov.alias("c"))
    # on the left, of equal covariates the smaller ids are nearest to the target, on the right too: so two numberings
    left = row_numbers(don, "c", [F.desc("id")], "rn", ["indicator"])
    right = row_numbers(don, "c", [F.asc("id")], "rn", ["indicator"])
    # where a target would stand: donors with a smaller covariate, from the counts of both together
    marked = don.select("indicator", "c", F.lit(1).alias("d")).union(targets.select("indicator", "c", F.lit(0)))
    steps = marked.groupBy("indicator", "c").agg(F.sum("d").alias("d"))
    below = _running(steps)
    at = targets.join(below, ["indicator", "c"])
    want = at.select("id", "indicator", "c", F.explode(F.sequence(F.lit(1 - k), F.lit(k))).alias("o"), "below").withColumn("rn", F.col("below") + F.col("o"))
    cols = ["indicator", "rn", F.col("id").alias("donor"), "value", F.col("c").alias("dc")]
    near = want.where("o <= 0").join(left.select(*cols), ["indicator", "rn"]).union(want.where("o > 0").join(right.select(*cols), ["indicator", "rn"]))
    w = Window.partitionBy("id", "indicator").orderBy(F.abs(F.col("c") - F.col("dc")), "donor")
    best = near.where("donor <> id").withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    return best.groupBy("id", "indicator").agg(F.avg("value").alias("knn"))


def _running(steps: DataFrame) -> DataFrame:
    """(indicator, c, below): sum of d over smaller c, bucket by bucket."""
    at = F.array(*[F.lit(i / 64) for i in range(1, 64)])
    cuts = steps.groupBy("indicator").agg(F.percentile_approx(F.col("c").cast("double"), at, F.lit(1000)).alias("cuts"))
    cut = steps.join(F.broadcast(cuts), "indicator").withColumn("bucket", F.size(F.filter("cuts", lambda x: x < F.col("c").cast("double")))).drop("cuts")
    sums = cut.groupBy("indicator", "bucket").agg(F.sum("d").alias("s"))
    before = sums.select("indicator", "bucket", (F.sum("s").over(Window.partitionBy("indicator").orderBy("bucket")) - F.col("s")).alias("before"))
    inside = F.sum("d").over(Window.partitionBy("indicator", "bucket").orderBy("c").rowsBetween(Window.unboundedPreceding, 0)) - F.col("d")
    return cut.join(F.broadcast(before), ["indicator", "bucket"]).select("indicator", "c", (F.col("before") + inside).alias("below"))


def cascade(fact: DataFrame, k: int = 5, pool: str = "observed", default_covariate: float | None = None) -> DataFrame:
    """fact (id, grp, indicator, value, covariate) filled by group means, then by nearest neighbours, with a ``status``.

    pool: donors are 'observed' cells only, or 'filled' ones, which include those the group means filled. A cell without covariate is
    given ``default_covariate``, or stays MISSING.
    """
    if default_covariate is not None:
        fact = fact.withColumn("covariate", F.coalesce("covariate", F.lit(default_covariate)))
    first = stable(group_mean(fact))
    near = nearest(first, k, F.col("status") == OBSERVED if pool == "observed" else None)
    both = first.join(near, ["id", "indicator"], "left")
    status = F.when(F.col("value").isNull() & F.col("knn").isNotNull(), NEIGHBOURS).otherwise(F.col("status"))
    return both.withColumn("status", status).withColumn("value", F.coalesce("value", "knn")).drop("knn")


def trend(series: DataFrame, targets: DataFrame, floor: float | None = None, ceiling: float | None = None) -> DataFrame:
    """(id, indicator, year, value): linear interpolation between the nearest known years, or extrapolation from the nearest two.

    series: (id, indicator, year, value); targets: (id, indicator, year). A known year gives its value. Fewer than two known points: null.
    """
    keys = ["id", "indicator"]
    known = series.where(F.col("value").isNotNull()).groupBy(*keys, "year").agg(F.max("value").alias("value"))
    # a series is one entity's years: short, so it may be an array
    points = known.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("year", "value"))).alias("p"))
    x = targets.select(*keys, "year").join(points, keys, "left")
    lo = F.expr("filter(p, x -> x.year <= year)")
    x = x.withColumn("n_lo", F.size(lo)).withColumn("i", F.greatest(F.lit(1), F.least(F.col("n_lo"), F.size("p") - 1)))
    a, b = F.expr("try_element_at(p, i)"), F.expr("try_element_at(p, i + 1)")
    line = a["value"] + (b["value"] - a["value"]) * (F.col("year") - a["year"]) / F.nullif(b["year"] - a["year"], F.lit(0))
    value = F.when(F.size("p") >= 2, line)
    if floor is not None:
        value = F.when(value.isNotNull(), F.greatest(value, F.lit(floor)))
    if ceiling is not None:
        value = F.when(value.isNotNull(), F.least(value, F.lit(ceiling)))
    return x.select(*keys, "year", value.alias("value"))


def cascade_by_evidence(fact: DataFrame, series: DataFrame, year: int, k: int = 5, floor: float | None = None, ceiling: float | None = None) -> DataFrame:
    """fact (id, grp, indicator, value, covariate) filled by trends, then by group means, then by nearest neighbours, with a ``status``.

    series: (id, indicator, year, value), from which a cell without value takes the trend at ``year`` (see ``trend``). The snapshot of evidence is what is observed or comes from a trend: both later
    stages read their donors from it alone, so no filled value justifies another. Neighbours are the ``k`` nearest by covariate. A cell that no stage reaches stays null and MISSING, among them all
    without a covariate whose group has no evidence; a missing covariate is not guessed. Values are not rounded. A null group is a group without evidence.
    """
    gaps = fact.where("value is null").select("id", "indicator", F.lit(year).alias("year"))
    lines = trend(series, gaps, floor, ceiling).select("id", "indicator", F.col("value").alias("trend_"))
    first = fact.join(lines, ["id", "indicator"], "left")
    status = F.when(F.col("value").isNotNull(), OBSERVED).when(F.col("trend_").isNotNull(), TREND)
    first = stable(first.withColumn("status", status).withColumn("value", F.coalesce("value", "trend_")).drop("trend_"))
    means = first.groupBy("grp", "indicator").agg(F.avg("value").alias("mean_"))  # of the snapshot: nothing else has a value yet
    second = first.join(means, ["grp", "indicator"], "left").withColumn("status", F.coalesce("status", F.when(F.col("mean_").isNotNull(), GROUP_MEAN)))
    second = stable(second.withColumn("value", F.coalesce("value", "mean_")).drop("mean_"))
    near = nearest(second, k, F.col("status").isin(OBSERVED, TREND))
    last = second.join(near, ["id", "indicator"], "left")
    status = F.coalesce("status", F.when(F.col("knn").isNotNull(), NEIGHBOURS), F.lit(MISSING))
    return last.withColumn("status", status).withColumn("value", F.coalesce("value", "knn")).select(*fact.columns, "status")


def merge_status(inherited: Column, imputed: Column) -> Column:
    """Inheritance wins over imputation."""
    return F.coalesce(F.when(inherited.startswith("INHERITED"), inherited), imputed, inherited)


def status_class(status: Column) -> Column:
    """Status without its source: INHERITED_FROM_7 counts as INHERITED."""
    return F.element_at(F.split(status, "_FROM_"), 1)
