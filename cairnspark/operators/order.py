"""Order statistics without global windows.

A window without a partition key puts all rows in one task. Here the different values of a column are counted first (which also takes
the weight out of a value that many rows share), cut into buckets at approximate quantiles, and summed up inside
buckets; the buckets' offsets are a table of at most ``BUCKETS`` rows for each group. Ranks and quantiles are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets that the values of a group are cut into.
BUCKETS = 64


def value_ranks(df: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """(by, value, n_lt, n_eq, n): for each different non-null value, how many rows of its group are smaller, equal, and there at all.

    by: columns with few different values (their cut points are broadcast).
    """
    by = list(by)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n_eq"))
    at = F.array(*[F.lit(i / BUCKETS) for i in range(1, BUCKETS)])
    cuts = counts.groupBy(*by).agg(F.percentile_approx(F.col(value).cast("double"), at, F.lit(1000)).alias("cuts"))
    cut = counts.join(F.broadcast(cuts), by) if by else counts.crossJoin(F.broadcast(cuts))
    cut = cut.withColumn("bucket", F.size(F.filter("cuts", lambda c: c < F.col(value).cast("double")))).drop("cuts")
    sums = cut.groupBy(*by, "bucket").agg(F.sum("n_eq").alias("in_bucket"))
    # at most BUCKETS rows for each group
    if by:
        first = Window.partitionBy(*by).orderBy("bucket")
        whole = Window.partitionBy(*by)
    else:
        sums = sums.withColumn("one", F.lit(1))
        first = Window.partitionBy("one").orderBy("bucket")
        whole = Window.partitionBy("one")
    offsets = sums.select(*by, "bucket", (F.sum("in_bucket").over(first) - F.col("in_bucket")).alias("before"), F.sum("in_bucket").over(whole).alias("n"))
    inside = F.sum("n_eq").over(Window.partitionBy(*by, "bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return cut.join(F.broadcast(offsets), [*by, "bucket"]).select(*by, value, (F.col("before") + inside - F.col("n_eq")).alias("n_lt"), "n_eq", "n")


def with_rank(df: DataFrame, value: str, name: str = "rank", by: list[str] = (), descending: bool = True, ties: str = "min") -> DataFrame:
    """df with the rank of value in its group: ties 'min' (1, 2, 2, 4), 'average' (1, 2.5, 2.5, 4) or 'percent' (average rank / n * 100).

    Null values have a null rank.
    """
    ranks = value_ranks(df, value, by)
    below = F.col("n") - F.col("n_lt") - F.col("n_eq") if descending else F.col("n_lt")
    expr: Column = {
        "min": (below + 1).cast("long"),
        "average": below + (F.col("n_eq") + 1) / F.lit(2.0),
        "percent": (below + (F.col("n_eq") + 1) / F.lit(2.0)) / F.col("n") * 100.0,
    }[ties]
    return df.join(ranks.select(*by, value, expr.alias(name)), [*by, value], "left").select(*df.columns, name)


def quantiles(df: DataFrame, value: str, ps: dict[str, float], by: list[str] = ()) -> DataFrame:
    """(by, one column for each named p): exact quantiles with linear interpolation; one row for each group."""
    ranks = value_ranks(df, value, by)
    out = []
    for name, p in ps.items():
        h = F.lit(float(p)) * (F.col("n") - 1)
        for side, k in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            out.append(F.max(F.when((F.col("n_lt") <= k) & (k < F.col("n_lt") + F.col("n_eq")), F.col(value))).alias(f"{name}_{side}"))
    n = F.max("n").alias("n_")
    agg = ranks.groupBy(*by).agg(*out, n)
    picked = []
    for name, p in ps.items():
        h = F.lit(float(p)) * (F.col("n_") - 1)
        picked.append((F.col(f"{name}_lo") + (F.col(f"{name}_hi") - F.col(f"{name}_lo")) * (h - F.floor(h))).alias(name))
    return agg.select(*by, *picked)


def row_numbers(df: DataFrame, value: str, tie: list[Column], name: str, by: list[str] = ()) -> DataFrame:
    """df with a dense 1-based position in ascending order of value, then of ``tie``."""
    ranks = value_ranks(df, value, by).select(*by, value, "n_lt")
    own = F.row_number().over(Window.partitionBy(*by, value).orderBy(*tie))
    return df.join(ranks, [*by, value]).withColumn(name, F.col("n_lt") + own).select(*df.columns, name)
