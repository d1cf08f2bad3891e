"""Kendall's tau of large rankings, by ranges.

The pairs that two rankings order differently are counted without bringing a ranking to one task. Both columns are cut at approximate quantiles into buckets; a value that is a cut is a bucket of
its own, so a value on many rows shares its bucket with no other. A discordant pair then lies in one of three places:

* in different buckets of both columns: counted from the table of rows in each pair of buckets, by sums over its corners;
* in one bucket of x: counted inside it, by merging;
* in one bucket of y and different ones of x: counted inside the bucket of y, the buckets of x standing for x.

A bucket of one value has no discordant pair inside. Groups of up to ``PER`` rows are one bucket; many such groups (the draws of a simulation, say) are as many tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stable import stable

#: Rows of a bucket that are aimed at, and the most buckets of a column (a power of two); groups beyond the product have larger buckets.
PER, MOST = 50_000, 512


def discordant(x: np.ndarray, y: np.ndarray) -> int:
    """Pairs with x[i] < x[j] and y[i] > y[j], n log n."""
    y = y[np.lexsort((y, x))]
    n, width, total = len(y), 1, 0
    while width < n:
        for a in range(0, n, 2 * width):
            left, right = y[a : a + width], y[a + width : a + 2 * width]
            if len(right):
                total += int((len(left) - np.searchsorted(left, right, "right")).sum())
                y[a : a + 2 * width] = np.sort(y[a : a + 2 * width], kind="stable")
        width *= 2
    return total


def across(bx: np.ndarray, by: np.ndarray, n: np.ndarray) -> int:
    """Pairs of rows whose bucket of x is smaller and whose bucket of y is larger, from the counts of rows in pairs of buckets."""
    kx, ix = np.unique(bx, return_inverse=True)
    ky, iy = np.unique(by, return_inverse=True)
    table = np.zeros((len(kx), len(ky)), np.int64)
    table[ix, iy] = n
    # rows in later buckets of x and earlier ones of y
    later = np.cumsum(table[::-1], axis=0)[::-1]
    corner = np.zeros_like(table)
    corner[:-1, 1:] = np.cumsum(later[1:], axis=1)[:, :-1]
    return sum(int(a) * int(b) for a, b in zip(table[table > 0].tolist(), corner[table > 0].tolist()))


def _bucket(value: Column, cuts: Column) -> Column:
    """Even numbers between the cuts, odd ones on them."""
    return 2 * F.size(F.filter(cuts, lambda c: c < value)) + F.array_contains(cuts, value).cast("int")


def kendall(df: DataFrame, x: str, y: str, by: list[str], per: int = PER) -> DataFrame:
    """(by, tau, n): Kendall's tau-b in each group, exact. Rows with a null or NaN in either column take no part; a column without two values gives a null.

    by: any number of groups, each of any size; what is broadcast is 8 KB for each group of more than ``per`` rows.
    """
    by = list(by)
    both = df.select(*by, F.nanvl(F.col(x).cast("double"), F.lit(None)).alias("x_"), F.nanvl(F.col(y).cast("double"), F.lit(None)).alias("y_")).where("x_ is not null and y_ is not null")
    # zeros of either sign are one value
    rows = stable(both.withColumn("x_", F.col("x_") + 0.0).withColumn("y_", F.col("y_") + 0.0))
    sizes = rows.groupBy(*by).agg(F.count("*").alias("n"))
    # every stride-th of MOST quantiles; a group of one bucket has no cuts
    buckets = F.least(F.lit(MOST), F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n") / float(per)))).cast("int"))
    large = sizes.where(F.col("n") > per).withColumn("stride", (F.lit(MOST) / buckets).cast("int")).drop("n")
    at = F.array(*[F.lit(i / MOST) for i in range(1, MOST)])
    cut = rows.join(F.broadcast(large), by).groupBy(*by).agg(F.max("stride").alias("stride"), *[F.percentile_approx(c, at, F.lit(4 * MOST)).alias(c) for c in ("x_", "y_")])
    thin = lambda c: F.array_distinct(F.filter(F.col(c), lambda v, i: (i + 1) % F.col("stride") == 0))
    cut = cut.select(*by, thin("x_").alias("cx"), thin("y_").alias("cy"))
    dealt = rows.join(F.broadcast(cut), by, "left")
    bucket = lambda c, cuts: F.coalesce(_bucket(F.col(c), F.col(cuts)), F.lit(0))
    dealt = stable(dealt.select(*by, "x_", "y_", bucket("x_", "cx").alias("bx"), bucket("y_", "cy").alias("by_"), F.col("cx").isNotNull().alias("cut_")))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*by).schema)
    keys = lambda pdf: [pdf[b].iloc[0] for b in by]

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*keys(pdf), discordant(pdf["k"].to_numpy(), pdf["v"].to_numpy())]], columns=[*by, "d"])

    def cornered(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*keys(pdf), across(pdf["bx"].to_numpy(), pdf["by_"].to_numpy(), pdf["n"].to_numpy())]], columns=[*by, "d"])

    inside_x = dealt.where("bx % 2 = 0").select(*by, F.lit(0).alias("side"), F.col("bx").alias("b"), F.col("x_").alias("k"), F.col("y_").alias("v"))
    inside_y = dealt.where("cut_ and by_ % 2 = 0").select(*by, F.lit(1).alias("side"), F.col("by_").alias("b"), F.col("bx").cast("double").alias("k"), F.col("y_").alias("v"))
    parts = inside_x.unionByName(inside_y).groupBy(*by, "side", "b").applyInPandas(merged, f"{fields}, d long")
    cells = dealt.where("cut_").groupBy(*by, "bx", "by_").agg(F.count("*").alias("n"))
    corners = cells.groupBy(*by).applyInPandas(cornered, f"{fields}, d long")
    pairs = lambda n: (n.cast("decimal(38,0)") * (n - 1) / 2).cast("decimal(38,0)")

    def ties(*columns: str) -> DataFrame:
        same = dealt.groupBy(*by, *columns).agg(F.count("*").alias("n"))
        return same.groupBy(*by).agg(F.sum(pairs(F.col("n"))).cast("double").alias("t_" + "".join(columns)))

    swapped = parts.unionByName(corners).groupBy(*by).agg(F.sum(F.col("d").cast("decimal(38,0)")).cast("double").alias("d"))
    out = sizes.join(swapped, by, "left")
    for columns in (("x_",), ("y_",), ("x_", "y_")):
        out = out.join(ties(*columns), by)
    all_pairs = pairs(F.col("n")).cast("double")
    more = all_pairs - F.col("t_x_") - F.col("t_y_") + F.col("t_x_y_") - 2.0 * F.coalesce("d", F.lit(0.0))
    under = F.sqrt((all_pairs - F.col("t_x_")) * (all_pairs - F.col("t_y_")))
    return out.select(*by, (more / F.nullif(under, F.lit(0.0))).alias("tau"), "n")
