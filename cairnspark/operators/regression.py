"""Least squares on several regressors, group by group, from one aggregation of moments.

The moments of a group (means and the cross products about them) are one row, merged by addition. What follows works on p x p values of that row: the Cholesky factor, its inverse, coefficients and
their standard errors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import f_upper, t_two_sided
from .order import with_rank
from .stable import stable


def cholesky(a: np.ndarray, least: float = 1e-12) -> tuple[np.ndarray, np.ndarray]:
    """(lower factor, which rows have a pivot) of a matrix scaled to a unit diagonal; a row that the ones before it explain has none, and a zero row and column in the factor."""
    p = len(a)
    low, free = np.zeros((p, p)), np.ones(p, bool)
    for j in range(p):
        pivot = a[j, j] - low[j, :j] @ low[j, :j]
        if not pivot > least:
            low[j] = 0.0
            free[j] = False
            continue
        low[j, j] = np.sqrt(pivot)
        for i in range(j + 1, p):
            low[i, j] = (a[i, j] - low[i, :j] @ low[j, :j]) / low[j, j]
    return low, free


def solve(s: np.ndarray, n: int, means: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """(coefficients with the intercept first, their standard errors, residual sum of squares, which regressors count) from centred cross products, the response last."""
    p = len(s) - 1
    scale = np.sqrt(np.maximum(np.diag(s)[:p], 0.0))
    usable = scale > 0
    unit = np.where(usable, scale, 1.0)
    low, free = cholesky(np.where(np.outer(usable, usable), s[:p, :p] / np.outer(unit, unit), 0.0))
    at = np.flatnonzero(free)
    b, inverse = np.zeros(p), np.full((p, p), np.nan)
    if len(at):
        l_inv = np.linalg.inv(low[np.ix_(at, at)])
        inv = l_inv.T @ l_inv / np.outer(unit[at], unit[at])
        b[at] = inv @ s[at, p]
        inverse[np.ix_(at, at)] = inv
    rss = max(0.0, float(s[p, p] - b @ s[:p, p]))
    dof = n - len(at) - 1
    var = rss / dof if dof > 0 else np.nan
    se = np.full(p + 1, np.nan)
    se[1:][at] = np.sqrt(var * np.diag(inverse)[at])
    m = means[:p][at]
    se[0] = np.sqrt(var * (1.0 / n + (m @ inverse[np.ix_(at, at)] @ m if len(at) else 0.0)))
    return np.concatenate([[means[p] - b @ means[:p]], b]), se, rss, free


def fit(df: DataFrame, y: str, xs: list[str], by: list[str] = ()) -> DataFrame:
    """(by, term, n, dof, coefficient, se, t, p, ci_lo, ci_hi, r2, adj_r2, f, f_p): a row for the intercept and each regressor of each group.

    Rows with a null in any column take no part. A regressor that does not vary, or that those named before it explain, has a coefficient of 0 and no error. Without a degree of freedom there are no
    errors; without rows there is no group. The interval is 1.96 errors wide.
    """
    by, cols = list(by), [*xs, y]
    x = df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols])
    for c in cols:
        x = x.where(F.col(c).isNotNull() & ~F.isnan(c))
    p = len(xs)
    pairs = [(i, j) for i in range(p + 1) for j in range(i + 1)]
    # Spark merges covariances about the means, so no digits go in differences of large sums
    moments = x.groupBy(*by).agg(F.count("*").alias("n_"), F.array(*[F.avg(c) for c in cols]).alias("m_"), F.array(*[F.covar_pop(cols[i], cols[j]) * F.count("*") for i, j in pairs]).alias("s_"))
    moments = moments.where("n_ > 0")
    names = ["intercept", *xs]

    def terms(batches):
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                s = np.zeros((p + 1, p + 1))
                for (i, j), v in zip(pairs, r["s_"]):
                    s[i, j] = s[j, i] = v
                n = int(r["n_"])
                b, se, rss, free = solve(s, n, np.asarray(r["m_"], float))
                r2 = 1.0 - rss / s[p, p] if s[p, p] > 0 else np.nan
                k = int(free.sum())
                rows += [[*[r[c] for c in by], names[i], n, n - k - 1, k, b[i], se[i], r2] for i in range(p + 1)]
            yield pd.DataFrame(rows, columns=[*by, "term", "n", "dof", "k", "coefficient", "se", "r2"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*by).schema)
    out = moments.mapInPandas(terms, f"{fields}term string, n long, dof long, k long, coefficient double, se double, r2 double")
    none = lambda c: F.nanvl(F.col(c), F.lit(None).cast("double"))
    out = out.withColumn("se", none("se")).withColumn("r2", none("r2")).withColumn("t", F.col("coefficient") / F.nullif(F.col("se"), F.lit(0.0)))
    dof, k = F.nullif(F.greatest("dof", F.lit(0)), F.lit(0)), F.nullif(F.col("k"), F.lit(0))
    out = out.withColumn("f", (F.col("r2") / k) / F.nullif((1.0 - F.col("r2")) / dof, F.lit(0.0)))
    return out.select(
        *by, "term", "n", "dof", "coefficient", "se", "t", t_two_sided(F.col("t"), F.col("dof")).alias("p"), (F.col("coefficient") - 1.96 * F.col("se")).alias("ci_lo"),
        (F.col("coefficient") + 1.96 * F.col("se")).alias("ci_hi"), "r2", (1.0 - (1.0 - F.col("r2")) * (F.col("n") - 1) / dof).alias("adj_r2"), "f", f_upper(F.col("f"), F.col("k"), F.col("dof")).alias("f_p"),
    )


def fitted(df: DataFrame, coefficients: DataFrame, xs: list[str], name: str = "fitted", by: list[str] = ()) -> DataFrame:
    """df with the fitted value; null where a regressor is missing. coefficients: as of ``fit``; a row for each group of ``by``, one overall without."""
    by = list(by)
    wide = coefficients.groupBy(*by).agg(*[F.max(F.when(F.col("term") == t, F.col("coefficient"))).alias(f"b{i}_") for i, t in enumerate(["intercept", *xs])])
    x = df.join(wide, by, "left") if by else df.crossJoin(F.broadcast(wide))
    value = F.col("b0_")
    for i, c in enumerate(xs, 1):
        value = value + F.col(f"b{i}_") * F.col(c)
    return x.withColumn(name, value).select(*df.columns, name)


def in_sample(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """One row (n, r2, rho): how well a fit on all rows repeats the response, and Spearman's correlation of the response and the fitted values (rounded to 12 digits before they are ranked)."""
    whole = df.select(y, *xs)
    for c in (y, *xs):
        whole = whole.where(F.col(c).isNotNull() & ~F.isnan(c))
    b = stable(fit(whole, y, xs))
    size = 12 - F.ceil(F.log10(F.greatest(F.abs("fitted"), F.lit(1.0))))
    f = stable(fitted(whole, b, xs).withColumn("fitted", F.rint(F.col("fitted") * F.pow(F.lit(10.0), size)) / F.pow(F.lit(10.0), size)))
    ranked = with_rank(with_rank(f, y, "ry_", ties="average"), "fitted", "rf_", ties="average")
    rho = F.covar_pop("ry_", "rf_") / F.nullif(F.stddev_pop("ry_") * F.stddev_pop("rf_"), F.lit(0.0))
    return ranked.agg(rho.alias("rho")).crossJoin(F.broadcast(b.agg(F.max("n").alias("n"), F.max("r2").alias("r2")))).select("n", "r2", "rho")
