"""Statistics for audits: correlation, regression, cross-validation, overlap and error metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import t_two_sided
from .order import quantiles, with_rank


def correlation(x: str, y: str) -> Column:
    """Pearson's correlation; null, not an error, where a column does not vary."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row (pearson, spearman): Spearman is Pearson of average ranks. Rows with a null in either take no part."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = with_rank(with_rank(both, x, "rx_", ties="average"), y, "ry_", ties="average")
    return ranked.agg(correlation(x, y).alias("pearson"), correlation("rx_", "ry_").alias("spearman"))


def correlation_pairs(wide: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r, band) for each unordered pair of columns, in one aggregation."""
    pairs = [(columns[i], columns[j]) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    row = wide.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs])
    return row.select(F.inline(cells)).withColumn("band", band(F.col("r")))


def band(r: Column) -> Column:
    a = F.abs(r)
    return F.when(r.isNull(), "UNDEFINED").when(a >= 0.9, "VERY HIGH").when(a >= 0.7, "HIGH").when(a >= 0.4, "MODERATE").otherwise("LOW")


def ols(df: DataFrame, y: str, x: str, by: list[str] = ()) -> DataFrame:
    """(by, n, slope, intercept, r2, adj_r2, slope_se, t, p, ci_lo, ci_hi) of a one-variable least-squares fit, from moments; p is two-sided."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    m = both.groupBy(*by).agg(
        F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"),
        F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"),
    )
    dof = F.nullif(F.col("n") - 2, F.lit(0))
    se = F.sqrt((1.0 - F.col("r2")) * F.col("syy") / dof / F.nullif(F.col("sxx"), F.lit(0.0)))
    m = m.withColumn("adj_r2", 1.0 - (1.0 - F.col("r2")) * (F.col("n") - 1) / dof).withColumn("slope_se", se)
    m = m.withColumn("t", F.col("slope") / F.nullif(F.col("slope_se"), F.lit(0.0)))
    m = m.withColumn("p", t_two_sided(F.col("t"), F.col("n") - 2))
    return m.withColumn("ci_lo", F.col("slope") - 1.96 * F.col("slope_se")).withColumn("ci_hi", F.col("slope") + 1.96 * F.col("slope_se")).drop("sxx", "syy")


def held_out_fit(df: DataFrame, y: str, x: str, fold: str) -> DataFrame:
    """(fold, n, slope, intercept, r2, rmse, mae, small_n): each fold predicted by the fit on all others.

    The fit on the others comes from all moments less the fold's own, so data are read twice, not once for each fold.
    """
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(fold, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    # moments about the overall means, which keeps differences of sums accurate
    centre = both.agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    z = both.crossJoin(F.broadcast(centre)).select(fold, "x", "y", "cx", "cy", (F.col("x") - F.col("cx")).alias("u"), (F.col("y") - F.col("cy")).alias("v"))
    own = z.groupBy(fold).agg(F.count("*").alias("n"), F.sum("u").alias("su"), F.sum("v").alias("sv"), F.sum(F.col("u") * F.col("u")).alias("suu"), F.sum(F.col("u") * F.col("v")).alias("suv"), F.max("cx").alias("cx"), F.max("cy").alias("cy"))
    names = ["n", "su", "sv", "suu", "suv"]
    total = own.agg(*[F.sum(c).alias(f"t_{c}") for c in names])
    rest = own.crossJoin(F.broadcast(total)).select(fold, "n", "cx", "cy", *[(F.col(f"t_{c}") - F.col(c)).alias(f"r_{c}") for c in names])
    m = F.nullif(F.col("r_n"), F.lit(0))
    slope = (F.col("r_suv") - F.col("r_su") * F.col("r_sv") / m) / F.nullif(F.col("r_suu") - F.col("r_su") * F.col("r_su") / m, F.lit(0.0))
    fit = rest.withColumn("slope", slope).withColumn("intercept", F.col("cy") + F.col("r_sv") / m - F.col("slope") * (F.col("cx") + F.col("r_su") / m)).select(fold, "slope", "intercept")
    e = z.join(F.broadcast(fit), fold).withColumn("e", F.col("y") - F.col("intercept") - F.col("slope") * F.col("x"))
    return e.groupBy(fold).agg(
        F.count("*").alias("n"), F.max("slope").alias("slope"), F.max("intercept").alias("intercept"),
        (1.0 - F.sum(F.col("e") * F.col("e")) / F.nullif(F.var_pop("y") * F.count("*"), F.lit(0.0))).alias("r2"),
        F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.avg(F.abs("e")).alias("mae"), (F.count("*") < 10).alias("small_n"),
    )


def error_metrics(df: DataFrame, a: str, b: str, thresholds: tuple[float, ...] = (1e-4, 1e-2)) -> DataFrame:
    """One row: n, max_abs, mean_abs, rmse and, for each threshold, how many differences exceed it."""
    d = F.abs(F.col(a) - F.col(b))
    over = [F.count_if(d > t).alias(f"over_{k + 1}") for k, t in enumerate(thresholds)]
    return df.agg(F.count(d).alias("n"), F.max(d).alias("max_abs"), F.avg(d).alias("mean_abs"), F.sqrt(F.avg(d * d)).alias("rmse"), *over)


def variant_metrics(base: DataFrame, variants: DataFrame, top: int = 20) -> DataFrame:
    """(variant, pearson, spearman, top_overlap, tier_agreement, mean_shift, max_shift) against the base.

    base: (id, score, rank, tier); variants: (variant, id, score, rank, tier). Spearman of average ranks.
    """
    b = base.select("id", F.col("score").alias("b_score"), F.col("rank").alias("b_rank"), F.col("tier").alias("b_tier"))
    both = variants.join(b, "id")
    ranked = with_rank(with_rank(both, "score", "rs_", ["variant"], ties="average"), "b_score", "rb_", ["variant"], ties="average")
    shift = F.abs(F.col("rank") - F.col("b_rank"))
    return ranked.groupBy("variant").agg(
        F.corr("score", "b_score").alias("pearson"), F.corr("rs_", "rb_").alias("spearman"),
        (100.0 * F.count_if((F.col("rank") <= top) & (F.col("b_rank") <= top)) / F.nullif(F.count_if(F.col("b_rank") <= top), F.lit(0))).alias("top_overlap"),
        (100.0 * F.avg((F.col("tier") == F.col("b_tier")).cast("double"))).alias("tier_agreement"),
        F.avg(shift.cast("double")).alias("mean_shift"), F.max(shift).alias("max_shift"),
    )


def winsor_share(df: DataFrame, value: str, p: float) -> DataFrame:
    """One row (share): what part of the total the values at or above a quantile hold."""
    q = quantiles(df, value, {"cut": p})
    return df.crossJoin(F.broadcast(q)).agg((F.sum(F.when(F.col(value) >= F.col("cut"), F.col(value))) / F.sum(value)).alias("share"))


def equal_multisets(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (only_a, only_b, equal): rows, counted with repeats, that one frame has beyond the other."""
    keys = a.columns
    n = a.withColumn("d_", F.lit(1)).unionByName(b.select(*keys).withColumn("d_", F.lit(-1))).groupBy(*keys).agg(F.sum("d_").alias("d_"))
    out = n.agg(F.coalesce(F.sum(F.greatest("d_", F.lit(0))), F.lit(0)).alias("only_a"), F.coalesce(F.sum(F.greatest(-F.col("d_"), F.lit(0))), F.lit(0)).alias("only_b"))
    return out.withColumn("equal", (F.col("only_a") == 0) & (F.col("only_b") == 0))
