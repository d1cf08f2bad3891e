"""Smaller table operators: unpivoting, coercion, positional joins, list flags, sub-samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import quantiles, with_rank


def unpivot(wide: DataFrame, key: list[str], columns: list[str], name: str = "indicator", value: str = "value") -> DataFrame:
    """One row for each key and column; columns the frame does not have are left out."""
    have = [c for c in columns if c in wide.columns]
    cells = F.array(*[F.struct(F.lit(c).alias(name), F.col(f"`{c}`").cast("double").alias(value)) for c in have])
    return wide.select(*key, F.inline(cells))


def coerce_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as numbers; what is none is filled with the column's median, and with 0 in a column without any number."""
    x = df
    for c in columns:
        x = x.withColumn(c, F.nanvl(F.col(c).cast("string").try_cast("double"), F.lit(None).cast("double")))
    for c in columns:
        m = quantiles(x.select(c), c, {f"{c}_median_": 0.5})
        x = x.join(F.broadcast(m), how="cross").withColumn(c, F.coalesce(c, f"{c}_median_", F.lit(0.0))).drop(f"{c}_median_")
    return x


def positional_join(left: DataFrame, left_order: str, right: DataFrame, right_order: str) -> DataFrame:
    """Rows side by side by their position in each frame's order; unmatched positions are kept. Orders have no ties."""
    from .order import row_numbers

    a = row_numbers(left, left_order, [F.lit(1)], "pos_")
    b = row_numbers(right, right_order, [F.lit(1)], "pos_")
    return a.join(b, "pos_", "full").withColumnRenamed("pos_", "position")


def listed(name: Column, names: list[str]) -> Column:
    """1 if any listed name is contained in the entity's name, else 0."""
    hit = F.lit(False)
    for n in names:
        hit = hit | F.coalesce(F.lower(name).contains(n.lower()), F.lit(False))
    return hit.cast("int")


def zero_if_covered(value: Column, covered: Column) -> Column:
    """A group that the source has but the entity is not in means zero; a group it does not have means unknown."""
    return F.coalesce(value, F.when(covered, F.lit(0)))


def subsample_correlation(cells: DataFrame, keep: Column, value: str = "value") -> DataFrame:
    """(indicator, n, spearman): ranks among the kept rows against the same rows' ranks among all."""
    every = with_rank(cells, value, "r_all", ["indicator"], ties="average")
    part = with_rank(every.where(keep), value, "r_part", ["indicator"], ties="average")
    return part.where(F.col(value).isNotNull()).groupBy("indicator").agg(F.count("*").alias("n"), F.corr("r_all", "r_part").alias("spearman"))


def file_profile(rows: DataFrame, patterns: dict[str, Column]) -> DataFrame:
    """(source, n_rows, hits of each pattern) for a family of files."""
    return rows.groupBy("source").agg(F.count("*").alias("n_rows"), *[F.count_if(c).alias(k) for k, c in patterns.items()])


def shares(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """df with each row's share of its group's total."""
    return df.withColumn("share", F.col(value) / F.nullif(F.sum(value).over(Window.partitionBy(*by)), F.lit(0.0)))


def size_and_intensity(df: DataFrame, count: str, population: str) -> DataFrame:
    """df with density, size (log of the count), intensity (log of the density) and their product."""
    d = F.col(count) / F.nullif(F.col(population), F.lit(0.0)) * 100_000.0
    x = df.withColumn("density", d).withColumn("size_index", F.log1p(count)).withColumn("intensity_index", F.log1p("density"))
    return x.withColumn("interaction", F.col("size_index") * F.col("intensity_index"))


def confidence(observed_pct: Column, inherited_pct: Column) -> Column:
    return F.when(observed_pct >= 80, "HIGH").when(observed_pct + inherited_pct >= 70, "MEDIUM").otherwise("LOW")
