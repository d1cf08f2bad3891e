"""Data quality: profiles, provenance counts, coverage, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .impute import status_class


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, nulls, infinite, distinct, lo, hi, mean, std, constant, in_domain) of numeric columns, in one pass.

    in_domain: percentages (name has 'pct') lie in 0-100; counts and densities are not negative.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])
    x = df.select(F.inline(cells))
    fin = F.when(F.abs("v") != float("inf"), F.nanvl("v", F.lit(None).cast("double")))
    x = x.withColumn("f", fin)
    out = x.groupBy("column").agg(
        F.count("*").alias("n"), F.count_if(F.col("v").isNull()).alias("nulls"), F.count_if(F.abs("v") == float("inf")).alias("infinite"),
        F.count_distinct("f").alias("distinct"), F.min("f").alias("lo"), F.max("f").alias("hi"), F.avg("f").alias("mean"), F.stddev_samp("f").alias("std"),
    )
    pct = F.col("column").contains("pct")
    count = F.col("column").contains("density") | F.col("column").contains("count")
    ok = F.when(pct, (F.col("lo") >= 0) & (F.col("hi") <= 100)).when(count, F.col("lo") >= 0).otherwise(F.lit(True))
    return out.withColumn("constant", F.col("distinct") <= 1).withColumn("in_domain", F.coalesce(ok, F.lit(True)))


def provenance(cells: DataFrame, by: list[str]) -> DataFrame:
    """(by, total, observed, inherited, imputed, missing, observed_pct, quality): counts by kind of status; quality weighs them 1, 0.85 and 0.6."""
    s = F.upper("status")
    kinds = {"observed": s.contains("OBSERVED"), "inherited": s.contains("INHERITED"), "imputed": s.contains("IMPUTED"), "missing": s.contains("MISSING")}
    out = cells.groupBy(*by).agg(F.count("*").alias("total"), *[F.count_if(c).alias(k) for k, c in kinds.items()])
    n = F.nullif(F.col("total"), F.lit(0))
    return out.withColumn("observed_pct", 100.0 * F.col("observed") / n).withColumn("quality", (F.col("observed") + 0.85 * F.col("inherited") + 0.6 * F.col("imputed")) / n)


def completeness(cells: DataFrame, classes: list[str]) -> DataFrame:
    """(indicator, one count for each status class); sources of inheritance are folded."""
    return cells.withColumn("k", status_class(F.col("status"))).groupBy("indicator").pivot("k", classes).count().na.fill(0, classes)


def group_status(cells: DataFrame, source: Column) -> DataFrame:
    """(grp, source, status): AVAILABLE if any cell was observed, else INHERITED, else IMPUTED."""
    s = cells.withColumn("source", source).groupBy("grp", "source").agg(F.bool_or(F.col("status") == "OBSERVED").alias("o"), F.bool_or(F.col("status").startswith("INHERITED")).alias("i"))
    return s.select("grp", "source", F.when(F.col("o"), "AVAILABLE").when(F.col("i"), "INHERITED").otherwise("IMPUTED").alias("status"))


def coverage(dim: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Every entity with how often the source has it and a status, whether it has it or not."""
    n = seen.groupBy(key).agg(F.count("*").alias("n_rows"))
    out = dim.join(n, key, "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))
    return out.withColumn("status", F.when(F.col("n_rows") > 0, "COVERED").otherwise("NOT COVERED"))


def strict_ids(df: DataFrame, key: str, dim: DataFrame) -> DataFrame:
    """df, which fails when read if an id is null, not a whole number, or not in the dimension."""
    known = dim.select(F.col(key).cast("long").alias(key), F.lit(True).alias("known_")).distinct()
    x = df.withColumn("id_", F.col(key).cast("string").try_cast("long"))
    bad = F.col("id_").isNull() | F.col("known_").isNull()
    joined = x.join(known.withColumnRenamed(key, "id_"), "id_", "left")
    check = F.when(bad, F.raise_error(F.concat(F.lit("not an entity id: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))).otherwise(F.col("id_"))
    return joined.withColumn(key, check).drop("id_", "known_")


def gate(name: str, df: DataFrame, passed: Column, metric: Column, critical: bool = True) -> DataFrame:
    """One row (gate, passed, metric, critical) from one aggregation."""
    return df.agg(passed.alias("passed"), metric.cast("double").alias("metric")).select(F.lit(name).alias("gate"), F.coalesce("passed", F.lit(False)).alias("passed"), "metric", F.lit(critical).alias("critical"))


def roll_up(gates: DataFrame) -> DataFrame:
    return gates.agg(F.count("*").alias("total"), F.count_if(F.col("passed")).alias("passed"), F.count_if(~F.col("passed")).alias("failed"), F.count_if(~F.col("passed") & F.col("critical")).alias("critical_failed"))
