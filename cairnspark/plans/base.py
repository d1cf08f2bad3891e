"""The query registry, and the fact table that queries on the star schema share.

Entities are customers, groups are nations, indicators are aggregates of their orders. Cells are made missing by stated rules, so
that every branch of the imputation runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stable import stable
from ..sources.readers import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: (indicator, pillar, direction). P5 is the dampener.
INDICATORS = [
    ("n_orders", "P1", "POSITIVE"),
    ("sum_price", "P1", "POSITIVE"),
    ("avg_price", "P2", "NEGATIVE"),
    ("acctbal", "P2", "POSITIVE"),
    ("urgent_pct", "P3", "POSITIVE"),
    ("late_orders", "P3", "POSITIVE"),
    ("filled_pct", "P5", "SATURATION_DAMPENER"),
]
DAMPENER, LAMBDA = "P5", 0.15
WEIGHTS = {"P1": 0.5, "P2": 0.3, "P3": 0.2}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def indicators(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(INDICATORS, "indicator string, pillar string, direction string")


def weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(WEIGHTS.items()), "pillar string, weight double")


def wide_facts(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each customer: id, grp and the indicators, with the stated gaps."""
    o = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("id")).agg(
        F.count("*").cast("double").alias("n_orders"), F.sum("o_totalprice").alias("sum_price"), F.avg("o_totalprice").alias("avg_price"),
        (100.0 * F.avg(F.col("o_orderpriority").startswith("1").cast("double"))).alias("urgent_pct"),
        F.sum((F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp_ntz")).cast("double")).alias("late_orders"),
        (100.0 * F.avg((F.col("o_orderstatus") == "F").cast("double"))).alias("filled_pct"),
    )
    c = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("grp"), F.col("c_acctbal").alias("acctbal"))
    x = c.join(o, "id", "left")
    gap = lambda name, hide: F.when(~hide, F.col(name)).alias(name)
    k, g = F.col("id"), F.col("grp")
    return x.select(
        "id", "grp", gap("n_orders", k % 7 == 0), gap("sum_price", k % 11 == 3), gap("avg_price", k % 7 == 2), "acctbal",
        gap("urgent_pct", (g % 5 == 0) | (k % 13 == 1)), "late_orders", "filled_pct",
    )


def facts(spark: SparkSession, folder: str) -> DataFrame:
    """(id, grp, indicator, value) in long form, evaluated once."""
    cells = F.array(*[F.struct(F.lit(i).alias("indicator"), F.col(i).alias("value")) for i, _, _ in INDICATORS])
    return stable(wide_facts(spark, folder).select("id", "grp", F.inline(cells)))


#: The same tables for DuckDB: w (wide), f (long), i (indicators), wt (pillar weights).
SQL = """WITH w AS (
  SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS grp,
    CASE WHEN c_custkey % 7 <> 0 THEN n_orders END AS n_orders, CASE WHEN c_custkey % 11 <> 3 THEN sum_price END AS sum_price,
    CASE WHEN c_custkey % 7 <> 2 THEN avg_price END AS avg_price, c_acctbal AS acctbal,
    CASE WHEN NOT (c_nationkey % 5 = 0 OR c_custkey % 13 = 1) THEN urgent_pct END AS urgent_pct, late_orders, filled_pct
  FROM customer LEFT JOIN (
    SELECT o_custkey, CAST(count(*) AS DOUBLE) AS n_orders, sum(o_totalprice) AS sum_price, avg(o_totalprice) AS avg_price,
      100.0 * avg(CASE WHEN o_orderpriority LIKE '1%' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS urgent_pct,
      sum(CASE WHEN o_orderdate >= TIMESTAMP '2000-01-01' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS late_orders,
      100.0 * avg(CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS filled_pct
    FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey
), i(indicator, pillar, direction) AS (VALUES """ + ", ".join(str(r) for r in INDICATORS) + """
), wt(pillar, weight) AS (VALUES """ + ", ".join(f"('{p}', {x}::DOUBLE)" for p, x in WEIGHTS.items()) + """
), f AS (
""" + " UNION ALL ".join(f"SELECT id, grp, '{i}' AS indicator, CAST({i} AS DOUBLE) AS value FROM w" for i, _, _ in INDICATORS) + """
)"""

#: m: group means filled; n: min-max of those (nothing is missing then but groups without a mean, which get 50).
FILLED = SQL + """, m AS (
  SELECT id, grp, indicator, coalesce(value, avg(value) OVER (PARTITION BY grp, indicator)) AS value, value IS NOT NULL AS had,
    CASE WHEN value IS NOT NULL THEN 'OBSERVED' WHEN count(value) OVER (PARTITION BY grp, indicator) > 0 THEN 'IMPUTED_GROUP_MEAN' ELSE 'MISSING' END AS status
  FROM f
), n AS (
  SELECT m.id, m.grp, m.indicator, pillar, m.status, CASE WHEN value IS NULL OR hi = lo THEN 50.0
    WHEN direction = 'NEGATIVE' THEN 100.0 - (value - lo) / (hi - lo) * 100.0 ELSE (value - lo) / (hi - lo) * 100.0 END AS norm
  FROM m JOIN (SELECT indicator, min(value) AS lo, max(value) AS hi FROM m GROUP BY 1) USING (indicator) JOIN i USING (indicator)
)"""

#: e: entropy weights; s: pillar scores; c: composite.
SCORED = FILLED + """, e0 AS (
  SELECT pillar, indicator, count(*) AS k, sum(norm + 1e-6) AS t, sum((norm + 1e-6) * ln(norm + 1e-6)) AS xl FROM n GROUP BY 1, 2
), e AS (
  SELECT pillar, indicator, ent, greatest(1.0 - ent, 1e-6) / sum(greatest(1.0 - ent, 1e-6)) OVER (PARTITION BY pillar) AS weight
  FROM (SELECT *, CASE WHEN k <= 1 THEN 1.0 ELSE (ln(t) - xl / t) / ln(k) END AS ent FROM e0)
), s AS (
  SELECT n.id, n.grp, n.pillar, sum(e.weight * n.norm) AS score FROM n JOIN e USING (pillar, indicator) GROUP BY 1, 2, 3
), c AS (
  SELECT id, grp, round(sum(weight * score), 6) AS driver, round(0.15 * coalesce(max(CASE WHEN pillar = 'P5' THEN score END), 0), 6) AS penalty,
    round(sum(weight * score) - 0.15 * coalesce(max(CASE WHEN pillar = 'P5' THEN score END), 0), 6) AS score,
    round(exp(sum(weight * ln(score + 1))) * greatest(1 - 0.15 * coalesce(max(CASE WHEN pillar = 'P5' THEN score END), 0) / 100, 0), 6) AS geometric
  FROM s LEFT JOIN wt USING (pillar) GROUP BY 1, 2
)"""


def normalised(spark: SparkSession, folder: str) -> DataFrame:
    """(id, grp, indicator, value, status, norm): filled by group means and scaled; evaluated once."""
    from ..operators import impute, normalise

    return stable(normalise.minmax(impute.group_mean(facts(spark, folder)), indicators(spark)))


def pillar_frame(spark: SparkSession, folder: str, norm: DataFrame | None = None) -> DataFrame:
    """(id, pillar, score) under entropy weights."""
    from ..operators import score, weights as w

    n = norm if norm is not None else normalised(spark, folder)
    own = n.join(F.broadcast(indicators(spark).select("indicator", "pillar")), "indicator")
    return score.pillar_scores(n, w.entropy(own))


def composite_frame(spark: SparkSession, folder: str) -> DataFrame:
    """(id, grp, driver, penalty, score, geometric), rounded and evaluated once."""
    from ..operators import score

    n = normalised(spark, folder)
    c = score.composite(pillar_frame(spark, folder, n), weights(spark), LAMBDA, DAMPENER)
    grp = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("grp"))
    return stable(c.join(grp, "id").select("id", "grp", *[F.round(x, 6).alias(x) for x in ("driver", "penalty", "score", "geometric")]))
