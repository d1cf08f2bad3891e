"""Indicator and pillar weights: entropy, pairwise comparison, equal, hybrid, first principal component."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Saaty's random consistency index by matrix size (fixed values).
RANDOM_INDEX = {1: 0.0, 2: 0.0, 3: 0.58, 4: 0.90, 5: 1.12, 6: 1.24, 7: 1.32, 8: 1.41, 9: 1.45, 10: 1.49}


def entropy(norm: DataFrame, epsilon: float = 1e-6, value: str = "norm", by: list[str] = ("pillar",)) -> DataFrame:
    """(by, indicator, entropy, weight): Shannon entropy weights inside each pillar.

    p = (x + epsilon) / sum, e = -sum p ln p / ln m, d = max(1 - e, 1e-6), weight = d / sum d. One row or less for each indicator: all weights equal.
    """
    by = list(by)
    x = F.col(value) + F.lit(epsilon)
    # -sum p ln p = ln S - (sum x ln x) / S, so one aggregation is enough
    s = norm.where(F.col(value).isNotNull()).groupBy(*by, "indicator").agg(F.count("*").alias("m"), F.sum(x).alias("s"), F.sum(x * F.ln(x)).alias("xlnx"))
    e = F.when(F.col("m") <= 1, F.lit(1.0)).otherwise((F.ln("s") - F.col("xlnx") / F.col("s")) / F.ln(F.col("m").cast("double")))
    d = s.withColumn("entropy", e).withColumn("d", F.greatest(1.0 - F.col("entropy"), F.lit(1e-6)))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))  # a handful of rows
    return d.select(*by, "indicator", "entropy", (F.col("d") / F.sum("d").over(w)).alias("weight"))


def entropy_present(norm: DataFrame, tolerance: float = 1e-9, value: str = "norm", by: list[str] = ("pillar",)) -> DataFrame:
    """(by, indicator, weight): entropy over the positive values each indicator has, without epsilon; equal weights where no indicator diverges."""
    by = list(by)
    x = F.when(F.col(value) > 0, F.col(value))
    s = norm.groupBy(*by, "indicator").agg(F.count(value).alias("m"), F.sum(x).alias("s"), F.sum(x * F.ln(x)).alias("xlnx"))
    e = F.when((F.col("m") <= 1) | F.col("s").isNull(), F.lit(1.0)).otherwise((F.ln("s") - F.col("xlnx") / F.col("s")) / F.ln(F.greatest(F.col("m"), F.lit(2)).cast("double")))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    d = s.withColumn("d", F.greatest(1.0 - e, F.lit(0.0))).withColumn("total", F.sum("d").over(w))
    even = F.lit(1.0) / F.count("*").over(w)
    return d.select(*by, "indicator", F.when(F.col("total") <= tolerance, even).otherwise(F.col("d") / F.nullif(F.col("total"), F.lit(0.0))).alias("weight"))


def pairwise(matrix: list[list[float]]) -> dict:
    """Principal-eigenvector weights of a reciprocal matrix, its eigenvalue, consistency index and ratio, and the residuals |M w - lambda w|."""
    m = np.array(matrix, float)
    n = len(m)
    values, vectors = np.linalg.eig(m)
    k = int(values.real.argmax())
    w = np.abs(vectors[:, k].real)
    w /= w.sum()
    top = float(values[k].real)
    ci = (top - n) / (n - 1) if n > 1 else 0.0
    ri = RANDOM_INDEX.get(n, 1.49)
    cr = ci / ri if ri else 0.0
    return {"weights": w.tolist(), "eigenvalue": top, "ci": ci, "ri": ri, "cr": cr, "consistent": cr < 0.10, "residuals": np.abs(m @ w - top * w).tolist()}


def pairwise_frame(spark: SparkSession, names: list[str], matrix: list[list[float]]) -> DataFrame:
    w = pairwise(matrix)["weights"]
    return spark.createDataFrame(list(zip(names, map(float, w))), "pillar string, weight double")


def pairwise_table(cells: DataFrame) -> DataFrame:
    """(item, weight, eigenvalue, ci, cr, consistent) from the upper half of a reciprocal matrix in long form (i, j, value), i < j; see ``pairwise``.

    The matrix has a row for each item that is compared, a bounded number; a pair that is not there counts as equal.
    """
    spark, found = cells.sparkSession, [(r.i, r.j, float(r.value)) for r in cells.select("i", "j", "value").collect()]
    items = sorted({x for i, j, _ in found for x in (i, j)})
    at = {x: k for k, x in enumerate(items)}
    m = np.ones((len(items), len(items)))
    for i, j, v in found:
        m[at[i], at[j]], m[at[j], at[i]] = v, 1.0 / v
    schema = f"item {cells.schema['i'].dataType.simpleString()}, weight double, eigenvalue double, ci double, cr double, consistent boolean"
    if not items:
        return spark.createDataFrame([], schema)
    p = pairwise(m.tolist())
    return spark.createDataFrame([(x, float(p["weights"][k]), p["eigenvalue"], p["ci"], p["cr"], bool(p["consistent"])) for x, k in at.items()], schema)


def geometric_mean_matrix(cells: DataFrame) -> DataFrame:
    """(i, j, value): element-wise geometric mean of several judges' matrices in long form (judge, i, j, value)."""
    return cells.groupBy("i", "j").agg(F.exp(F.avg(F.ln("value"))).alias("value"))


def renormalised(weights: DataFrame, keep, by: list[str] = ()) -> DataFrame:
    """Weights of the rows that ``keep`` selects, made to sum to one again (in each group)."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    return weights.where(keep).withColumn("weight", F.col("weight") / F.sum("weight").over(w))


def hybrid(a: DataFrame, b: DataFrame, key: str = "indicator") -> DataFrame:
    """(key, weight): product of two weightings, made to sum to one."""
    both = a.select(key, F.col("weight").alias("a_")).join(b.select(key, F.col("weight").alias("b_")), key)
    p = F.col("a_") * F.col("b_")
    return both.select(key, (p / F.sum(p).over(Window.partitionBy(F.lit(1)))).alias("weight"))


def equal(names: DataFrame, key: str = "indicator") -> DataFrame:
    return names.select(key, (F.lit(1.0) / F.count("*").over(Window.partitionBy(F.lit(1)))).alias("weight"))


def schemes(names: DataFrame, own: DataFrame, experts: dict[str, float]) -> DataFrame:
    """(scheme, indicator, weight) of four weightings of the same indicators, each summing to one.

    names: (indicator, pillar); own: (pillar, indicator, weight), entropy weights inside pillars; experts: pillar weights, dealt evenly to a pillar's indicators. Hybrid is
    the expert weight of the pillar times the entropy weight.
    """
    every, pillar = Window.partitionBy(F.lit(1)), Window.partitionBy("pillar")  # a handful of rows
    x = names.join(own.select("indicator", F.col("weight").alias("e_")), "indicator")
    x = x.withColumn("p_", F.try_element_at(F.create_map(*[F.lit(v) for kv in experts.items() for v in kv]), F.col("pillar")))
    mixed = F.col("e_") * F.col("p_")
    kinds = {"EQUAL": 1.0 / F.count("*").over(every), "ENTROPY": F.col("e_") / F.sum("e_").over(every), "EXPERT": F.col("p_") / F.count("*").over(pillar), "HYBRID": mixed / F.sum(mixed).over(every)}
    x = x.select("indicator", *[c.alias(k) for k, c in kinds.items()])
    return x.select("indicator", F.inline(F.array(*[F.struct(F.lit(k).alias("scheme"), F.col(k).alias("weight")) for k in kinds]))).select("scheme", "indicator", "weight")


def first_component(wide: DataFrame, columns: list[str], id_col: str = "id") -> DataFrame:
    """(id, pc1): scores on the first principal component of standardised columns, min-max to 0-100, loadings summing to a positive number.

    The moments are one aggregation; the driver solves a matrix of columns x columns.
    """
    moments = [F.avg(c).alias(f"m_{i}") for i, c in enumerate(columns)] + [F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(columns)]
    pairs = [F.corr(columns[i], columns[j]).alias(f"r_{i}_{j}") for i in range(len(columns)) for j in range(i)]
    row = wide.agg(*moments, *pairs).first()
    k = len(columns)
    r = np.eye(k)
    for i in range(k):
        for j in range(i):
            r[i, j] = r[j, i] = row[f"r_{i}_{j}"] or 0.0
    values, vectors = np.linalg.eigh(r)
    load = vectors[:, int(values.argmax())]
    load = load if load.sum() >= 0 else -load
    score = sum(((F.col(c) - F.lit(row[f"m_{i}"])) / F.lit(row[f"s_{i}"] or 1.0) * F.lit(float(load[i])) for i, c in enumerate(columns)), F.lit(0.0))
    raw = wide.select(id_col, score.alias("raw"))
    span = raw.agg(F.min("raw").alias("lo"), F.max("raw").alias("hi"))
    return raw.crossJoin(F.broadcast(span)).select(id_col, ((F.col("raw") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * 100.0).alias("pc1"))
