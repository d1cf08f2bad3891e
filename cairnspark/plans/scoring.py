"""Queries: imputation, normalisation, weights, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import impute, lineage, normalise, score
from ..operators import weights as w
from ..operators.stable import stable

from ..sources.readers import table
from .base import DAMPENER, FILLED, LAMBDA, SCORED, SQL, WEIGHTS, composite_frame, facts, indicators, normalised, pillar_frame, query, weights

TIERS = "CASE WHEN {v} >= {p}80 THEN 'TIER 1' WHEN {v} >= {p}50 THEN 'TIER 2' WHEN {v} >= {p}20 THEN 'TIER 3' ELSE 'TIER 4' END"
_Q = ", q AS (SELECT quantile_cont(score, 0.8) AS q80, quantile_cont(score, 0.5) AS q50, quantile_cont(score, 0.2) AS q20 FROM c)"


@query(SCORED + _Q + " SELECT id, grp, driver, penalty, score, geometric, rank() OVER (ORDER BY score DESC) AS rank, rank() OVER (PARTITION BY grp ORDER BY score DESC) AS group_rank, " + TIERS.format(v="score", p="q") + " AS tier FROM c, q")
def flagship_index(spark: SparkSession, folder: str) -> DataFrame:
    """The whole index: impute, scale, weigh by entropy, score, rank, tier."""
    return score.ranks_and_tiers(composite_frame(spark, folder)).select("id", "grp", "driver", "penalty", "score", "geometric", "rank", "group_rank", "tier")


@query(FILLED + " SELECT id, grp, indicator, round(value, 6) AS value, status FROM m")
def group_mean_impute(spark, folder):
    return impute.group_mean(facts(spark, folder)).select("id", "grp", "indicator", F.round("value", 6).alias("value"), "status")


_KNN = """
  SELECT t.id, t.indicator, d.value, row_number() OVER (PARTITION BY t.id, t.indicator ORDER BY abs(t.covariate - d.covariate), d.id) AS r
  FROM {t} t JOIN {d} d ON t.indicator = d.indicator AND d.id <> t.id"""


def _covered(spark, folder):
    c = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("covariate"))
    return facts(spark, folder).join(c, "id")


@query(SQL + ", fc AS (SELECT f.*, c_acctbal AS covariate FROM f JOIN customer ON c_custkey = id), t AS (SELECT * FROM fc WHERE value IS NULL), d AS (SELECT * FROM fc WHERE value IS NOT NULL), k AS (" + _KNN.format(t="t", d="d") + ") SELECT id, indicator, round(avg(value), 6) AS knn FROM k WHERE r <= 5 GROUP BY 1, 2")
def knn_impute(spark, folder):
    return impute.nearest(_covered(spark, folder), 5).select("id", "indicator", F.round("knn", 6).alias("knn"))


def _cascade_sql(donors: str) -> str:
    return (
        FILLED
        + f", mc AS (SELECT m.*, c_acctbal AS covariate FROM m JOIN customer ON c_custkey = id), t AS (SELECT * FROM mc WHERE value IS NULL), d AS (SELECT * FROM mc WHERE value IS NOT NULL AND {donors}), k AS ("
        + _KNN.format(t="t", d="d")
        + "), a AS (SELECT id, indicator, avg(value) AS knn FROM k WHERE r <= 5 GROUP BY 1, 2) SELECT mc.id, mc.indicator, round(coalesce(value, knn), 6) AS value, CASE WHEN value IS NULL AND knn IS NOT NULL THEN 'IMPUTED_KNN' ELSE status END AS status FROM mc LEFT JOIN a ON a.id = mc.id AND a.indicator = mc.indicator"
    )


@query(_cascade_sql("had"))
def cascade_snapshot(spark, folder):
    """Donors are observed cells only."""
    return impute.cascade(_covered(spark, folder), 5, "observed").select("id", "indicator", F.round("value", 6).alias("value"), "status")


@query(_cascade_sql("true"))
def cascade_pool(spark, folder):
    """Donors include what the group means filled."""
    return impute.cascade(_covered(spark, folder), 5, "filled").select("id", "indicator", F.round("value", 6).alias("value"), "status")


@query("""WITH RECURSIVE v AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal END AS value, CASE WHEN c_custkey > 0 THEN c_custkey // 2 END AS parent FROM customer),
r AS (SELECT id, value, parent, parent AS at, 0 AS d FROM v UNION ALL SELECT r.id, v.value, r.parent, v.parent, d + 1 FROM r JOIN v ON v.id = r.at WHERE r.value IS NULL)
SELECT v.id, 'acctbal' AS indicator, b.value, CASE WHEN v.value IS NOT NULL THEN 'OBSERVED' WHEN b.value IS NOT NULL THEN 'INHERITED_FROM_' || v.parent ELSE 'MISSING' END AS status
FROM v LEFT JOIN (SELECT id, arg_min(value, d) AS value FROM r WHERE value IS NOT NULL GROUP BY 1) b USING (id)""")
def lineage_inherit(spark, folder):
    c = table(spark, folder, "customer")
    values = c.select(F.col("c_custkey").alias("id"), F.lit("acctbal").alias("indicator"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal")).alias("value"))
    edges = c.where("c_custkey > 0").select(F.col("c_custkey").alias("child"), F.expr("c_custkey div 2").alias("parent"))
    return lineage.inherit(values, edges)


@query("""WITH y AS (SELECT o_custkey AS id, CAST(year(o_orderdate) AS INTEGER) AS year, sum(o_totalprice) AS value FROM orders WHERE o_orderpriority LIKE '1%' GROUP BY 1, 2),
t AS (SELECT c_custkey AS id, CAST(u.year AS INTEGER) AS year FROM customer, (SELECT unnest(range(1994, 2004)) AS year) u),
p AS (SELECT id, list(struct_pack(year := year, value := value) ORDER BY year) AS p FROM y GROUP BY 1),
x AS (SELECT t.id, t.year, p, greatest(1, least(len(list_filter(p, lambda e: e.year <= t.year)), len(p) - 1)) AS k FROM t LEFT JOIN p USING (id))
SELECT id, 'price' AS indicator, year, CASE WHEN len(p) >= 2 THEN round(p[k].value + (p[k + 1].value - p[k].value) * (year - p[k].year) / (p[k + 1].year - p[k].year), 4) END AS value FROM x""")
def trend_interpolate(spark, folder):
    o = table(spark, folder, "orders").where("o_orderpriority like '1%'")
    series = o.groupBy(F.col("o_custkey").alias("id"), F.year("o_orderdate").alias("year")).agg(F.sum("o_totalprice").alias("value")).withColumn("indicator", F.lit("price"))
    targets = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.lit("price").alias("indicator"), F.explode(F.sequence(F.lit(1994), F.lit(2003))).alias("year"))
    return impute.trend(series, targets).withColumn("value", F.round("value", 4))


@query(FILLED + " SELECT id, indicator, round(norm, 6) AS norm FROM n")
def minmax_dir(spark, folder):
    return normalised(spark, folder).select("id", "indicator", F.round("norm", 6).alias("norm"))


@query(SQL + " SELECT f.id, f.indicator, round(CASE WHEN hi = lo THEN 50.0 WHEN direction = 'NEGATIVE' THEN 100.0 - (value - lo) / (hi - lo) * 100.0 ELSE (value - lo) / (hi - lo) * 100.0 END, 6) AS norm FROM f JOIN (SELECT indicator, min(value) AS lo, max(value) AS hi FROM f GROUP BY 1) USING (indicator) JOIN i USING (indicator)")
def minmax_propagate(spark, folder):
    n = normalise.minmax(facts(spark, folder), indicators(spark), missing="propagate")
    return n.select("id", "indicator", F.when(F.col("value").isNotNull(), F.round("norm", 6)).alias("norm"))


_SCALE = "CASE WHEN z IS NULL OR hi = lo THEN 50.0 WHEN direction = 'NEGATIVE' THEN 100.0 - (z - lo) / (hi - lo) * 100.0 ELSE (z - lo) / (hi - lo) * 100.0 END"


@query(SQL + ", z AS (SELECT f.id, indicator, (value - q2) / CASE WHEN q3 - q1 <= 0 THEN 1 ELSE q3 - q1 END AS z FROM f JOIN (SELECT indicator, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) AS q3 FROM f GROUP BY 1) USING (indicator)) SELECT z.id, indicator, round(" + _SCALE + ", 6) AS norm FROM z JOIN (SELECT indicator, min(z) AS lo, max(z) AS hi FROM z GROUP BY 1) USING (indicator) JOIN i USING (indicator)")
def robust_iqr(spark, folder):
    return normalise.robust_iqr(facts(spark, folder), indicators(spark)).select("id", "indicator", F.round("norm", 6).alias("norm"))


@query(SQL + ", z AS (SELECT f.id, indicator, CASE WHEN value IS NOT NULL THEN greatest(a, least(b, value)) END AS z FROM f JOIN (SELECT indicator, quantile_cont(value, 0.05) AS a, quantile_cont(value, 0.95) AS b FROM f GROUP BY 1) USING (indicator)) SELECT z.id, indicator, round(" + _SCALE + ", 6) AS norm FROM z JOIN (SELECT indicator, min(z) AS lo, max(z) AS hi FROM z GROUP BY 1) USING (indicator) JOIN i USING (indicator)")
def winsor_minmax(spark, folder):
    return normalise.winsorised(facts(spark, folder), indicators(spark)).select("id", "indicator", F.round("norm", 6).alias("norm"))


@query(SQL + ", r AS (SELECT f.id, indicator, direction, rank() OVER (PARTITION BY indicator ORDER BY value) + (count(*) OVER (PARTITION BY indicator, value) - 1) / 2.0 AS up, rank() OVER (PARTITION BY indicator ORDER BY value DESC) + (count(*) OVER (PARTITION BY indicator, value) - 1) / 2.0 AS down, count(*) OVER (PARTITION BY indicator) AS k FROM f JOIN i USING (indicator) WHERE value IS NOT NULL) SELECT f.id, f.indicator, round(CASE WHEN r.direction = 'NEGATIVE' THEN down ELSE up END / k * 100.0, 6) AS norm FROM f LEFT JOIN r USING (id, indicator)")
def pct_rank_norm(spark, folder):
    return normalise.percentile_rank(facts(spark, folder), indicators(spark)).select("id", "indicator", F.round("norm", 6).alias("norm"))


@query(SQL + " SELECT f.id, f.indicator, round((value - mu) / nullif(sd, 0), 6) AS norm FROM f JOIN (SELECT indicator, avg(value) AS mu, stddev_pop(value) AS sd FROM f GROUP BY 1) USING (indicator)")
def zscore(spark, folder):
    return normalise.zscore(facts(spark, folder)).select("id", "indicator", F.round("norm", 6).alias("norm"))


def _norm_with_pillar(spark, folder):
    return normalised(spark, folder).join(F.broadcast(indicators(spark).select("indicator", "pillar")), "indicator")


@query(SCORED + " SELECT pillar, indicator, round(ent, 9) AS entropy, round(weight, 6) AS weight FROM e")
def entropy_weights(spark, folder):
    return w.entropy(_norm_with_pillar(spark, folder)).select("pillar", "indicator", F.round("entropy", 9).alias("entropy"), F.round("weight", 6).alias("weight"))


@query(FILLED + ", a AS (SELECT pillar, indicator, count(norm) AS k, sum(CASE WHEN norm > 0 THEN norm END) AS t, sum(CASE WHEN norm > 0 THEN norm * ln(norm) END) AS xl FROM n GROUP BY 1, 2), d AS (SELECT pillar, indicator, greatest(1 - CASE WHEN k <= 1 OR t IS NULL THEN 1.0 ELSE (ln(t) - xl / t) / ln(greatest(k, 2)) END, 0) AS d FROM a) SELECT pillar, indicator, round(d / sum(d) OVER (PARTITION BY pillar), 6) AS weight FROM d")
def entropy_weights_present(spark, folder):
    return w.entropy_present(_norm_with_pillar(spark, folder)).select("pillar", "indicator", F.round("weight", 6).alias("weight"))


@query("""WITH RECURSIVE t AS (SELECT c_mktsegment AS judge, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS i, sum(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
g AS (SELECT x.i, y.i AS j, exp(avg(ln(greatest(1.0, least(9.0, round(4 * x.v / y.v)))))) AS v FROM t x JOIN t y ON x.judge = y.judge AND x.i < y.i GROUP BY 1, 2),
m AS (SELECT i, j, v FROM g UNION ALL SELECT j, i, 1 / v FROM g UNION ALL SELECT DISTINCT i, i, 1.0::DOUBLE FROM t),
r AS (SELECT i, list(v ORDER BY j) AS row FROM m GROUP BY 1), a AS (SELECT list(row ORDER BY i) AS a, count(*) AS n FROM r),
p AS (SELECT 0 AS k, list_transform(range(n), lambda z: 1.0::DOUBLE / n) AS w, 0.0::DOUBLE AS top FROM a UNION ALL
SELECT k + 1, list_transform(u, lambda z: z / list_sum(u)), list_sum(u) FROM (SELECT k, list_transform(a, lambda row: list_dot_product(row, w)) AS u FROM p, a WHERE k < 80)),
l AS (SELECT w, top FROM p WHERE k = 80)
SELECT 'priority ' || u.i AS item, round(w[u.i], 6) AS weight, round(top, 6) AS eigenvalue, round((top - n) / (n - 1), 6) AS ci, round((top - n) / (n - 1) / 1.12, 6) AS cr FROM l, a, (SELECT unnest(range(1, 6)) AS i) u""")
def ahp_weights(spark, folder):
    """Priorities compared two by two: each market segment judges how much more one brings in than another, on a scale of whole numbers; the judges' geometric mean is the matrix."""
    o = table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    t = o.groupBy(F.col("c_mktsegment").alias("judge"), F.substring("o_orderpriority", 1, 1).cast("int").alias("i")).agg(F.sum("o_totalprice").alias("v"))
    pair = t.join(t.select("judge", F.col("i").alias("j"), F.col("v").alias("v2")), "judge").where("i < j")
    said = pair.select("judge", "i", "j", F.greatest(F.lit(1.0), F.least(F.lit(9.0), F.round(4 * F.col("v") / F.col("v2")))).alias("value"))
    named = [c.alias(k) for c, k in ((F.concat(F.lit("priority "), F.col("item").cast("string")), "item"), *((F.round(k, 6), k) for k in ("weight", "eigenvalue", "ci", "cr")))]
    return w.pairwise_table(w.geometric_mean_matrix(said)).select(*named)


@query(SCORED + ", g AS (SELECT pillar, sum(weight * ent) AS g FROM e GROUP BY 1) SELECT pillar, round(g * weight / sum(g * weight) OVER (), 6) AS weight FROM g JOIN wt USING (pillar)")
def hybrid_weights(spark, folder):
    e = w.entropy(_norm_with_pillar(spark, folder)).groupBy("pillar").agg(F.sum(F.col("weight") * F.col("entropy")).alias("weight"))
    return w.hybrid(e, weights(spark), "pillar").select("pillar", F.round("weight", 6).alias("weight"))


@query("SELECT CAST(l_linenumber AS INTEGER) AS i, l_returnflag AS j, round(exp(avg(ln(l_extendedprice))), 4) AS value FROM lineitem GROUP BY 1, 2")
def geo_mean_matrix(spark, folder):
    cells = table(spark, folder, "lineitem").select(F.col("l_linenumber").alias("i"), F.col("l_returnflag").alias("j"), F.col("l_extendedprice").alias("value"))
    return w.geometric_mean_matrix(cells).withColumn("value", F.round("value", 4))


@query(SCORED + " SELECT id, pillar, round(score, 6) AS score FROM s")
def pillar_scores(spark, folder):
    return pillar_frame(spark, folder).withColumn("score", F.round("score", 6))


@query(FILLED + " SELECT id, pillar, round(avg(norm), 6) AS score FROM n GROUP BY 1, 2")
def pillar_equal(spark, folder):
    return score.equal_pillar_scores(normalised(spark, folder), indicators(spark)).withColumn("score", F.round("score", 6))


_OWN = SQL + """, n AS (SELECT f.id, f.indicator, pillar, CASE WHEN direction = 'NEGATIVE' THEN 100.0 - (value - lo) / (hi - lo) * 100.0 ELSE (value - lo) / (hi - lo) * 100.0 END AS norm
  FROM f JOIN (SELECT indicator, min(value) AS lo, max(value) AS hi FROM f GROUP BY 1) USING (indicator) JOIN i USING (indicator)),
s AS (SELECT id, pillar, avg(norm) AS score FROM n GROUP BY 1, 2)"""


@query(_OWN + " SELECT id, round(greatest(0, least(100, sum(weight * score) / nullif(sum(CASE WHEN score IS NOT NULL THEN weight END), 0) - 0.15 * coalesce(max(CASE WHEN pillar = 'P5' THEN score END), 0))), 6) AS score, round(100.0 * count(CASE WHEN score IS NOT NULL THEN weight END) / count(weight), 6) AS coverage FROM s LEFT JOIN wt USING (pillar) GROUP BY 1")
def pillar_renorm_missing(spark, folder):
    """Absent pillars' weight goes to the others; the score is clamped."""
    n = normalise.minmax(facts(spark, folder), indicators(spark), missing="propagate")
    per = indicators(spark).select("pillar", "indicator", F.lit(1.0).alias("weight"))
    p = score.pillar_scores(n, per, renormalise=True)
    return score.composite(p, weights(spark), LAMBDA, DAMPENER, clamp=True, renormalise=True).select("id", F.round("score", 6).alias("score"), F.round("coverage", 6).alias("coverage"))


_FULL = {**WEIGHTS, DAMPENER: LAMBDA}


@query(_OWN + ", aw(pillar, weight) AS (VALUES " + ", ".join(f"('{p}', {x!r}::DOUBLE)" for p, x in _FULL.items()) + "), o AS (SELECT id, sum(CASE WHEN s.pillar <> 'P5' AND score IS NOT NULL THEN weight END) AS own, sum(CASE WHEN s.pillar <> 'P5' THEN weight * score END) AS total, max(CASE WHEN s.pillar = 'P5' THEN score END) AS damp, " + ", ".join(f"max(CASE WHEN s.pillar = '{p}' AND score IS NOT NULL THEN weight END) AS {p.lower()}" for p in WEIGHTS) + " FROM s JOIN aw USING (pillar) GROUP BY 1), y AS (SELECT *, CASE WHEN own > 0 THEN greatest(0, least(100, total / own - 0.15 * coalesce(damp, 0))) END AS score FROM o), z AS (SELECT *, rank() OVER (ORDER BY score DESC NULLS LAST) AS rk, count(score) OVER () AS n FROM y) SELECT id, round(score, 4) AS score, round(100 * coalesce(own, 0), 1) AS coverage_pct, (SELECT round(100 * sum(weight), 1) FROM aw WHERE pillar IN (SELECT pillar FROM s WHERE score IS NOT NULL)) AS global_coverage_pct, round(0.15 * damp, 4) AS dampener_applied, CASE WHEN score IS NULL THEN 'UNSCORED' WHEN (rk - 1)::DOUBLE / n < 0.25 THEN 'TIER 1' WHEN (rk - 1)::DOUBLE / n < 0.5 THEN 'TIER 2' WHEN (rk - 1)::DOUBLE / n < 0.75 THEN 'TIER 3' ELSE 'TIER 4' END AS tier, " + ", ".join(f"round({p.lower()} / own, 6) AS w_{p.lower()}" for p in WEIGHTS) + ", CASE WHEN own > 0 AND damp IS NOT NULL THEN -0.15::DOUBLE END AS w_p5 FROM z")
def coverage_report(spark, folder):
    """By the drivers each entity has, with a report of coverage and of the dampener."""
    n = normalise.minmax(facts(spark, folder), indicators(spark), missing="propagate")
    own = indicators(spark).select("pillar", "indicator", F.lit(1.0).alias("weight"))
    p = stable(score.pillar_scores(n, own, renormalise=True))
    r = score.coverage_report(p, spark.createDataFrame(list(_FULL.items()), "pillar string, weight double"), LAMBDA, DAMPENER)
    of = lambda k: F.try_element_at(F.col("pillar_weights"), F.lit(k))
    rounded = [F.round(c, d).alias(c) for c, d in (("score", 4), ("coverage_pct", 1), ("global_coverage_pct", 1), ("dampener_applied", 4))]
    return r.select("id", *rounded, "tier", *[F.round(of(k), 6).alias(f"w_{k.lower()}") for k in WEIGHTS], of(DAMPENER).alias("w_p5"))


@query(SCORED + " SELECT id, driver, penalty, score FROM c")
def composite(spark, folder):
    return composite_frame(spark, folder).select("id", "driver", "penalty", "score")


@query(SCORED + " SELECT id, geometric FROM c")
def geometric(spark, folder):
    return composite_frame(spark, folder).select("id", "geometric")


@query(SCORED + _Q + " SELECT id, score, " + TIERS.format(v="score", p="q") + " AS tier FROM c, q")
def tiers_quantile(spark, folder):
    return score.ranks_and_tiers(composite_frame(spark, folder), group=None).select("id", "score", "tier")


@query(SCORED + ", r AS (SELECT id, score, (rank() OVER (ORDER BY score DESC) - 1)::DOUBLE / count(*) OVER () AS x FROM c) SELECT id, score, CASE WHEN x < 0.25 THEN 'Q1' WHEN x < 0.5 THEN 'Q2' WHEN x < 0.75 THEN 'Q3' ELSE 'Q4' END AS tier FROM r")
def tiers_quartile(spark, folder):
    return score.quartile_tiers(composite_frame(spark, folder)).select("id", "score", "tier")


@query(SCORED + " SELECT id, CASE WHEN driver >= 50 AND penalty >= 4.5 THEN 'STRONG SATURATED' WHEN driver >= 50 THEN 'STRONG OPEN' WHEN penalty >= 4.5 THEN 'WEAK SATURATED' ELSE 'WEAK OPEN' END AS quadrant FROM c")
def quadrants(spark, folder):
    c = composite_frame(spark, folder)
    strong, full = F.col("driver") >= 50, F.col("penalty") >= 4.5
    return c.select("id", F.when(strong & full, "STRONG SATURATED").when(strong, "STRONG OPEN").when(full, "WEAK SATURATED").otherwise("WEAK OPEN").alias("quadrant"))


@query(SCORED + ", p AS (SELECT id, round(max(CASE WHEN pillar = 'P1' THEN score END), 6) AS size, round(max(CASE WHEN pillar = 'P2' THEN score END), 6) AS price FROM s GROUP BY 1), md AS (SELECT quantile_cont(size, 0.5) AS ms, quantile_cont(price, 0.5) AS mp FROM p) SELECT id, CASE WHEN size >= ms AND price >= mp THEN 'LEADER' WHEN size >= ms THEN 'VOLUME' WHEN price >= mp THEN 'VALUE' ELSE 'NICHE' END AS archetype FROM p, md")
def archetypes(spark, folder):
    from ..operators.order import quantiles

    at = lambda k: F.round(F.max(F.when(F.col("pillar") == k, F.col("score"))), 6)
    p = stable(pillar_frame(spark, folder).groupBy("id").agg(at("P1").alias("size"), at("P2").alias("price")))
    m = quantiles(p, "size", {"ms": 0.5}).crossJoin(quantiles(p, "price", {"mp": 0.5}))
    big, dear = F.col("size") >= F.col("ms"), F.col("price") >= F.col("mp")
    return p.crossJoin(F.broadcast(m)).select("id", F.when(big & dear, "LEADER").when(big, "VOLUME").when(dear, "VALUE").otherwise("NICHE").alias("archetype"))


@query("SELECT s_suppkey AS id, CAST(s_nationkey AS BIGINT) AS grp, round(t.total * greatest(s_acctbal, 0.0) / nullif(sum(greatest(s_acctbal, 0.0)) OVER (PARTITION BY s_nationkey), 0), 4) AS share FROM supplier JOIN (SELECT c_nationkey, sum(o_totalprice) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) t ON c_nationkey = s_nationkey")
def topdown_allocation(spark, folder):
    """Each group's total, dealt to its entities by a covariate."""
    total = table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.sum("o_totalprice").alias("total"))
    s = table(spark, folder, "supplier").withColumn("x", F.greatest("s_acctbal", F.lit(0.0)))
    sums = s.groupBy("s_nationkey").agg(F.sum("x").alias("xs"))
    both = total.join(sums, F.col("c_nationkey") == F.col("s_nationkey")).select("s_nationkey", "total", "xs")
    return s.join(F.broadcast(both), "s_nationkey").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("long").alias("grp"), F.round(F.col("total") * F.col("x") / F.nullif(F.col("xs"), F.lit(0.0)), 4).alias("share"))


_PCA = ["n_orders", "sum_price", "avg_price", "acctbal"]


@query(FILLED.replace("WITH w AS", "WITH RECURSIVE w AS", 1) + ", x AS (SELECT id, " + ", ".join(f"max(CASE WHEN indicator = '{c}' THEN norm END) AS c{k}" for k, c in enumerate(_PCA, 1)) + " FROM n GROUP BY 1), st AS (SELECT " + ", ".join(f"avg(c{k}) AS m{k}, stddev_pop(c{k}) AS s{k}" for k in (1, 2, 3, 4)) + ", " + ", ".join(f"[{', '.join('1.0::DOUBLE' if a == b else f'corr(c{a}, c{b})' for b in (1, 2, 3, 4))}] AS r{a}" for a in (1, 2, 3, 4)) + " FROM x), pw AS (SELECT 0 AS k, [0.5::DOUBLE, 0.41, 0.33, 0.27] AS v UNION ALL SELECT k + 1, list_transform(u, lambda z: z / sqrt(list_dot_product(u, u))) FROM (SELECT k, [" + ", ".join(f"list_dot_product(r{a}, v)" for a in (1, 2, 3, 4)) + "] AS u FROM pw, st WHERE k < 4000)), l AS (SELECT list_transform(v, lambda z: z * CASE WHEN list_sum(v) >= 0 THEN 1 ELSE -1 END) AS v FROM pw WHERE k = 4000), raw AS (SELECT id, " + " + ".join(f"(c{k} - m{k}) / s{k} * v[{k}]" for k in (1, 2, 3, 4)) + " AS raw FROM x, st, l) SELECT id, round((raw - min(raw) OVER ()) / (max(raw) OVER () - min(raw) OVER ()) * 100, 3) AS pc1 FROM raw")
def pca_weights(spark, folder):
    """Scores on the first principal component of the filled indicators."""
    n = normalised(spark, folder)
    wide = n.where(F.col("indicator").isin(_PCA)).groupBy("id").pivot("indicator", _PCA).agg(F.first("norm"))
    return w.first_component(wide, _PCA).withColumn("pc1", F.round("pc1", 3))


