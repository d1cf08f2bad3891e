"""Queries: statistics, sensitivity, quality, sources, streaming forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import concordance, order, quality, rank_histograms, regression, sensitivity, stats
from ..operators.stable import stable
from ..sources import readers
from ..sources.readers import table
from ..streaming import events as streams
from .base import DAMPENER, FILLED, LAMBDA, SCORED, SQL, WEIGHTS, composite_frame, indicators, normalised, pillar_frame, query, weights, wide_facts

_AVG_RANK = "rank() OVER ({w} ORDER BY {v}) + (count(*) OVER (PARTITION BY {p}{v}) - 1) / 2.0"


@query(SQL + ", p AS (SELECT * FROM w WHERE sum_price IS NOT NULL), r AS (SELECT acctbal, sum_price, " + _AVG_RANK.format(w="", v="acctbal", p="") + " AS ra, " + _AVG_RANK.format(w="", v="sum_price", p="") + " AS rb FROM p) SELECT round(corr(acctbal, sum_price), 9) AS pearson, round(corr(ra, rb), 9) AS spearman FROM r")
def pearson_spearman(spark, folder):
    x = stable(wide_facts(spark, folder).select("acctbal", "sum_price"))
    return stats.spearman(x, "acctbal", "sum_price").select(F.round("pearson", 9).alias("pearson"), F.round("spearman", 9).alias("spearman"))


_COLS = ["n_orders", "sum_price", "avg_price", "acctbal", "late_orders"]
_PAIRS = [(a, b) for k, a in enumerate(_COLS) for b in _COLS[k + 1 :]]


@query(SQL + ", r AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM w" for a, b in _PAIRS) + ") SELECT a, b, round(r, 8) AS r, CASE WHEN abs(r) >= 0.9 THEN 'VERY HIGH' WHEN abs(r) >= 0.7 THEN 'HIGH' WHEN abs(r) >= 0.4 THEN 'MODERATE' ELSE 'LOW' END AS band FROM r")
def redundancy_report(spark, folder):
    return stats.correlation_pairs(wide_facts(spark, folder), _COLS).withColumn("r", F.round("r", 8))


@query("""WITH s AS (SELECT s_suppkey AS id, s_acctbal AS x, t AS y FROM supplier JOIN (SELECT l_suppkey, sum(l_quantity) AS t FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey),
p AS (SELECT sign(a.x - b.x) AS u, sign(a.y - b.y) AS v FROM s a JOIN s b ON a.id < b.id)
SELECT 'supplier' AS pair, round(sum(u * v) / sqrt(sum(abs(u))::DOUBLE * sum(abs(v))::DOUBLE), 9) AS tau, (SELECT count(*) FROM s) AS n FROM p""")
def kendall_tau(spark, folder):
    t = table(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.sum("l_quantity").alias("y"))
    s = table(spark, folder, "supplier").join(t, "s_suppkey").select(F.lit("supplier").alias("pair"), F.col("s_acctbal").alias("x"), "y")
    return concordance.kendall(s, "x", "y", ["pair"]).withColumn("tau", F.round("tau", 9))


_M = "count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_r2(y, x) AS r2, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy"
_XY = SQL + ", xy AS (SELECT id, grp, sum_price AS y, n_orders AS x FROM w WHERE sum_price IS NOT NULL AND n_orders IS NOT NULL)"


def _xy(spark, folder) -> DataFrame:
    return wide_facts(spark, folder).select("id", "grp", F.col("sum_price").alias("y"), F.col("n_orders").alias("x"))


@query(_XY + f", m AS (SELECT {_M} FROM xy), d AS (SELECT *, sqrt((1 - r2) * syy / (n - 2) / sxx) AS se FROM m) SELECT n, round(b, 4) AS slope, round(a, 4) AS intercept, round(r2, 8) AS r2, round(1 - (1 - r2) * (n - 1) / (n - 2), 8) AS adj_r2, round(se, 4) AS slope_se, round(b / se, 4) AS t, round(b - 1.96 * se, 3) AS ci_lo, round(b + 1.96 * se, 3) AS ci_hi FROM d")
def ols_diagnostics(spark, folder):
    o = stats.ols(_xy(spark, folder), "y", "x")
    return o.select("n", *[F.round(c, k).alias(c) for c, k in (("slope", 4), ("intercept", 4), ("r2", 8), ("adj_r2", 8), ("slope_se", 4), ("t", 4), ("ci_lo", 3), ("ci_hi", 3))])


@query(_XY + f", m AS (SELECT grp, {_M} FROM xy GROUP BY 1) SELECT grp, n, round(b, 4) AS slope, round(a, 4) AS intercept, round(r2, 8) AS r2 FROM m")
def ols_simple(spark, folder):
    return stats.ols(_xy(spark, folder), "y", "x", ["grp"]).select("grp", "n", F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r2", 8).alias("r2"))


@query(_XY + f", m AS (SELECT {_M} FROM xy), r AS (SELECT id, round(y - a - b * x, 4) AS residual FROM xy, m) SELECT id, residual, rank() OVER (ORDER BY residual DESC) AS rank FROM r")
def residualised_rank(spark, folder):
    x = stable(_xy(spark, folder).where("y is not null and x is not null"))
    m = stats.ols(x, "y", "x").select("slope", "intercept")
    r = stable(x.crossJoin(F.broadcast(m)).select("id", F.round(F.col("y") - F.col("intercept") - F.col("slope") * F.col("x"), 4).alias("residual")))
    return order.with_rank(r, "residual")


def _cv(fold: str) -> str:
    return (
        _XY
        + f""", z AS (SELECT *, {fold} AS fold FROM xy), k AS (SELECT DISTINCT fold FROM z),
fit AS (SELECT k.fold, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM k JOIN z ON z.fold <> k.fold GROUP BY 1),
e AS (SELECT z.fold, y, y - a - b * x AS e, a, b FROM z JOIN fit ON fit.fold = z.fold)
SELECT fold, count(*) AS n, round(max(b), 4) AS slope, round(max(a), 4) AS intercept, round(1 - sum(e * e) / nullif(var_pop(y) * count(*), 0), 7) AS r2, round(sqrt(avg(e * e)), 4) AS rmse, round(avg(abs(e)), 4) AS mae, count(*) < 10 AS small_n FROM e GROUP BY 1"""
    )


def _rounded_cv(x: DataFrame) -> DataFrame:
    return x.select("fold", "n", *[F.round(c, k).alias(c) for c, k in (("slope", 4), ("intercept", 4), ("r2", 7), ("rmse", 4), ("mae", 4))], "small_n")


@query(_cv("id % 5"))
def kfold_cv(spark, folder):
    return _rounded_cv(stats.held_out_fit(_xy(spark, folder).withColumn("fold", F.col("id") % 5), "y", "x", "fold"))


@query(_cv("grp"))
def loso_cv(spark, folder):
    """Leave one group out."""
    return _rounded_cv(stats.held_out_fit(_xy(spark, folder).withColumn("fold", F.col("grp")), "y", "x", "fold"))


@query(SCORED + ", d AS (SELECT abs(score - geometric) AS d FROM c) SELECT count(*) AS n, round(max(d), 6) AS max_abs, round(avg(d), 6) AS mean_abs, round(sqrt(avg(d * d)), 6) AS rmse, count(*) FILTER (d > 1) AS over_1, count(*) FILTER (d > 5) AS over_2 FROM d")
def error_metrics(spark, folder):
    e = stats.error_metrics(composite_frame(spark, folder), "score", "geometric", (1.0, 5.0))
    return e.select("n", *[F.round(c, 6).alias(c) for c in ("max_abs", "mean_abs", "rmse")], "over_1", "over_2")


# --- sensitivity ---

_LAMBDAS = [0.0, 0.05, 0.10, 0.15, 0.20, 0.25]
_PS = SCORED + ", ps AS (SELECT id, pillar, round(score, 9) AS score FROM s), dr AS (SELECT id, sum(weight * score) AS driver, max(CASE WHEN pillar = 'P5' THEN score END) AS damp FROM ps LEFT JOIN wt USING (pillar) GROUP BY 1)"


def _pillars(spark, folder) -> DataFrame:
    return stable(pillar_frame(spark, folder).withColumn("score", F.round("score", 9)))


def _drivers(p: DataFrame, spark) -> DataFrame:
    x = p.join(F.broadcast(weights(spark)), "pillar", "left")
    return x.groupBy("id").agg(F.sum(F.col("weight") * F.col("score")).alias("driver"), F.max(F.when(F.col("pillar") == DAMPENER, F.col("score"))).alias("damp"))


@query(_PS + ", v AS (SELECT lam, id, round(driver - lam * damp, 6) AS score FROM dr, (VALUES " + ", ".join(f"({x}::DOUBLE)" for x in _LAMBDAS) + ") l(lam)) SELECT lam, id, score, rank() OVER (PARTITION BY lam ORDER BY score DESC) AS rank FROM v")
def lambda_sweep(spark, folder):
    lams = spark.createDataFrame([(x,) for x in _LAMBDAS], "lam double")
    v = _drivers(_pillars(spark, folder), spark).crossJoin(F.broadcast(lams)).select("lam", "id", F.round(F.col("driver") - F.col("lam") * F.col("damp"), 6).alias("score"))
    return order.with_rank(stable(v), "score", by=["lam"])


_VARIANTS = {"base": "driver - 0.15 * damp", "no_dampener": "driver", "positive": "driver + 0.15 * damp", "strong": "driver - 0.3 * damp"}
_VSQL = _PS + ", v AS (" + " UNION ALL ".join(f"SELECT '{k}' AS variant, id, round({e}, 6) AS score FROM dr" for k, e in _VARIANTS.items()) + "), vr AS (SELECT *, rank() OVER (PARTITION BY variant ORDER BY score DESC) AS rank FROM v)"


def _variants(spark, folder) -> DataFrame:
    d = _drivers(_pillars(spark, folder), spark)
    cells = F.array(*[F.struct(F.lit(k).alias("variant"), F.round(F.expr(e.replace("0.15", "0.15D").replace("0.3 ", "0.3D ")), 6).alias("score")) for k, e in _VARIANTS.items()])
    return order.with_rank(stable(d.select("id", F.inline(cells)).select("variant", "id", "score")), "score", by=["variant"])


@query(_VSQL + " SELECT id, count(*) AS variants, max(rank) - min(rank) AS spread, round(avg(rank), 4) AS mean_rank, round(quantile_cont(rank, 0.5), 4) AS median_rank, round(quantile_cont(rank, 0.05), 4) AS p05, round(quantile_cont(rank, 0.95), 4) AS p95, CASE WHEN max(rank) - min(rank) <= 5 THEN 'ROBUST' WHEN max(rank) - min(rank) <= 20 THEN 'MODERATE' ELSE 'SENSITIVE' END AS robustness FROM vr GROUP BY 1")
def variant_sweep(spark, folder):
    s = sensitivity.rank_spread(_variants(spark, folder))
    return s.select("id", "variants", "spread", *[F.round(c, 4).alias(c) for c in ("mean_rank", "median_rank", "p05", "p95")], "robustness")


_TIER = "CASE WHEN score >= a THEN 'TIER 1' WHEN score >= b THEN 'TIER 2' WHEN score >= c THEN 'TIER 3' ELSE 'TIER 4' END"


@query(_VSQL + ", q AS (SELECT variant, quantile_cont(score, 0.8) AS a, quantile_cont(score, 0.5) AS b, quantile_cont(score, 0.2) AS c FROM v GROUP BY 1), vt AS (SELECT vr.*, " + _TIER + " AS tier, " + _AVG_RANK.format(w="PARTITION BY variant", v="score", p="variant, ") + " AS ar FROM vr JOIN q USING (variant)), j AS (SELECT x.variant, x.score, x.rank, x.tier, x.ar, y.score AS bs, y.rank AS br, y.tier AS bt, y.ar AS bar FROM vt x JOIN vt y ON y.id = x.id AND y.variant = 'base' WHERE x.variant <> 'base') SELECT variant, round(corr(score, bs), 8) AS pearson, round(corr(ar, bar), 8) AS spearman, round(100.0 * count(*) FILTER (rank <= 20 AND br <= 20) / count(*) FILTER (br <= 20), 4) AS top_overlap, round(100.0 * avg(CASE WHEN tier = bt THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS tier_agreement, round(avg(abs(rank - br)), 4) AS mean_shift, max(abs(rank - br)) AS max_shift FROM j GROUP BY 1")
def variant_metrics(spark, folder):
    v = _variants(spark, folder)
    q = order.quantiles(v, "score", {"a": 0.8, "b": 0.5, "c": 0.2}, ["variant"])
    s = F.col("score")
    t = F.when(s >= F.col("a"), "TIER 1").when(s >= F.col("b"), "TIER 2").when(s >= F.col("c"), "TIER 3").otherwise("TIER 4")
    v = stable(v.join(F.broadcast(q), "variant").withColumn("tier", t).select("variant", "id", "score", "rank", "tier"))
    m = stats.variant_metrics(v.where("variant = 'base'"), v.where("variant <> 'base'"))
    return m.select("variant", *[F.round(c, k).alias(c) for c, k in (("pearson", 8), ("spearman", 8), ("top_overlap", 4), ("tier_agreement", 4), ("mean_shift", 4))], "max_shift")


@query(_PS + ", g AS (SELECT x.pillar AS variant, y.pillar, y.weight / sum(y.weight) OVER (PARTITION BY x.pillar) AS wr FROM wt x JOIN wt y ON x.pillar <> y.pillar) SELECT g.variant, ps.id, round(sum(wr * score) - 0.15 * max(damp), 6) AS score FROM ps JOIN g ON g.pillar = ps.pillar JOIN dr ON dr.id = ps.id GROUP BY 1, 2")
def leave_one_pillar_out(spark, folder):
    return sensitivity.without_each(_pillars(spark, folder), weights(spark), LAMBDA, DAMPENER).withColumn("score", F.round("score", 6))


_DRAWS = sensitivity.lognormal_draws(WEIGHTS, 40)
_DSQL = _PS + ", dw(draw, pillar, weight) AS (VALUES " + ", ".join(f"({d}, '{p}', {x!r}::DOUBLE)" for d, p, x in _DRAWS) + "), v AS (SELECT dw.draw, ps.id, round(sum(dw.weight * ps.score) - 0.15 * max(damp), 6) AS score FROM ps JOIN dw ON dw.pillar = ps.pillar JOIN dr ON dr.id = ps.id GROUP BY 1, 2), vr AS (SELECT *, rank() OVER (PARTITION BY draw ORDER BY score DESC) AS rank FROM v)"


@query(_DSQL + " SELECT id, round(avg(rank), 4) AS mean_rank, round(quantile_cont(rank, 0.5), 4) AS median_rank, round(stddev_pop(rank), 4) AS std_rank, round(quantile_cont(rank, 0.05), 4) AS p05, round(quantile_cont(rank, 0.95), 4) AS p95, min(rank) AS best, max(rank) AS worst, round(100.0 * count(*) FILTER (rank <= 10) / count(*), 4) AS top10_pct, round(100.0 * count(*) FILTER (rank <= 20) / count(*), 4) AS top20_pct FROM vr GROUP BY 1")
def monte_carlo(spark, folder):
    """Forty draws, which the SQL twin has as a table."""
    draws = sensitivity.draws_frame(spark, _DRAWS)
    s = rank_histograms.rank_statistics(_pillars(spark, folder), draws, LAMBDA, DAMPENER, 6)
    cols = ("mean_rank", "median_rank", "std_rank", "p05", "p95")
    return s.select("id", *[F.round(c, 4).alias(c) for c in cols], "best", "worst", *[F.round(c, 4).alias(c) for c in ("top10_pct", "top20_pct")])


@query(_DSQL + ", b AS (SELECT id, round(driver - 0.15 * damp, 6) AS bs FROM dr), j AS (SELECT draw, rank, " + _AVG_RANK.format(w="PARTITION BY draw", v="score", p="draw, ") + " AS ra, rank() OVER (PARTITION BY draw ORDER BY bs DESC) AS br, rank() OVER (PARTITION BY draw ORDER BY bs) + (count(*) OVER (PARTITION BY draw, bs) - 1) / 2.0 AS rb FROM vr JOIN b USING (id)) SELECT draw, round(corr(ra, rb), 8) AS spearman, round(100.0 * count(*) FILTER (rank <= 20 AND br <= 20) / count(*) FILTER (br <= 20), 4) AS top_overlap FROM j GROUP BY 1")
def mc_agreement(spark, folder):
    a = rank_histograms.agreement(_pillars(spark, folder), sensitivity.draws_frame(spark, _DRAWS), WEIGHTS, LAMBDA, DAMPENER, 6)
    return a.select("draw", F.round("spearman", 8).alias("spearman"), F.round("top_overlap", 4).alias("top_overlap"))


@query(_XY.replace("n_orders AS x FROM w", "n_orders AS x, acctbal AS z FROM w") + ", m AS (SELECT count(*) AS n, covar_pop(x, x) AS xx, covar_pop(z, z) AS zz, covar_pop(x, z) AS xz, covar_pop(x, y) AS xy, covar_pop(z, y) AS zy, covar_pop(y, y) AS yy FROM xy), b AS (SELECT *, (zz * xy - xz * zy) / (xx * zz - xz * xz) AS b1, (xx * zy - xz * xy) / (xx * zz - xz * xz) AS b2 FROM m) SELECT n, round(b1, 3) AS b1, round(b2, 5) AS b2, round((b1 * xy + b2 * zy) / yy, 8) AS r2 FROM b")
def ols_many(spark, folder):
    x = wide_facts(spark, folder).select(F.col("sum_price").alias("y"), F.col("n_orders").alias("x"), F.col("acctbal").alias("z"))
    at = lambda t: F.max(F.when(F.col("term") == t, F.col("coefficient")))
    return regression.fit(x, "y", ["x", "z"]).groupBy("n").agg(F.round(at("x"), 3).alias("b1"), F.round(at("z"), 5).alias("b2"), F.round(F.max("r2"), 8).alias("r2"))


@query("WITH o AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), x AS (SELECT CAST(sum(greatest(1 - n, 0)) AS BIGINT) AS only_a, CAST(sum(greatest(n - 1, 0)) AS BIGINT) AS only_b FROM o) SELECT only_a, only_b, only_a = 0 AND only_b = 0 AS equal FROM x")
def multiset_difference(spark, folder):
    o = table(spark, folder, "orders").select(F.col("o_custkey").alias("k"))
    return stats.equal_multisets(o.distinct(), o)


@query("SELECT event_type, CAST(sum(CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS BIGINT)) AS BIGINT) AS k, CAST(min(year(ts)) AS INTEGER) AS first_year, CAST(max(month(ts)) AS INTEGER) AS last_month FROM events GROUP BY 1")
def json_and_dates(spark, folder):
    x = table(spark, folder, "events").groupBy("event_type")
    return x.agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"), F.min(F.year("ts")).alias("first_year"), F.max(F.month("ts")).alias("last_month"))


def _with_draws(draws: list[tuple[int, str, float]]) -> str:
    """_DSQL with other draws, and scores of nine decimals."""
    return _DSQL.replace(_DSQL.split("(VALUES ")[-1].split("), v AS")[0], ", ".join(f"({d}, '{p}', {x!r}::DOUBLE)" for d, p, x in draws)).replace("max(damp), 6) AS score", "max(damp), 9) AS score")


_STABILITY = "id, round(avg(rank), 4) AS mean_rank, round(quantile_cont(rank, 0.5), 4) AS median_rank, round(stddev_pop(rank), 4) AS std_rank, round(quantile_cont(rank, 0.05), 4) AS p05, round(quantile_cont(rank, 0.95), 4) AS p95, min(rank) AS best, max(rank) AS worst, round(100.0 * count(*) FILTER (rank <= 10) / count(*), 4) AS top10_pct, round(100.0 * count(*) FILTER (rank <= 20) / count(*), 4) AS top20_pct, CASE WHEN stddev_pop(rank) <= 2 THEN 'VERY STABLE' WHEN stddev_pop(rank) <= 5 THEN 'STABLE' WHEN stddev_pop(rank) <= 10 THEN 'MODERATE' ELSE 'VOLATILE' END AS label"


def _rounded_stability(s: DataFrame) -> DataFrame:
    return s.withColumns({c: F.round(c, 4) for c in ("mean_rank", "median_rank", "std_rank", "p05", "p95", "top10_pct", "top20_pct")})


_THOUSAND = sensitivity.lognormal_draws(WEIGHTS, 1000)


@query(_with_draws(_THOUSAND) + f" SELECT {_STABILITY} FROM vr GROUP BY 1")
def mc_full(spark, folder):
    """A thousand draws with stability labels."""
    s = rank_histograms.rank_statistics(_pillars(spark, folder), sensitivity.draws_frame(spark, _THOUSAND), LAMBDA, DAMPENER)
    return _rounded_stability(s).drop("p025", "p975", "tier1_pct", "tier2_pct", "tier3_pct", "tier4_pct")


@query(_DSQL + ", q AS (SELECT draw, quantile_cont(score, 0.8) AS a, quantile_cont(score, 0.5) AS b, quantile_cont(score, 0.2) AS c FROM v GROUP BY 1) SELECT id, " + ", ".join(f"round(100.0 * avg(CASE WHEN t = {k} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS tier{k}_pct" for k in (1, 2, 3, 4)) + " FROM (SELECT v.id, CASE WHEN score >= a THEN 1 WHEN score >= b THEN 2 WHEN score >= c THEN 3 ELSE 4 END AS t FROM v JOIN q USING (draw)) GROUP BY 1")
def tier_probabilities(spark, folder):
    draws = sensitivity.draws_frame(spark, _DRAWS)
    t = rank_histograms.rank_statistics(_pillars(spark, folder), draws, LAMBDA, DAMPENER, 6)
    return t.select("id", *[F.round(f"tier{k}_pct", 4).alias(f"tier{k}_pct") for k in (1, 2, 3, 4)])


_SHARES = (0.1, 0.2, 0.3)
_MOVED = [(500 * k + d, p, x) for k, share in enumerate(_SHARES) for d, p, x in sensitivity.uniform_draws(WEIGHTS, 500, share)]


@query(_with_draws(_MOVED).replace("vr AS (SELECT *, rank()", "vr AS (SELECT *, (draw // 500 + 1) / 10.0::DOUBLE AS share, rank()") + f" SELECT share, {_STABILITY} FROM vr GROUP BY 1, 2")
def uniform_perturbation(spark, folder):
    """Rank stability under weights moved by up to 10, 20 and 30 percent, 500 draws each."""
    p, out = _pillars(spark, folder), None
    for share in _SHARES:
        d = sensitivity.draws_frame(spark, sensitivity.uniform_draws(WEIGHTS, 500, share))
        s = rank_histograms.rank_statistics(p, d, LAMBDA, DAMPENER).withColumn("share", F.lit(share))
        out = s if out is None else out.unionByName(s)
    return _rounded_stability(out).drop("p025", "p975", "tier1_pct", "tier2_pct", "tier3_pct", "tier4_pct")


@query(FILLED + ", z AS (SELECT id, indicator, norm, (SELECT count(*) FROM n) AS total FROM n), e AS (SELECT id, avg(norm) AS plain FROM n GROUP BY 1), r AS (SELECT m.id, avg(CASE WHEN r.k IS NULL THEN 50.0 ELSE r.k END) AS ranked FROM m LEFT JOIN (SELECT id, indicator, CASE WHEN direction = 'NEGATIVE' THEN (rank() OVER (PARTITION BY indicator ORDER BY v DESC) + (count(*) OVER (PARTITION BY indicator, v) - 1) / 2.0) ELSE (rank() OVER (PARTITION BY indicator ORDER BY v) + (count(*) OVER (PARTITION BY indicator, v) - 1) / 2.0) END / count(*) OVER (PARTITION BY indicator) * 100.0 AS k FROM (SELECT id, indicator, round(value, 6) AS v, direction FROM m JOIN i USING (indicator) WHERE value IS NOT NULL)) r ON r.id = m.id AND r.indicator = m.indicator GROUP BY 1) SELECT e.id, round(plain, 6) AS plain, round(ranked, 6) AS ranked FROM e JOIN r USING (id)")
def norm_family(spark, folder):
    """Equal-weight means under min-max and percentile-rank normalisation."""
    from ..operators import normalise

    n = normalised(spark, folder)
    plain = n.groupBy("id").agg(F.avg("norm").alias("plain"))
    x = stable(n.select("id", "indicator", F.round("value", 6).alias("value")))
    ranked = normalise.percentile_rank(x, indicators(spark)).groupBy("id").agg(F.avg(F.coalesce("norm", F.lit(50.0))).alias("ranked"))
    return plain.join(ranked, "id").select("id", F.round("plain", 6).alias("plain"), F.round("ranked", 6).alias("ranked"))


# --- quality ---


@query("SELECT CAST(n_nationkey AS BIGINT) AS grp, n_name AS name, coalesce(k, 0) AS n_rows, CASE WHEN k > 0 THEN 'COVERED' ELSE 'NOT COVERED' END AS status FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS k FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) ON s_nationkey = n_nationkey")
def coverage_audit(spark, folder):
    dim = table(spark, folder, "nation").select(F.col("n_nationkey").cast("long").alias("grp"), F.col("n_name").alias("name"))
    seen = table(spark, folder, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").cast("long").alias("grp"))
    return quality.coverage(dim, seen, "grp")


@query("SELECT count(*) - count(DISTINCT o_custkey) AS repeated, count(*) FILTER (o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)) AS unknown FROM orders")
def dup_unknown(spark, folder):
    o = table(spark, folder, "orders").select(F.col("o_custkey").alias("k"))
    known = table(spark, folder, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"), F.lit(True).alias("known"))
    x = o.groupBy("k").agg(F.count("*").alias("n")).join(known, "k", "left")
    return x.agg((F.sum("n") - F.count("*")).alias("repeated"), F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("n"))), F.lit(0)).alias("unknown"))


@query("SELECT l_returnflag AS flag, count(*) FILTER (l_discount * 100 NOT BETWEEN 0 AND 100) AS bad_pct, count(*) FILTER (l_quantity < 0) AS negative, count(*) FILTER (l_extendedprice IS NULL) AS missing FROM lineitem GROUP BY 1")
def domain_checks(spark, folder):
    x = table(spark, folder, "lineitem").groupBy(F.col("l_returnflag").alias("flag"))
    return x.agg(F.count_if(~(F.col("l_discount") * 100).between(0, 100)).alias("bad_pct"), F.count_if(F.col("l_quantity") < 0).alias("negative"), F.count_if(F.col("l_extendedprice").isNull()).alias("missing"))


# --- documents as sources, and the batch form of streams ---


@query("SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, trim(line, ' ') AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents) WHERE trim(line, ' ') <> ''")
def document_lines(spark, folder):
    return readers.text_lines(table(spark, folder, "documents"), "doc_id", "text")


@query("SELECT event_type, CAST(CAST(ts AS DATE) AS DATE) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_tumbling_ext(spark, folder):
    e = table(spark, folder, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    return streams.tumbling(e).select("event_type", F.to_date("start").alias("day"), "n", F.round("total", 4).alias("total"))


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, n, count(*) AS n_sessions FROM (SELECT user_id, k, count(*) AS n FROM s GROUP BY 1, 2) GROUP BY 1, 2")
def events_sessions_ext(spark, folder):
    e = table(spark, folder, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return streams.sessions(e).groupBy("user_id", "n").agg(F.count("*").alias("n_sessions"))


