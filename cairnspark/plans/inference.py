"""Queries: fits on several regressors with errors and p-values, concordance by ranges and by draw, seeded folds, allocation, filling by evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import keyed
from ..functions.keyed import PRIME, constants
from ..operators import allocate, concordance, folds, impute, order, rank_histograms, regression, robustness, sensitivity, stats
from ..operators.stable import stable
from ..sources.readers import table
from .base import DAMPENER, FILLED, INDICATORS, LAMBDA, WEIGHTS, indicators, normalised, query, weights, wide_facts
from .statistics import _AVG_RANK, _DRAWS, _DSQL, _XY, _drivers, _pillars, _rounded_cv

_XZ = _XY.replace("n_orders AS x FROM w", "n_orders AS x, acctbal AS z FROM w")


def _xz(spark, folder) -> DataFrame:
    return wide_facts(spark, folder).select("id", F.col("sum_price").alias("y"), F.col("n_orders").alias("x"), F.col("acctbal").alias("z"))


#: The two-sided chance of Student's t by its finite series, for rows (.., t, dof) of a table.
_P = """co AS (SELECT k, exp(sum(ln((2.0 * k - 1) / (2.0 * k))) OVER (ORDER BY k)) AS ce, exp(sum(ln((2.0 * k) / (2.0 * k + 1))) OVER (ORDER BY k)) AS co FROM range(1, 40000) r(k)),
th AS (SELECT *, atan(abs(t) / sqrt(dof)) AS a FROM {table}),
ev AS (SELECT th.{key}, 1 - sin(max(a)) * (1 + coalesce(sum(ce * pow(cos(a), 2 * k)), 0)) AS p FROM th LEFT JOIN co ON k <= dof // 2 - 1 WHERE dof % 2 = 0 GROUP BY 1),
od AS (SELECT th.{key}, 1 - 2 / pi() * (max(a) + CASE WHEN max(dof) > 1 THEN sin(max(a)) * (cos(max(a)) + coalesce(sum(co * pow(cos(a), 2 * k + 1)), 0)) ELSE 0 END) AS p FROM th LEFT JOIN co ON k <= (dof - 1) // 2 - 1 WHERE dof % 2 = 1 GROUP BY 1),
pv AS (SELECT * FROM ev UNION ALL SELECT * FROM od)"""

_TWO = _XZ + """, m AS (SELECT count(*) AS n, avg(x) AS mx, avg(z) AS mz, avg(y) AS my, covar_pop(x, x) AS xx, covar_pop(z, z) AS zz, covar_pop(x, z) AS xz, covar_pop(x, y) AS xy, covar_pop(z, y) AS zy, covar_pop(y, y) AS yy FROM xy),
b AS (SELECT *, xx * zz - xz * xz AS det, (zz * xy - xz * zy) / (xx * zz - xz * xz) AS b1, (xx * zy - xz * xy) / (xx * zz - xz * xz) AS b2 FROM m),
v AS (SELECT *, my - b1 * mx - b2 * mz AS b0, (yy - b1 * xy - b2 * zy) / (n - 3) AS s, (b1 * xy + b2 * zy) / yy AS r2 FROM b),
tt AS (
  SELECT 'intercept' AS term, n, n - 3 AS dof, r2, b0 AS c, sqrt(s * (1 + (mx * mx * zz + mz * mz * xx - 2 * mx * mz * xz) / det)) AS se FROM v
  UNION ALL SELECT 'x', n, n - 3, r2, b1, sqrt(s * zz / det) FROM v UNION ALL SELECT 'z', n, n - 3, r2, b2, sqrt(s * xx / det) FROM v
), t AS (SELECT *, c / se AS t FROM tt), """


@query(_TWO + _P.format(table="t", key="term") + " SELECT t.term, n, dof, round(c, 4) AS coefficient, round(se, 4) AS se, round(t, 6) AS t, round(p, 9) AS p, round(c - 1.96 * se, 3) AS ci_lo, round(c + 1.96 * se, 3) AS ci_hi, round(r2, 8) AS r2, round(1 - (1 - r2) * (n - 1) / dof, 8) AS adj_r2, round(r2 / 2 / ((1 - r2) / dof), 3) AS f, round(pow(1 + 2 * (r2 / 2 / ((1 - r2) / dof)) / dof, -dof / 2.0), 9) AS f_p FROM t JOIN pv USING (term)")
def ols_terms(spark, folder):
    """Two regressors; the twin solves them in closed form, t by its finite series, and F of two by its closed form."""
    o = regression.fit(_xz(spark, folder), "y", ["x", "z"])
    return o.select("term", "n", "dof", *[F.round(c, k).alias(c) for c, k in (("coefficient", 4), ("se", 4), ("t", 6), ("p", 9), ("ci_lo", 3), ("ci_hi", 3), ("r2", 8), ("adj_r2", 8), ("f", 3), ("f_p", 9))])


@query(_TWO + "ft AS (SELECT y, b0 + b1 * x + b2 * z AS f FROM xy, v), rk AS (SELECT " + _AVG_RANK.format(w="", v="y", p="") + " AS ry, " + _AVG_RANK.format(w="", v="f", p="") + " AS rf FROM ft) SELECT (SELECT n FROM v) AS n, round((SELECT r2 FROM v), 8) AS r2, round(corr(ry, rf), 8) AS rho FROM rk")
def in_sample_fit(spark, folder):
    """How well the fit repeats what it was made from."""
    x = _xz(spark, folder).where("y is not null and x is not null")
    return regression.in_sample(x, "y", ["x", "z"]).select("n", F.round("r2", 8).alias("r2"), F.round("rho", 8).alias("rho"))


@query(_XZ + ", m AS (SELECT grp, count(*) AS n, covar_pop(x, x) AS xx, covar_pop(z, z) AS zz, covar_pop(x, z) AS xz, covar_pop(x, y) AS xy, covar_pop(z, y) AS zy, covar_pop(y, y) AS yy FROM xy GROUP BY 1), b AS (SELECT *, xx * zz - xz * xz AS det, (zz * xy - xz * zy) / nullif(xx * zz - xz * xz, 0) AS b1, (xx * zy - xz * xy) / nullif(xx * zz - xz * xz, 0) AS b2 FROM m WHERE n > 5) SELECT grp, n, round(b1, 3) AS x, round(b2, 4) AS z, round(sqrt((yy - b1 * xy - b2 * zy) / (n - 3) * zz / det), 3) AS x_se, round((b1 * xy + b2 * zy) / yy, 7) AS r2 FROM b")
def ols_by_group(spark, folder):
    """A fit in each group of over five rows, all from one aggregation."""
    x = wide_facts(spark, folder).select("grp", F.col("sum_price").alias("y"), F.col("n_orders").alias("x"), F.col("acctbal").alias("z"))
    o = regression.fit(x, "y", ["x", "z"], ["grp"]).where("n > 5").groupBy("grp", "n")
    at = lambda t, c: F.max(F.when(F.col("term") == t, F.col(c)))
    return o.agg(F.round(at("x", "coefficient"), 3).alias("x"), F.round(at("z", "coefficient"), 4).alias("z"), F.round(at("x", "se"), 3).alias("x_se"), F.round(F.max("r2"), 7).alias("r2"))


@query(_DSQL + ", b AS (SELECT id, round(driver - 0.15 * damp, 6) AS bs FROM dr), j AS (SELECT draw, id, score, bs FROM vr JOIN b USING (id)) SELECT x.draw, round(sum(sign(x.score - y.score) * sign(x.bs - y.bs)) / sqrt(sum(abs(sign(x.score - y.score)))::DOUBLE * sum(abs(sign(x.bs - y.bs)))::DOUBLE), 8) AS tau FROM j x JOIN j y ON x.draw = y.draw AND x.id < y.id GROUP BY 1")
def draw_tau(spark, folder):
    """Kendall's tau of each draw's scores against the base's."""
    p = _pillars(spark, folder)
    draws = sensitivity.draw_scores(p, sensitivity.draws_frame(spark, _DRAWS), LAMBDA, DAMPENER).select("draw", "id", F.round("score", 6).alias("score"))
    base = stable(_drivers(p, spark).select("id", F.round(F.col("driver") - LAMBDA * F.col("damp"), 6).alias("b_")))
    t = concordance.kendall(draws.join(base, "id"), "score", "b_", ["draw"])
    return t.select("draw", F.round("tau", 8).alias("tau"))


@query("""WITH s AS (SELECT c_custkey AS id, round(c_acctbal / 50) AS x, count(o_orderkey) AS y FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2),
p AS (SELECT sign(a.x - b.x) AS u, sign(a.y - b.y) AS v FROM s a JOIN s b ON a.id < b.id)
SELECT 'customer' AS pair, round(sum(u * v) / sqrt(sum(abs(u))::DOUBLE * sum(abs(v))::DOUBLE), 9) AS tau, (SELECT count(*) FROM s) AS n FROM p""")
def kendall_ranges(spark, folder):
    """Many ties, in buckets of a hundred rows."""
    n = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("y"))
    s = table(spark, folder, "customer").join(n, "c_custkey", "left").select(F.lit("customer").alias("pair"), F.round(F.col("c_acctbal") / 50).alias("x"), F.coalesce("y", F.lit(0)).alias("y"))
    return concordance.kendall(s, "x", "y", ["pair"], per=100).withColumn("tau", F.round("tau", 9))


def _step_sql(x: str, pair: tuple[int, int]) -> str:
    square = f"((v * v) % {PRIME})"
    return f"list_transform([({x} * {pair[0]} + {pair[1]}) % {PRIME}], lambda v: ({square} * {square} % {PRIME}) * v % {PRIME})[1]"


def _residue_sql(key: str, seed: int) -> str:
    a, b, c = constants(seed, 3)
    return _step_sql(_step_sql(f"(({_step_sql(f'({key} % {PRIME})', a)} + {key} // {PRIME}) % {PRIME})", b), c)


def _normal_sql(key: str, seed: int) -> str:
    u = lambda k: f"(({_residue_sql(key, 2 * seed + k)} + 0.5::DOUBLE) / {PRIME}.0::DOUBLE)"
    return f"(sqrt(-2.0::DOUBLE * ln({u(0)})) * cos(2 * pi() * {u(1)}))"


def _once_sql(p: str, seed: int) -> str:
    h = f"{{'l': {p} % a, 'r': {p} // a}}"
    for k, pair in enumerate(constants(seed, folds.ROUNDS)):
        moved = f"{{'l': (h.l + {_step_sql('h.r', pair)}) % a, 'r': h.r}}" if k % 2 == 0 else f"{{'l': h.l, 'r': (h.r + {_step_sql('h.l', pair)}) % b}}"
        h = f"list_transform([{h}], lambda h: {moved})[1]"
    return f"list_transform([{h}], lambda h: h.r * a + h.l)[1]"


def _folds_sql(source: str, k: int, seed: int) -> str:
    """folds (id, fold) of a table with unique ids."""
    return f"""numbered AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS p0, count(*) OVER () AS n, CAST(ceil(sqrt(count(*) OVER ())) AS BIGINT) AS a FROM {source}),
grid AS (SELECT id, p0, n, a, CAST(ceil(n / a) AS BIGINT) AS b FROM numbered),
walk AS (SELECT id, n, a, b, {_once_sql('p0', seed)} AS p FROM grid UNION ALL SELECT id, n, a, b, {_once_sql('p', seed)} AS p FROM walk WHERE p >= n),
folds AS (SELECT id, CAST(p % {k} AS INTEGER) AS fold FROM walk WHERE p < n)"""


@query("WITH RECURSIVE cu AS (SELECT c_custkey AS id FROM customer), " + _folds_sql("cu", 7, 42) + " SELECT id, fold FROM folds")
def seeded_folds(spark, folder):
    return folds.shuffled_folds(table(spark, folder, "customer").select(F.col("c_custkey").alias("id")), "id", 7, 42)


@query(_XY.replace("WITH w AS", "WITH RECURSIVE w AS") + ", " + _folds_sql("xy", 5, 42) + """, z AS (SELECT xy.*, fold FROM xy JOIN folds USING (id)), k AS (SELECT DISTINCT fold FROM z),
fit AS (SELECT k.fold, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM k JOIN z ON z.fold <> k.fold GROUP BY 1),
e AS (SELECT z.fold, y, y - a - b * x AS e, a, b FROM z JOIN fit ON fit.fold = z.fold)
SELECT fold, count(*) AS n, round(max(b), 4) AS slope, round(max(a), 4) AS intercept, round(1 - sum(e * e) / nullif(var_pop(y) * count(*), 0), 7) AS r2, round(sqrt(avg(e * e)), 4) AS rmse, round(avg(abs(e)), 4) AS mae, count(*) < 10 AS small_n FROM e GROUP BY 1""")
def kfold_shuffled(spark, folder):
    """Five folds of the rows with both columns, shuffled by seed 42."""
    x = stable(wide_facts(spark, folder).select("id", F.col("sum_price").alias("y"), F.col("n_orders").alias("x")).where("y is not null and x is not null"))
    return _rounded_cv(stats.held_out_fit(folds.shuffled_folds(x, "id", 5, 42), "y", "x", "fold"))


@query("""WITH t AS (SELECT CAST(c_nationkey AS BIGINT) AS grp, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
m AS (SELECT s_suppkey AS id, CAST(s_nationkey AS BIGINT) AS grp, CAST(round(greatest(s_acctbal, 0.0) * exp(0.12::DOUBLE * """ + _normal_sql("s_suppkey", 101) + f""") * {allocate.GRAIN}) AS HUGEINT) AS w FROM supplier),
q AS (SELECT id, m.grp, w, total, nullif(sum(w) OVER (PARTITION BY m.grp), 0) AS s FROM m LEFT JOIN t ON t.grp = m.grp),
b AS (SELECT *, CAST(total AS HUGEINT) * w // CAST(s AS HUGEINT) AS base, CAST(total AS HUGEINT) * w % CAST(s AS HUGEINT) AS rest FROM q),
r AS (SELECT *, total - sum(base) OVER (PARTITION BY grp) AS extra, row_number() OVER (PARTITION BY grp ORDER BY rest DESC, id) AS place FROM b)
SELECT id, grp, CAST(w AS DOUBLE) / {allocate.GRAIN} AS weight, CAST(base + CASE WHEN place <= extra THEN 1 ELSE 0 END AS BIGINT) AS units FROM r""")
def allocation(spark, folder):
    """Each nation's orders in cents, dealt to its suppliers by balance with noise; the cents add up."""
    o = table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    totals = o.groupBy(F.col("c_nationkey").cast("long").alias("grp")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("total"))
    members = table(spark, folder, "supplier").select(F.col("s_suppkey").cast("long").alias("id"), F.col("s_nationkey").cast("long").alias("grp"), F.col("s_acctbal").alias("weight"))
    return allocate.allocate(totals, members, 0.12, 101)


@query("""WITH y AS (SELECT o_custkey AS id, CAST(year(o_orderdate) AS INTEGER) AS year, sum(o_totalprice) AS value FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority LIKE '1%' AND c_nationkey % 5 <> 0 GROUP BY 1, 2),
g AS (SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS grp, CASE WHEN c_custkey % 9 <> 0 THEN c_acctbal END AS cov, (SELECT value FROM y WHERE y.id = c_custkey AND year = 1998 AND c_custkey % 3 <> 0) AS v FROM customer),
p AS (SELECT id, list(struct_pack(year := year, value := value) ORDER BY year) AS p FROM y WHERE year <> 1998 GROUP BY 1),
x AS (SELECT g.*, p, greatest(1, least(len(list_filter(p, lambda e: e.year <= 1998)), len(p) - 1)) AS k FROM g LEFT JOIN p USING (id)),
s AS (SELECT id, grp, cov, v AS own, coalesce(v, CASE WHEN len(p) >= 2 THEN greatest(0.0, p[k].value + (p[k + 1].value - p[k].value) * (1998 - p[k].year) / (p[k + 1].year - p[k].year)) END) AS ev FROM x),
a AS (SELECT *, avg(ev) OVER (PARTITION BY grp) AS mean FROM s),
nn AS (SELECT t.id, d.ev, row_number() OVER (PARTITION BY t.id ORDER BY abs(t.cov - d.cov), d.id) AS r FROM a t JOIN a d ON t.mean IS NULL AND t.ev IS NULL AND t.cov IS NOT NULL AND d.ev IS NOT NULL AND d.cov IS NOT NULL),
kn AS (SELECT id, avg(ev) AS knn FROM nn WHERE r <= 3 GROUP BY 1)
SELECT id, 'price' AS indicator, round(coalesce(ev, mean, knn), 5) AS value, CASE WHEN own IS NOT NULL THEN 'OBSERVED' WHEN ev IS NOT NULL THEN 'IMPUTED_TREND' WHEN mean IS NOT NULL THEN 'IMPUTED_GROUP_MEAN' WHEN knn IS NOT NULL THEN 'IMPUTED_KNN' ELSE 'MISSING' END AS status FROM a LEFT JOIN kn USING (id)""")
def cascade_evidence(spark, folder):
    """Spend on urgent orders in 1998: observed, by trend, by group, by the three nearest balances; nations of every fifth number have no evidence, every ninth customer no covariate."""
    c = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("grp"), F.when(F.col("c_custkey") % 9 != 0, F.col("c_acctbal")).alias("covariate"))
    o = table(spark, folder, "orders").where("o_orderpriority like '1%'").select(F.col("o_custkey").alias("id"), F.year("o_orderdate").alias("year"), "o_totalprice")
    y = stable(o.join(c.where("grp % 5 <> 0").select("id"), "id").groupBy("id", "year").agg(F.sum("o_totalprice").alias("value")).withColumn("indicator", F.lit("price")))
    own = y.where("year = 1998 and id % 3 <> 0").select("id", "value")
    fact = c.join(own, "id", "left").withColumn("indicator", F.lit("price")).select("id", "grp", "indicator", "value", "covariate")
    out = impute.cascade_by_evidence(fact, y.where("year <> 1998"), 1998, k=3, floor=0.0)
    return out.select("id", "indicator", F.round("value", 5).alias("value"), "status")


_SIGMA, _SEED, _MANY = 0.2, 7, 5000


def _keyed_draws(spark, n: int) -> DataFrame:
    """(draw, pillar, weight): log-normal factors that the number of draw and pillar decide, weights made to sum to one."""
    names = sorted(WEIGHTS)
    x = spark.range(n).select(F.col("id").alias("draw"), F.posexplode(F.array(*[F.lit(WEIGHTS[p]) for p in names])))
    x = x.withColumn("w", F.col("col") * F.exp(_SIGMA * keyed.normal(F.col("draw") * len(names) + F.col("pos"), _SEED))).withColumn("pillar", F.array(*[F.lit(p) for p in names])[F.col("pos")])
    total = x.groupBy("draw").agg(F.sum("w").alias("t"))
    return x.join(total, "draw").select(F.col("draw").cast("int").alias("draw"), "pillar", (F.col("w") / F.col("t")).alias("weight"))


_MANY_SQL = (
    _DSQL.split(", dw(draw")[0]
    + ", nm AS (SELECT CAST(d AS BIGINT) AS draw, CAST(k AS BIGINT) AS k, pillar, w * exp(0.2::DOUBLE * "
    + _normal_sql(f"(CAST(d AS BIGINT) * {len(WEIGHTS)} + k)", _SEED)
    + f") AS w FROM range({_MANY}) r(d), (VALUES "
    + ", ".join(f"({k}, '{p}', {WEIGHTS[p]!r}::DOUBLE)" for k, p in enumerate(sorted(WEIGHTS)))
    + ") v(k, pillar, w)), dw AS (SELECT draw, pillar, w / sum(w) OVER (PARTITION BY draw) AS weight FROM nm), v AS (SELECT dw.draw, ps.id, round(sum(dw.weight * ps.score) - 0.15 * max(damp), 6) AS score FROM ps JOIN dw ON dw.pillar = ps.pillar JOIN dr ON dr.id = ps.id GROUP BY 1, 2), vr AS (SELECT *, rank() OVER (PARTITION BY draw ORDER BY score DESC) AS rank FROM v), q AS (SELECT draw, quantile_cont(score, 0.8) AS a, quantile_cont(score, 0.5) AS b, quantile_cont(score, 0.2) AS c FROM v GROUP BY 1)"
)


@query(_MANY_SQL + " SELECT id, round(avg(rank), 4) AS mean_rank, " + ", ".join(f"round(quantile_cont(rank, {p}), 4) AS {n}" for n, p in (("median_rank", 0.5), ("p025", 0.025), ("p05", 0.05), ("p95", 0.95), ("p975", 0.975))) + ", round(stddev_pop(rank), 4) AS std_rank, min(rank) AS best, max(rank) AS worst, round(100.0 * count(*) FILTER (rank <= 10) / count(*), 4) AS top10_pct, round(100.0 * count(*) FILTER (rank <= 20) / count(*), 4) AS top20_pct, " + ", ".join(f"round(100.0 * count(*) FILTER (t = {k}) / count(*), 4) AS tier{k}_pct" for k in (1, 2, 3, 4)) + ", CASE WHEN stddev_pop(rank) <= 2 THEN 'VERY STABLE' WHEN stddev_pop(rank) <= 5 THEN 'STABLE' WHEN stddev_pop(rank) <= 10 THEN 'MODERATE' ELSE 'VOLATILE' END AS label FROM (SELECT vr.*, CASE WHEN score >= a THEN 1 WHEN score >= b THEN 2 WHEN score >= c THEN 3 ELSE 4 END AS t FROM vr JOIN q USING (draw)) GROUP BY 1")
def mc_histograms(spark, folder):
    """Five thousand draws: intervals of 90 and 95 percent, top and tier shares, from histograms of ranks."""
    s = rank_histograms.rank_statistics(_pillars(spark, folder), _keyed_draws(spark, _MANY), LAMBDA, DAMPENER, 6)
    rounded = [c for c in s.columns if c not in ("id", "best", "worst", "label")]
    return s.select("id", *[F.round(c, 4).alias(c) for c in rounded], "best", "worst", "label")


_NOISE = {"INHERITED": 2.5, "IMPUTED": 5.0, "MISSING": 5.0}
_ORDER = [i for i, _, _ in INDICATORS]


@query(FILLED + ", nz AS (SELECT n.id, n.pillar, d, round(greatest(0.0, least(100.0, norm + CASE WHEN status = 'OBSERVED' THEN 0.0 ELSE 5.0::DOUBLE * " + _normal_sql(f"((id * {len(_ORDER)} + list_position([{', '.join(repr(i) for i in _ORDER)}], indicator) - 1) * 100 + d)", 42) + " END)), 6) AS norm FROM n, range(100) r(d)), ps AS (SELECT d, id, pillar, avg(norm) AS score FROM nz GROUP BY 1, 2, 3), sc AS (SELECT d, id, round(sum(weight * score) - 0.15 * max(CASE WHEN pillar = 'P5' THEN score END), 9) AS score FROM ps LEFT JOIN wt USING (pillar) GROUP BY 1, 2), vr AS (SELECT id, rank() OVER (PARTITION BY d ORDER BY score DESC) AS rank FROM sc) SELECT id, round(quantile_cont(rank, 0.05), 4) AS p05, round(quantile_cont(rank, 0.95), 4) AS p95, round(avg(rank), 4) AS mean_rank FROM vr GROUP BY 1")
def imputation_uncertainty(spark, folder):
    """Rank intervals when imputed cells are noisy; 100 draws of keyed noise."""
    own = {i: p for i, p, _ in INDICATORS}
    x = sensitivity.noisy_scores(normalised(spark, folder), own, 100, _NOISE, _ORDER, WEIGHTS, LAMBDA, DAMPENER)
    s = rank_histograms.score_statistics(x, 100)
    return s.select("id", *[F.round(c, 4).alias(c) for c in ("p05", "p95", "mean_rank")])


_UP = "CASE WHEN hi = lo THEN 50.0 WHEN direction = 'NEGATIVE' THEN 100.0 - (v - lo) / (hi - lo) * 100.0 ELSE (v - lo) / (hi - lo) * 100.0 END"
_SCALED = f"""mv AS (SELECT m.id, m.indicator, pillar, direction, value FROM m JOIN i USING (indicator)),
qs AS (SELECT indicator, quantile_cont(value, 0.05) AS q05, quantile_cont(value, 0.95) AS q95, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) AS q3 FROM mv GROUP BY 1),
vv AS (
  SELECT 'MINMAX' AS scale, id, indicator, pillar, direction, value AS v FROM mv
  UNION ALL SELECT 'ROBUST_IQR', id, indicator, pillar, direction, (value - q2) / CASE WHEN q3 - q1 <= 0 THEN 1.0 ELSE q3 - q1 END FROM mv JOIN qs USING (indicator)
  UNION ALL SELECT 'WINSORISED', id, indicator, pillar, direction, CASE WHEN value IS NOT NULL THEN greatest(q05, least(q95, value)) END FROM mv JOIN qs USING (indicator)
),
mm AS (SELECT scale, indicator, min(v) AS lo, max(v) AS hi FROM vv GROUP BY 1, 2),
pr AS (SELECT id, indicator, (rank() OVER (PARTITION BY indicator ORDER BY CASE WHEN direction = 'NEGATIVE' THEN -value ELSE value END) + (count(*) OVER (PARTITION BY indicator, value) - 1) / 2.0) / count(*) OVER (PARTITION BY indicator) * 100.0 AS norm FROM mv WHERE value IS NOT NULL),
ns AS (
  SELECT vv.scale, id, vv.indicator, pillar, coalesce({_UP}, 50.0) AS norm FROM vv JOIN mm ON mm.scale = vv.scale AND mm.indicator = vv.indicator
  UNION ALL SELECT 'PERCENTILE_RANK', mv.id, mv.indicator, pillar, coalesce(norm, 50.0) FROM mv LEFT JOIN pr ON pr.id = mv.id AND pr.indicator = mv.indicator
),
es AS (SELECT scale, pillar, indicator, count(*) AS k, sum(norm + 1e-6) AS t, sum((norm + 1e-6) * ln(norm + 1e-6)) AS xl FROM ns GROUP BY 1, 2, 3),
ed AS (SELECT scale, pillar, indicator, greatest(1.0 - CASE WHEN k <= 1 THEN 1.0 ELSE (ln(t) - xl / t) / ln(k) END, 1e-6) AS d FROM es),
ew AS (SELECT scale, pillar, indicator, d / sum(d) OVER (PARTITION BY scale, pillar) AS weight FROM ed),
pl AS (
  SELECT ns.scale || '_FIXED' AS variant, id, ns.pillar, sum(weight * norm) AS score FROM ns JOIN ew ON ew.scale = 'MINMAX' AND ew.indicator = ns.indicator GROUP BY 1, 2, 3
  UNION ALL SELECT ns.scale || '_RECOMPUTED', id, ns.pillar, sum(weight * norm) FROM ns JOIN ew ON ew.scale = ns.scale AND ew.indicator = ns.indicator GROUP BY 1, 2, 3
),
v AS (SELECT variant, id, round(sum(weight * score) - 0.15 * coalesce(max(CASE WHEN pillar = 'P5' THEN score END), 0), 6) AS score FROM pl LEFT JOIN wt USING (pillar) GROUP BY 1, 2),
vr AS (SELECT *, rank() OVER (PARTITION BY variant ORDER BY score DESC) AS rank FROM v)"""


@query(FILLED + ", " + _SCALED + ", va AS (SELECT *, " + _AVG_RANK.format(w="PARTITION BY variant", v="score", p="variant, ") + " AS ar FROM vr), j AS (SELECT x.variant, x.rank, x.ar, y.rank AS br, y.ar AS bar FROM va x JOIN va y ON y.id = x.id AND y.variant = 'MINMAX_FIXED' WHERE x.variant <> 'MINMAX_FIXED') SELECT variant, round(corr(ar, bar), 6) AS spearman, round(1 - corr(ar, bar), 6) AS disruption FROM j GROUP BY 1")
def scaling_effects(spark, folder):
    """What a scale does to the ranking, and what the weights that it leads to add."""
    v = robustness.scaling_effects(normalised(spark, folder), indicators(spark), weights(spark), LAMBDA, DAMPENER)
    return robustness.agreement(v, "MINMAX_FIXED", tau=False).select("variant", F.round("spearman", 6).alias("spearman"), F.round("disruption", 6).alias("disruption"))
