"""Queries: projections, filters, joins, sets, aggregates, windows, text."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numeric, text
from ..operators import order, quality, resolve, sequence, tables
from ..sources.readers import table
from .base import SQL, indicators, normalised, query


@query("SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND contains(lower(c_name), '7') AND c_nationkey = 3")
def filter_search(spark, folder):
    c = table(spark, folder, "customer")
    return c.where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & F.coalesce(F.lower("c_name").contains("7"), F.lit(False)) & (F.col("c_nationkey") == 3)).select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")
    )


@query("""SELECT p_partkey AS id, regexp_matches(p_brand, '^(Brand#1|Brand#2)') AS by_prefix, regexp_matches(lower(p_name), 'red|green|widget') AS by_word,
 regexp_matches(p_name, 'e') AND NOT regexp_matches(p_name, 'r') AS by_exclusion,
 CASE WHEN regexp_matches(p_type, '^(STANDARD|PROMO)') AND p_size >= 25 THEN 'A' WHEN regexp_matches(p_type, '^(STANDARD|PROMO)') THEN 'B' WHEN p_retailprice > 1200 THEN 'C' ELSE 'D' END AS class FROM part""")
def classify_case(spark, folder):
    p = table(spark, folder, "part")
    a = text.starts_with_any(F.col("p_type"), ["STANDARD", "PROMO"])
    return p.select(
        F.col("p_partkey").alias("id"), text.starts_with_any(F.col("p_brand"), ["Brand#1", "Brand#2"]).alias("by_prefix"),
        text.contains_any(F.col("p_name"), ["red", "green", "widget"]).alias("by_word"), text.matches_except(F.col("p_name"), "e", "r").alias("by_exclusion"),
        F.when(a & (F.col("p_size") >= 25), "A").when(a, "B").when(F.col("p_retailprice") > 1200, "C").otherwise("D").alias("class"),
    )


@query("SELECT c_custkey AS id, round(coalesce(t, 0), 2) AS total FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS t FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) ON o_custkey = c_custkey")
def left_join_scores(spark, folder):
    t = table(spark, folder, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("t"))
    return table(spark, folder, "customer").join(t, "c_custkey", "left").select(F.col("c_custkey").alias("id"), F.round(F.coalesce("t", F.lit(0.0)), 2).alias("total"))


@query("""SELECT r_name AS region, n_name AS nation, c_mktsegment AS segment, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3""")
def multi_inner_join(spark, folder):
    t = lambda n: table(spark, folder, n)
    x = t("lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice", "l_discount").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    x = x.join(t("customer").select("c_custkey", "c_nationkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    x = x.join(t("supplier").select("s_suppkey", "s_nationkey"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    x = x.groupBy("s_nationkey", "c_mktsegment").agg(F.count("*").alias("n"), F.sum(F.col("l_extendedprice") * (1.0 - F.col("l_discount"))).alias("revenue"))
    place = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("n_name").alias("nation"), F.col("r_name").alias("region"))
    return x.join(F.broadcast(place), F.col("s_nationkey") == F.col("n_nationkey")).select("region", "nation", F.col("c_mktsegment").alias("segment"), "n", F.round("revenue", 2).alias("revenue"))


@query("SELECT p_brand AS name, count(*) AS n FROM part WHERE p_brand NOT IN (SELECT DISTINCT p_brand FROM part WHERE p_size > 48) OR p_brand IS NULL GROUP BY 1")
def anti_unmatched(spark, folder):
    p = table(spark, folder, "part")
    return p.join(p.where("p_size > 48").select("p_brand").distinct(), "p_brand", "left_anti").groupBy(F.col("p_brand").alias("name")).agg(F.count("*").alias("n"))


@query("WITH a AS (SELECT c_custkey AS id FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 50), b AS (SELECT o_custkey AS id FROM orders GROUP BY 1 ORDER BY sum(o_totalprice) DESC, 1 LIMIT 50) SELECT count(*) AS common, 100.0 * count(*) / 50 AS overlap_pct FROM a JOIN b USING (id)")
def semi_topn_overlap(spark, folder):
    a = table(spark, folder, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(50).select(F.col("c_custkey").alias("id"))
    b = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.sum("o_totalprice").alias("t")).orderBy(F.desc("t"), "id").limit(50)
    return a.join(b, "id", "left_semi").agg(F.count("*").alias("common"), (100.0 * F.count("*") / 50).alias("overlap_pct"))


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def pair_self_join(spark, folder):
    n = table(spark, folder, "nation")
    a, b = n.select(F.col("n_nationkey").alias("a"), "n_regionkey"), n.select(F.col("n_nationkey").alias("b"), "n_regionkey")
    return a.join(b, "n_regionkey").where("a < b").select("a", "b")


@query("WITH d AS (SELECT DISTINCT lower(substr(p_name, 2, 3)) AS name FROM part), e AS (SELECT name, name AS pos FROM d WHERE name <> '') SELECT p_partkey AS row_id, arg_min(name, pos) AS id FROM part JOIN e ON contains(lower(p_name), name) GROUP BY 1")
def contains_join_first(spark, folder):
    p = table(spark, folder, "part")
    names = p.select(F.lower(F.substring("p_name", 2, 3)).alias("name")).distinct().where("name <> ''")
    dim = names.withColumn("pos", F.col("name")).withColumn("id", F.col("name"))
    return resolve.first_contained(p.select(F.col("p_partkey").alias("row_id"), F.col("p_name").alias("text")), dim)


@query("SELECT page_id, coalesce(nullif(regexp_extract(url, 'p/([0-9]+)', 1), ''), nullif(regexp_extract(url, '([0-9]+)', 1), ''), 'none') AS code, CASE WHEN regexp_matches(url, 'p/[0-9]+') THEN 'path' WHEN regexp_matches(url, '[0-9]+') THEN 'number' ELSE 'default' END AS method FROM pages")
def fallback_chain(spark, folder):
    u = F.col("url")
    a, b = text.code(u, "p/([0-9]+)"), text.code(u, "([0-9]+)")
    return table(spark, folder, "pages").select("page_id", F.coalesce(a, b, F.lit("none")).alias("code"), F.when(a.isNotNull(), "path").when(b.isNotNull(), "number").otherwise("default").alias("method"))


@query("SELECT c_custkey AS id, CASE WHEN n IS NOT NULL THEN n WHEN c_nationkey IN (SELECT DISTINCT c_nationkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 400000) THEN 0 END AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 400000 GROUP BY 1) ON o_custkey = c_custkey")
def covered_zero(spark, folder):
    """Zero where the source has the entity's group, unknown where it does not."""
    c = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey")
    n = table(spark, folder, "orders").where("o_totalprice > 400000").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n"))
    seen = c.join(n, "id").select("c_nationkey").distinct().withColumn("seen", F.lit(True))
    return c.join(n, "id", "left").join(F.broadcast(seen), "c_nationkey", "left").select("id", F.coalesce("n", F.when(F.col("seen"), F.lit(0).cast("long"))).alias("n"))


@query("""WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P')
SELECT 'union' AS op, count(*) AS n FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT 'intersect', count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b)
UNION ALL SELECT 'except', count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'union_all', (SELECT count(*) FROM a) + (SELECT count(*) FROM b)
UNION ALL SELECT 'not_subset', count(*) FROM b WHERE k NOT IN (SELECT k FROM a)""")
def set_equal_diff(spark, folder):
    o = table(spark, folder, "orders")
    a, b = (o.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k")).distinct() for s in "FP")
    count = lambda name, x: x.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
    out = count("union", a.union(b).distinct()).union(count("intersect", a.intersect(b))).union(count("except", a.exceptAll(b)))
    return out.union(count("union_all", a.unionByName(b))).union(count("not_subset", b.join(a, "k", "left_anti")))


@query("SELECT CAST(c_nationkey AS BIGINT) AS grp, count(*) AS n, round(avg(c_acctbal), 4) AS mean, round(quantile_cont(c_acctbal, 0.5), 4) AS median, arg_max(c_name, (c_acctbal, -c_custkey)) AS best FROM customer GROUP BY 1")
def state_summary(spark, folder):
    c = table(spark, folder, "customer").withColumn("grp", F.col("c_nationkey").cast("long"))
    m = order.quantiles(c, "c_acctbal", {"median": 0.5}, ["grp"])
    a = c.groupBy("grp").agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 4).alias("mean"), F.max_by("c_name", F.struct("c_acctbal", -F.col("c_custkey"))).alias("best"))
    return a.join(m, "grp").select("grp", "n", "mean", F.round("median", 4).alias("median"), "best")


@query("SELECT o_orderpriority AS priority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def crosstab_tier(spark, folder):
    x = table(spark, folder, "orders").groupBy(F.col("o_orderpriority").alias("priority")).pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)
    return x.select("priority", F.col("F").alias("f"), F.col("O").alias("o"), F.col("P").alias("p"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def value_counts(spark, folder):
    return table(spark, folder, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT CAST(c_nationkey AS BIGINT) AS id, count(*) AS n, count(DISTINCT o_custkey) AS n_names FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def two_phase_count(spark, folder):
    """Counts by raw name first, so that each name is resolved once."""
    raw = table(spark, folder, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    c = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("id"))
    return raw.join(c, "o_custkey").groupBy("id").agg(F.sum("n").alias("n"), F.count("*").alias("n_names"))


_PROFILE = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) AS n, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS \"distinct\", min({c} + 0) AS lo, max({c} + 0) AS hi, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 6) AS std FROM lineitem"
    for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
)


@query(_PROFILE)
def column_profile(spark, folder):
    p = quality.profile(table(spark, folder, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return p.select("column", "n", "nulls", "distinct", "lo", "hi", F.round("mean", 4).alias("mean"), F.round("std", 6).alias("std"))


@query("SELECT l_returnflag AS flag, round(quantile_cont(l_extendedprice, 0.2), 4) AS p20, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.8), 4) AS p80 FROM lineitem GROUP BY 1")
def quantiles_exact(spark, folder):
    x = table(spark, folder, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_extendedprice")
    q = order.quantiles(x, "l_extendedprice", {"p20": 0.2, "p50": 0.5, "p80": 0.8}, ["flag"])
    return q.select("flag", *[F.round(c, 4).alias(c) for c in ("p20", "p50", "p80")])


@query("SELECT CAST(c_nationkey AS BIGINT) AS grp, round(sum(o_totalprice), 2) AS total, round(sum(o_totalprice) / sum(sum(o_totalprice)) OVER (), 9) AS share FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def share_of_total(spark, folder):
    c = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("grp"))
    g = table(spark, folder, "orders").join(c, "o_custkey").groupBy("grp").agg(F.sum("o_totalprice").alias("t"))
    return g.select("grp", F.round("t", 2).alias("total"), F.round(F.col("t") / F.sum("t").over(Window.partitionBy(F.lit(1))), 9).alias("share"))


@query("SELECT round(sum(CASE WHEN o_totalprice >= q THEN o_totalprice END) / sum(o_totalprice), 9) AS share FROM orders, (SELECT quantile_cont(o_totalprice, 0.99) AS q FROM orders)")
def concentration_share(spark, folder):
    from ..operators.stats import winsor_share

    return winsor_share(table(spark, folder, "orders").select("o_totalprice"), "o_totalprice", 0.99).select(F.round("share", 9).alias("share"))


_SCEN = [(f"{s}_{m}", s, m) for s in ("strict", "inclusive", "conservative") for m in ("n", "price", "qty")]
_COND = {"strict": "l_returnflag = 'R'", "inclusive": "l_returnflag IN ('R', 'A')", "conservative": "l_returnflag = 'R' AND l_discount < 0.05"}
_MEAS = {"n": "1.0", "price": "l_extendedprice", "qty": "l_quantity"}


@query("SELECT l_suppkey AS id, " + ", ".join(f"round(sum(CASE WHEN {_COND[s]} THEN CAST({_MEAS[m]} AS DOUBLE) ELSE 0 END), 2) AS {k}" for k, s, m in _SCEN) + " FROM lineitem GROUP BY 1")
def scenario_sums(spark, folder):
    aggs = [F.round(F.sum(F.expr(f"CASE WHEN {_COND[s]} THEN CAST({_MEAS[m]} AS DOUBLE) ELSE 0D END")), 2).alias(k) for k, s, m in _SCEN]
    return table(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(*aggs)


_FILL = SQL + ", m AS (SELECT *, CASE WHEN value IS NOT NULL THEN 'OBSERVED' WHEN count(value) OVER (PARTITION BY grp, indicator) > 0 THEN 'IMPUTED_GROUP_MEAN' ELSE 'MISSING' END AS status FROM f)"


@query(_FILL + " SELECT id, count(*) AS total, count(*) FILTER (status = 'OBSERVED') AS observed, count(*) FILTER (status LIKE 'IMPUTED%') AS imputed, round(100.0 * count(*) FILTER (status = 'OBSERVED') / count(*), 4) AS observed_pct, round((count(*) FILTER (status = 'OBSERVED') + 0.6 * count(*) FILTER (status LIKE 'IMPUTED%')) / count(*), 6) AS quality FROM m GROUP BY 1")
def quality_pct(spark, folder):
    p = quality.provenance(normalised(spark, folder), ["id"])
    return p.select("id", "total", "observed", "imputed", F.round("observed_pct", 4).alias("observed_pct"), F.round("quality", 6).alias("quality"))


@query(_FILL + " SELECT grp, pillar AS source, CASE WHEN bool_or(status = 'OBSERVED') THEN 'AVAILABLE' WHEN bool_or(status LIKE 'INHERITED%') THEN 'INHERITED' ELSE 'IMPUTED' END AS status FROM m JOIN i USING (indicator) GROUP BY 1, 2")
def source_status(spark, folder):
    x = normalised(spark, folder).join(F.broadcast(indicators(spark).select("indicator", "pillar")), "indicator")
    return quality.group_status(x, F.col("pillar"))


@query(_FILL + " SELECT indicator, count(*) FILTER (status = 'OBSERVED') AS observed, count(*) FILTER (status = 'IMPUTED_GROUP_MEAN') AS imputed, count(*) FILTER (status = 'MISSING') AS missing FROM m GROUP BY 1")
def completeness_pivot(spark, folder):
    c = quality.completeness(normalised(spark, folder), ["OBSERVED", "IMPUTED_GROUP_MEAN", "MISSING"])
    return c.select("indicator", F.col("OBSERVED").alias("observed"), F.col("IMPUTED_GROUP_MEAN").alias("imputed"), F.col("MISSING").alias("missing"))


@query(_FILL + " SELECT indicator, grp, status, count(*) AS n FROM m GROUP BY 1, 2, 3")
def provenance_counts(spark, folder):
    return normalised(spark, folder).groupBy("indicator", "grp", "status").agg(F.count("*").alias("n"))


@query("""SELECT p_partkey AS id, rank() OVER (ORDER BY p_size DESC) AS r_min, rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS r_brand,
 rank() OVER (ORDER BY p_size DESC) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS r_avg, round((rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0) / count(*) OVER () * 100, 6) AS r_pct FROM part""")
def rank_min_avg(spark, folder):
    p = table(spark, folder, "part").select(F.col("p_partkey").alias("id"), "p_size", "p_brand")
    x = order.with_rank(p, "p_size", "r_min")
    x = order.with_rank(x, "p_size", "r_brand", ["p_brand"])
    x = order.with_rank(x, "p_size", "r_avg", ties="average")
    x = order.with_rank(x, "p_size", "r_pct", descending=False, ties="percent")
    return x.select("id", "r_min", "r_brand", "r_avg", F.round("r_pct", 6).alias("r_pct"))


@query("SELECT c_custkey AS id, CAST(1 + ((row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1) * 4) // count(*) OVER () AS BIGINT) AS quartile FROM customer")
def quartile_ntile(spark, folder):
    c = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal")
    n = c.agg(F.count("*").alias("n"))
    x = order.row_numbers(c, "c_acctbal", [F.asc("id")], "rn").crossJoin(F.broadcast(n))
    return x.select("id", (1 + F.expr("((rn - 1) * 4) div n")).cast("long").alias("quartile"))


@query("SELECT event_id, user_id, CASE WHEN event_id % 4 = 0 THEN event_type END AS seen, last_value(CASE WHEN event_id % 4 = 0 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM events")
def ffill_group(spark, folder):
    e = table(spark, folder, "events").select("event_id", "user_id", F.when(F.col("event_id") % 4 == 0, F.col("event_type")).alias("seen"))
    return sequence.fill_down(e, "seen", ["user_id"], ["event_id"], "filled")


@query("SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS occurrence FROM events")
def occurrence_index(spark, folder):
    e = table(spark, folder, "events").select("event_id", "user_id", "event_type")
    return sequence.occurrence(e, ["user_id", "event_type"], ["event_id"]).withColumn("occurrence", F.col("occurrence").cast("long"))


@query("SELECT event_id, lead(event_type, 1) OVER w AS next_1, lead(event_type, 2) OVER w AS next_2, round(value - lag(value) OVER w, 6) AS delta FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def lookahead(spark, folder):
    e = table(spark, folder, "events").select("event_id", "user_id", "event_type", "value")
    w = Window.partitionBy("user_id").orderBy("event_id")
    x = sequence.look_ahead(e, "event_type", ["user_id"], ["event_id"]).withColumn("delta", F.round(F.col("value") - F.lag("value").over(w), 6))
    return x.select("event_id", "next_1", "next_2", "delta")


@query("SELECT user_id, event_type, min(event_id) AS first_id, max(event_id) AS last_id, round(arg_min(value, event_id), 6) AS first_value, round(arg_max(value, event_id), 6) AS last_value, count(*) AS n_rows FROM events GROUP BY 1, 2")
def dedupe_first_last(spark, folder):
    e = table(spark, folder, "events").select("user_id", "event_type", "event_id", F.round("value", 6).alias("value"))
    k = ["user_id", "event_type"]
    a = sequence.keep_first(e, k, F.col("event_id")).select(*k, F.col("event_id").alias("first_id"), F.col("value").alias("first_value"))
    b = sequence.keep_last(e, k, F.col("event_id")).select(*k, F.col("event_id").alias("last_id"), F.col("value").alias("last_value"), "n_rows")
    return a.join(b, k).select(*k, "first_id", "last_id", "first_value", "last_value", "n_rows")


@query("SELECT o_orderkey AS id, o_totalprice AS price FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def topk(spark, folder):
    return table(spark, folder, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))


@query("SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_ext(spark, folder):
    x = table(spark, folder, "lineitem").rollup(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"))
    return x.agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("SELECT p_partkey AS id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(lower(trim(p_name || ' District. - ' || p_brand)), ' district', ''), ' dist.', ''), ' dist', ''), '-', ' '), '_', ' '), '.', ''), ',', ''), '\\s+', ' ', 'g')) AS name FROM part")
def normalize_name(spark, folder):
    raw = F.concat("p_name", F.lit(" District. - "), "p_brand")
    return table(spark, folder, "part").select(F.col("p_partkey").alias("id"), text.normalise_name(raw, marks=False).alias("name"))


@query("""WITH c AS (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'NA' WHEN 1 THEN '-' WHEN 2 THEN 'Rs' || CAST(p_size AS VARCHAR) || ',500' WHEN 3 THEN ' ' || CAST(p_size AS VARCHAR) || '.25 ' ELSE '*' END AS cell FROM part)
SELECT id, CASE WHEN upper(trim(cell)) IN ('NA', 'N/A', '-', '') THEN NULL ELSE try_cast(replace(regexp_replace(trim(cell), '^[A-Za-z]+', ''), ',', '') AS DOUBLE) END AS value FROM c""")
def numeric_cell(spark, folder):
    k, s = F.col("p_partkey"), F.col("p_size").cast("string")
    cell = F.when(k % 5 == 0, "NA").when(k % 5 == 1, "-").when(k % 5 == 2, F.concat(F.lit("Rs"), s, F.lit(",500"))).when(k % 5 == 3, F.concat(F.lit(" "), s, F.lit(".25 "))).otherwise("*")
    return table(spark, folder, "part").select(F.col("p_partkey").alias("id"), text.numeric_cell(cell).alias("value"))


@query("SELECT page_id, nullif(regexp_extract(url, '([0-9]{2,})', 1), '') AS code FROM pages")
def extract_code(spark, folder):
    return table(spark, folder, "pages").select("page_id", text.code(F.col("url"), "([0-9]{2,})").alias("code"))


@query("""WITH c AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN '12. Women (%) ' || CAST(p_size AS VARCHAR) || '.5 7' WHEN 1 THEN 'Cost Rs. 1,' || CAST(100 + p_size AS VARCHAR) WHEN 2 THEN 'Share (%) *' ELSE 'Total 8 ' || CAST(p_size AS VARCHAR) END AS line FROM part)
SELECT id, CASE WHEN regexp_extract(line, '(?:\\(%\\)|Rs\\.)\\s*\\(?([0-9,]+(?:\\.[0-9]+)?|\\*|na)', 1) <> '' THEN try_cast(replace(regexp_extract(line, '(?:\\(%\\)|Rs\\.)\\s*\\(?([0-9,]+(?:\\.[0-9]+)?|\\*|na)', 1), ',', '') AS DOUBLE) ELSE try_cast(list_last(regexp_extract_all(line, '(-?[0-9]+(?:\\.[0-9]+)?)')) AS DOUBLE) END AS value FROM c""".replace("\\\\", "\\"))
def unit_value(spark, folder):
    k, s = F.col("p_partkey"), F.col("p_size").cast("string")
    line = F.when(k % 4 == 0, F.concat(F.lit("12. Women (%) "), s, F.lit(".5 7"))).when(k % 4 == 1, F.concat(F.lit("Cost Rs. 1,"), (100 + F.col("p_size")).cast("string"))).when(k % 4 == 2, "Share (%) *").otherwise(F.concat(F.lit("Total 8 "), s))
    return table(spark, folder, "part").select(F.col("p_partkey").alias("id"), text.unit_value(line).alias("value"))


def _resolve_inputs(spark, folder):
    """Names as they are, with an ending, with another first letter, aliased, and garbled; groups as hints in full, in part, of no entity, and none."""
    p = table(spark, folder, "part")
    dim = p.select(F.col("p_partkey").alias("id"), F.lower(F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string"))).alias("name"), F.lower("p_brand").alias("grp"))
    k = F.col("id")
    garbled = F.when(k % 3 == 0, F.concat(F.lit("q"), F.substring("name", 2, 1000))).when(k % 3 == 1, F.concat("name", F.lit("x"))).otherwise(F.concat(F.lit("zz"), F.reverse("name")))
    asked = dim.select(
        F.when(k % 4 == 0, F.col("name")).when(k % 4 == 2, F.concat(F.lit("old "), "name")).otherwise(garbled).alias("name"),
        F.when(k % 8 == 5, F.lit(None)).when(k % 16 == 6, F.lit("nowhere")).when(k % 16 == 7, F.substring("grp", 1, 7)).when(k % 16 == 12, F.concat("grp", F.lit(" area"))).otherwise(F.col("grp")).alias("hint"),
    )
    aliases = dim.where("id % 4 = 2").select(F.concat(F.lit("old "), "name").alias("alias"), "id", F.lit("historical").alias("method"), F.lit(0.9).alias("confidence"))
    return asked, dim, aliases


_FITS = "(hint IS NULL OR contains(grp, hint) OR contains(hint, grp))"
_RESOLVE = f"""WITH dim AS (SELECT p_partkey AS id, lower(p_name || ' ' || p_partkey) AS name, lower(p_brand) AS grp FROM part),
ask AS (SELECT DISTINCT CASE WHEN id % 4 = 0 THEN name WHEN id % 4 = 2 THEN 'old ' || name WHEN id % 3 = 0 THEN 'q' || substr(name, 2) WHEN id % 3 = 1 THEN name || 'x' ELSE 'zz' || reverse(name) END AS name,
  CASE WHEN id % 8 = 5 THEN NULL WHEN id % 16 = 6 THEN 'nowhere' WHEN id % 16 = 7 THEN substr(grp, 1, 7) WHEN id % 16 = 12 THEN grp || ' area' ELSE grp END AS hint FROM dim),
a AS (SELECT ask.name, hint, min(dim.id) AS id FROM ask JOIN dim ON ask.name = 'old ' || dim.name AND dim.id % 4 = 2 WHERE {_FITS} GROUP BY 1, 2),
x AS (SELECT ask.name, hint, CASE WHEN count(*) FILTER ({_FITS}) > 0 THEN list_sort(list(id) FILTER ({_FITS})) ELSE list_sort(list(id)) END AS found FROM ask JOIN dim ON dim.name = ask.name GROUP BY 1, 2),
z AS (SELECT ask.name, hint, id, 1.0 - levenshtein(ask.name, dim.name)::DOUBLE / greatest(length(ask.name), length(dim.name)) AS ratio FROM ask JOIN dim ON {_FITS}),
t AS (SELECT name, hint, max(ratio) AS top FROM z GROUP BY 1, 2 HAVING max(ratio) >= 0.84),
y AS (SELECT z.name, z.hint, max(top) AS top, list_sort(list(id)) AS close FROM z JOIN t ON z.name = t.name AND z.hint IS NOT DISTINCT FROM t.hint WHERE top - ratio <= 0.03 GROUP BY 1, 2)
SELECT ask.name, ask.hint, CASE WHEN a.id IS NOT NULL THEN a.id WHEN len(found) = 1 THEN found[1] WHEN found IS NULL AND len(close) = 1 THEN close[1] END AS id,
 CASE WHEN a.id IS NOT NULL THEN 'historical' WHEN len(found) = 1 THEN 'exact' WHEN found IS NOT NULL THEN 'ambiguous' WHEN len(close) = 1 THEN 'fuzzy' WHEN close IS NOT NULL THEN 'ambiguous' ELSE 'unmatched' END AS method,
 round(CASE WHEN a.id IS NOT NULL THEN 0.9 WHEN found IS NOT NULL THEN 1.0 ELSE coalesce(top, 0) END, 6) AS confidence,
 CASE WHEN a.id IS NULL AND (len(found) > 1 OR (found IS NULL AND len(close) > 1)) THEN array_to_string(coalesce(found, close), ',') END AS candidates
FROM ask LEFT JOIN a ON a.name = ask.name AND a.hint IS NOT DISTINCT FROM ask.hint LEFT JOIN x ON x.name = ask.name AND x.hint IS NOT DISTINCT FROM ask.hint LEFT JOIN y ON y.name = ask.name AND y.hint IS NOT DISTINCT FROM ask.hint"""


@query(_RESOLVE)
def resolve_cascade(spark, folder):
    r = resolve.resolve(*_resolve_inputs(spark, folder))
    return r.select("name", "hint", "id", "method", F.round("confidence", 6).alias("confidence"), F.array_join(F.col("candidates").cast("array<string>"), ",").alias("candidates"))


@query()
def fuzzy_difflib(spark, folder):
    """The same with the Ratcliff-Obershelp ratio."""
    asked, dim, aliases = _resolve_inputs(spark, folder)
    return resolve.resolve(asked, dim, aliases, similarity=text.sequence_ratio).select("name", "hint", "id", "method", F.round("confidence", 6).alias("confidence"))


@query("SELECT c_custkey AS id, round(n / greatest(c_acctbal, 1.0), 3) AS per_100k, CASE WHEN c_acctbal > 0 THEN round(n * 100000.0 / c_acctbal, 4) END AS rate, round(100.0 * f / n, 2) AS pct, greatest(CAST(trunc(n * 1.8) AS INTEGER), 6) AS truncated, round(ln(1 + n) * (1 + ln(1 + greatest(c_acctbal, 0.0))), 6) AS intensity, round(n, 0) > 12 AS large FROM (SELECT c_custkey, c_acctbal, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (o_orderstatus = 'F') AS DOUBLE) AS f FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)")
def rates_and_ratios(spark, folder):
    o = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").cast("double").alias("n"), F.count_if(F.col("o_orderstatus") == "F").cast("double").alias("f"))
    x = table(spark, folder, "customer").select("c_custkey", "c_acctbal").join(o, "c_custkey")
    n, a = F.col("n"), F.col("c_acctbal")
    return x.select(
        F.col("c_custkey").alias("id"), numeric.per_100k(n, a).alias("per_100k"), F.round(numeric.rate_or_null(n, a), 4).alias("rate"), numeric.percent(F.col("f"), n).alias("pct"),
        numeric.truncated_count(n, 1.8, 6).alias("truncated"), F.round(numeric.intensity(n, F.greatest(a, F.lit(0.0))), 6).alias("intensity"), (F.round(n, 0) > 12).alias("large"),
    )




@query("SELECT id, indicator, value FROM (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS p_size, p_retailprice FROM part) UNPIVOT INCLUDE NULLS (value FOR indicator IN (p_size, p_retailprice))")
def unpivot_records(spark, folder):
    return tables.unpivot(table(spark, folder, "part").withColumnRenamed("p_partkey", "id"), ["id"], ["p_size", "p_retailprice", "absent"])


@query("WITH x AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS v FROM part) SELECT id, coalesce(v, (SELECT quantile_cont(v, 0.5) FROM x), 0) AS v FROM x")
def coerce_median(spark, folder):
    v = F.when(F.col("p_partkey") % 9 == 0, "n/a").otherwise(F.col("p_size").cast("string"))
    return tables.coerce_numeric(table(spark, folder, "part").select(F.col("p_partkey").alias("id"), v.alias("v")), ["v"]).select("id", "v")


@query("WITH a AS (SELECT s_suppkey AS a_id, row_number() OVER (ORDER BY s_suppkey) AS position FROM supplier), b AS (SELECT c_custkey AS b_id, row_number() OVER (ORDER BY c_custkey) AS position FROM customer) SELECT position, a_id, b_id FROM a FULL JOIN b USING (position)")
def positional_join(spark, folder):
    a = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("a_id"))
    b = table(spark, folder, "customer").select(F.col("c_custkey").alias("b_id"))
    return tables.positional_join(a, "a_id", b, "b_id")


@query("SELECT p_partkey AS id, CAST(contains(lower(p_name), 'red') OR contains(lower(p_name), 'gear') AS INTEGER) AS listed FROM part")
def listed_flag(spark, folder):
    return table(spark, folder, "part").select(F.col("p_partkey").alias("id"), tables.listed(F.col("p_name"), ["Red", "gear"]).alias("listed"))


@query("WITH x AS (SELECT 'balance' AS indicator, c_custkey AS id, c_acctbal AS v, rank() OVER (ORDER BY c_acctbal) AS ra, c_mktsegment AS seg FROM customer), y AS (SELECT *, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS rp, ra + (SELECT count(*) - 1 FROM customer WHERE c_acctbal = v) / 2.0 AS rr FROM x WHERE seg = 'BUILDING') SELECT indicator, count(*) AS n, round(corr(rr, rp), 8) AS spearman FROM y GROUP BY 1")
def subsample_correlation(spark, folder):
    c = table(spark, folder, "customer").select(F.lit("balance").alias("indicator"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value"), "c_mktsegment")
    return tables.subsample_correlation(c, F.col("c_mktsegment") == "BUILDING").withColumn("spearman", F.round("spearman", 8))


@query("SELECT source, count(*) AS n_rows, count(*) FILTER (lang = 'en') AS english, count(*) FILTER (n_chars > 5000) AS long FROM documents GROUP BY 1")
def file_profile(spark, folder):
    return tables.file_profile(table(spark, folder, "documents").select("source", "lang", "n_chars"), {"english": F.col("lang") == "en", "long": F.col("n_chars") > 5000})


@query("SELECT c_custkey AS id, round(n / c_acctbal * 100000, 4) AS density, round(ln(1 + n), 8) AS size_index, round(ln(1 + n / c_acctbal * 100000), 8) AS intensity_index, round(ln(1 + n) * ln(1 + n / c_acctbal * 100000), 7) AS interaction FROM (SELECT o_custkey, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1) JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0")
def size_and_intensity(spark, folder):
    n = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").cast("double").alias("n"))
    x = table(spark, folder, "customer").where("c_acctbal > 0").select("c_custkey", "c_acctbal").join(n, "c_custkey")
    x = tables.size_and_intensity(x, "n", "c_acctbal")
    return x.select(F.col("c_custkey").alias("id"), *[F.round(c, k).alias(c) for c, k in (("density", 4), ("size_index", 8), ("intensity_index", 8), ("interaction", 7))])
