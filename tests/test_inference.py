"""Special functions against tables, statistics against plain Python, permutations, allocation, similar names."""

import itertools
import math
import random
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cairnspark.functions import keyed, numeric, special, text
from cairnspark.operators import allocate, concordance, folds, impute, rank_histograms, regression, resolve, sensitivity, similar

# --- special functions ---


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_log_gamma(spark):
    xs = [0.5, 1.0, 1.5, 2.0, 3.7, 10.0, 123.456, 1e6, 0.01]
    got = one(spark, *[special.log_gamma(F.lit(x)) for x in xs])
    for x, g in zip(xs, got):
        assert math.isclose(g, math.lgamma(x), rel_tol=1e-13, abs_tol=1e-13), x
    big = one(spark, special.log_gamma_step(F.lit(5e8), F.lit(0.5)))[0]
    a = 5e8
    assert math.isclose(big, 0.5 * math.log(a) - 1 / (8 * a), rel_tol=1e-15)


#: Two-sided chances of Student's t, to all digits given: (t, degrees of freedom, chance) in closed form.
T_TABLE = [
    (1.0, 1, 0.5), (math.sqrt(3.0), 1, 1 / 3), (math.sqrt(2.0), 2, 1 - 1 / math.sqrt(2.0)), (0.0, 5, 1.0),
    (12.706204736174698, 1, 0.05), (4.302652729749464, 2, 0.05), (2.5705818366147395, 5, 0.05), (2.2281388519649385, 10, 0.05), (2.042272456301238, 30, 0.05), (1.9839715184496334, 100, 0.05),
    (63.65674116287399, 1, 0.01), (3.169272667175838, 10, 0.01), (2.6258905214380184, 100, 0.01),
]


def test_t_against_tables(spark):
    rows = spark.createDataFrame([(float(t), float(v), float(p)) for t, v, p in T_TABLE], "t double, v double, p double")
    for r in rows.select("t", "v", "p", special.t_two_sided(F.col("t"), F.col("v")).alias("got"), special.t_two_sided(-F.col("t"), F.col("v")).alias("neg")).collect():
        assert abs(r.got - r.p) < 1e-9 and r.neg == r.got, r


def finite_t(t, v):
    """The two-sided chance by its finite series (whole degrees of freedom)."""
    a = math.atan(abs(t) / math.sqrt(v))
    s, c = math.sin(a), math.cos(a)
    if v % 2:
        total, term = 0.0, c
        for k in range(1, (v - 1) // 2 + 1):
            total += term
            term *= c * c * 2 * k / (2 * k + 1)
        return 1 - 2 / math.pi * (a + s * total)
    total, term = 0.0, 1.0
    for k in range(1, v // 2 + 1):
        total += term
        term *= c * c * (2 * k - 1) / (2 * k)
    return 1 - s * total


def test_t_for_many_arguments(spark):
    grid = [(t, v) for t in (1e-6, 0.1, 0.7, 1.3, 1.75, 2.5, 5.0, 9.0) for v in (1, 2, 3, 4, 7, 50, 333, 20_000)]
    rows = spark.createDataFrame([(float(t), int(v)) for t, v in grid], "t double, v long")
    got = rows.select("t", "v", special.t_two_sided(F.col("t"), F.col("v")).alias("p")).collect()
    assert all(abs(r.p - finite_t(r.t, r.v)) < 1e-9 for r in got)
    normal = one(spark, special.t_two_sided(F.lit(1.959963984540054), F.lit(10**9)), special.t_two_sided(F.lit(40.0), F.lit(10**6)), special.t_two_sided(F.lit(1.0), F.lit(0)), special.t_two_sided(F.lit(None).cast("double"), F.lit(4)))
    assert abs(normal[0] - 0.05) < 1e-8 and 0 <= normal[1] < 1e-200 and normal[2] is None and normal[3] is None
    assert abs(one(spark, special.f_upper(F.lit(4.0), F.lit(2), F.lit(10)))[0] - (1 + 8 / 10) ** -5) < 1e-12  # of two, in closed form


def test_exact_rounding_of_a_million_values(spark):
    """Ties of the printed value, of the binary value, neighbours of ties, large, tiny, and plain values."""
    rng = np.random.default_rng(1)
    whole = rng.integers(-(10**9), 10**9, 200_000)
    digits = rng.integers(0, 9, 200_000)
    ties = (whole * 2 + 1) / (2.0 * 10.0**digits)
    x = np.concatenate([ties, np.nextafter(ties, np.inf), np.nextafter(ties, -np.inf), rng.normal(size=200_000) * 10.0 ** rng.integers(-12, 16, 200_000), rng.integers(-(2**54), 2**54, 100_000) / 2.0 ** rng.integers(0, 30, 100_000)])
    x = np.concatenate([x, [0.0, -0.0, 5e-324, 1.7e308, -1.7e308, 2.0**52 + 0.5, 2.0**53 - 1, 0.5, 1.5, 2.5, 2.675]])
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    wanted = (0, 2, 4, 6)
    got = df.select("x", *[numeric.round_half_even(F.col("x"), d).alias(f"r{d}") for d in wanted]).toPandas()
    for d in wanted:
        want = np.array([round(v, d) for v in got["x"].tolist()])
        assert (got[f"r{d}"].to_numpy() == want).all(), got["x"][got[f"r{d}"] != want].head()
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,)], "x double").select(numeric.round_half_even(F.col("x"), 2).alias("r")).collect()
    assert math.isnan(odd[0].r) and odd[1].r == math.inf and odd[2].r is None


# --- concordance ---


def slow_tau(x, y):
    con = sum(np.sign(a - c) * np.sign(b - d) for (a, b), (c, d) in itertools.combinations(list(zip(x, y)), 2))
    pairs = len(x) * (len(x) - 1) / 2
    ties = lambda v: sum(k * (k - 1) / 2 for k in Counter(v).values())
    return con / math.sqrt((pairs - ties(x)) * (pairs - ties(y)))


def test_tau_by_ranges_is_tau(spark):
    rng = np.random.default_rng(2)
    groups = {
        "plain": (rng.normal(size=700), rng.normal(size=700)), "tied": (rng.integers(0, 9, 600).astype(float), rng.integers(0, 5, 600).astype(float)),
        "alike": (np.arange(400.0), np.arange(400.0) + rng.normal(size=400) * 9), "hot": (np.where(rng.random(600) < 0.4, 3.0, rng.normal(size=600) * 9), np.where(rng.random(600) < 0.3, 0.0, rng.normal(size=600))),
        "small": (np.array([1.0, 2.0, 3.0, -0.0]), np.array([1.0, 3.0, 2.0, 0.0])),
    }
    rows = [(g, float(a), float(b)) for g, (x, y) in groups.items() for a, b in zip(x, y)]
    rows += [("none", 1.0, 2.0), ("none", None, 1.0), ("none", float("nan"), 1.0), ("flat", 1.0, 1.0), ("flat", 1.0, 2.0)]
    got = {r.g: r for r in concordance.kendall(spark.createDataFrame(rows, "g string, x double, y double"), "x", "y", ["g"], per=40).collect()}
    for g, (x, y) in groups.items():
        assert math.isclose(got[g].tau, slow_tau(x, y), rel_tol=1e-12, abs_tol=1e-12) and got[g].n == len(x), g
    assert got["none"].tau is None and got["none"].n == 1 and got["flat"].tau is None
    assert concordance.kendall(spark.createDataFrame([], "g string, x double, y double"), "x", "y", ["g"]).count() == 0


def test_tau_of_a_large_group(spark):
    """Twenty thousand rows of one group in buckets of two hundred."""
    rows = spark.range(20_000).select(F.lit("g").alias("g"), F.pmod(F.xxhash64("id"), F.lit(10**6)).cast("double").alias("x"), F.pmod(F.xxhash64(F.col("id") + 10**6), F.lit(10**6)).cast("double").alias("y"))
    got = concordance.kendall(rows, "x", "y", ["g"], per=200).first()
    p = rows.toPandas()
    want = concordance.discordant(p["x"].to_numpy(), p["y"].to_numpy())
    pairs = 20_000 * 19_999 / 2
    tx, ty = (sum(k * (k - 1) / 2 for k in Counter(p[c]).values()) for c in "xy")
    txy = sum(k * (k - 1) / 2 for k in Counter(zip(p["x"], p["y"])).values())
    assert math.isclose(got.tau, (pairs - tx - ty + txy - 2 * want) / math.sqrt((pairs - tx) * (pairs - ty)), rel_tol=1e-12)


# --- regression ---


def test_fit_against_numpy(spark):
    rng = np.random.default_rng(4)
    n = 500
    x = rng.normal(size=(n, 3)) * [1, 50, 1e-3] + [1e4, 0, 7]
    y = 3 + x @ [2, -0.5, 400] + rng.normal(size=n)
    rows = [("a", *map(float, r), float(t)) for r, t in zip(x, y)] + [("b", 1.0, 2.0, 3.0, 4.0), ("b", None, 1.0, 1.0, 1.0), ("c", None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, x1 double, x2 double, x3 double, y double")
    got = {(r.g, r.term): r for r in regression.fit(df, "y", ["x1", "x2", "x3"], ["g"]).collect()}
    z = np.hstack([np.ones((n, 1)), x])
    b, *_ = np.linalg.lstsq(z, y, rcond=None)
    e = y - z @ b
    cov = np.linalg.inv(z.T @ z) * (e @ e) / (n - 4)
    for k, term in enumerate(["intercept", "x1", "x2", "x3"]):
        r = got["a", term]
        assert math.isclose(r.coefficient, b[k], rel_tol=1e-6) and math.isclose(r.se, math.sqrt(cov[k, k]), rel_tol=1e-6) and math.isclose(r.t, r.coefficient / r.se)
        assert abs(r.p - finite_t(r.t, n - 4)) < 1e-9 and r.dof == n - 4
    assert math.isclose(got["a", "x1"].r2, 1 - e @ e / ((y - y.mean()) @ (y - y.mean())), rel_tol=1e-9)
    assert got["b", "x1"].n == 1 and got["b", "x1"].se is None and ("c", "x1") not in got


def test_a_regressor_that_others_explain_has_no_part(spark):
    df = spark.createDataFrame([(float(i), float(2 * i + 1), 5.0, float(i * i)) for i in range(30)], "a double, twice double, flat double, y double")
    got = {r.term: r for r in regression.fit(df, "y", ["a", "twice", "flat"]).collect()}
    assert got["twice"].coefficient == 0 and got["twice"].se is None and got["flat"].coefficient == 0 and math.isclose(got["a"].coefficient, 29.0) and got["a"].dof == 28
    f = regression.fitted(df, regression.fit(df, "y", ["a", "twice", "flat"]), ["a", "twice", "flat"]).where("a = 3").first()
    assert math.isclose(f.fitted, got["intercept"].coefficient + 87.0)


# --- folds, allocation ---


@pytest.mark.parametrize("n", [1, 2, 3, 7, 50, 1000, 4097])
def test_permutations_are_bijections(spark, n):
    ids = spark.range(n)
    perms = [tuple(r[0] for r in ids.select(folds.permuted(F.col("id"), F.lit(n), seed)).collect()) for seed in (1, 2)]
    assert all(sorted(p) == list(range(n)) for p in perms) and (n < 7 or perms[0] != perms[1])
    if n >= 1000:  # no trend is left
        for p in perms:
            assert abs(np.corrcoef(np.arange(n), p)[0, 1]) < 0.12


def test_folds_are_of_equal_size(spark):
    df = spark.range(1003).select((F.col("id") * 17 + 5).alias("key"), F.lit("x").alias("at_"))
    a, b = (folds.shuffled_folds(df, "key", 10, seed).collect() for seed in (42, 43))
    assert sorted(Counter(r.fold for r in a).values()) == [100] * 7 + [101] * 3
    assert {r.key: r.fold for r in a} != {r.key: r.fold for r in b}
    assert {r.key: r.fold for r in a} == {r.key: r.fold for r in folds.shuffled_folds(df.repartition(3), "key", 10, 42).collect()}
    assert folds.shuffled_folds(df.limit(0), "key", 10).count() == 0


def test_keyed_numbers_are_uniform_and_normal(spark):
    r = spark.range(-20_000, 20_000).select(keyed.uniform(F.col("id"), 3).alias("u"), keyed.normal(F.col("id"), 3).alias("z")).agg(F.avg("u"), F.var_pop("u"), F.min("u"), F.max("u"), F.avg("z"), F.var_pop("z"), F.corr("u", "z")).first()
    assert abs(r[0] - 0.5) < 0.01 and abs(r[1] - 1 / 12) < 0.002 and 0 < r[2] and r[3] < 1 and abs(r[4]) < 0.02 and abs(r[5] - 1) < 0.03 and abs(r[6]) < 0.02


def test_allocations_add_up(spark):
    totals = spark.createDataFrame([(1, 1000), (2, 7), (3, 5), (4, 0), (6, 10**15)], "grp long, total long")
    members = [(i, 1, 1.0) for i in range(3)] + [(10 + i, 2, 0.1 * i) for i in range(40)] + [(60, 3, 0.0), (61, 3, None), (62, 3, -4.0), (70, 4, 2.0), (80, 5, 1.0)] + [(90 + i, 6, 1e9 + i) for i in range(5)]
    m = spark.createDataFrame(members, "id long, grp long, weight double").withColumn("units_", F.lit(1))
    for sigma in (0.0, 0.4):
        got = {r.id: r for r in allocate.allocate(totals, m, sigma, 9).collect()}
        assert len(got) == len(members)
        for g, total in ((1, 1000), (2, 7), (4, 0), (6, 10**15)):
            assert sum(r.units for r in got.values() if r.grp == g) == total
        assert all(got[i].units is None for i in (60, 61, 62, 80)) and got[10].units == 0
    plain = {r.id: r.units for r in allocate.allocate(totals, m).collect()}
    assert [plain[i] for i in range(3)] == [334, 333, 333]  # equal remainders: the smaller id first


# --- filling by evidence ---


def test_evidence_does_not_grow(spark):
    fact = spark.createDataFrame(
        [(1, "g", "i", 10.0, 1.0), (2, "g", "i", None, 2.0), (3, "g", "i", None, 3.0), (4, "h", "i", None, 2.2), (5, "h", "i", None, None), (6, None, "i", None, 100.0)],
        "id long, grp string, indicator string, value double, covariate double",
    )
    series = spark.createDataFrame([(2, "i", 2000, 20.0), (2, "i", 2002, 30.0), (3, "i", 2000, 9.0)], "id long, indicator string, year int, value double")
    got = {r.id: (r.value, r.status) for r in impute.cascade_by_evidence(fact, series, 2001, k=2).collect()}
    assert got[1] == (10.0, "OBSERVED") and got[2] == (25.0, "IMPUTED_TREND") and got[3] == (17.5, "IMPUTED_GROUP_MEAN")
    assert got[4] == (17.5, "IMPUTED_KNN")  # of ids 1 and 2 alone: the filled id 3 is no donor
    assert got[5] == (None, "MISSING") and got[6] == (17.5, "IMPUTED_KNN")


# --- histograms of ranks ---


def test_histograms_are_the_ranks_of_all_draws(spark):
    rng = np.random.default_rng(6)
    rows = [(i, p, float(np.round(rng.normal() * 3, 1))) for i in range(130) for p in ("A", "B", "D") if rng.random() < 0.9] + [(500, "D", 1.0)]
    pillars = spark.createDataFrame(rows, "id long, pillar string, score double").repartition(4)
    draws = sensitivity.draws_frame(spark, sensitivity.lognormal_draws({"A": 0.6, "B": 0.4}, 30))
    slow = sensitivity.draw_ranks(sensitivity.draw_scores(pillars, draws, 0.1, "D"), 6).collect()
    want = {}
    for r in slow:
        want.setdefault(r.id, Counter())[r["rank"]] += 1
    for bucket in (1000, 25):  # one bucket, and several
        got = {r.id: {x["rank"]: 0 for x in r.ranks} for r in rank_histograms.rank_histograms(pillars, draws, 0.1, "D", 6, bucket).collect()}
        full = rank_histograms.rank_histograms(pillars, draws, 0.1, "D", 6, bucket).collect()
        for r in full:
            for x in r.ranks:
                got[r.id][x["rank"]] += x["n"]
        assert {k: dict(v) for k, v in want.items()} == got
    old = {r.id: r for r in sensitivity.stability(sensitivity.draw_ranks(sensitivity.draw_scores(pillars, draws, 0.1, "D"), 6)).collect()}
    tiers = {r.id: r for r in sensitivity.tier_shares(sensitivity.draw_scores(pillars, draws, 0.1, "D").withColumn("score", F.round("score", 6))).collect()}
    for r in rank_histograms.stability(rank_histograms.rank_histograms(pillars, draws, 0.1, "D", 6, 25)).collect():
        for c in ("mean_rank", "median_rank", "std_rank", "p05", "p95", "best", "worst", "top10_pct", "top20_pct"):
            assert math.isclose(r[c], old[r.id][c], rel_tol=1e-9, abs_tol=1e-9), c
        assert all(math.isclose(r[f"tier{k}_pct"], tiers[r.id][f"tier{k}_pct"], abs_tol=1e-9) for k in (1, 2, 3, 4))


# --- similar names ---


def test_no_similar_pair_is_missed(spark):
    rnd = random.Random(11)
    names = sorted({"".join(rnd.choice("abc ") for _ in range(rnd.randint(1, 14))).strip() for _ in range(260)} - {""})
    known = spark.createDataFrame([(n,) for n in names], "d_name string")
    asked = set()
    for n in names:
        t = list(n)
        for _ in range(rnd.randrange(4)):
            k = rnd.randrange(len(t) + 1)
            t[k : k + rnd.randrange(2)] = rnd.choice(["", "a", "x"])
        asked.add("".join(t))
    asked = sorted(asked - {""})
    ask = spark.createDataFrame([(n,) for n in asked], "name string")

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    near = {(r.name, r.d_name) for r in similar.one_edit(ask, known).collect()}
    assert {(a, b) for a in asked for b in names if lev(a, b) <= 1} <= near
    for measure, ratio in ((text.edit_ratio, lambda a, b: 1 - lev(a, b) / max(len(a), len(b))), (text.sequence_ratio, lambda a, b: SequenceMatcher(None, a, b).ratio())):
        found = similar.few_edits(ask.withColumn("group", F.lit("*")), known.withColumn("group", F.lit("*")), similar.Bound(measure), 0.75)
        assert {(a, b) for a in asked for b in names if ratio(a, b) >= 0.75} <= {(r.name, r.d_name) for r in found.collect()}


def test_names_of_one_vocabulary_meet_few_others(spark):
    """Pairs that are decided: at most 20 a name where all names are made of a few words and a number."""
    folder = "/root/testdata/sf0.01"
    from cairnspark.plans.relational import _resolve_inputs

    asked, dim, _ = _resolve_inputs(spark, folder)
    open_ = asked.join(dim.select("name"), "name", "left_anti").distinct()
    known = dim.select(F.col("name").alias("d_name"), F.concat(F.lit("g"), "grp").alias("group"))
    n = open_.select("name").distinct().count()
    first = similar.one_edit(open_.select("name").distinct(), known.select("d_name").distinct()).count()
    with_hint = open_.where("hint like 'brand#%' and hint not like '% area'").select("name", F.concat(F.lit("g"), "hint").alias("group"))
    then = similar.few_edits(with_hint, known, similar.Bound(text.edit_ratio), 0.81).count()
    assert n > 1000 and first <= 20 * n and then <= 20 * with_hint.count(), (n, first, then)
    assert resolve.THRESHOLD - resolve.MARGIN == pytest.approx(0.81)


def test_statistics_of_ranks_in_many_buckets(spark):
    """As from histograms, with ties, an absent pillar, and more buckets and blocks than one."""
    from unittest import mock

    rows = [(k, p, float((k * m) % 17)) for k in range(300) for p, m in (("A", 3), ("B", 7), ("D", 5)) if k % 11 or p != "B"]
    draws = [(d, p, x) for d in range(12) for p, x in (("A", 0.3 + d / 40), ("B", 0.7 - d / 40))]
    pillars, drawn = spark.createDataFrame(rows, "id long, pillar string, score double"), spark.createDataFrame(draws, "draw int, pillar string, weight double")
    score = {k: {p: s for i, p, s in rows if i == k} for k in range(300)}
    weight = {d: {p: x for e, p, x in draws if e == d} for d in range(12)}
    want = {k: [] for k in range(300)}
    for d in range(12):
        s = {k: round(sum(weight[d][p] * v.get(p, 0.0) for p in "AB") - 0.15 * v["D"], 6) for k, v in score.items()}
        for k in s:
            want[k].append(1 + sum(x > s[k] for x in s.values()))
    with mock.patch.object(rank_histograms, "CELLS", 600):
        got = rank_histograms.rank_statistics(pillars, drawn, 0.15, "D", 6, positions=(0.25,), bucket=20).collect()
    assert len(got) == 300
    for r in got:
        w = sorted(want[r.id])
        assert (r.best, r.worst, r.pos0) == (w[0], w[-1], w[3]) and math.isclose(r.mean_rank, sum(w) / 12) and math.isclose(r.median_rank, (w[5] + w[6]) / 2)
