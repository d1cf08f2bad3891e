"""Operators on small fixtures with known answers."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cairnspark.functions import numeric, text
from cairnspark.operators import audit, concordance, impute, lineage, normalise, order, quality, resolve, score, sensitivity, sequence, stats
from cairnspark.operators import weights as w


def fact(spark, rows):
    return spark.createDataFrame(rows, "id long, grp long, indicator string, value double")


def values(df, key="id", value="norm"):
    return {r[key]: r[value] for r in df.collect()}


def directions(spark, d="POSITIVE"):
    return spark.createDataFrame([("x", d)], "indicator string, direction string")


def test_minmax(spark):
    f = fact(spark, [(1, 0, "x", 10.0), (2, 0, "x", 50.0), (3, 0, "x", 90.0), (4, 0, "x", None)])
    assert values(normalise.minmax(f, directions(spark))) == {1: 0.0, 2: 50.0, 3: 100.0, 4: 50.0}
    assert values(normalise.minmax(f, directions(spark, "NEGATIVE"), missing="propagate")) == {1: 100.0, 2: 50.0, 3: 0.0, 4: None}


def test_minmax_of_a_constant_is_neutral(spark):
    assert set(values(normalise.minmax(fact(spark, [(1, 0, "x", 7.0), (2, 0, "x", 7.0)]), directions(spark))).values()) == {50.0}


def test_average_ranks(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 2.0), (4, 3.0), (5, None)], "id long, v double")
    assert values(order.with_rank(df, "v", descending=False, ties="average"), value="rank") == {1: 1.0, 2: 2.5, 3: 2.5, 4: 4.0, 5: None}
    assert values(order.with_rank(df, "v"), value="rank") == {1: 4, 2: 2, 3: 2, 4: 1, 5: None}


def test_quantiles_match_linear_interpolation(spark):
    df = spark.range(1, 1002).select((F.col("id") * 8 % 1001).cast("double").alias("v"))
    q = order.quantiles(df, "v", {"a": 0.25, "b": 0.5, "c": 0.999}).first()
    assert (q.a, q.b, q.c) == (250.0, 500.0, 999.0)


def test_quantiles_with_a_value_on_a_third_of_rows(spark):
    df = spark.range(900).select(F.when(F.col("id") < 300, 5.0).otherwise(F.col("id").cast("double")).alias("v"))
    q = order.quantiles(df, "v", {"a": 0.1, "b": 0.5}).first()
    assert (q.a, q.b) == (5.0, 449.5)


def test_entropy_prefers_the_varying_indicator(spark):
    rows = [("P", "a", x) for x in (0.0, 50.0, 100.0)] + [("P", "b", 50.0)] * 3
    got = {r.indicator: r.weight for r in w.entropy(spark.createDataFrame(rows, "pillar string, indicator string, norm double")).collect()}
    assert math.isclose(sum(got.values()), 1.0) and got["a"] > got["b"]


def test_entropy_present_of_constants_is_equal(spark):
    rows = [("P", "a", 50.0)] * 20 + [("P", "b", 50.0)] * 18
    got = {r.indicator: r.weight for r in w.entropy_present(spark.createDataFrame(rows, "pillar string, indicator string, norm double")).collect()}
    assert got == {"a": 0.5, "b": 0.5}
    rows = [("P", "a", x) for x in (1.0, 99.0, 3.0)] + [("P", "b", 50.0)] * 3
    got = {r.indicator: r.weight for r in w.entropy_present(spark.createDataFrame(rows, "pillar string, indicator string, norm double")).collect()}
    assert got["a"] > 0.99


def test_pairwise_of_a_consistent_matrix():
    got = w.pairwise([[1, 2, 4], [0.5, 1, 2], [0.25, 0.5, 1]])
    assert got["consistent"] and abs(got["eigenvalue"] - 3) < 1e-9
    assert [round(x, 6) for x in got["weights"]] == [round(4 / 7, 6), round(2 / 7, 6), round(1 / 7, 6)]
    assert max(got["residuals"]) < 1e-9


@pytest.mark.parametrize("damp, want", [(0.0, 80.0), (100.0, 65.0)])
def test_saturation(spark, damp, want):
    p = spark.createDataFrame([(1, "A", 80.0), (1, "B", 80.0), (1, "P5", damp)], "id long, pillar string, score double")
    c = score.composite(p, spark.createDataFrame([("A", 0.6), ("B", 0.4)], "pillar string, weight double"), 0.15, "P5").first()
    assert math.isclose(c.score, want) and math.isclose(c.driver - c.penalty, c.score)


def test_missing_pillar_is_renormalised(spark):
    p = spark.createDataFrame([(1, "A", 80.0), (1, "B", None), (2, "A", None)], "id long, pillar string, score double")
    got = {r.id: r for r in score.composite(p, spark.createDataFrame([("A", 0.6), ("B", 0.4)], "pillar string, weight double"), 0.15, "P5", renormalise=True).collect()}
    assert math.isclose(got[1].score, 80.0) and got[1].coverage == 50.0 and got[2].score is None


def test_tiers_of_distinct_scores(spark):
    t = score.ranks_and_tiers(spark.range(1, 149).select("id", F.lit(1).alias("grp"), F.col("id").cast("double").alias("score")))
    n = {r.tier: r["count"] for r in t.groupBy("tier").count().collect()}
    assert n["TIER 1"] == 30 and n["TIER 4"] == 30


@pytest.mark.parametrize("edges", [[(3, 2), (2, 1)], [(2, 1), (3, 2)], [(3, 2), (2, 1), (4, 3)]])
def test_lineage_of_any_depth(spark, edges):
    v = spark.createDataFrame([(1, "x", 77.0), (2, "x", None), (3, "x", None), (4, "x", None)], "id long, indicator string, value double")
    got = {r.id: r for r in lineage.inherit(v, spark.createDataFrame(edges, "child long, parent long")).collect()}
    assert got[3].value == 77.0 and got[3].status == "INHERITED_FROM_2"
    assert got[4].value == (77.0 if len(edges) == 3 else None)


def test_lineage_with_a_cycle_and_without_values(spark):
    v = spark.createDataFrame([(1, "x", None), (2, "x", None)], "id long, indicator string, value double")
    got = lineage.inherit(v, spark.createDataFrame([(1, 2), (2, 1)], "child long, parent long"), 8).collect()
    assert {r.status for r in got} == {"MISSING"}


def test_trend(spark):
    s = spark.createDataFrame([(1, "x", 2011, 8.2), (1, "x", 2021, 9.6), (2, "x", 2011, 1.0)], "id long, indicator string, year int, value double")
    t = spark.createDataFrame([(1, "x", 2016), (1, "x", 2024), (2, "x", 2016)], "id long, indicator string, year int")
    got = {(r.id, r.year): r.value for r in impute.trend(s, t).collect()}
    assert math.isclose(got[1, 2016], 8.9) and math.isclose(got[1, 2024], 10.02) and got[2, 2016] is None


def test_cascade(spark):
    rows = [(1, 1, "x", 16.9, 1.0), (2, 1, "x", 19.9, 2.0), (3, 1, "x", None, 3.0), (4, 2, "x", None, 1.4), (5, 2, "x", None, None)]
    f = spark.createDataFrame(rows, "id long, grp long, indicator string, value double, covariate double")
    got = {r.id: (r.value, r.status) for r in impute.cascade(f, 1).collect()}
    assert math.isclose(got[3][0], 18.4) and got[3][1] == "IMPUTED_GROUP_MEAN"
    assert got[4] == (16.9, "IMPUTED_KNN") and got[5] == (None, "MISSING")


def test_nearest_breaks_ties_by_id(spark):
    rows = [(9, "x", 9.0, 5.0), (3, "x", 3.0, 5.0), (7, "x", 7.0, 5.0), (1, "x", None, 5.0), (2, "x", None, 6.0)]
    f = spark.createDataFrame(rows, "id long, indicator string, value double, covariate double")
    assert values(impute.nearest(f, 2), value="knn") == {1: 5.0, 2: 5.0}


def test_spearman(spark):
    df = spark.createDataFrame([(1.0, 10.0), (2.0, 100.0), (3.0, 1000.0)], "x double, y double")
    assert math.isclose(stats.spearman(df, "x", "y").first().spearman, 1.0)
    assert math.isclose(stats.spearman(df.select("x", (-F.col("y")).alias("y")), "x", "y").first().spearman, -1.0)


def test_kendall_with_ties(spark):
    df = spark.createDataFrame([("a", float(x), float(y)) for x, y in [(1, 1), (2, 1), (2, 3), (3, 2), (4, 4)]], "g string, x double, y double")
    assert math.isclose(concordance.kendall(df, "x", "y", ["g"]).first().tau, 6 / 9)



def test_name_normalisation(spark):
    df = spark.createDataFrame([("Y.S.R. Kadapa",), ("YSR  Kadapa District",), ("Ysr-Kàdapa",)], "n string")
    assert {r[0] for r in df.select(text.normalise_name(F.col("n"))).collect()} == {"ysr kadapa"}


def test_resolution(spark):
    dim = spark.createDataFrame([(1, "alpha", "g"), (2, "beta", "g"), (3, "beta", "h")], "id long, name string, grp string")
    ask = spark.createDataFrame([("alpha", "g"), ("beta", None), ("beta", "h"), ("alphaa", "g"), ("omega", "g"), ("old", "g")], "name string, hint string")
    al = spark.createDataFrame([("old", 2)], "alias string, id long")
    got = {(r.name, r.hint): (r.id, r.method) for r in resolve.resolve(ask, dim, al, threshold=0.8).collect()}
    assert got["alpha", "g"] == (1, "exact") and got["beta", "h"] == (3, "exact") and got["old", "g"] == (2, "alias")
    assert got["beta", None] == (None, "ambiguous") and got["alphaa", "g"] == (1, "fuzzy") and got["omega", "g"] == (None, "unmatched")


def test_resolution_hints_candidates_and_edges(spark):
    dim = spark.createDataFrame([(1, "north hill", "alpha state"), (2, "north hall", "alpha state"), (3, "river", "beta"), (4, "rivet", "gamma"), (5, "twin", "beta"), (6, "twin", "gamma")], "id long, name string, grp string")
    ask = [("river", "beta land"), ("xiver", None), ("twin", "delta"), ("twin", "gam"), ("north hell", "alpha"), ("old", "gamma"), ("old", "bet"), ("", None), ("riverr", "gamma"), ("riverr", "beta")]
    al = spark.createDataFrame([("old", 3, "historical", 0.9)], "alias string, id long, method string, confidence double")
    got = {(r.name, r.hint): r for r in resolve.resolve(spark.createDataFrame(ask, "name string, hint string"), dim, al, threshold=0.78).collect()}
    say = lambda *k: (got[k].id, got[k].method, got[k].candidates)
    assert say("river", "beta land") == (3, "exact", None) and say("xiver", None) == (3, "fuzzy", None)  # another first letter, no hint
    assert say("twin", "delta") == (None, "ambiguous", [5, 6]) and say("twin", "gam") == (6, "exact", None)
    assert say("north hell", "alpha") == (None, "ambiguous", [1, 2])  # both at 0.9
    assert say("old", "bet") == (3, "historical", None) and got["old", "bet"].confidence == 0.9
    assert say("old", "gamma") == (None, "unmatched", None) and say("", None) == (None, "unmatched", None)
    assert say("riverr", "beta") == (3, "fuzzy", None) and say("riverr", "gamma")[1] == "unmatched"


def slow_resolve(name, hint, dim, ratio, threshold=0.84, margin=0.03):
    """The cascade without aliases, entity by entity."""
    fits = lambda g: hint is None or hint in g or g in hint
    same = [d for d in dim if d[1] == name]
    if same:
        some = [d for d in same if fits(d[2])] or same
        return (some[0][0], "exact") if len(some) == 1 else (None, "ambiguous")
    scored = sorted(((ratio(name, d[1]), d[0]) for d in dim if fits(d[2])), reverse=True)
    if not scored or scored[0][0] < threshold:
        return None, "unmatched"
    close = [i for s, i in scored if scored[0][0] - s <= margin]
    return (close[0], "fuzzy") if len(close) == 1 else (None, "ambiguous")


def test_resolution_by_matching_blocks_loses_nobody(spark):
    from difflib import SequenceMatcher

    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcde") for _ in range(rnd.randint(1, 9)))
    dim = [(i, f"{word()} {word()}".strip(), rnd.choice(["g", "gh", "k"])) for i in range(150)]
    ask = set()
    for i, n, g in dim:
        t = list(n)
        for _ in range(rnd.randrange(3)):
            k = rnd.randrange(len(t) + 1)
            t[k : k + rnd.randrange(2)] = rnd.choice(["", "x", "a"])
        ask.add(("".join(t), rnd.choice([None, g, "g", "zz"])))
    rows = resolve.resolve(spark.createDataFrame(sorted(ask, key=str), "name string, hint string"), spark.createDataFrame(dim, "id long, name string, grp string"), similarity=text.sequence_ratio).collect()
    assert len(rows) == len(ask)
    for r in rows:
        assert (r.id, r.method) == slow_resolve(r.name, r.hint, dim, lambda a, b: SequenceMatcher(None, a, b).ratio()), r


def test_crosswalk_rows(spark):
    raw = spark.createDataFrame([("A-b", "7", "", None, "x"), ("a b", "8", "SPLIT", "0.5", "3"), ("c", "none", None, None, None)], "source string, id string, method string, confidence string, parent string").withColumn("n", F.monotonically_increasing_id())
    got = [tuple(r) for r in resolve.crosswalk(raw.withColumn("alias", F.col("source")), text.normalise_name(F.col("source")), F.col("n")).collect()]
    assert got == [("a b", 8, "split", 0.5, 3)]


def test_contained_names_wherever_they_stand(spark):
    rows = spark.createDataFrame([(1, "xxgoaxx"), (2, "Panaji, Goa"), (3, "none"), (4, None), (5, "a")], "row_id long, text string")
    dim = spark.createDataFrame([(10, "Goa", 2), (11, "naj", 1), (12, "a", 9), (13, "", 0), (14, "panaji, goa and more", 0)], "id long, name string, pos int")
    assert {r.row_id: r.id for r in resolve.first_contained(rows, dim).collect()} == {1: 10, 2: 11, 5: 12}


def test_header_names_and_values(spark):
    rows = [(["x", "District Fact She et", "Kolar", "Karnataka"], "/a/b.pdf"), (["District Fact Sheet", "Ministry of Health", "y"], "/a/S5_DistFact_Goa_North Goa__North Goa.pdf"), (["z"], "/a/DistFact_Kerala_Idukki.pdf"), (["z"], "/a/other.pdf")]
    h = text.header_names(F.col("lines"), F.col("path"), "District Fact Sheet", ["ministry", "survey"], "DistFact_")
    got = [(r.h.name, r.h.grp) for r in spark.createDataFrame(rows, "lines array<string>, path string").select(h.alias("h")).collect()]
    assert got == [("Kolar", "Karnataka"), ("North Goa", "Goa"), ("Idukki", "Kerala"), (None, None)]
    one = spark.range(1).select(text.unit_values(F.lit("5. Women (%) (12.5) 1,004")).alias("v"), text.trailing_number(F.lit("12. none")).alias("t")).first()
    assert (one.v.now, one.v.before, one.t) == (12.5, 1004.0, None)


def test_rounding_of_the_exact_value(spark):
    got = spark.createDataFrame([(2.675,), (0.5,), (1.5,), (2.5,), (None,), (1.0005,)], "x double").select(numeric.round_half_even(F.col("x"), 2).alias("a"), numeric.round_half_even(F.col("x"), 0).alias("b")).collect()
    assert [r.a for r in got] == [2.67, 0.5, 1.5, 2.5, None, 1.0] and [r.b for r in got] == [3.0, 0.0, 2.0, 2.0, None, 1.0]


def test_correlation_with_a_constant_is_null(spark):
    assert stats.spearman(spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double"), "x", "y").first().pearson is None


def test_geography_check_fails_when_numbers_differ(spark):
    dim = spark.createDataFrame([(1, "a"), (2, "b")], "id long, grp string")
    assert audit.geography_check(dim, 2, 2).first().passed
    with pytest.raises(Exception, match="2 ids, 2 groups"):
        audit.geography_check(dim, 3).collect()


def test_draws_repeat():
    a = sensitivity.lognormal_draws({"A": 0.5, "B": 0.5}, 10)
    assert a == sensitivity.lognormal_draws({"A": 0.5, "B": 0.5}, 10)
    assert all(math.isclose(sum(x for d, _, x in a if d == k), 1.0) for k in range(10))
    assert sensitivity.gauss_draws({"A": 0.5, "B": 0.5}, 3) == sensitivity.gauss_draws({"A": 0.5, "B": 0.5}, 3)


def test_entities_without_pillars_are_not_ranked(spark):
    p = spark.createDataFrame([(1, "A", 80.0), (2, "A", None)], "id long, pillar string, score double")
    d = sensitivity.draws_frame(spark, sensitivity.lognormal_draws({"A": 1.0}, 3))
    assert {r.id for r in sensitivity.draw_scores(p, d, 0.15, "P5").collect()} == {1}


def test_strict_ids(spark):
    dim = spark.createDataFrame([(560,)], "id long")
    good = spark.createDataFrame([("560",)], "id string")
    assert [r.id for r in quality.strict_ids(good, "id", dim).collect()] == [560]
    with pytest.raises(Exception, match="not an entity id"):
        quality.strict_ids(spark.createDataFrame([("SAMPLE-1",), ("560",)], "id string"), "id", dim).collect()


def test_gate_roll_up(spark):
    df = spark.range(3)
    g = quality.gate("a", df, F.count("*") == 3, F.count("*")).union(quality.gate("b", df, F.count("*") == 4, F.count("*")))
    assert tuple(quality.roll_up(g).first()) == (2, 1, 1, 1)


def test_keep_first_and_last(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, o int, v string")
    assert {(r.k, r.v) for r in sequence.keep_first(df, ["k"], F.col("o")).collect()} == {("a", "x"), ("b", "z")}
    assert {(r.k, r.v, r.n_rows) for r in sequence.keep_last(df, ["k"], F.col("o")).collect()} == {("a", "y", 2), ("b", "z", 1)}


def test_small_functions(spark):
    row = spark.range(1).select(
        numeric.per_100k(F.lit(3.0), F.lit(0.5)).alias("a"), numeric.rate_or_null(F.lit(3.0), F.lit(0.0)).alias("b"), numeric.mean_of_two(F.lit(2.0), F.lit(None).cast("double")).alias("c"),
        numeric.differs(F.lit(100.0), F.lit(102.0)).alias("d"), text.digits_number(F.lit("Rs 1,2.5")).alias("e"), text.alnum_lower(F.lit("A b-C")).alias("f"),
        numeric.missing_to_null(F.lit(float("nan"))).alias("g"), text.both_ways(F.lit("ab"), F.lit("xabx")).alias("h"),
    ).first()
    assert tuple(row) == (3.0, None, 2.0, True, 12.5, "abc", None, True)


def test_index_from_end_to_end(spark):
    from cairnspark.plans.index import build
    from cairnspark.sources.config import IndexConfig

    config = IndexConfig([("a", "A", "POSITIVE"), ("b", "B", "NEGATIVE"), ("c", "P5", "SATURATION_DAMPENER")], {"A": 2.0, "B": 1.0}, draws=20)
    rows = [(i, i % 2, k, float((i * m) % 13), float(i)) for i in range(12) for k, m in (("a", 3), ("b", 5), ("c", 7))]
    rows = [(i, g, k, None if (i, k) in {(3, "a"), (4, "b")} else v, c) for i, g, k, v, c in rows]
    f = spark.createDataFrame(rows, "id long, grp long, indicator string, value double, covariate double")
    got = build(f, config, spark.createDataFrame([(3, 5)], "child long, parent long"))
    assert got.scores.count() == 12 and got.stability.count() == 12
    status = {(r.id, r.indicator): r.status for r in got.cells.collect()}
    assert status[3, "a"] == "INHERITED_FROM_5" and status[4, "b"] == "IMPUTED_GROUP_MEAN" and status[0, "a"] == "OBSERVED"
    assert all(r.passed for r in got.gates.collect())
    assert sorted(r["rank"] for r in got.scores.collect())[0] == 1


def test_config(spark, tmp_path):
    from cairnspark.sources import config

    (tmp_path / "c.json").write_text('{"indicators": [{"id": "a", "pillar": "A"}], "weights": {"A": 1}, "cuts": [0.9, 0.5, 0.1]}')
    c = config.load(spark, str(tmp_path / "c.json"))
    assert c.indicators == [("a", "A", "POSITIVE")] and c.cuts == (0.9, 0.5, 0.1)
    with pytest.raises(ValueError, match="without weight"):
        config.IndexConfig([("a", "A", "POSITIVE")], {"B": 1.0})


def _stored(spark, folder, rows, schema):
    """As a file, of whose rows Spark's planner has an estimate (small, so it would be broadcast)."""
    spark.createDataFrame(rows, schema).write.parquet(str(folder))
    return spark.read.parquet(str(folder))


def test_pieces_of_texts_are_not_broadcast(spark, tmp_path, capsys):
    texts = _stored(spark, tmp_path / "t", [(1, "Large ring"), (2, "hot bolt"), (3, "Large ring"), (4, None)], "row_id long, text string")
    dim = _stored(spark, tmp_path / "d", [(7, "ring", 2), (8, "LARGE", 1), (9, "lt", 3)], "id long, name string, pos int")
    found = resolve.first_contained(texts, dim)
    assert sorted(map(tuple, found.collect())) == [(1, 8), (2, 9), (3, 8)]
    found.explain()
    assert "BroadcastHashJoin" not in capsys.readouterr().out


def test_names_and_entities_are_not_broadcast(spark, tmp_path, capsys):
    asked = _stored(spark, tmp_path / "a", [("red ring 1", "brand#1"), ("xed bolt 22", None), ("old one", None), ("zzz", None)], "name string, hint string")
    dim = _stored(spark, tmp_path / "d", [(1, "red ring 1", "brand#1"), (2, "red bolt 22", "brand#2"), (3, "one", "brand#1")], "id long, name string, grp string")
    aliases = _stored(spark, tmp_path / "l", [("old one", 3)], "alias string, id long")
    done = resolve.resolve(asked, dim, aliases)
    assert {r.name: (r.id, r.method) for r in done.collect()} == {"red ring 1": (1, "exact"), "xed bolt 22": (2, "fuzzy"), "old one": (3, "alias"), "zzz": (None, "unmatched")}
    done.explain()
    # but for the groups that fit a hint, which are few
    assert not [x for x in capsys.readouterr().out.splitlines() if "BroadcastHashJoin" in x and "h_#" not in x]


def test_names_within_a_margin_of_a_near_one(spark):
    """What one edit finds bounds the search, but a name with more edits that is within the margin still counts."""
    dim = spark.createDataFrame([(k, n, "") for k, n in enumerate(["abcdefghijklmnopqrst uvwxyz 01234567890123", "abcdefghijklmnopqrst uvwxyz 0123456789zz23", "something else"])], "id long, name string, grp string")
    asked = spark.createDataFrame([("Xbcdefghijklmnopqrst uvwxyz 01234567890123", None), ("abcdefghijklmnopqrst uvwxyz 0123456789QQ23Q", None)], "name string, hint string")
    for similarity in (text.edit_ratio, text.sequence_ratio):
        got = {r.name[0]: (r.method, r.candidates) for r in resolve.resolve(asked, dim, similarity=similarity, margin=0.08).collect()}
        assert got == {"X": ("ambiguous", [0, 1]), "a": ("ambiguous", [0, 1])}, got
