"""Variants and draws without a row shuffled for each variant or draw and entity."""

import numpy as np
from pyspark.sql import functions as F

from cairnspark.operators import rank_histograms, robustness, sensitivity
from cairnspark.operators.stable import stable


def _random_pillars(spark, n):
    rng = np.random.RandomState(8)
    rows = [(i, p, float(rng.randint(0, 40))) for i in range(n) for p in ("P1", "P2", "P5") if (i + len(p)) % 9 or p == "P1"]
    return stable(spark.createDataFrame(rows, "id long, pillar string, score double"))


def test_agreement_of_draws_by_blocks_and_without_rows_of_draws(spark, monkeypatch):
    """Equal to the sums over a row for each draw and entity, which are not made; many ties, several buckets and blocks."""
    p, w = _random_pillars(spark, 500), {"P1": 0.6, "P2": 0.4}
    draws = sensitivity.draws_frame(spark, sensitivity.lognormal_draws(w, 7))
    base = sensitivity.draw_scores(p, sensitivity.draws_frame(spark, [(0, k, x) for k, x in w.items()]), 0.15, "P5").select("id", F.round("score", 6).alias("score"))
    want = sensitivity.draw_agreement(sensitivity.draw_ranks(sensitivity.draw_scores(p, draws, 0.15, "P5"), 6), stable(base)).toPandas().sort_values("draw")
    monkeypatch.setattr(rank_histograms, "CELLS", 1500)
    got = rank_histograms.agreement(p, draws, w, 0.15, "P5", 6, bucket=60).toPandas().sort_values("draw")
    assert got.draw.tolist() == want.draw.tolist() == list(range(7))
    assert np.allclose(got.spearman, want.spearman, atol=1e-12) and np.allclose(got.top_overlap, want.top_overlap)


def test_noisy_scores_are_those_of_single_cells(spark):
    names, own, w = ["a", "b", "c"], {"a": "P1", "b": "P1", "c": "P5"}, {"P1": 1.0}
    rows = [(i, 0, k, float((7 * i + j) % 101), ("OBSERVED", "IMPUTED_X", "MISSING")[(i + j) % 3]) for i in range(60) for j, k in enumerate(names) if (i + j) % 11 or k == "c"]
    fact = spark.createDataFrame(rows, "id long, grp int, indicator string, norm double, status string")
    n = sensitivity.imputation_noise(fact, 9, {"IMPUTED": 5.0, "MISSING": 2.0}, names).toPandas()
    n["pillar"] = n.indicator.map(own)
    m = n.groupby(["draw", "id", "pillar"]).norm.mean().unstack()
    want = (m.P1.fillna(0.0) - 0.15 * m.P5).unstack("draw")
    frame = sensitivity.noisy_scores(fact, own, 9, {"IMPUTED": 5.0, "MISSING": 2.0}, names, w, 0.15, "P5")
    got = {r.id: r.x for r in frame.collect()}
    assert all(np.allclose(got[i], want.loc[i], atol=2e-9) for i in want.index) and len(got) == len(want)
    assert frame._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange") == 1  # of cells, not of draws
    s = rank_histograms.score_statistics(frame, 9, bucket=20).toPandas().set_index("id")
    ranks = want.round(9).rank(ascending=False, method="min")
    assert np.allclose(s.mean_rank.loc[want.index], ranks.mean(axis=1)) and np.allclose(s.p95.loc[want.index], ranks.quantile(0.95, axis=1))


def test_variants_come_from_one_aggregation(spark, monkeypatch):
    """A union of aggregations by id left all variants to one task."""
    plans = []
    real = robustness.stable
    monkeypatch.setattr(robustness, "stable", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df))
    norm = spark.createDataFrame([(i, 0, k, float(i * (j + 3) % 17)) for i in range(40) for j, k in enumerate("abcd")], "id long, grp int, indicator string, norm double").withColumn("value", F.col("norm"))
    names = spark.createDataFrame([("a", "P1", "POSITIVE"), ("b", "P2", "POSITIVE"), ("c", "P2", "NEGATIVE"), ("d", "P5", "POSITIVE")], "indicator string, pillar string, direction string")
    out = robustness.specifications(norm, names, {"P1": 0.6, "P2": 0.4}, 0.15, "P5", ["c"], "P2")
    assert out.groupBy("variant").count().where("count = 40").count() == 10
    assert plans[-1].count("Aggregate [") == 1


def test_few_edits_gives_only_pairs_within_the_bound(spark):
    """By trees in many blocks: all pairs of brute force and no others, where most names share long segments."""
    from unittest import mock

    from cairnspark.functions import text
    from cairnspark.operators import similar

    names = sorted({f"{c} {n} {k * 37 % 1009}" for k in range(400) for c, n in ((("red", "ring"), ("old", "gear"))[k % 2],)} | {"r", "red", "zzé"})
    asked = sorted({"q" + n[1:] for n in names[::9]} | {n + "x" for n in names[::7]} | {"zz" + n[::-1] for n in names[::11]} | {"s"})
    known = spark.createDataFrame([(n, g) for k, n in enumerate(names) for g in ("*", f"g{k % 3}")], "d_name string, group string")
    ask = spark.createDataFrame([(n, ("*", "g1", "none")[k % 3], 0.81 + 0.02 * (k % 4)) for k, n in enumerate(asked)], "name string, group string, least_ double")
    groups = {"*": names, "g1": names[1::3], "none": []}

    def edits(a, b, replaced):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + replaced * (x != y))
        return row[-1]

    for measure, replaced, size in ((text.edit_ratio, 1, lambda a, b: max(len(a), len(b))), (text.sequence_ratio, 2, lambda a, b: len(a) + len(b))):
        want = {(a.name, b) for a in ask.collect() for b in groups[a.group] if edits(a.name, b, replaced) <= (1 - a.least_) * size(a.name, b) + 1e-6}
        with mock.patch.multiple(similar, PREFIXES=60, BLOCK=20):
            got = [tuple(r) for r in similar.few_edits(ask, known, similar.Bound(measure), 0.81).collect()]
        assert len(want) > 50 and len(got) == len(set(got)) and set(got) == want


def test_ranks_are_sent_in_a_byte_each():
    """Packed ranks of a block in one bucket, at a 60th of its entities: about the bits that their differences have, and the same when read."""
    import numpy as np

    from cairnspark.operators import rank_histograms

    counts = np.full(20, 300)
    ranks = np.concatenate([np.sort(np.random.default_rng(k).integers(0, 300 * 60, 300)) for k in range(20)])
    base, width, packed = rank_histograms._packed(ranks, counts)
    assert len(base) + len(packed) <= 1.25 * len(ranks)
    assert (rank_histograms._unpacked(base, width, packed, counts) == ranks).all()


def test_buckets_get_entities_once_for_many_draws(spark):
    """What a bucket is sent: pillar scores of an entity, not a score for each draw; the ranks are those of plain sorting, with draws in any order."""
    from unittest import mock

    import numpy as np

    from cairnspark.operators import rank_histograms

    r = np.random.default_rng(7)
    x = np.round(r.random((400, 3)) * 20, 1)
    w = r.dirichlet([5, 3], 500)
    pillars = spark.createDataFrame([(k, p, float(x[k, c])) for k in range(400) for c, p in enumerate("ABD")], "id long, pillar string, score double")
    draws = spark.createDataFrame([(d, p, float(w[d, c])) for d in range(500) for c, p in enumerate("AB")], "draw int, pillar string, weight double")
    with mock.patch.multiple(rank_histograms, CELLS=20_000, HELD=60_000):
        df = rank_histograms.rank_statistics(pillars, draws, 0.15, "D", 6, bucket=60)
        got = {k.id: k for k in df.collect()}
    s = np.rint((x[:, :1] * w[:, 0] + x[:, 1:2] * w[:, 1] - 0.15 * x[:, 2:]) * 1e6)
    ranks = np.array([1 + (s > row).sum(axis=0) for row in s])
    assert len(got) == 400 and all(abs(got[k].mean_rank - ranks[k].mean()) < 1e-9 and (got[k].best, got[k].worst) == (ranks[k].min(), ranks[k].max()) for k in range(400))
