"""Model variants side by side: ten specifications, how entities fare under them, what leaving a member out disturbs, and how variants agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import concordance, normalise, score, stats
from . import weights as w
from .order import with_rank
from .stable import stable

#: Shares of inclusion (percent) from which a member of a top list is invariant, highly or moderately robust, or sensitive; below, volatile.
BANDS = (("INVARIANT", 100.0), ("HIGH", 90.0), ("MODERATE", 70.0), ("SENSITIVE", 40.0))
#: Standard deviations of ranks up to which others are highly and moderately robust.
SPREADS = (("HIGH_MEMBER", 4.5), ("MODERATE_MEMBER", 8.0))


def _sums(kind: str, weights: dict[str, float], lam: float, dampener: str, geometric: bool = False) -> Column:
    """An entity's score over the rows (kind, pillar, score) of one kind, to be aggregated; weights of the drivers. An entity without rows of the kind has none: null, in place of a struct with the score."""
    own = F.col("kind") == kind
    at = F.try_element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("pillar"))
    drives = own & F.col("pillar").isin(*weights)
    damp = F.coalesce(F.max(F.when(own & (F.col("pillar") == dampener), F.col("score"))), F.lit(0.0))
    if geometric:
        score = F.exp(F.sum(F.when(drives, at * F.ln(F.col("score") + 1.0)))) * F.greatest(1.0 - F.lit(lam) * damp / 100.0, F.lit(0.0))
    else:
        score = F.sum(F.when(drives, at * F.col("score"))) - F.lit(lam) * damp
    return F.when(F.count_if(own) > 0, F.struct(score.alias("score")))


def _laid_out(frames: dict[str, DataFrame], variants: dict[str, Column], digits: int) -> DataFrame:
    """(variant, id, score) of all variants from one aggregation over frames (id, pillar, score) of each kind. A union of one aggregation for each variant would
    leave all variants of the same ids to one task."""
    rows = None
    for kind, f in frames.items():
        x = f.select(F.lit(kind).alias("kind"), "id", "pillar", "score")
        rows = x if rows is None else rows.unionByName(x)
    each = rows.groupBy("id").agg(*[c.alias(f"v{k}_") for k, c in enumerate(variants.values())])
    cells = F.array(*[F.when(F.col(f"v{k}_").isNotNull(), F.struct(F.lit(name).alias("variant"), F.round(F.col(f"v{k}_.score"), digits).alias("score"))) for k, name in enumerate(variants)])
    return each.select("id", F.inline(F.filter(cells, lambda c: c.isNotNull()))).select("variant", "id", "score")


def scaled(weights: dict[str, float], without: str | None = None) -> dict[str, float]:
    kept = {k: x for k, x in weights.items() if k != without}
    return {k: x / sum(kept.values()) for k, x in kept.items()}


def specifications(norm: DataFrame, names: DataFrame, weights: dict[str, float], lam: float, dampener: str, left_out: list[str], neutral: str, digits: int = 6) -> DataFrame:
    """(variant, id, score) of ten specifications.

    norm: (id, grp, indicator, value, norm); names: (indicator, pillar, direction). Base; equal pillars; equal indicators; robust scaling with its own entropy
    weights; no, low and high dampening; geometric; without the indicators in ``left_out``, weights recomputed; the pillar ``neutral`` without weight.
    """
    own = names.select("indicator", "pillar")

    def pillars(n: DataFrame) -> DataFrame:
        x = n.join(F.broadcast(own), "indicator")
        return stable(score.pillar_scores(n, w.entropy(x)).withColumn("score", F.round("score", 9)))

    base = pillars(norm)
    equal = stable(score.equal_pillar_scores(norm, own).withColumn("score", F.round("score", 9)))
    robust = pillars(normalise.robust_iqr(norm.select("id", "grp", "indicator", "value"), names.select("indicator", "direction")))
    fewer = pillars(norm.where(~F.col("indicator").isin(*left_out)))
    even = {k: 1.0 / len(weights) for k in weights}
    of = lambda kind, w, l=lam, **more: _sums(kind, w, l, dampener, **more)
    variants = {
        "V01_BASE": of("base", weights), "V02_EQUAL_PILLARS": of("base", even), "V03_EQUAL_INDICATORS": of("equal", weights), "V04_ROBUST_SCALING": of("robust", weights),
        "V05_NO_DAMPENER": of("base", weights, 0.0), "V06_LOW_DAMPENER": of("base", weights, 0.10), "V07_HIGH_DAMPENER": of("base", weights, 0.20), "V08_GEOMETRIC": of("base", weights, geometric=True),
        "V09_FEWER_INDICATORS": of("fewer", weights), "V10_NEUTRAL_PILLAR": of("base", scaled(weights, neutral)),
    }
    return stable(_laid_out({"base": base, "equal": equal, "robust": robust, "fewer": fewer}, variants, digits))


def inclusion(ranks: DataFrame, base: str, tops: tuple[int, ...] = (5, 10, 20, 30)) -> DataFrame:
    """(id, base_rank, topN_pct.., mean_rank, median_rank, std_rank, p05, p95, spread, class) over long (variant, id, rank).

    The class goes by the smallest of the last three lists that the base rank is in, by the share of variants with the entity in that list; others by the spread of ranks.
    """
    agg = ranks.groupBy("id").agg(
        F.max(F.when(F.col("variant") == base, F.col("rank"))).alias("base_rank"), *[(100.0 * F.avg((F.col("rank") <= n).cast("double"))).alias(f"top{n}_pct") for n in tops],
        F.avg("rank").alias("mean_rank"), F.percentile("rank", 0.5).alias("median_rank"), F.stddev_pop("rank").alias("std_rank"), F.percentile("rank", 0.05).alias("p05"),
        F.percentile("rank", 0.95).alias("p95"), (F.max("rank") - F.min("rank")).alias("spread"),
    )

    def band(n: int) -> Column:
        c = F.lit(f"VOLATILE_TOP{n}")
        for name, least in reversed(BANDS):
            c = F.when(F.col(f"top{n}_pct") >= least, f"{name}_TOP{n}").otherwise(c)
        return c

    label = F.lit("SPECIFICATION_SENSITIVE")
    for name, most in reversed(SPREADS):
        label = F.when(F.col("std_rank") <= most, name).otherwise(label)
    for n in sorted(tops[-3:], reverse=True):
        label = F.when(F.col("base_rank") <= n, band(n)).otherwise(label)
    return agg.withColumn("class", label)


def recount(rows: DataFrame, top: int = 10, spread: int = 5) -> DataFrame:
    """One row: how many entities are in each band of inclusion of a top list, and how many move by ``spread`` ranks at most. rows: as of ``inclusion``."""
    p = F.col(f"top{top}_pct")
    return rows.agg(F.count("*").alias("n"), F.count_if(p == 100).alias("invariant"), F.count_if((p >= 90) & (p < 100)).alias("high"), F.count_if((p >= 70) & (p < 90)).alias("moderate"), F.count_if(F.col("spread") <= spread).alias("steady"))


def agreement(ranks: DataFrame, base: str, tops: tuple[int, ...] = (10, 20), tau: bool = True) -> DataFrame:
    """(variant, spearman, disruption, tau, topN_overlap..) of each other variant's scores against the base's. ranks: (variant, id, score, rank)."""
    b = ranks.where(F.col("variant") == base).select("id", F.col("score").alias("b_"), F.col("rank").alias("br_"))
    both = stable(ranks.where(F.col("variant") != base).join(b, "id"))
    x = with_rank(with_rank(both, "score", "ra_", ["variant"], ties="average"), "b_", "rb_", ["variant"], ties="average")
    m = x.groupBy("variant").agg(F.corr("ra_", "rb_").alias("spearman"), *[F.count_if((F.col("rank") <= n) & (F.col("br_") <= n)).alias(f"top{n}_overlap") for n in tops])
    m = m.withColumn("disruption", 1.0 - F.col("spearman"))
    return m.join(concordance.kendall(both, "score", "b_", ["variant"]).select("variant", "tau"), "variant") if tau else m


def without_each_indicator(norm: DataFrame, names: DataFrame, weights: dict[str, float], lam: float, dampener: str, digits: int = 6) -> DataFrame:
    """(variant, id, score): the composite without each indicator in turn, entropy weights of its pillar made to sum to one again; a pillar without any counts as 0.

    An indicator's divergence does not depend on the others, so all variants come from one set of weights; indicators x indicators is the table that is broadcast.
    """
    own = names.select("indicator", "pillar")
    e = w.entropy(norm.join(F.broadcast(own), "indicator")).select("pillar", "indicator", "weight")
    out = e.select(F.col("indicator").alias("variant"), F.col("pillar").alias("out_pillar"))
    grid = e.crossJoin(F.broadcast(out)).where("indicator <> variant")
    share = F.sum("weight").over(Window.partitionBy("variant", "pillar"))
    per = F.create_map(*[F.lit(x) for kv in {**weights, dampener: -lam}.items() for x in kv])
    grid = grid.select("variant", "indicator", (F.col("weight") / share * F.try_element_at(per, F.col("pillar"))).alias("k"))
    x = norm.select("id", "indicator", "norm").join(F.broadcast(grid), "indicator")
    return stable(x.groupBy("variant", "id").agg(F.round(F.sum(F.col("k") * F.col("norm")), digits).alias("score")))


def comparison(base: DataFrame, others: dict[str, DataFrame]) -> DataFrame:
    """base (id, score, rank, ..) beside the rank that each other model gives. others: name -> (id, rank)."""
    out = base
    for name, f in others.items():
        out = out.join(f.select("id", F.col("rank").alias(f"{name}_rank")), "id")
    return out


def rank_intervals(ranks: DataFrame, digits: int = 0) -> DataFrame:
    """(id, mean_rank, std_rank, interval_95, interval_90) over draws: percentiles of ranks, rounded and printed as [#a, #b]."""
    q = F.percentile("rank", F.array(*[F.lit(x) for x in (0.025, 0.05, 0.95, 0.975)]))
    x = ranks.groupBy("id").agg(F.avg("rank").alias("mean_rank"), F.stddev_pop("rank").alias("std_rank"), q.alias("q"))
    return printed_intervals(x.select("id", "mean_rank", "std_rank", *[F.col("q")[k].alias(c) for k, c in enumerate(("p025", "p05", "p95", "p975"))]), digits)


def printed_intervals(x: DataFrame, digits: int = 0) -> DataFrame:
    """As ``rank_intervals``, of rows with mean_rank, std_rank, p025, p05, p95 and p975."""
    say = lambda a, b: F.format_string("[#%d, #%d]", F.round(F.round(a, 6), digits).cast("long"), F.round(F.round(b, 6), digits).cast("long"))
    return x.select("id", "mean_rank", "std_rank", say("p025", "p975").alias("interval_95"), say("p05", "p95").alias("interval_90"))


def scenario_agreement(wide: DataFrame, base: str, others: list[str], least: float = 0.95) -> DataFrame:
    """(comparison, spearman, verdict) of a base scenario's column with the others'."""
    out = None
    for c in others:
        r = stats.spearman(wide, base, c).select(F.lit(f"{base} vs {c}").alias("comparison"), "spearman", F.when(F.col("spearman") > least, "INVARIANT").otherwise("SENSITIVE").alias("verdict"))
        out = r if out is None else out.unionByName(r)
    return out


def circularity(wide: DataFrame, covariates: list[str], targets: list[str], built_in: list[str]) -> DataFrame:
    """(covariate, target, pearson, spearman, risk): how far each covariate tells each target; a covariate that hardly varies has 0.

    risk: HIGH for covariates the target was made from, else MODERATE from a correlation of 0.7 on, else LOW.
    """
    out = None
    for c in covariates:
        flat = wide.agg((F.coalesce(F.stddev_pop(c), F.lit(0.0)) <= 1e-6).alias("flat"))
        for t in targets:
            r = stats.spearman(wide, c, t).crossJoin(F.broadcast(flat))
            r = r.select(F.lit(c).alias("covariate"), F.lit(t).alias("target"), *[F.when(F.col("flat"), 0.0).otherwise(F.coalesce(k, F.lit(0.0))).alias(k) for k in ("pearson", "spearman")])
            out = r if out is None else out.unionByName(r)
    risk = F.when(F.col("covariate").isin(*built_in), "HIGH").when(F.abs("pearson") >= 0.7, "MODERATE").otherwise("LOW")
    return out.withColumn("risk", risk)


def fold_summary(folds: DataFrame, columns: list[str], label: str = "fold") -> DataFrame:
    """The rows of folds and below them their mean, median and population standard deviation."""
    parts = [("MEAN", F.avg), ("MEDIAN", lambda c: F.percentile(c, 0.5)), ("STD_DEV", F.stddev_pop)]
    out = folds.select(F.col(label).cast("string").alias(label), *columns)
    for name, f in parts:
        out = out.unionByName(folds.agg(*[f(c).alias(c) for c in columns]).select(F.lit(name).alias(label), *columns))
    return out


def master(base: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """base joined with each part by id; entities that any part lacks are not in it."""
    out = base
    for p in parts:
        out = out.join(p, "id")
    return out


def truncated_and_rounded(df: DataFrame, value: str, by: list[str], p: float) -> DataFrame:
    """(by, exact, truncated, rounded): a percentile (of six decimals, which hides errors of interpolation) as a whole number, cut towards zero and rounded half to even."""
    q = df.groupBy(*by).agg(F.round(F.percentile(value, p), 6).alias("exact"))
    return cut_and_rounded(q, by)


def cut_and_rounded(q: DataFrame, by: list[str]) -> DataFrame:
    """q (by, exact) with exact cut towards zero and rounded half to even."""
    return q.select(*by, "exact", F.col("exact").cast("long").alias("truncated"), F.bround("exact", 0).cast("long").alias("rounded"))


#: Scalings whose effect is taken apart from that of the weights they lead to; the first is the base.
SCALINGS = {"MINMAX": normalise.minmax, "ROBUST_IQR": normalise.robust_iqr, "PERCENTILE_RANK": normalise.percentile_rank, "WINSORISED": normalise.winsorised}


def scaling_effects(filled: DataFrame, names: DataFrame, weights: DataFrame, lam: float, dampener: str, digits: int = 6) -> DataFrame:
    """(variant, id, score, rank): composites under each scaling, with the base's entropy weights (<scaling>_FIXED) and with those that the scaling itself leads to (<scaling>_RECOMPUTED).

    filled: (id, indicator, value) after imputation, a null value counts as 50 on every scale; names: (indicator, pillar, direction); weights: (pillar, weight). Against the base (MINMAX_FIXED, see ``agreement``) the first kind
    shows what the scale does, the second what the scale and its weights do.
    """
    own = F.broadcast(names.select("indicator", "pillar"))
    frames, base = {}, None
    for name, scale in SCALINGS.items():
        norm = scale(filled.select("id", "indicator", "value"), names).withColumn("norm", F.coalesce("norm", F.lit(50.0)))
        norm = stable(norm.select("id", "indicator", "norm"))
        mine = stable(w.entropy(norm.join(own, "indicator")))
        base = mine if base is None else base
        both = base.select("pillar", "indicator", F.lit("FIXED").alias("kind"), "weight").unionByName(mine.select("pillar", "indicator", F.lit("RECOMPUTED").alias("kind"), "weight"))
        x = norm.join(F.broadcast(both), "indicator").groupBy("id", "pillar", "kind").agg(F.sum(F.col("weight") * F.col("norm")).alias("score"))
        x = stable(x)
        frames |= {f"{name}_{kind}": x.where(F.col("kind") == kind) for kind in ("FIXED", "RECOMPUTED")}
    given = {r.pillar: r.weight for r in weights.collect()}
    variants = {name: _sums(name, given, lam, dampener) for name in frames}
    return with_rank(stable(_laid_out(frames, variants, digits)), "score", by=["variant"])
