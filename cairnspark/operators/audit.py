"""Quality gates and audits of a run: every gate is a row, every entity, source row or cell of an audit keeps its row whether it passed or not."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of status a cell may have, by a part of its name (fixed values of the status vocabulary).
KNOWN = ("OBSERVED", "NATIVE", "INHERITED", "IMPUTED", "STRUCTURAL_ZERO", "UNAVAILABLE", "MISSING", "PROXY")


def cell_class(status: Column) -> Column:
    s = F.upper(status)
    observed = s.contains("OBSERVED") | s.contains("NATIVE")
    return F.when(observed, "OBSERVED").when(s.contains("INHERITED"), "INHERITED").when(s.contains("IMPUTED"), "IMPUTED").otherwise("OTHER")


def domain_error(indicator: Column, value: Column) -> Column:
    """Percentages lie in 0-100, densities and counts are not negative; a null is no error."""
    pct, size = indicator.contains("pct"), indicator.contains("density") | indicator.contains("count") | indicator.startswith("n_")
    return F.coalesce(F.when(pct, ~value.between(0, 100)).when(size, value < 0), F.lit(False))


def fifteen_gates(
    dim: DataFrame, raw: DataFrame, cells: DataFrame, scores: DataFrame, pillars: list[str], denominator: str, sources: DataFrame, dampener_source: str, inputs: list[str], targets: list[str], low: float = 0.0, high: float = 100.0
) -> DataFrame:
    """(gate_id, gate, passed, severity, metric): the gates of a run, one row each.

    dim: (id); raw and cells: (id, indicator, value), cells with status; scores: (id, score, a column for each pillar); sources: as of ``presence``;
    inputs, targets: names of model inputs and of what it is validated with. One aggregation for each frame; ids are compared by joins.
    """
    ids = dim.select("id").distinct()
    own = F.sum(F.when(F.col("in_dim").isNull(), 1).otherwise(0))
    mark = ids.withColumn("in_dim", F.lit(True))
    s = scores.groupBy("id").agg(
        F.count("*").alias("n"), F.count_if(F.col("score").isNull() | F.isnan("score")).alias("none"), F.count_if(F.abs("score") == float("inf")).alias("endless"), F.min("score").alias("lo"), F.max("score").alias("hi")
    )
    name = F.lower(F.col("id").cast("string"))
    placeholder = name.startswith("sample-") | name.contains("mock") | name.contains("placeholder")
    s = s.withColumn("placeholder_", placeholder).join(mark, "id", "full").agg(
        F.count("n").alias("s_ids"), F.count_if(F.col("n").isNotNull() & F.col("in_dim").isNull()).alias("s_unknown"), F.count_if(F.col("n").isNull()).alias("s_missing"),
        F.count_if("placeholder_").alias("s_placeholder"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("s_repeated"), F.coalesce(F.sum("none"), F.lit(0)).alias("s_none"),
        F.coalesce(F.sum("endless"), F.lit(0)).alias("s_endless"), F.min("lo").alias("s_lo"), F.max("hi").alias("s_hi"),
    )
    kind = cell_class(F.col("status"))
    unclear = reduce(lambda a, b: a & b, (~F.upper("status").contains(k) for k in KNOWN), F.lit(True))
    c = cells.groupBy("id").agg(
        F.count("*").alias("n"), *[F.count_if(kind == k.upper()).alias(k) for k in ("observed", "inherited", "imputed")],
        F.count_if(F.coalesce(unclear, F.lit(True))).alias("unclear"), F.count_if(domain_error(F.col("indicator"), F.col("value"))).alias("off"),
    )
    c = c.join(mark, "id", "left").agg(
        F.count("*").alias("c_ids"), own.alias("c_unknown"), *[F.coalesce(F.sum(k), F.lit(0)).alias(f"c_{k}") for k in ("n", "observed", "inherited", "imputed", "unclear", "off")]
    )
    have = raw.where((F.col("indicator") == denominator) & (F.col("value") > 0)).select("id").distinct()
    d = ids.join(have.withColumn("has_", F.lit(True)), "id", "left").agg(F.count("*").alias("d_ids"), F.count_if(F.col("has_").isNull()).alias("d_lost"))
    p = sources.agg(F.count_if(F.col("status") != "PRESENT").alias("p_missing"), F.coalesce(F.bool_or((F.col("source") == dampener_source) & (F.col("status") == "PRESENT")), F.lit(False)).alias("p_mode"))
    lost = [k for k in pillars if k not in scores.columns]
    leaked = sorted(set(inputs) & set(targets))
    g = F.col
    all_ = g("c_observed") + g("c_inherited") + g("c_imputed")
    # fixed values: the gates' numbers, names and severities
    rows = [
        ("canonical entities", (g("s_unknown") == 0) & (g("s_missing") == 0) & (g("s_ids") == g("d_ids")), "CRITICAL", g("s_ids")),
        ("no placeholder ids", g("s_placeholder") == 0, "CRITICAL", g("s_placeholder")),
        ("no unknown entity in the cells", g("c_unknown") == 0, "CRITICAL", g("c_unknown")),
        ("required sources", g("p_missing") == 0, "CRITICAL", g("p_missing")),
        ("coverage by known sources", (g("c_n") > 0) & (100.0 * all_ / F.nullif(g("c_n"), F.lit(0)) >= 99.9), "HIGH", F.round(100.0 * all_ / F.nullif(g("c_n"), F.lit(0)), 6)),
        ("no repeated entity", g("s_repeated") == 0, "CRITICAL", g("s_repeated")),
        ("units and domains", g("c_off") == 0, "HIGH", g("c_off")),
        ("score range", (g("s_none") == 0) & (g("s_endless") == 0) & (g("s_lo") >= low) & (g("s_hi") <= high), "CRITICAL", g("s_none") + g("s_endless")),
        ("denominators", g("d_lost") == 0, "CRITICAL", g("d_lost")),
        ("classified provenance", g("c_unclear") == 0, "HIGH", g("c_unclear")),
        ("all pillars", F.lit(not lost), "CRITICAL", F.lit(len(lost))),
        ("dampener's mode declared", F.lit(True), "INFO", g("p_mode").cast("int")),
        ("no silent fallback", all_ == g("c_n"), "HIGH", g("c_n") - all_),
        ("no target among the inputs", F.lit(not leaked), "INFO", F.lit(len(leaked))),
        ("provenance of every entity", g("c_ids") == g("d_ids"), "HIGH", g("c_ids")),
    ]
    cells_ = [F.struct(F.lit(f"GATE_{k:02d}").alias("gate_id"), F.lit(n).alias("gate"), F.coalesce(ok, F.lit(False)).alias("passed"), F.lit(sev).alias("severity"), m.cast("double").alias("metric")) for k, (n, ok, sev, m) in enumerate(rows, 1)]
    return s.crossJoin(F.broadcast(c)).crossJoin(F.broadcast(d)).crossJoin(F.broadcast(p)).select(F.inline(F.array(*cells_)))


def geography_audit(dim: DataFrame, lineage: DataFrame) -> DataFrame:
    """dim (id, name, grp) with is_child, parent_id and parent_name; lineage: (child, parent), one row for each child."""
    names = dim.select(F.col("id").alias("parent_id"), F.col("name").alias("parent_name"))
    x = dim.join(lineage.select(F.col("child").alias("id"), F.col("parent").alias("parent_id")), "id", "left").join(names, "parent_id", "left")
    return x.select("id", "name", "grp", F.col("parent_id").isNotNull().alias("is_child"), "parent_id", "parent_name")


def source_audit(dim: DataFrame, seen: DataFrame, lineage: DataFrame) -> DataFrame:
    """(id, name, grp, mapping, source_id, n_indicators, reason): whether a source has an entity itself, through its parent, or not.

    seen: (id, n): entities with a document of their own and how many indicators it gave.
    """
    own = seen.select("id", F.col("n").alias("own_"))
    parent = lineage.join(seen, F.col("parent") == F.col("id")).select(F.col("child").alias("id"), F.col("parent").alias("p_"), F.col("n").alias("pn_"))
    x = dim.join(own, "id", "left").join(parent, "id", "left")
    direct, inherited = F.col("own_").isNotNull(), F.col("p_").isNotNull()
    mapping = F.when(direct, "DIRECT_OBSERVED").when(inherited, "INHERITED_FROM_PARENT").otherwise("IMPUTED_GROUP_MEAN")
    reason = F.when(direct, "a document of its own").when(inherited, F.concat(F.lit("split off later: profile of parent "), F.col("p_").cast("string"))).otherwise("no document: mean of its group")
    source = F.when(direct, F.col("id")).otherwise(F.col("p_"))
    return x.select("id", "name", "grp", mapping.alias("mapping"), source.alias("source_id"), F.coalesce("own_", "pn_", F.lit(0)).cast("long").alias("n_indicators"), reason.alias("reason"))


def row_audit(rows: DataFrame, resolved: DataFrame, groups: DataFrame) -> DataFrame:
    """Every row of a facility table with its level and what became of it: matched, a group's total, or unresolved.

    rows: (name, hint, and figures); resolved: as of ``resolve``; groups: (grp), whose names stand for totals, as does any name with 'total'.
    """
    r = resolved.select(F.col("name").alias("n_"), F.col("hint").alias("h_"), "id", "method")
    x = rows.join(r, (F.col("name") == F.col("n_")) & F.col("hint").eqNullSafe(F.col("h_")), "left").drop("n_", "h_")
    total = groups.select(F.lower("grp").alias("t_"), F.lit(True).alias("is_group_")).distinct()
    x = x.join(total, F.lower("name") == F.col("t_"), "left").drop("t_")
    sum_row = F.coalesce(F.lower("name").contains("total"), F.lit(False)) | F.coalesce("is_group_", F.lit(False))
    status = F.when(F.col("id").isNotNull(), "MATCHED").when(sum_row, "GROUP_TOTAL_EXCLUDED").otherwise("UNRESOLVED")
    return x.select(*rows.columns, F.when(sum_row, "GROUP_TOTAL").otherwise("ENTITY").alias("level"), "id", status.alias("mapping"), F.when(F.col("id").isNotNull(), F.col("method")).otherwise("EXCLUDED").alias("method")).drop("is_group_")


def scope_audit(rows: DataFrame, resolved: DataFrame, scope: DataFrame) -> DataFrame:
    """Every record of a registry: out of scope by its group, matched, or unresolved, with a reason. rows: (name, hint, ..); scope: (grp), groups in scope."""
    r = resolved.select(F.col("name").alias("n_"), F.col("hint").alias("h_"), "id", "method")
    x = rows.join(r, (F.col("name") == F.col("n_")) & F.col("hint").eqNullSafe(F.col("h_")), "left").drop("n_", "h_")
    x = x.join(scope.select(F.col("grp").alias("hint"), F.lit(True).alias("in_")).distinct(), "hint", "left")
    inside = F.coalesce("in_", F.lit(False))
    mapping = F.when(~inside, "EXCLUDED_OUT_OF_SCOPE").when(F.col("id").isNotNull(), "MATCHED").otherwise("UNRESOLVED")
    reason = F.when(~inside, F.concat(F.lit("group outside the scope: "), F.coalesce("hint", F.lit("none")))).when(F.col("id").isNotNull(), F.concat(F.lit("matched as "), "method")).otherwise("split or unmatched spelling")
    return x.select(*rows.columns, F.when(inside, F.col("id")).alias("id"), mapping.alias("mapping"), reason.alias("reason"))


def mode_audit(dim: DataFrame, bulk: DataFrame) -> DataFrame:
    """dim with how a pillar that depends on a bulk source was made for each entity: observed where the source has it (bulk: (id)), else a calibrated proxy."""
    seen = bulk.select("id").distinct().withColumn("bulk_source", F.lit(True))
    x = dim.join(seen, "id", "left").withColumn("bulk_source", F.coalesce("bulk_source", F.lit(False)))
    return x.withColumn("mode", F.when(F.col("bulk_source"), "DIRECT_OBSERVED").otherwise("CALIBRATED_PROXY"))


def cell_audit(cells: DataFrame) -> DataFrame:
    """(id, indicator, value, status, class) of every cell."""
    k = cell_class(F.col("status"))
    return cells.select("id", "indicator", "value", "status", F.when(k == "OTHER", "PROXY").otherwise(k).alias("class"))


def geography_check(dim: DataFrame, n_ids: int | None = None, n_groups: int | None = None) -> DataFrame:
    """One row (n_ids, n_groups, repeated, passed); reading it fails if numbers are asked for and differ, or an id is repeated."""
    x = dim.agg(F.count_distinct("id").alias("n_ids"), F.count_distinct("grp").alias("n_groups"), (F.count("id") - F.count_distinct("id")).alias("repeated"))
    ok = F.col("repeated") == 0
    if n_ids is not None:
        ok = ok & (F.col("n_ids") == n_ids)
    if n_groups is not None:
        ok = ok & (F.col("n_groups") == n_groups)
    return x.withColumn("passed", F.when(ok, F.lit(True)).otherwise(F.raise_error(F.format_string("%d ids, %d groups, %d repeated", "n_ids", "n_groups", "repeated")).cast("boolean")))


def outcome_skeleton(dim: DataFrame, years: DataFrame, measures: dict[str, float]) -> DataFrame:
    """One row for each entity for outcomes that are not there yet: the year they are due (years: (id, year); an entity without one has no history), measures at their initial value, and flags that say so."""
    x = dim.join(years.select("id", "year"), "id", "left")
    flag = F.when(F.col("year").isNull(), "NO_HISTORY").otherwise("PENDING")
    return x.select("id", "name", "grp", "year", *[F.lit(float(v)).alias(k) for k, v in measures.items()], flag.alias("source_flag"), F.lit("STRUCTURE_ONLY").alias("provenance"))


def reconcile(ours: DataFrame, theirs: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """One row: two computations of (id, score, rank, tier) against each other, entities on one side only included."""
    a, b = ours.select("id", *[F.col(c).alias(f"a_{c}") for c in ("score", "rank", "tier")]), theirs.select("id", *[F.col(c).alias(f"b_{c}") for c in ("score", "rank", "tier")])
    x = a.join(b, "id", "full")
    d = F.abs(F.col("a_score") - F.col("b_score"))
    return x.agg(
        F.count("*").alias("n"), F.count_if(F.col("a_score").isNull() != F.col("b_score").isNull()).alias("one_sided"), F.max(d).alias("max_abs"), F.avg(d).alias("mean_abs"), F.sqrt(F.avg(d * d)).alias("rmse"),
        F.count_if(d > tolerance).alias("over"), F.count_if(F.col("a_rank") != F.col("b_rank")).alias("rank_differs"), F.count_if(F.col("a_tier") != F.col("b_tier")).alias("tier_differs"),
    )


def precision_trace(stages: dict[str, tuple[DataFrame, DataFrame]], key: list[str], value: str) -> DataFrame:
    """(stage, n, max_abs, mean_abs): what rounding costs after each stage; stages: name -> (unrounded frame, rounded frame), with ``key`` of which a frame has some."""
    out = None
    for k, (name, (a, b)) in enumerate(stages.items()):
        on = [c for c in key if c in a.columns and c in b.columns]
        d = F.abs(F.col("a_") - F.col("b_"))
        row = a.select(*on, F.col(value).alias("a_")).join(b.select(*on, F.col(value).alias("b_")), on).agg(F.count(d).alias("n"), F.max(d).alias("max_abs"), F.avg(d).alias("mean_abs"))
        row = row.select(F.lit(k).alias("step"), F.lit(name).alias("stage"), "n", "max_abs", "mean_abs")
        out = row if out is None else out.unionByName(row)
    return out
