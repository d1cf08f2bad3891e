"""Resolving messy names onto a dimension: alias, then exact name, then the most similar name; nothing is dropped.

Different raw names are resolved once and joined back, so a name on a third of all rows costs one look-up. Similar names are found by
the indexes of ``similar``, first for one edit and then, for names that this leaves open, by segments inside the groups that fit the hint; entities whose group fits a hint, by
pieces of the group's name. So no name is compared with all entities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import edit_ratio
from . import similar
from .similar import large
from .stable import stable

#: Least similarity of a fuzzy match, and the lead over the second that makes it unambiguous.
THRESHOLD, MARGIN = 0.84, 0.03
#: Characters of a name by which texts that may contain it are found.
PIECE = 4


def last_alias(rows: DataFrame, order: Column) -> DataFrame:
    """One row for each alias: of several, the last in ``order`` (of equal ones the largest id)."""
    rest = [c for c in rows.columns if c != "alias"]
    return rows.groupBy("alias").agg(F.max_by(F.struct(*rest), F.struct(order, "id")).alias("r")).select("alias", "r.*")


def crosswalk(rows: DataFrame, name: Column, order: Column) -> DataFrame:
    """(alias, id, method, confidence, parent) of raw rows (alias, id[, method, confidence, parent]), all strings.

    A missing mapping type is alias, a missing confidence 1, a parent that is no number none. Rows without a whole id go; of several rows for an
    alias the last one counts. name: the normalised alias.
    """
    have = set(rows.columns)
    text = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) if c in have else F.lit(None).cast("string")
    x = rows.select(
        name.alias("alias"), text("id").try_cast("long").alias("id"), F.lower(F.coalesce(text("method"), F.lit("alias"))).alias("method"),
        F.coalesce(text("confidence").try_cast("double"), F.lit(1.0)).alias("confidence"), text("parent").try_cast("long").alias("parent"), order.alias("order_"),
    )
    return last_alias(x.where(F.col("id").isNotNull() & (F.col("alias") != "")), F.col("order_")).drop("order_")


def containing(texts: DataFrame, text: str, names: DataFrame, name: str) -> DataFrame:
    """Rows of texts beside the rows of names whose name the text contains, both as they are.

    Joined on the first PIECE characters of the name (all of a shorter one) against the pieces of the text. Empty names are contained in nothing.
    """
    size = F.least(F.length(name), F.lit(PIECE))
    keyed = names.where(F.length(name) > 0).withColumn("piece_", F.substring(F.col(name), F.lit(1), size))
    pieces = [F.expr(f"transform(sequence(1, greatest(1, length({text}) - {k - 1})), i -> substring({text}, i, {k}))") for k in range(1, PIECE + 1)]
    cut = texts.withColumn("piece_", F.explode(F.array_distinct(F.concat(*pieces))))
    return large(cut).join(large(keyed), "piece_").where(F.contains(F.col(text), F.col(name))).drop("piece_")


def similar_entities(asked: DataFrame, entity: DataFrame, fitting: DataFrame, similarity, threshold: float, margin: float) -> DataFrame:
    """(name, hint, id, grp, ratio): entities at least threshold - margin alike, among them all that can be the best one of an asked (name, hint) or within the margin of it.

    entity: (id, name, grp); fitting: (h_, g_), the groups that fit each hint. A name whose best fitting entity by one edit is so alike that nothing else can come within the margin with more is
    settled; the others are looked up in the segments of their groups, for what is as alike as that entity less the margin.
    """
    least, bound = threshold - margin, similar.Bound(similarity)
    named = entity.where("name <> ''").select("id", F.col("name").alias("d_name"), F.coalesce("grp", F.lit("")).alias("grp"))
    decided = lambda pairs: pairs.where(bound.may_reach(F.col("name"), F.col("d_name"), least)).withColumn("ratio", similarity(F.col("name"), F.col("d_name"))).where(F.col("ratio") >= least - 1e-9)
    in_group = F.col("hint").isNull() | (F.col("grp") == "") | F.col("g_").isNotNull()
    beside = lambda pairs, ask: ask.join(large(pairs), "name").join(large(named), "d_name").join(fitting.select("h_", "g_"), (F.col("hint") == F.col("h_")) & (F.col("grp") == F.col("g_")), "left").where(in_group).select("name", "hint", "id", "grp", "ratio")
    near = stable(beside(decided(similar.one_edit(asked.select("name").distinct(), named.select("d_name").distinct())), asked))
    top = near.groupBy("name", "hint").agg(F.max("ratio").alias("top")).where(F.col("top") >= threshold)
    settled = top.where(bound.most_edits(F.length("name"), F.col("top") - margin) <= 1).select(F.col("name").alias("n_"), F.col("hint").alias("h_"))
    same = (F.col("name") == F.col("n_")) & F.col("hint").eqNullSafe(F.col("h_"))
    best = top.select(F.col("name").alias("n_"), F.col("hint").alias("h_"), "top")
    floor = F.coalesce(F.greatest(F.col("top") - margin, F.lit(least)), F.lit(least)).alias("least_")
    rest = stable(asked.join(large(settled), same, "left_anti").join(large(best), same, "left").select("name", "hint", floor))
    # the groups a name is sought in: those that fit the hint and none, or everywhere; an entity is found in its own and everywhere
    fits = rest.join(fitting.select("h_", "g_"), F.col("hint") == F.col("h_")).select("name", "least_", F.concat(F.lit("g"), "g_").alias("group"))
    some = rest.where("hint is not null").select("name", "least_", F.lit("g").alias("group"))
    every = rest.where("hint is null").select("name", "least_", F.lit(similar.EVERYWHERE).alias("group"))
    sought = fits.unionByName(some).unionByName(every).groupBy("name", "group").agg(F.min("least_").alias("least_"))
    found = named.select("d_name", F.explode(F.array(F.concat(F.lit("g"), "grp"), F.lit(similar.EVERYWHERE))).alias("group")).distinct()
    more = beside(decided(similar.few_edits(sought, found, bound, least)), rest.select("name", "hint"))
    return near.join(large(settled), same, "left_semi").unionByName(more)


def resolve(names: DataFrame, dim: DataFrame, aliases: DataFrame | None = None, similarity=edit_ratio, threshold: float = THRESHOLD, margin: float = MARGIN) -> DataFrame:
    """(name, hint, id, method, confidence, candidates) for every different (name, hint) of names.

    names: normalised (name, hint), hint may be null; dim: (id, name, grp), normalised; aliases: (alias, id[, method, confidence]), one row each. A group fits a
    hint if either contains the other; no hint fits all. An alias counts if its entity's group fits. Then entities of that very name: those that fit, or all if
    none does; one is exact, more are ambiguous. Then the most similar fitting entity, from ``threshold`` on: ambiguous if others are
    within ``margin`` of it. candidates: the ids of an ambiguous name. An empty name is unmatched. similarity: the edit ratio, or one of the form 2 M / (a + b) of letters
    matched in order. The threshold less the margin may not be under 0.7.
    """
    if threshold - margin < 0.7:
        raise ValueError("names so different need not share a segment")
    ask = names.select("name", F.nullif("hint", F.lit("")).alias("hint")).distinct()
    if aliases is None:
        aliases = dim.select(F.col("name").alias("alias"), "id").limit(0)
    for c, default in (("method", F.lit("alias")), ("confidence", F.lit(1.0))):
        if c not in aliases.columns:
            aliases = aliases.withColumn(c, default)
    # groups that fit each hint
    hints, groups = ask.select("hint").distinct().where("hint is not null"), dim.select("grp").distinct().where("grp <> ''")
    fits = containing(hints, "hint", groups, "grp").unionByName(containing(groups, "grp", hints, "hint")).distinct()
    fitting = fits.select(F.col("hint").alias("h_"), F.col("grp").alias("g_"), F.lit(True).alias("fit_"))

    def with_fit(rows: DataFrame) -> DataFrame:
        """rows (hint, grp, ..) with fit_: whether the group fits."""
        x = rows.join(fitting, (F.col("hint") == F.col("h_")) & (F.col("grp") == F.col("g_")), "left").drop("h_", "g_")
        return x.withColumn("fit_", F.col("hint").isNull() | F.col("grp").isNull() | (F.col("grp") == "") | F.coalesce("fit_", F.lit(False)))

    entity = dim.select("id", "name", "grp")
    known = aliases.select(F.col("alias").alias("name"), "id", "method", "confidence").join(large(entity.select("id", "grp")), "id")
    by_alias = with_fit(ask.join(large(known), "name")).where("fit_").groupBy("name", "hint").agg(F.min(F.struct("id", "method", "confidence")).alias("a"))
    same = with_fit(ask.join(large(entity), "name")).groupBy("name", "hint").agg(F.sort_array(F.collect_list(F.when(F.col("fit_"), F.col("id")))).alias("fit"), F.sort_array(F.collect_list("id")).alias("every"))
    same = same.select("name", "hint", F.when(F.size("fit") > 0, F.col("fit")).otherwise(F.col("every")).alias("found"))

    def beside(left: DataFrame, right: DataFrame) -> DataFrame:
        r = right.withColumnsRenamed({"name": "n_", "hint": "h_"})
        return left.join(large(r), (F.col("name") == F.col("n_")) & F.col("hint").eqNullSafe(F.col("h_")), "left").drop("n_", "h_")

    two = beside(beside(ask, by_alias), same)
    open_ = two.where("a is null and found is null and name <> ''").select("name", "hint")
    scored = stable(similar_entities(stable(open_), entity, fitting, similarity, threshold, margin))
    top = scored.groupBy("name", "hint").agg(F.max("ratio").alias("top")).where(F.col("top") >= threshold)
    t = top.withColumnsRenamed({"name": "n_", "hint": "h_"})
    close = scored.join(large(t), (F.col("name") == F.col("n_")) & F.col("hint").eqNullSafe(F.col("h_"))).where(F.col("top") - F.col("ratio") <= margin)
    best = close.groupBy("name", "hint").agg(F.max("top").alias("top"), F.sort_array(F.collect_list("id")).alias("close"), F.max_by("id", "ratio").alias("f_id"))
    done = beside(two, best)
    method = (
        F.when(F.col("a").isNotNull(), F.col("a.method")).when(F.size("found") == 1, "exact").when(F.size("found") > 1, "ambiguous")
        .when(F.size("close") == 1, "fuzzy").when(F.size("close") > 1, "ambiguous").otherwise("unmatched")
    )
    done = done.withColumn("method", method)
    found = F.when(F.col("a").isNotNull(), F.col("a.id")).when(F.col("method") == "exact", F.element_at("found", 1)).when(F.col("method") == "fuzzy", F.col("f_id"))
    confidence = F.when(F.col("a").isNotNull(), F.col("a.confidence")).when(F.col("found").isNotNull(), 1.0).otherwise(F.coalesce("top", F.lit(0.0)))
    candidates = F.when(F.col("method") == "ambiguous", F.coalesce("found", "close"))
    return done.select("name", "hint", found.alias("id"), "method", confidence.alias("confidence"), candidates.alias("candidates"))


def listed_entities(dim: DataFrame, names: DataFrame, aliases: DataFrame | None = None, similarity=edit_ratio) -> DataFrame:
    """(id, flag): 1 for entities that a complete list names, resolved as above; all others are known not to be listed, 0."""
    hit = resolve(names, dim, aliases, similarity).where("id is not null").select("id").distinct().withColumn("flag", F.lit(1))
    return dim.select("id").join(hit, "id", "left").select("id", F.coalesce("flag", F.lit(0)).alias("flag"))


def by_prefix(rows: DataFrame, code: str, prefixes: DataFrame, size: int = 3) -> DataFrame:
    """rows with the id of the first ``size`` characters of the code; null for shorter codes and unknown prefixes. prefixes: (prefix, id), one row each."""
    key = F.when(F.length(code) >= size, F.substring(F.col(code), 1, size))
    return rows.withColumn("p_", key).join(prefixes.select(F.col("prefix").alias("p_"), "id"), "p_", "left").drop("p_")


def first_contained(rows: DataFrame, dim: DataFrame, text: str = "text", key: str = "row_id") -> DataFrame:
    """(key, id): the first entity, in the dimension's order, whose name the text contains, whatever stands around it. dim: (id, name, pos); case does not count."""
    texts = rows.select(key, F.lower(F.col(text)).alias("text_"))
    # a text on many rows is looked up once
    found = containing(texts.select("text_").distinct(), "text_", dim.select("id", F.lower("name").alias("name_"), "pos"), "name_")
    first = found.groupBy("text_").agg(F.min(F.struct("pos", "id")).alias("f_"))
    return texts.join(large(first), "text_").groupBy(key).agg(F.min("f_").alias("f_")).select(key, "f_.id")
