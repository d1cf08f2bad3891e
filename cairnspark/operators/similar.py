"""Names that are similar, without comparing every name with every other.

How alike two names may be bounds the edits between them. Two indexes are built on that bound, from which no pair within it is missing:

* At most one edit: a name cut into ``PIECES`` pieces agrees with the other in all but one of them, so both are joined by what is left of them without a piece. Names of
  one vocabulary seldom agree in so much.
* At most t edits: names of a group are kept as trees of their prefixes, in blocks, and a name is sought in the blocks that hold prefixes it can still come near to. Names of one vocabulary share long
  prefixes, so that few are looked at for each name; whole segments that two names share, on which they could be joined, would be the same in most of them.

Callers look for one edit first, and for more only where that leaves the question open.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import edit_ratio
from .prefix_tree import PrefixTree

#: Pieces of a name in the index for one edit.
PIECES = 8
#: The group key of names that are sought in all groups.
EVERYWHERE = "*"
#: First letters that names are dealt to blocks by, the most such beginnings, and names of a block (more where they begin alike).
LETTERS, PREFIXES, BLOCK = (1, 2, 3, 4, 6, 8, 10, 12, 16, 24, 32), 20_000, 10_000


def large(df: DataFrame) -> DataFrame:
    """df, never broadcast in a join: Spark's estimate of a small compressed file knows nothing of the rows that ``explode`` makes of it."""
    return df.hint("merge")


class Bound:
    """How many edits, and which lengths, a similarity of at least r leaves to names of given lengths.

    In the edit ratio, distance = (1 - ratio) * longer length. For ratios of matched letters in order (2 M / (a + b)), what is not matched is deleted or inserted, which
    are a + b - 2 M edits.
    """

    def __init__(self, similarity: Callable):
        self.by_longer = similarity is edit_ratio

    def edits(self, a: Column, b: Column, r: float | Column) -> Column:
        size = F.greatest(a, b) if self.by_longer else a + b
        # a hair more than the bound, for ratios that are not exact
        return F.floor((1.0 - r) * size + 1e-6).cast("int")

    def longest(self, a: Column, r: float | Column) -> Column:
        """The longest other name."""
        return F.floor((a / r if self.by_longer else a * (2.0 - r) / r) + 1e-6).cast("int")

    def shortest(self, a: Column, r: float | Column) -> Column:
        return F.greatest(F.lit(1), F.ceil((a * r if self.by_longer else a * r / (2.0 - r)) - 1e-6).cast("int"))

    def most_edits(self, a: Column, r: float | Column) -> Column:
        """Edits to any name that is at least r alike."""
        return self.edits(a, self.longest(a, r), r)

    def may_reach(self, a: Column, b: Column, r: float) -> Column:
        """Whether the edit distance leaves the names a ratio of r; a cheap test ahead of a dear ratio."""
        most = self.edits(F.length(a), F.length(b), r)
        return F.lit(True) if self.by_longer else F.call_function("levenshtein", a, b, most) >= 0


def one_edit(asked: DataFrame, known: DataFrame) -> DataFrame:
    """(name, d_name): all pairs of at most one edit. asked: (name); known: (d_name); both without repeats and empty names."""
    piece = f"struct(i as i, cast(floor(i * size_ / {PIECES}) as int) as a, cast(floor((i + 1) * size_ / {PIECES}) as int) as b)"
    cut = f"explode(filter(transform(sequence(0, {PIECES - 1}), i -> {piece}), p -> p.a < p.b)) as cut_"
    index = known.withColumn("size_", F.length("d_name")).select("d_name", "size_", F.expr(cut))
    left = F.xxhash64("size_", "cut_.i", F.expr("substring(d_name, 1, cut_.a)"), F.expr("substring(d_name, cut_.b + 1, size_ - cut_.b)"))
    index = index.select("d_name", left.alias("key_"))
    probe = asked.withColumn("own_", F.length("name")).select("name", "own_", F.expr("explode(filter(sequence(own_ - 1, own_ + 1), x -> x > 0)) as size_")).select("name", "own_", "size_", F.expr(cut))
    probe = probe.where("cut_.a + size_ - cut_.b <= own_")
    left = F.xxhash64("size_", "cut_.i", F.expr("substring(name, 1, cut_.a)"), F.expr("substring(name, own_ - (size_ - cut_.b) + 1, size_ - cut_.b)"))
    return probe.select("name", left.alias("key_")).join(large(index), "key_").where(F.call_function("levenshtein", F.col("name"), F.col("d_name"), F.lit(1)) >= 0).select("name", "d_name").distinct()


def few_edits(asked: DataFrame, known: DataFrame, bound: Bound, r: float) -> DataFrame:
    """(name, d_name): pairs of a name and one of its group that are at least ``least_`` alike by the bound of their edits.

    asked: (name, group[, least_]), a row for each group a name is sought in, least_ from r on (r itself if there is none); known: (d_name, group), a row for each group a name is found in.
    A group's names are dealt to blocks by their first letters, whose table (``PREFIXES`` rows at most) tells in which blocks an asked name may find one; there it is sought in the tree of prefixes.
    """
    if "least_" not in asked.columns:
        asked = asked.withColumn("least_", F.lit(r))
    known = known.select("d_name", "group").distinct()
    ends = known.agg(F.count("*").alias("n"), *[F.approx_count_distinct(F.struct("group", F.substring("d_name", 1, k))).alias(f"k{k}") for k in LETTERS]).first()
    # the longest beginnings of which there are few; none where groups alone are many
    letters = max((k for k in LETTERS if ends[f"k{k}"] <= min(PREFIXES, ends.n // 10)), default=0)
    begin = F.substring("d_name", 1, letters)
    counted = known.groupBy("group", begin.alias("begin_")).agg(F.count("*").alias("n"), F.max(F.length("d_name")).cast("int").alias("longest"))
    by_longer, spark = bound.by_longer, known.sparkSession
    if not letters:
        routed, dealt = asked.select("name", "group", "least_", F.lit(0).alias("block_")), known.withColumn("block_", F.lit(0))
    else:
        begins: dict[str, list] = {}
        for x in sorted(counted.collect()):
            begins.setdefault(x.group, []).append((x.begin_, x.longest, x.n))
        block = {g: ((np.cumsum([n for *_, n in rows]) - 1) // BLOCK).tolist() for g, rows in begins.items()}
        table = spark.createDataFrame([(g, b, k) for g, rows in begins.items() for (b, *_), k in zip(rows, block[g])], "group string, begin_ string, block_ int")
        dealt = known.withColumn("begin_", begin).join(F.broadcast(table), ["group", "begin_"])

        def route(batches):
            trees: dict[str, PrefixTree] = {}
            for pdf in batches:
                for group, own in pdf.groupby("group"):
                    if group not in begins:
                        continue
                    if group not in trees:
                        trees[group] = PrefixTree([b for b, *_ in begins[group]], np.array([m for _, m, _ in begins[group]]))
                    of = np.array(block[group])
                    for q, b in trees[group].near(own["name"].tolist(), own["least_"].to_numpy(), by_longer, begins=True):
                        q, k = np.unique(np.stack([q, of[b]]), axis=1)
                        yield own.iloc[q].assign(block_=k)

        routed = asked.select("name", "group", "least_").mapInPandas(route, "name string, group string, least_ double, block_ int").distinct()

    def sought(asks: pd.DataFrame, names: pd.DataFrame) -> pd.DataFrame:
        mine, theirs, out = asks["name"].tolist(), sorted(names["d_name"].tolist()), []
        if mine and theirs:
            out = [(mine[i], theirs[j]) for q, n in PrefixTree(theirs).near(mine, asks["least_"].to_numpy(), by_longer) for i, j in zip(q.tolist(), n.tolist())]
        return pd.DataFrame(out, columns=["name", "d_name"])

    pairs = routed.groupBy("group", "block_").cogroup(dealt.select("d_name", "group", "block_").groupBy("group", "block_"))
    return pairs.applyInPandas(sought, "name string, d_name string").distinct()
