"""Shuffled folds of equal size, from a seed.

Rows are numbered in the order of a key, by buckets and their offsets. A keyed permutation of 0 .. n - 1 then says where each row stands in the shuffle; nothing is sorted by a random number, and any row's fold follows from
its number alone. The permutation is a Feistel network on pairs (a, b) of a grid that is at most one row of cells larger than n; what falls outside is permuted again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keyed import constants, step
from .order import row_numbers

#: Rounds of the network, and times that a position may fall outside. Fewer cells are outside than a side of the grid has, so for a side of up to WALK that is exact, and beyond it happens once in WALK^WALK rows.
ROUNDS, WALK = 6, 40


def permuted(position: Column, n: Column, seed: int) -> Column:
    """Where a position (0 to n - 1) of n goes: a bijection of these for each seed. Null in, null out."""
    side = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    other = F.ceil(n / F.greatest(side, F.lit(1))).cast("long")
    start = F.struct(position.cast("long").alias("p"), n.cast("long").alias("n"), side.alias("a"), F.greatest(other, F.lit(1)).cast("long").alias("b"), F.lit(True).alias("out"))

    def once(s: Column) -> Column:
        def left(pair):
            return lambda h: F.struct(((h["l"] + step(h["r"], pair)) % s["a"]).alias("l"), h["r"].alias("r"))

        def right(pair):
            return lambda h: F.struct(h["l"].alias("l"), ((h["r"] + step(h["l"], pair)) % s["b"]).alias("r"))

        halves = F.struct((s["p"] % s["a"]).alias("l"), F.floor(s["p"] / s["a"]).cast("long").alias("r"))
        for k, pair in enumerate(constants(seed, ROUNDS)):
            halves = F.transform(F.array(halves), (right if k % 2 else left)(pair))[0]
        return F.transform(F.array(halves), lambda h: h["r"] * s["a"] + h["l"])[0]

    def walk(s: Column, _: Column) -> Column:
        p = F.when(s["out"], once(s)).otherwise(s["p"])
        return F.transform(F.array(p), lambda q: F.struct(q.alias("p"), s["n"].alias("n"), s["a"].alias("a"), s["b"].alias("b"), (q >= s["n"]).alias("out")))[0]

    return F.when(position.isNotNull() & (n > 0), F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), start, walk, lambda s: s["p"]))


def shuffled_folds(df: DataFrame, key: str, k: int, seed: int = 42, name: str = "fold") -> DataFrame:
    """df with a fold 0 .. k - 1 of its rows, shuffled by the seed; sizes differ by one at most.

    key: a column without repeats or nulls (whole numbers or other sortable values); its order is what the seed shuffles. Fewer rows than folds leave folds empty.
    """
    n = df.agg(F.count("*").alias("n_"))
    numbered = row_numbers(df, key, [F.col(key)], "at_").crossJoin(F.broadcast(n))
    return numbered.withColumn(name, (permuted(F.col("at_") - 1, F.col("n_"), seed) % k).cast("int")).select(*df.columns, name)
