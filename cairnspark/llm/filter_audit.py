"""How filters of documents interact, by inclusion and exclusion over their joint failures.

A document has one flag for each filter it fails. For every set of filters, the documents that fail all of it are summed up as products of flags: 2^k sums
for k filters, in one aggregation. All else follows from these joint counts alone: a Moebius inversion over the subsets of a set S gives the documents that
fail none of S (its survivors); differences of survivors give what a filter removes after others, what only it would remove, and what it would remove but finds removed. The
joint counts with alternating signs are the Harsanyi dividends of the game "documents removed by a set of filters"; a filter's Shapley value is the sum of its sets'
dividends, each shared evenly by the set's filters.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

#: The filters of the audit query; a filter's place here is its bit.
FILTERS = "ABCDE"


def text_failures(text: Column) -> Column:
    """Bits of the filters that look at one text: under 50 words (A), fewer than 65 % different words (B), over 5 % capitals (C), a mark (D). A null text is empty."""
    t = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(t, r"[\x20\x09-\x0D]+"), "")
    capitals = F.length(t) - F.length(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    fails = [
        F.size(words) < 50,
        100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        100 * capitals.cast("long") > 5 * F.length(t),
        t.rlike(r"[#$%&*|]"),
    ]
    return reduce(Column.bitwiseOR, (F.when(f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(fails)))


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, fails, n): how many rows of a document fail the filters whose bits are set in fails; all others of (doc_id, text, source) are read.

    The last filter (E) fails a text that a smaller doc_id has too, anywhere in the table. Texts are compared by 128-bit hashes. A row without a doc_id has no smaller one;
    rows of one doc_id and text are not copies of each other. part: the source, '' for null. An empty table gives an empty one.

    A text's smallest doc_id is found with map-side combining, and joined by doc_id and text together, so a text on a third of all rows is in no task's way.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    each = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(t.cast("binary"))).alias("h"), F.coalesce("source", F.lit("")).alias("part"), text_failures(F.col("text")).alias("fails"))
    rows = materialise(each.groupBy("doc_id", "h", "part", "fails").agg(F.count("*").alias("n")))
    first = rows.groupBy("h").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").withColumn("first", F.lit(True))
    copy = F.when(F.col("doc_id").isNotNull() & F.col("first").isNull(), F.lit(1 << FILTERS.index("E"))).otherwise(F.lit(0))
    return rows.join(first.hint("merge"), ["doc_id", "h"], "left").select("doc_id", "part", F.col("fails").bitwiseOR(copy).alias("fails"), "n")


def joint_failures(rows: DataFrame, by: list[str], k: int, weights: dict[str, Column]) -> DataFrame:
    """(by, <weight>: array<long>): at place S of the array, the weight of the rows that fail all filters of the set S (bits).

    rows: (by, fails). A row counts for S if the product of its flags of S is one. Map-side combining leaves one row for each group and task.
    """
    product = {s: (F.col("fails").bitwiseAND(F.lit(s)) == s).cast("long") for s in range(1 << k)}
    sums = rows.groupBy(*by).agg(*[F.sum(product[s] * w).alias(f"{name}_{s}") for name, w in weights.items() for s in product])
    return sums.select(*by, *[F.array(*[F.col(f"{name}_{s}") for s in product]).alias(name) for name in weights])


def _subsets(s: int) -> list[int]:
    return [t for t in range(s + 1) if t & ~s == 0]


def survivors(joint: Column, k: int) -> Column:
    """array<long>: at place S, what fails no filter of S, by Moebius inversion of the joint counts."""
    sign = lambda t: -1 if t.bit_count() % 2 else 1
    return F.array(*[reduce(Column.__add__, (joint[t] * sign(t) for t in _subsets(s))) for s in range(1 << k)])


def dividends(joint: Column, k: int) -> Column:
    """array<long>: at place S, the Harsanyi dividend of S in the game that pays a set of filters what it removes."""
    return F.array(*[joint[s] * (0 if not s else 1 if s.bit_count() % 2 else -1) for s in range(1 << k)])


def shapley_over_orders(dividend: Column, k: int) -> Column:
    """array<long>: for each filter, what it removes summed over all k! orders, k! times its Shapley value. k! is a multiple of every set's size."""
    share = lambda s: factorial(k) // s.bit_count()
    return F.array(*[reduce(Column.__add__, (dividend[s] * share(s) for s in range(1 << k) if s >> f & 1)) for f in range(k)])


def audit(joint: DataFrame, by: list[str], filters: str) -> DataFrame:
    """(by, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of every order of the filters and every step.

    joint: arrays docs, good and toxic, as of ``joint_failures``. The joint counts are one row a group; each gives k! x k rows.
    """
    k, full = len(filters), (1 << len(filters)) - 1
    left = joint.select(*by, "docs", *[survivors(F.col(c), k).alias(f"{c}_left") for c in ("docs", "good", "toxic")], shapley_over_orders(dividends(F.col("docs"), k), k).alias("values"))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(filters)])
    steps = left.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k))))
    place = f"instr('{filters}', substring(filter_order, {{}}, 1)) - 1"
    before = f"aggregate(filter(sequence(1, {k}), i -> i < step), 0, (a, i) -> a | shiftleft(1, {place.format('i')}))"
    x = steps.withColumn("own", F.expr(place.format("step"))).withColumn("before", F.expr(before)).withColumn("bit", F.expr("shiftleft(1, own)"))
    x = x.withColumn("after", F.expr("before | bit"))
    gone = lambda c: F.col(f"{c}_left")[F.col("before")] - F.col(f"{c}_left")[F.col("after")]
    only = F.col("docs_left")[F.expr(f"{full} ^ bit")] - F.col("docs_left")[full]
    return x.select(
        *by, "filter_order", "step", F.col("docs_left")[F.col("after")].alias("kept"), gone("docs").alias("removed"), (F.col("docs")[F.col("bit")] - gone("docs")).alias("redundant"),
        only.alias("unique_fails"), gone("good").alias("good_lost"), gone("toxic").alias("toxic_lost"), F.col("values")[F.col("own")].alias("shapley"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of the five filters over all documents; a document with several labels is good, or toxic, if any says so."""
    docs, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    said = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(said("quality"), said("toxic")).withColumnsRenamed({"quality": "good_", "toxic": "toxic_"})
    rows = failures(docs.select("doc_id", "text", "source")).join(marks, "doc_id", "left")
    weight = lambda c: F.coalesce(F.col(c), F.lit(0)) * F.col("n")
    joint = joint_failures(rows, ["part"], len(FILTERS), {"docs": F.col("n"), "good": weight("good_"), "toxic": weight("toxic_")})
    return audit(joint, ["part"], FILTERS)


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), f AS (
  SELECT doc_id, part,
         concat(CASE WHEN len(w) < 50 THEN 'A' ELSE '' END, CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END,
                CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 'C' ELSE '' END,
                CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END,
                CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END) AS fails
  FROM t
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id
), p AS (
  SELECT part, fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(bad), 0) AS bad FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (SELECT o, CAST(s AS INTEGER) AS step, substr(o, s, 1) AS own, substr(o, 1, s - 1) AS prior FROM orders, range(1, 6) r(s)
), r AS (
  SELECT part, o AS filter_order, step, own,
         coalesce(sum(n) FILTER (translate(fails, prior || own, '') = fails), 0) AS kept,
         coalesce(sum(n) FILTER (translate(fails, prior, '') = fails AND contains(fails, own)), 0) AS removed,
         coalesce(sum(n) FILTER (translate(fails, prior, '') <> fails AND contains(fails, own)), 0) AS redundant,
         coalesce(sum(n) FILTER (fails = own), 0) AS unique_fails,
         coalesce(sum(good) FILTER (translate(fails, prior, '') = fails AND contains(fails, own)), 0) AS good_lost,
         coalesce(sum(bad) FILTER (translate(fails, prior, '') = fails AND contains(fails, own)), 0) AS toxic_lost
  FROM p, steps GROUP BY part, o, step, own
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM r
"""
