"""A corpus pipeline of five llm operators: language ID, line dedup, near-duplicate removal, repeated-passage removal, packing.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept, and returns the columns of documents (doc_id, text, lang, source,
n_chars), but for the last, which returns packed pieces. Texts that a stage changes get a new n_chars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnspark.llm import jaccard, language_id, line_dedup, packing, suffix
from cairnspark.llm.common import materialise, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))


def _different(docs: DataFrame) -> DataFrame:
    """One of all rows with equal doc_id and text. The rows are shuffled only if there are equal ones."""
    keyed = docs.withColumn("_h", F.xxhash64("text"))
    if keyed.groupBy("doc_id", "_h").count().where("count > 1").isEmpty():
        return docs
    return keyed.dropDuplicates(["doc_id", "_h"]).drop("_h")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is told: `und` texts go (null, or without a letter), and lang becomes the predicted language.

    Trained on the labelled rows of ``docs``; without any, all texts are `und`.
    """
    docs = _columns(docs)
    model = language_id.train(docs.select("lang", "text"))
    named = language_id.predict(docs, model, "doc_id", "text", "source", "n_chars")
    return named.where(F.col("lang_pred") != language_id.UNKNOWN).select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one occurrence of each group of near-equal lines; a document that loses all its words goes."""
    docs = _columns(docs)
    kept = line_dedup.kept_texts(docs, ["lang", "source", "n_chars"], line_dedup.removals(suffix.keyed(docs)))
    changed = F.col("n_removed") > 0
    left = ~changed | F.col("text").rlike(r"\S")
    return kept.where(left).select("doc_id", "text", "lang", "source", F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast("long").alias("n_chars"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of each group of documents linked by five-word shingles with a similarity of 0.8 or more, the one with the smallest id (an id before none), and one of equal rows.

    Rows are compared by themselves: rows of one id with different texts, and rows without an id, are documents like any other.
    """
    docs = _different(_columns(docs)).withColumn("key_", F.xxhash64("doc_id", "text"))
    groups = jaccard.jaccard_join(docs.select(F.col("key_").alias("doc_id"), "text"), 5, 80, 100).select(F.col("doc_id").alias("key_"), "component_id")
    members = groups.join(docs.select("key_", "doc_id"), "key_")
    first = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key_")).alias("first_")).select("first_.key_")
    return docs.join(first.hint("merge"), "key_", "left_semi").select(*COLUMNS)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts what strings of PASSAGE_BYTES bytes that occur elsewhere cover, after equal rows are made one; a document that loses all its words goes."""
    cut = suffix.cut_repeats(_different(_columns(docs)), PASSAGE_BYTES, ["lang", "source", "n_chars"])
    changed = F.col("n_removed") > 0
    left = ~changed | F.col("text").rlike(r"\S")
    return cut.where(left).select("doc_id", "text", "lang", "source", F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast("long").alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(_columns(docs), packing.default_path())


#: Bytes of a passage that counts as repeated: 51 words of one letter and the spaces between, so one of over 50 words is always caught.
PASSAGE_BYTES = 101

STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("packing", pack),
]

#: None: no stage but the first can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
