"""Language identification with error-correcting output codes.

Each language has a codeword of n_bits bits. A binary n-gram classifier for each bit - log odds of byte trigrams between the
languages whose bit is 1 and those whose bit is 0, each language weighing the same - votes on a text. Loss-weighted
decoding chooses the codeword with the smallest sum of logistic losses of its signed votes, each bit weighing as much as it
told the training languages apart; a small lead over the second codeword flags the text as ambiguous.

Training counts cover every training document: each task counts the n-grams of its rows, and the counts are summed by (language,
n-gram bucket) with map-side combining. The driver gets at most languages x buckets sums, whatever the corpus' size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, slices, table, text_arrays, trimmed

#: Hash buckets of byte trigrams (a power of two).
BUCKETS = 1 << 15
#: Lead of the best codeword, as a share of the whole probability, under which a text counts as ambiguous.
AMBIGUOUS = 0.2
UNKNOWN = "und"

# Letters stay (A-Z lower-cased, bytes of other scripts as they are); everything else is a space.
_MAP = np.full(256, 0x20, np.uint8)
_MAP[0x80:] = np.arange(0x80, 0x100)
_MAP[0x61:0x7B] = _MAP[0x41:0x5B] = np.arange(0x61, 0x7B)


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, whether it counts) of the trigram that starts at each byte; those that leave their row, and those of three
    non-letters, do not count."""
    m = _MAP[data].astype(np.uint32)
    n = len(m)
    code = np.zeros(n, np.uint32)
    if n < 3:
        return code, np.zeros(n, bool)
    code[:-2] = (m[:-2] << np.uint32(16)) | (m[1:-1] << np.uint32(8)) | m[2:]
    ok = code != 0x202020
    ok[-2:] = False
    for back in (1, 2):
        at = offsets[1:] - back
        ok[at[at >= offsets[:-1]]] = False
    bucket = (code * np.uint32(2654435761)) >> np.uint32(32 - (BUCKETS.bit_length() - 1))
    return bucket, ok


def codewords(n: int) -> np.ndarray:
    """n codewords of +1 and -1, one row for each language, far apart and without a constant or repeated column.

    Up to 7 languages: the exhaustive code of 2^(n-1) - 1 bits. More: of many random codes of 10 log2(n) bits, the
    one with the largest smallest distance.
    """
    if n <= 1:
        return np.ones((n, 1))
    if n <= 7:
        bits = 2 ** (n - 1) - 1
        return np.array([[1.0 if r == 0 or ((c >> (r - 1)) & 1) else -1.0 for c in range(bits)] for r in range(n)])
    rng, bits = np.random.default_rng(7), int(np.ceil(10 * np.log2(n)))
    best, most = None, -1
    for _ in range(200):
        m = rng.choice([-1.0, 1.0], (n, bits))
        if (np.abs(m.sum(axis=0)) == n).any():
            continue
        apart = int(((bits - m @ m.T) / 2 + np.eye(n) * bits).min())
        if apart > most:
            best, most = m, apart
    return best


def count(rows: DataFrame) -> DataFrame:
    """(lang, bucket, n) over rows of (lang, text)."""
    prepare(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            raw, off = text_arrays(batch.column(1))
            for i, j in slices(off):
                part = off[i : j + 1] - off[i]
                bucket, ok = trigrams(raw[off[i] : off[j]], part)
                names, of = np.unique(langs[i:j], return_inverse=True)
                row = np.repeat(of, np.diff(part))[ok]
                both = np.bincount(row * BUCKETS + bucket[ok], minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
                for k, name in enumerate(names):
                    sums[name] = sums[name] + both[k] if name in sums else both[k]
        for name, v in sums.items():
            at = np.flatnonzero(v)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(v[at].astype(np.int64))], ["lang", "bucket", "n"])

    return rows.mapInArrow(trimmed(run), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray):
        """counts: languages x buckets."""
        self.langs = langs
        self.code = codewords(len(langs))
        p = counts + 0.5
        p /= p.sum(axis=1, keepdims=True)
        bits = self.code.shape[1]
        self.odds = np.zeros((BUCKETS, bits), np.float32)
        self.weight = np.ones(bits)
        for b in range(bits):
            one, zero = self.code[:, b] > 0, self.code[:, b] < 0
            if zero.any() and one.any():
                self.odds[:, b] = np.log(p[one].mean(axis=0)) - np.log(p[zero].mean(axis=0))
                # what a trigram of each language votes on average: a bit weighs as much as its surest language is apart
                self.weight[b] = max(1e-3, float(np.abs(p @ self.odds[:, b]).min()))
        self.weight /= self.weight.sum()

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language number, score 0 to 1, lead over the second) of each row."""
        n = len(offsets) - 1
        bucket, ok = trigrams(data, offsets)
        votes = np.zeros((n, self.code.shape[1]))
        if len(bucket):
            filled = np.flatnonzero(offsets[1:] > offsets[:-1])
            sums = np.empty((len(filled), self.code.shape[1]))
            for b in range(self.code.shape[1]):
                each = self.odds[:, b].take(bucket)
                each *= ok
                sums[:, b] = np.add.reduceat(each, offsets[filled], dtype=np.float64)
            votes[filled] = sums / np.maximum(1, np.add.reduceat(ok, offsets[filled], dtype=np.int64))[:, None]
        loss = np.log1p(np.exp(-4 * self.code[None, :, :] * votes[:, None, :])) @ self.weight
        share = np.exp(-8 * (loss - loss.min(axis=1, keepdims=True)))
        share /= share.sum(axis=1, keepdims=True)
        best = share.argmax(axis=1)
        top = np.sort(share, axis=1)
        lead = top[:, -1] - (top[:, -2] if share.shape[1] > 1 else 0)
        return best, np.clip(top[:, -1], 0, 1), lead


def train(rows: DataFrame) -> Model | None:
    """rows: (lang, text). Null lang or text teaches nothing. None if nothing is left."""
    known = rows.where("lang is not null and text is not null")
    found = count(known.select("lang", "text")).collect()  # languages x buckets sums at most
    if not found:
        return None
    langs = sorted({r[0] for r in found})
    at = {x: i for i, x in enumerate(langs)}
    counts = np.zeros((len(langs), BUCKETS))
    for lang, bucket, n in found:
        counts[at[lang], bucket] = n
    return Model(langs, counts)


def predict(docs: DataFrame, model: Model | None, *carry: str) -> DataFrame:
    """(the carried columns, lang_pred, score, ambiguous) for every row.

    docs: text and the carried columns. `und` with score 0 for a null text, a text without a letter, or without a model. A text with a
    letter but shorter than a trigram has no votes: all codewords tie, the first language is chosen, ambiguous. Nothing is
    shuffled; repeated rows are predicted alike; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)  # buckets x bits floats
    has_letter: Column = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model | None = shared.value
        for batch in batches:
            raw, off = text_arrays(batch.column(0))
            n = batch.num_rows
            best, score, lead = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
            if m is not None:
                for i, j in slices(off):
                    best[i:j], score[i:j], lead[i:j] = m.predict(raw[off[i] : off[j]], off[i : j + 1] - off[i])
            ok = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), bool) & (m is not None)
            names = np.array([*(m.langs if m else []), UNKNOWN], object)
            cols = [pa.array(names[np.where(ok, best, len(names) - 1)], pa.string()), pa.array(np.where(ok, score, 0.0)), pa.array(ok & (lead < AMBIGUOUS))]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], *cols], [*carry, "lang_pred", "score", "ambiguous"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema)
    return docs.select("text", has_letter.alias("has_letter"), *carry).mapInArrow(trimmed(run), f"{fields}, lang_pred string, score double, ambiguous boolean")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous) of every document, learnt from the labelled ones that are not held out; und for null texts and those without a letter."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    model = train(docs.where(F.coalesce(fold != 2, F.lit(False))).select("lang", "text"))
    return predict(docs.select("doc_id", "text", F.coalesce(fold == 2, F.lit(False)).alias("held_out")), model, "doc_id", "held_out")
