"""Language-model scoring by an Elias-Fano n-gram trie.

The model is a word bigram model, interpolated with a smoothed unigram model: P(w | v) = LAMBDA c(v, w) / c(v) + (1 - LAMBDA) P(w). No
task and no driver could hold the model of a large corpus, so it is sharded by n-gram: a shard has the trie of its own
bigrams. Level one is the monotone sequence of the contexts and the monotone pointers to their followers; level
two is the followers, made monotone by adding, in each context, the last value of the one before; both are Elias-Fano coded, beside
16-bit codes of the smoothed log probabilities, all in one memory-mapped file that lives as long as its task. A bigram is found by successor
search for its context, and then, relative to that context, for its follower.

Texts are cut into chunks. A chunk sends its different words to the word shards and gets back their counts and
ids; then sends its different bigrams, with the documents that have them, to the bigram shards and gets back sums for its
documents. Equal n-grams of a chunk travel once. Shards are chosen by hashes of whole bigrams, so neither a
frequent context nor a frequent word makes a shard large.
"""

from __future__ import annotations

import hashlib
import mmap
import struct
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, materialise, mix64, prefix_hash, prepare, runs, slices, span_hash, table, text_arrays, trimmed, words

#: Weight of the bigram's relative frequency.
LAMBDA = 0.4
#: Text bytes of a chunk, and of a shard of the bigrams: both bound what a task holds at a time.
CHUNK_BYTES, SHARD_BYTES = 6 << 20, 8 << 20
#: Hashes that stand for the end of a text, and for its beginning as a context.
END, BEGIN = np.uint64(0xE0E0E0E0E0E0E0E1), np.uint64(0xB0B0B0B0B0B0B0B1)
#: Steps of a log10 unit in the codes of probabilities.
STEPS = 4096.0


# --- bit-packed monotone sequences ---


class EliasFano:
    """A monotone sequence of whole numbers: low bits packed, high bits in unary. Decoded block by block."""

    BLOCK = 1 << 16

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, at: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.at = n, low_bits, low, high, at

    @classmethod
    def encode(cls, x: np.ndarray) -> EliasFano:
        n = len(x)
        if not n:
            return cls(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(1, np.int64))
        low_bits = max(0, (int(x[-1] + 1) // n).bit_length() - 1)
        top = x >> low_bits
        where = top + np.arange(n)
        bits = np.zeros(int(where[-1]) + 1, np.uint8)
        bits[where] = 1
        low = [np.packbits(((x[i : i + cls.BLOCK, None] >> np.arange(low_bits)) & 1).astype(np.uint8)) for i in range(0, n, cls.BLOCK)] if low_bits else []
        # where each block's unary part begins
        at = np.concatenate([[0], where[cls.BLOCK - 1 : n - 1 : cls.BLOCK] + 1, [len(bits)]])
        return cls(n, low_bits, np.concatenate(low) if low else np.zeros(0, np.uint8), np.packbits(bits), at.astype(np.int64))

    def blocks(self) -> int:
        return -(-self.n // self.BLOCK)

    def block(self, b: int) -> np.ndarray:
        i, j = b * self.BLOCK, min(self.n, (b + 1) * self.BLOCK)
        first, last = int(self.at[b]), int(self.at[b + 1])
        bits = np.unpackbits(self.high[first // 8 : -(-last // 8)])[first % 8 : first % 8 + last - first]
        out = (np.flatnonzero(bits) + first - np.arange(i, j)) << self.low_bits
        if self.low_bits:
            size = self.BLOCK * self.low_bits // 8
            low = np.unpackbits(self.low[b * size : b * size + -(-(j - i) * self.low_bits // 8)])[: (j - i) * self.low_bits]
            out += low.reshape(-1, self.low_bits).astype(np.int64) @ (1 << np.arange(self.low_bits))
        return out

    def take(self, at: np.ndarray) -> np.ndarray:
        """Values at ascending positions."""
        out = np.empty(len(at), np.int64)
        edge = np.searchsorted(at, np.arange(self.blocks() + 1) * self.BLOCK)
        for b in range(self.blocks()):
            if edge[b + 1] > edge[b]:
                out[edge[b] : edge[b + 1]] = self.block(b)[at[edge[b] : edge[b + 1]] - b * self.BLOCK]
        return out

    def successor(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, value) of the first element not below each of the ascending keys; (n, -1) if there is none."""
        at, value = np.full(len(keys), self.n), np.full(len(keys), -1)
        done = 0
        for b in range(self.blocks()):
            x = self.block(b)
            end = int(np.searchsorted(keys, x[-1], "right"))
            if end > done:
                k = np.searchsorted(x, keys[done:end])
                at[done:end] = k + b * self.BLOCK
                value[done:end] = x[k]
                done = end
        return at, value


class Trie:
    """Two levels: contexts with pointers, followers with codes."""

    def __init__(self, context: np.ndarray, follower: np.ndarray, code: np.ndarray):
        """Sorted, different (context, follower) pairs of whole numbers from 0, and the code of each."""
        edge = runs(context)
        own = follower + 1
        last = own[edge[1:] - 1] if len(context) else own
        base = np.concatenate([[0], np.cumsum(last)[:-1]]) if len(last) else last
        parts = [EliasFano.encode(context[edge[:-1]]), EliasFano.encode(edge), EliasFano.encode(own + np.repeat(base, np.diff(edge)))]
        self.file = tempfile.TemporaryFile()
        layout = []
        for p in parts:
            for a in (p.low, p.high):
                layout.append((self.file.tell(), len(a)))
                self.file.write(a.tobytes() + b"\0" * (-len(a) % 8))
        at = self.file.tell()
        self.file.write(code.astype("<u2").tobytes() + b"\0\0")
        self.file.flush()
        self.bytes = self.file.tell()
        self.map = mmap.mmap(self.file.fileno(), 0, access=mmap.ACCESS_READ)
        raw = np.frombuffer(self.map, np.uint8)
        cut = [raw[a : a + n] for a, n in layout]
        self.contexts, self.pointers, self.followers = (EliasFano(p.n, p.low_bits, cut[2 * i], cut[2 * i + 1], p.at) for i, p in enumerate(parts))
        self.codes = raw[at : at + 2 * len(code)].view("<u2")

    def find(self, context: np.ndarray, follower: np.ndarray) -> np.ndarray:
        """Positions in the second level of ascending (context, follower) pairs; -1 where there is none."""
        out = np.full(len(context), -1, np.int64)
        i, value = self.contexts.successor(context)
        hit = np.flatnonzero(value == context)
        if not len(hit):
            return out
        i = i[hit]
        lo, hi = self.pointers.take(i), self.pointers.take(i + 1)
        inner = lo > 0
        base = np.zeros(len(lo), np.int64)
        base[inner] = self.followers.take(lo[inner] - 1)
        target = base + follower[hit] + 1
        # a follower beyond its context's last one would lead into the next context
        inside = target <= self.followers.take(hi - 1)
        at, value = self.followers.successor(target[inside])
        out[hit[inside]] = np.where(value == target[inside], at, -1)
        return out

    def close(self) -> None:
        del self.codes, self.contexts, self.pointers, self.followers
        self.file.close()


# --- blobs ---


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays, byte planes apart, compressed together."""
    out = [struct.pack("<B", len(arrays))]
    for a in arrays:
        out += [struct.pack("<2sq", a.dtype.str[1:].encode(), len(a)), np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()]
    return zstandard.ZstdCompressor(1).compress(b"".join(out))


def unsqueeze(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = raw[0], 1, []
    for _ in range(n):
        kind, size = struct.unpack_from("<2sq", raw, at)
        at += 10
        d = np.dtype(kind.decode())
        planes = np.frombuffer(raw, np.uint8, size * d.itemsize, at).reshape(d.itemsize, size)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(d))
        at += size * d.itemsize
    return out


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the tokens of all rows, each row's words and its end; where the rows begin, and the number of all)."""
    hashes, counts = [], []
    for i, j in slices(offsets):
        part = LOWER[raw[offsets[i] : offsets[j]]]
        start, end, row = words(part, offsets[i : j + 1] - offsets[i])
        hashes.append(span_hash(prefix_hash(part), start, end))
        counts.append(np.bincount(row, minlength=j - i))
    count = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    at = np.concatenate([[0], np.cumsum(count + 1)])
    out = np.full(int(at[-1]), END, np.uint64)
    inside = np.ones(len(out), bool)
    inside[at[1:] - 1] = False
    if hashes:
        out[inside] = np.concatenate(hashes)
    return out, at


def _chunks(batches: Iterator[pa.RecordBatch]):
    """(key, doc ids, held, learned, raw, offsets) of runs of rows with CHUNK_BYTES of text.

    The key says which chunk of which partition it is, and has a digest of what is in it: both passes over a table must cut it alike.
    """
    waiting, size, number = [], 0, 0

    def close():
        raw = np.concatenate([text_arrays(b.column(3))[0] for b in waiting])
        lens = np.concatenate([np.diff(text_arrays(b.column(3))[1]) for b in waiting])
        off = np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)
        ids = pa.concat_arrays([b.column(0) for b in waiting])
        held, learned = (np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in waiting]).astype(bool) for k in (1, 2))
        key = hashlib.blake2b(raw.tobytes(), digest_size=16)
        key.update(off.tobytes() + held.tobytes() + learned.tobytes() + ids.fill_null(-1).to_numpy().tobytes())
        return struct.pack("<qq", TaskContext.get().partitionId(), number) + key.digest(), ids, held, learned, raw, off

    for batch in batches:
        if batch.num_rows:
            waiting.append(batch)
            size += batch.column(3).nbytes
        if size >= CHUNK_BYTES:
            yield close()
            waiting, size, number = [], 0, number + 1
    if waiting:
        yield close()


def opened(blob: bytes) -> list[np.ndarray]:
    """(valid, ids, held, learned, offsets, bytes) of a chunk's texts."""
    size = struct.unpack_from("<q", blob)[0]
    return [*unsqueeze(blob[8 : 8 + size]), np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[8 + size :]), np.uint8)]


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


BLOBS = "chunk binary, shard int, kind int, blob binary"
_KINDS = (pa.binary(), pa.int32(), pa.int32(), pa.binary())
# kinds of blobs
WORDS, TOTALS, TEXTS, PAIRS, DOCS, SUMS = range(6)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), _KINDS)], ["chunk", "shard", "kind", "blob"])


def _frame(out: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(out, columns=["chunk", "shard", "kind", "blob"])


def score(docs: DataFrame, held: Column, learned: Column) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    docs: doc_id, text and what ``held`` and ``learned`` use; rows for which ``learned`` is not true teach nothing. A null text is
    empty: one token, its end. Equal rows count and are scored each. Without any learned row, every count is 0. An empty
    table gives an empty one. Probabilities in the trie are rounded to 1 / STEPS of a log10 unit.
    """
    spark = docs.sparkSession
    prepare(spark)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held, F.lit(False)).alias("held"), F.coalesce(learned, F.lit(False)).alias("learned"), "text")
    src = materialise(src)  # both passes cut it into chunks: rows that come from a shuffle could be in another order the second time
    # a shard is a partition of its own, whatever the number of partitions is set to
    shards = max(1, -(-(src.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARD_BYTES))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(3)
        for key, ids, held_, learned_, raw, off in _chunks(batches):
            head = squeeze(ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8), ids.fill_null(0).to_numpy(), held_.astype(np.uint8), learned_.astype(np.uint8), off)
            yield _rows([(key, -1, TEXTS, struct.pack("<q", len(head)) + head + z.compress(raw.tobytes()))])

    def vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, _, _, learned_, raw, off in _chunks(batches):
            h, at = tokens(raw, off)
            word, inverse = np.unique(h, return_inverse=True)
            n = np.bincount(inverse, weights=np.repeat(learned_, np.diff(at)), minlength=len(word)).astype(np.uint32)
            cut = np.searchsorted(_shard(word, shards), np.arange(shards + 1))
            yield _rows([(key, s, WORDS, squeeze(word[a:b], n[a:b])) for s, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())) if b > a])

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(pdf["shard"].iloc[0])
        parts = [unsqueeze(b) for b in pdf["blob"]]
        word, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        n = np.bincount(inverse, weights=np.concatenate([p[1] for p in parts])).astype(np.uint64)
        at = np.cumsum([0, *(len(p[0]) for p in parts)])
        # ids are dense in the shard; the shard's number goes in front
        out = [(k, shard, WORDS, squeeze(inverse[a:b].astype(np.uint32), n[inverse[a:b]])) for k, a, b in zip(pdf["chunk"], at[:-1], at[1:])]
        return _frame([*out, (b"", shard, TOTALS, struct.pack("<qqq", int(n.sum()), int((n > 0).sum()), len(word)))])

    counted = materialise(src.mapInArrow(trimmed(vocabulary), BLOBS).repartition(shards, "shard").groupBy("shard").applyInPandas(count, BLOBS))
    # one row for each shard
    totals = [(r["shard"], *struct.unpack("<qqq", bytes(r["blob"]))) for r in counted.where(F.col("kind") == TOTALS).select("shard", "blob").collect()]
    n_all, v_all = sum(t[1] for t in totals), sum(t[2] for t in totals)
    first_id = np.zeros(shards + 1, np.int64)
    for s, _, _, n in totals:
        first_id[s + 1] = n
    first_id = np.cumsum(first_id)
    begin_id = int(first_id[-1])
    if begin_id >= 1 << 32 or n_all >= 1 << 53:
        raise OverflowError("more different words or more tokens than the model's numbers hold")
    floor = n_all + 0.1 * (v_all + 1)

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        key = pdf["chunk"].iloc[0]
        text = pdf[pdf["kind"] == TEXTS]
        if not len(text):
            raise RuntimeError("a chunk was cut differently when its words were counted")
        back = pdf[pdf["kind"] == WORDS].sort_values("shard")
        got = [unsqueeze(b) for b in back["blob"]]
        word_id = np.concatenate([g[0] + first_id[s] for g, s in zip(got, back["shard"])]) if got else np.zeros(0, np.int64)
        c = np.concatenate([g[1] for g in got]).astype(np.float64)
        valid, ids, held_, learned_, off, raw = opened(text["blob"].iloc[0])
        h, at = tokens(raw, off)
        word, inverse = np.unique(h, return_inverse=True)
        log_p = np.log10((c + 0.1) / floor)
        doc = np.repeat(np.arange(len(off) - 1), np.diff(at))
        base = np.bincount(doc, weights=log_p[inverse], minlength=len(off) - 1)
        known = np.bincount(doc, weights=(c > 0)[inverse], minlength=len(off) - 1).astype(np.int64)
        out = [(key, int.from_bytes(key[-4:], "little") % shards, DOCS, squeeze(valid, ids, held_, np.diff(at), known, base))]
        # bigrams of local numbers, the beginning last; local numbers and ids are in the same order
        follower = inverse.astype(np.int64)
        context = np.empty_like(follower)
        context[1:] = follower[:-1]
        context[at[:-1]] = len(word)
        wid = np.concatenate([word_id, [begin_id]])
        cc = np.concatenate([c, [c[np.searchsorted(word, END)]]])  # a text begins as often as one ends
        code = np.round(-log_p * STEPS).clip(0, 65535).astype(np.uint16)
        # in order of shard and bigram; equal ones of a document are one entry
        shard = _shard(mix64(mix64(wid[context].astype(np.uint64)) + wid[follower].astype(np.uint64)), shards)
        whole = context * (len(word) + 1) + follower
        order = np.lexsort((whole, shard))  # stable, so documents stay in order
        shard, whole, doc = shard[order], whole[order], doc[order]
        new_pair = np.concatenate([[True], whole[1:] != whole[:-1]])
        entry = np.flatnonzero(new_pair | np.concatenate([[True], doc[1:] != doc[:-1]]))
        times = np.diff(np.concatenate([entry, [len(whole)]]))
        pair_of = np.cumsum(new_pair)[entry] - 1
        pair = np.flatnonzero(new_pair)
        p_context, p_follower = whole[pair] // (len(word) + 1), whole[pair] % (len(word) + 1)
        per = np.bincount(pair_of, minlength=len(pair))
        taught = np.bincount(pair_of, weights=times * learned_[doc[entry]], minlength=len(pair))
        cut_pair = np.searchsorted(shard[pair], np.arange(shards + 1)).tolist()
        cut_entry = np.searchsorted(shard[entry], np.arange(shards + 1)).tolist()
        for s in range(shards):
            a, b, e, f = cut_pair[s], cut_pair[s + 1], cut_entry[s], cut_entry[s + 1]
            if b > a:
                x, y = p_context[a:b], p_follower[a:b]
                columns = (
                    np.diff(wid[x], prepend=0), cc[x], wid[y].astype(np.uint32), code[y], taught[a:b].astype(np.uint32),
                    per[a:b].astype(np.uint32), doc[entry[e:f]].astype(np.uint32), times[e:f].astype(np.uint32), np.array([len(off) - 1], np.int64),
                )
                out.append((key, s, PAIRS, squeeze(*columns)))
        return _frame(out)

    def look(pdf: pd.DataFrame) -> pd.DataFrame:
        out = list(pdf[pdf["kind"] == DOCS][["chunk", "shard", "kind", "blob"]].itertuples(index=False, name=None))
        own = pdf[pdf["kind"] == PAIRS]
        if not len(own):
            return _frame(out)
        parts = [unsqueeze(b) for b in own["blob"]]
        c_context, code, taught = (np.concatenate([p[k] for p in parts]) for k in (1, 3, 4))
        # ids are below 2^32, so a bigram is one number
        bigram = np.concatenate([(np.cumsum(p[0]).astype(np.uint64) << np.uint64(32)) | p[2] for p in parts])
        order = np.argsort(bigram, kind="stable")
        edge = runs(bigram[order])
        at = order[edge[:-1]]  # one occurrence of each different bigram
        bigram = bigram[at]
        x, y = (bigram >> np.uint64(32)).astype(np.int64), (bigram & np.uint64(0xFFFFFFFF)).astype(np.int64)
        n = np.add.reduceat(taught[order].astype(np.float64), edge[:-1])
        seen = n > 0
        known = at[seen]
        p = LAMBDA * n[seen] / np.maximum(1, c_context[known]) + (1 - LAMBDA) * 10 ** (code[known] / -STEPS)
        trie = Trie(x[seen], y[seen], np.round(-np.log10(p) * STEPS).clip(0, 65535).astype(np.uint16))
        # look every different bigram up
        found = trie.find(x, y)
        # a context that was never seen leaves all weight to the unigram
        log_p = np.where(c_context[at] > 0, np.log10(1 - LAMBDA), 0.0) - code[at] / STEPS
        hit = found >= 0
        log_p[hit] = trie.codes[found[hit]] / -STEPS
        trie.close()
        each = np.empty(len(order))
        each[order] = np.repeat(log_p, np.diff(edge))
        a = 0
        for key, p in zip(own["chunk"], parts):
            b = a + len(p[0])
            sums = np.bincount(p[6], weights=np.repeat(each[a:b], p[5]) * p[7], minlength=int(p[8][0]))
            out.append((key, int(own["shard"].iloc[0]), SUMS, squeeze(sums)))
            a = b
        return _frame(out)

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        valid, ids, held_, n, known, base = unsqueeze(pdf[pdf["kind"] == DOCS]["blob"].iloc[0])
        total = np.zeros(len(ids))
        for blob in pdf[pdf["kind"] == SUMS].sort_values("shard")["blob"]:
            total += unsqueeze(blob)[0]
        doc_id = pd.Series(ids).astype("Int64").mask(valid == 0)
        return pd.DataFrame({"doc_id": doc_id, "held_out": held_ == 1, "n_tokens": n, "n_known": known, "train_tokens": n_all, "base_score": base, "score": total})

    sent = src.mapInArrow(trimmed(texts), BLOBS).unionByName(counted.where(F.col("kind") == WORDS))
    scored = sent.groupBy("chunk").applyInPandas(pairs, BLOBS).repartition(shards, "shard").groupBy("shard").applyInPandas(look, BLOBS)
    return scored.groupBy("chunk").applyInPandas(gather, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and scores of every document under a model of those that are not held out; a null text is one end token."""
    fold = F.crc32(F.col("doc_id").cast("long").cast("string")) % 10
    return score(table(spark, sf_dir, "documents"), fold == 0, fold != 0)
