"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Only documents longer than a sequence are cut. The plan depends on the histogram of piece lengths alone (at most ``capacity``
entries, so the driver's share is bounded at any corpus size): a configuration linear program - one variable for each way
to fill a sequence - is solved by multiplicative weights, whose pricing step is an unbounded knapsack solved by dynamic
programming; the solution is rounded down, and what is left is placed best-fit decreasing, length by length. The
plan's slots are then dealt to the pieces by length and rank. Ranks are taken inside salted parts of each length, so a
length that a third of all pieces share is spread over many tasks.
"""

from __future__ import annotations

import os
import sys
import unicodedata
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import CACHES, materialise, prepare, runs, table, trimmed

#: Words kept in a worker's cache; a full cache is emptied. It only saves time.
CACHE_WORDS = 1_000_000
#: Relative gap between a cover and the dual bound at which the LP counts as solved.
GAP = 0.02
#: Factor of a price for the share of a demand that is covered (its logarithm), value in tokens that may be lost to break ties, share of the best pattern's value
#: below which a pattern is not used, share of what is left that a step may cover, and steps after each pricing.
LEARN, LATE, TIES, NEARLY, STEP, SUBSTEPS = 0.004, 0.1, 2.0, 0.004, 0.3, 4
#: Share of the tokens that is left to best fit.
RESIDUE = 0.05
#: Rounds of pricing that all solutions of a plan may take together; what is not covered then is left to best fit.
MOST_ROUNDS = 300
#: Shares of the sequences, worst filled first, that are dissolved and dealt again by best fit, each kept only where it saves sequences. The last one is best fit alone.
AGAIN = (0.02, 0.1, 0.3, 0.6, 1.0)
#: Rounds between exact dual bounds.
BOUND_EACH = 10
#: Rows that one salted part of a length should hold.
PART_ROWS = 20_000


def _letters_only(s: str) -> bool:
    """Whether s is letters before and after normalisation and lower-casing."""
    return s.isalpha() and (s.isascii() or unicodedata.normalize("NFC", s).lower().isalpha())


class WordTokenizer:
    """Ids of texts by a tokenizer whose words never reach across white space, with each chunk encoded once and cached.

    A-Z are lower-cased ahead, as the tokenizer itself would, so that a chunk is cached once; not so in texts with ``<|``, where
    its special strings, which it matches as written, could arise. New chunks of letters only are encoded together as one
    text and told apart at the tokens that end a word.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        assert sys.byteorder == "little" and array("I").itemsize == 4
        self.inner = Tokenizer.from_file(path)
        self.cache: dict[bytes, bytes] = {b"": b""}
        vocab = self.inner.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        cache, get = self.cache, self.cache.get
        if len(cache) > CACHE_WORDS:
            cache.clear()
            cache[b""] = b""
        out: list[bytes] = []
        short: list[tuple[int, list, list[int], list[bytes]]] = []
        for i, t in enumerate(texts):
            raw = t.encode()
            if b"<|" not in raw:
                raw = raw.lower()
            ws = raw.replace(b"\n", b" ").split(b" ")
            got = list(map(get, ws))
            try:
                out.append(b"".join(got))
            except TypeError:  # a chunk that is not cached gives None
                at = [k for k, g in enumerate(got) if g is None]
                out.append(b"")
                short.append((i, got, at, [ws[k] for k in at]))
        if short:
            self._learn({w for *_, new in short for w in new})
            for i, got, at, new in short:
                for k, w in zip(at, new):
                    got[k] = cache[w]
                out[i] = b"".join(got)
        return out

    def _learn(self, chunks: set[bytes]) -> None:
        cache = self.cache
        tails: list[tuple[bytes, bytes, bytes]] = []
        letters: set[str] = set()
        rest: list[str] = []
        for w in chunks:
            s = w.decode()
            if _letters_only(s):
                letters.add(s)
            elif s[-1] in ".,;:?!" and _letters_only(s[:-1]):  # a mark after letters is a word of its own
                tails.append((w, w[:-1], w[-1:]))
                if w[:-1] not in cache:
                    letters.add(s[:-1])
                if w[-1:] not in cache:
                    rest.append(s[-1])
            else:
                rest.append(s)
        words = list(letters)
        if words:
            ids = np.array(self.inner.encode(" ".join(words), add_special_tokens=False).ids, "<u4")
            end = np.flatnonzero(self.ends[ids]) + 1
            if len(end) == len(words) and end[-1] == len(ids):
                packed, a = ids.tobytes(), 0
                for s, b in zip(words, (4 * end).tolist()):
                    cache[s.encode()] = packed[a:b]
                    a = b
            else:
                rest += words
        if rest:
            for s, e in zip(rest, self.inner.encode_batch_fast(rest, add_special_tokens=False)):
                cache[s.encode()] = array("I", e.ids).tobytes()
        for w, head, mark in tails:
            cache[w] = cache[head] + cache[mark]


_tokenizers: dict[str, WordTokenizer] = {}
CACHES["words"] = _tokenizers.clear


def tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int, with_ids: bool) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document's ids followed by end_id, cut at ``capacity``."""
    prepare(docs.sparkSession)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i in range(0, len(ids), 256):
                rows: list[tuple] = []
                for d, packed in zip(ids[i : i + 256], tok.encode([t or "" for t in texts[i : i + 256]])):
                    packed += tail
                    for k, at in enumerate(range(0, len(packed), 4 * capacity)):
                        part = packed[at : at + 4 * capacity]
                        rows.append((d, k, at // 4, len(part) // 4, zlib.crc32(part)) + ((np.frombuffer(part, "<u4").astype(np.int64),) if with_ids else ()))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(trimmed(run, "words"), schema)


# --- the plan, on the driver, over the histogram ---


def price(values: np.ndarray, shift: np.ndarray, noise: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack by dynamic programming: (best value of each room; last length taken for it, 0 where one unit stays free).

    values[l]: of a piece of length l, -inf where there is none; index 0 is not used. Near ties are broken by ``noise``, from another
    place of it for every room, so that the patterns of one table differ.
    """
    best, take = np.zeros(len(values)), np.zeros(len(values), np.int64)
    v = values[1:]
    for c in range(1, len(values)):
        got = best[:c][::-1] + v[:c]
        k = int((got + noise[shift[c] : shift[c] + c]).argmax())
        best[c] = best[c - 1]
        if got[k] > best[c] + 1e-15:
            best[c], take[c] = got[k], k + 1
    return best, take


def filled(size: np.ndarray, at: np.ndarray, take: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pattern, index of a length, how often), in this order: pattern i holds size[i] and the best of what fits beside it. at: index of each length."""
    n = len(size)
    last = np.maximum.accumulate(np.where(take > 0, np.arange(len(take)), 0))
    room = len(take) - 1 - size
    live = np.arange(n)
    keys = [live * n + live]
    while len(live):
        room[live] = last[room[live]]
        live = live[room[live] > 0]
        taken = take[room[live]]
        keys.append(live * n + at[taken])
        room[live] -= taken
    key, times = np.unique(np.concatenate(keys), return_counts=True)
    return key // n, key % n, times


def lower_bound(size: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """(bound, prices) of the best of some dual solutions of the LP: lengths above capacity - a count whole, those below a count nothing."""
    best = (0.0, size / capacity)
    for a in {0, *(int(capacity * k) // 64 for k in range(1, 33))}:
        y = np.where(size > capacity - a, 1.0, np.where(size >= a, size / capacity, 0.0))
        best = max(best, (float((y * counts).sum()), y), key=lambda x: x[0])
    return best


@dataclass
class Cover:
    """An approximate solution of the configuration LP: pattern p is used ``times[p]`` times and holds each length in index[edge[p]:edge[p + 1]] as often as ``many`` says.

    left: demand that no pattern covers, for which sequences of one length are counted. primal, dual: sequences of this solution, and the bound it
    is near to.
    """

    index: np.ndarray
    many: np.ndarray
    edge: np.ndarray
    times: np.ndarray
    left: np.ndarray
    primal: float
    dual: float


def solve(size: np.ndarray, counts: np.ndarray, capacity: int, gap: float = GAP, rounds: list[int] | None = None) -> Cover:
    """The covering LP over all patterns, by multiplicative weights, until primal <= (1 + gap) dual.

    size: different ascending lengths below ``capacity``. Prices begin as the best dual solution known. A phase covers the whole demand; in it a length's
    price falls by a factor for every share of its demand that is covered, and after it the prices of those that were covered late have risen for the next one.
    Phases end when the gap is reached, when three in a row have bettered neither side, or when no rounds are left; the least cover is returned. rounds: how many are left, counted down (none given: no bound).
    """
    rounds = [1 << 60] if rounds is None else rounds
    rng = np.random.default_rng(7)
    bound, prior = lower_bound(size, counts, capacity)
    prior = np.maximum(prior, 1e-3 * size / capacity)  # what costs nothing is placed too
    best, worse = None, 0
    while worse < 3 and (best is None or rounds[0] > 0):
        cover, late = phase(size, counts.astype(float), capacity, prior, bound, gap, rng, rounds)
        better = best is None or cover.primal < best.primal * (1 - gap / 100) or cover.dual > bound * (1 + gap / 100)
        worse, bound = 0 if better else worse + 1, max(bound, cover.dual)
        if best is None or cover.primal < best.primal:
            best = cover
        if best.primal <= (1 + gap) * bound:
            break
        prior = prior * np.exp(LATE * (late - np.average(late, weights=size * counts)))
    best.dual = bound
    return best


def phase(size: np.ndarray, demand: np.ndarray, capacity: int, prior: np.ndarray, bound: float, gap: float, rng, most: list[int]) -> tuple[Cover, np.ndarray]:
    """(cover, mean share of each length's demand that was not yet covered).

    Each round prices all rooms at once; of each length the best pattern that holds it is used if it is worth nearly as much as the best of all, by
    fractional steps: no step covers more than STEP of what is left of any length, the width of the step. Ends before all is covered if the gap is reached.
    """
    at = np.zeros(capacity + 1, np.int64)
    at[size] = np.arange(len(size))
    tokens, alone = size * demand, capacity // size
    left, used, dual, late, rounds = demand.copy(), 0.0, bound, np.zeros(len(size)), 0
    kept: list[tuple] = []
    while True:
        primal = used + float((left / alone).sum())
        if primal <= (1 + gap) * dual or float((size * left).sum()) <= gap / 4 * tokens.sum() or most[0] <= 0:
            break
        most[0] -= 1
        share = left / demand
        late, rounds = late + share, rounds + 1
        open_ = share > 1e-6
        y = prior * np.exp(LEARN * (share - np.average(share, weights=tokens)))
        values = np.full(capacity + 1, -np.inf)
        values[size[open_]] = y[open_]
        _, take = price(values, rng.integers(0, capacity, capacity + 1), rng.random(2 * capacity) * (TIES / capacity))
        if rounds % BOUND_EACH == 1:  # ties broken by noise lose value: a bound needs the exact best
            exact, _ = price(values, np.zeros(capacity + 1, np.int64), np.zeros(capacity))
            dual = max(dual, float((y * demand)[open_].sum()) / exact[capacity])
        pattern, index, many = filled(size, at, take)
        value = np.bincount(pattern, weights=y[index] * many, minlength=len(size))
        good = open_ & (value >= (1 - NEARLY) * value[open_].max())
        inside = good[pattern]
        pattern, index, many = pattern[inside], index[inside], many[inside]
        own = np.zeros(len(size))
        own[pattern[pattern == index]] = many[pattern == index]
        total = np.zeros(len(size))
        for _ in range(SUBSTEPS):
            width = STEP * left
            step = np.where(good, width / np.maximum(own, 1), 0.0)
            asked = np.bincount(index, weights=many * step[pattern], minlength=len(size))
            slow = np.minimum(1.0, width / np.maximum(asked, 1e-300))
            rate = np.ones(len(size))
            np.minimum.at(rate, pattern, slow[index])
            step *= rate
            left = np.maximum(0.0, left - np.bincount(index, weights=many * step[pattern], minlength=len(size)))
            total += step
        some = total[pattern] > 1e-9
        used += float(total[total > 1e-9].sum())
        pattern = pattern[some]
        kept.append((index[some], many[some], np.diff(runs(pattern)), total[pattern[runs(pattern)[:-1]]]))
    none = np.zeros(0, np.int64)
    index, many, lens, times = (np.concatenate(c) for c in zip(*kept)) if kept else (none, none, none, np.zeros(0))
    return Cover(index, many, np.concatenate([[0], np.cumsum(lens)]).astype(np.int64), times, left, primal, dual), late / max(1, rounds)


def rounded(cover: Cover, size: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[list[tuple[int, list[tuple[int, int]]]], np.ndarray]:
    """(sequences as of ``plan``, counts that are left): every pattern of the cover by its whole part, then once each, most used first, while its pieces last."""
    left = counts.astype(np.int64)
    edge = cover.edge
    order = np.argsort(-cover.times, kind="stable")
    out: list[tuple[int, list[tuple[int, int]]]] = []
    for whole in (True, False):
        todo = order[cover.times[order] >= 1] if whole else order
        for a in range(0, len(todo), 4096):
            part = todo[a : a + 4096]
            lens = np.diff(edge)[part]
            ends = np.cumsum(lens)
            inside = np.repeat(edge[part] - ends + lens, lens) + np.arange(ends[-1])
            can = np.minimum.reduceat((left[cover.index] >= cover.many)[inside], ends - lens)
            for p in part[can].tolist():
                i, k = cover.index[edge[p] : edge[p + 1]], cover.many[edge[p] : edge[p + 1]]
                n = min(int(cover.times[p]) if whole else 1, int((left[i] // k).min()))
                if n > 0:
                    left[i] -= n * k
                    out.append((n, list(zip(size[i].tolist(), k.tolist()))))
    return out, left


def lp_bins(size: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[list[tuple[int, list[tuple[int, int]]]], np.ndarray]:
    """As of ``rounded``; what rounding leaves is solved again until less than RESIDUE of the tokens are left, or no less than half."""
    bins, left, total, rounds = [], counts, float((size * counts).sum()), [MOST_ROUNDS]
    while (before := float((size * left).sum())) > RESIDUE * total and rounds[0] > 0:
        on = left > 0
        more, rest = rounded(solve(size[on], left[on], capacity, rounds=rounds), size[on], left[on], capacity)
        left = left.copy()
        left[on] = rest
        bins += more
        if float((size * left).sum()) > before / 2:
            break
    return bins, left


def plan(lengths: list[int], counts: list[int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(number of sequences, [(length, how many), ...]), ...] that together place every piece of the histogram.

    The LP's patterns come first, rounded; best fit places what is left. Then the worst filled sequences are dissolved and dealt again, as long as that saves any, so there are never more
    sequences than best fit alone would make.
    """
    order = np.argsort(lengths)
    size, left = np.array(lengths, np.int64)[order], np.array(counts, np.int64)[order]
    out: list[tuple[int, list[tuple[int, int]]]] = []
    whole = size == capacity
    if whole.any():
        out.append((int(left[whole][0]), [(capacity, 1)]))
        size, left = size[~whole], left[~whole]
    if not len(size):
        return out
    bins, rest = lp_bins(size, left, capacity)
    packed = best_fit(size, rest, capacity, bins)
    for share in AGAIN:
        again = dealt_again(packed, size, capacity, share)
        if sum(n for n, _ in again) < sum(n for n, _ in packed):
            packed = again
    return out + packed


def dealt_again(bins: list[tuple[int, list[tuple[int, int]]]], size: np.ndarray, capacity: int, share: float) -> list[tuple[int, list[tuple[int, int]]]]:
    """The sequences, but for a share of the worst filled ones, whose pieces best fit deals to all."""
    todo = int(np.ceil(share * sum(n for n, _ in bins)))
    left = np.zeros(len(size), np.int64)
    kept = []
    for n, what in sorted(bins, key=lambda b: sum(s * k for s, k in b[1])):
        gone = min(n, todo)
        todo -= gone
        for s, k in what:
            left[np.searchsorted(size, s)] += gone * k
        if n > gone:
            kept.append((n - gone, list(what)))
    return best_fit(size, left, capacity, kept)


def best_fit(size: np.ndarray, left: np.ndarray, capacity: int, begun: list[tuple[int, list[tuple[int, int]]]] = ()) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best fit decreasing over a histogram, into what room ``begun`` sequences have too; equal sequences are handled together, so the work follows the
    histogram, not the pieces. Returns all sequences.
    """
    # open sequences: room -> list of [how many, contents]
    rooms: dict[int, list[list]] = {}
    keys: list[int] = []

    def add(room: int, n: int, what: tuple) -> None:
        if room not in rooms:
            rooms[room] = []
            insort(keys, room)
        rooms[room].append([n, what])

    for n, what in begun:
        add(capacity - sum(s * k for s, k in what), n, tuple(what))
    for s, n in zip(size[::-1].tolist(), left[::-1].tolist()):
        while n > 0:
            at = bisect_left(keys, s)
            if at == len(keys):  # no open sequence has room: open full stacks of this length, and one partial stack
                per = capacity // s
                if n >= per:
                    add(capacity - per * s, n // per, ((s, per),))
                if n % per:
                    add(capacity - (n % per) * s, 1, ((s, n % per),))
                n = 0
                break
            room = keys[at]
            group = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
                keys.pop(at)
            m = min(n, group[0])
            add(room - s, m, (*group[1], (s, 1)))
            if group[0] > m:
                add(room, group[0] - m, group[1])
            n -= m
    return [(n, list(what)) for groups in rooms.values() for n, what in groups]


def slots(bins: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """length -> (first rank, first sequence, places in a sequence, offset) of each run of its slots."""
    by: dict[int, list[list[int]]] = {}
    reached: dict[int, int] = {}
    base = 0
    for n, what in bins:
        at = 0
        for s, k in what:
            by.setdefault(s, []).append([reached.get(s, 0), base, k, at])
            reached[s] = reached.get(s, 0) + n * k
            at += s * k
        base += n
    return {s: tuple(np.array(c, np.int64) for c in zip(*rows)) for s, rows in by.items()}


def pack(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset), one row for each piece.

    docs: doc_id, text; other columns are ignored. A null or empty text is a document of one id (end_id). Repeated rows are packed
    as documents of their own. An empty table packs into nothing. Sequences are gapless from offset 0.
    Memory: the driver holds the length histogram and the plan; a task holds an Arrow batch or a part of one length.
    """
    cut = materialise(pieces(docs, path, capacity, end_id, with_ids))
    found = cut.groupBy("length").count().collect()  # at most ``capacity`` rows
    lengths, counts = [r[0] for r in found], [r[1] for r in found]
    parts = max(1, -(-sum(counts) // PART_ROWS))
    places = slots(plan(lengths, counts, capacity))
    salted = cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)))
    sizes = salted.groupBy("length", "part").count()
    before = sizes.select("length", "part", (F.sum("count").over(Window.partitionBy("length").orderBy("part")) - F.col("count")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece")) - 1
    ranked = salted.withColumn("rank", rank).join(before, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("before"))
    shared = docs.sparkSession.sparkContext.broadcast(places)  # as large as the plan, which is bounded by the histogram

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n = length.to_numpy()
        r = rank.to_numpy()
        seq, off = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        order = np.argsort(n, kind="stable")
        edge = np.flatnonzero(np.diff(n[order], prepend=-1))
        for a, b in zip(edge, [*edge[1:], len(n)]):
            rows = order[a:b]
            s = int(n[rows[0]])
            first, base, k, at = shared.value[s]
            j = np.searchsorted(first, r[rows], "right") - 1
            q = r[rows] - first[j]
            seq[rows] = base[j] + q // k[j]
            off[rows] = at[j] + (q % k[j]) * s
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    ids = ["ids"] * with_ids
    return ranked.withColumn("place", place("length", "rank")).select("doc_id", "piece", "start", "length", "ids_crc32", *ids, "place.sequence_id", "place.offset")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each piece of every document, with its place in a sequence of 4096 ids; a null text is the end id alone."""
    return pack(table(spark, sf_dir, "documents"), default_path())
