"""Repeated substrings over a corpus, by a logarithmic family of suffix arrays.

A full suffix array of the corpus would sort every byte. Here each string of ``length`` bytes is represented by its minimiser: the
position in it whose next ``SEED`` bytes hash lowest (leftmost on ties). Equal strings have it at the same place, so two equal
strings are two suffixes that start at such anchors, agree to the right, and whose texts before the anchors agree to the
left. Only anchors whose seed occurs again can matter; these go, with the text of the strings they stand for, to a
task chosen by their seed.

There, arrivals are handled in batches. A batch gets two suffix arrays with common-prefix lengths: its contexts sorted by
the text from the anchor on, and by the text before the anchor read backwards. It is merge-scanned against itself and every level of the
index family, then becomes a level; levels of about equal size merge, so there are logarithmically many.
A seed of very many documents (a short passage that stands in a third of them) would be one task's. A string of ``length`` bytes around an
anchor has (length + seed) / 2 bytes from it on, or (length - seed) / 2 before it; so contexts of such a seed go to two groups, by a hash of the
one and of the other, and any two that share a string meet in one of them.
In a scan, a string that begins j bytes before its anchor is repeated if another context is in the same class of the left array
(j common bytes) and in the same class of the right one (length - j common bytes); classes are running counts over the arrays, so no
pairs are formed. Contexts that are equal altogether are one entry, and copies of a known one are answered at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BASE_INV, materialise, mix64, powers, prefix_hash, prepare, runs, slices, table, text_arrays, trimmed

#: Bytes that an anchor's seed covers.
SEED = 64
#: Contexts in a batch of the index, and documents with a seed from which its contexts are told apart by more than the seed.
BATCH = 16_000
HOT = 2000
#: Bytes of a group's number.
SIGN = 8


def seed_length(length: int) -> int:
    return min(SEED, max(1, length // 2))


def anchors(raw: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(row, anchor, first string start, last string start, seed hash) of every anchor; positions in raw."""
    s = seed_length(length)
    w, n = length - s + 1, len(raw)
    none = np.zeros(0, np.int64)
    if n < length or not (np.diff(offsets) >= length).any():
        return none, none, none, none, none.view(np.uint64)
    p = prefix_hash(raw)
    h = (p[s:] - p[:-s]) * powers(BASE_INV, n + 1)[: n - s + 1]
    m = len(h)
    key = (h * np.uint64(0x9FB21C651E98DF25)) & np.uint64(0xFFFFFFFF00000000)
    key |= np.arange(m, dtype=np.uint64)
    size = -(-m // w) * w
    grid = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    grid[:m] = key
    grid = grid.reshape(-1, w)
    head = np.minimum.accumulate(grid, axis=1).reshape(-1)
    tail = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    least = np.minimum(tail[: m - w + 1], head[w - 1 : m])
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)  # the anchor of the string that starts here
    ok = np.zeros(len(at), bool)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= length:
            ok[a : b - length + 1] = True
    start = np.flatnonzero(ok)
    edge = np.flatnonzero(np.concatenate([[True], (at[start][1:] != at[start][:-1]) | (np.diff(start) > 1)]))
    first, last = start[edge], start[np.concatenate([edge[1:], [len(start)]]) - 1]
    anchor = at[first]
    return np.searchsorted(offsets, first, "right") - 1, anchor, first, last, mix64(h[anchor])


class Level:
    """Contexts in both orders. right: bytes from the anchor on; left: the group's number, then the bytes before the anchor, backwards; both padded with zeros."""

    def __init__(self, ids: np.ndarray, right: np.ndarray, left: np.ndarray, lo: np.ndarray, hi: np.ndarray, seed: np.ndarray, by_right=None, by_left=None):
        self.ids, self.right, self.left, self.lo, self.hi, self.seed = ids, right, left, lo, hi, seed
        self.by_right = np.argsort(_key(right), kind="stable") if by_right is None else by_right
        self.by_left = np.argsort(_key(left), kind="stable") if by_left is None else by_left

    def __len__(self) -> int:
        return len(self.ids)

    def part(self, keep: np.ndarray) -> Level:
        new = np.cumsum(keep) - 1
        r, l_ = self.by_right[keep[self.by_right]], self.by_left[keep[self.by_left]]
        return Level(self.ids[keep], self.right[keep], self.left[keep], self.lo[keep], self.hi[keep], self.seed[keep], new[r], new[l_])

    def merged(self, other: Level) -> Level:
        n = len(self)
        both = [np.concatenate([getattr(self, f), getattr(other, f)]) for f in ("ids", "right", "left", "lo", "hi", "seed")]
        return Level(*both, _merge(self.right, self.by_right, other.right, other.by_right, n), _merge(self.left, self.by_left, other.left, other.by_left, n))


def _key(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").reshape(-1)


def _merge(a: np.ndarray, a_order: np.ndarray, b: np.ndarray, b_order: np.ndarray, n: int) -> np.ndarray:
    """The order of two sorted orders together."""
    place = np.searchsorted(_key(a[a_order]), _key(b[b_order]), "right") + np.arange(len(b_order))
    out = np.empty(len(a_order) + len(b_order), np.int64)
    taken = np.zeros(len(out), bool)
    taken[place] = True
    out[place] = b_order + n
    out[~taken] = a_order
    return out


def _common(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common-prefix length of each row with the one before it in order."""
    out = np.zeros(len(order), np.int64)
    for i in range(1, len(order), 20_000):
        j = min(len(order), i + 20_000)
        differ = rows[order[i:j]] != rows[order[i - 1 : j - 1]]
        out[i:j] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return out


class Family:
    """The index of one task."""

    def __init__(self, length: int):
        self.length, self.seed = length, seed_length(length)
        self.levels: list[Level] = []
        self.known: dict[bytes, int] = {}
        # of each context: first and last repeated string (bytes before the anchor; least > most: none), and its only place so far
        self.least, self.most = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.place: list[tuple | None] = []

    def add(self, contexts: list[tuple[int, int, bytes, list, list, list]]) -> list[tuple[int, int, int, int]]:
        """Takes (seed, lead, text, docs, hashes, starts); returns covered (doc, hash, start, end) that are certain by now."""
        out: list[tuple[int, int, int, int]] = []
        new: list[tuple[int, int, bytes]] = []
        n = len(self.place)
        for seed, lead, text, docs, hashes, starts in contexts:
            key = hashlib.blake2b(text, digest_size=16, salt=lead.to_bytes(8, "little"), person=seed.to_bytes(8, "little", signed=True)).digest()
            i = self.known.get(key)
            places = list(zip(docs, hashes, starts))
            if i is None:
                self.known[key] = i = len(self.place)
                new.append((seed, lead, text))
                self.place.append(None if len(places) > 1 else (*places[0], lead, len(text)))
                if len(places) == 1:
                    continue
            elif self.place[i] is not None:
                d, h, a, *_ = self.place[i]
                places.append((d, h, a))
                self.place[i] = None
            out += [(d, h, a, a + len(text)) for d, h, a in places]
        if new:
            lead = np.array([c[1] for c in new], np.int64)
            size = np.array([len(c[2]) for c in new], np.int64)
            count = size - self.length + 1
            self.least = np.concatenate([self.least, np.full(len(new), 1 << 40)])
            self.most = np.concatenate([self.most, np.full(len(new), -1)])
            seed = np.array([c[0] for c in new], np.int64)
            right, left = self._sides([c[2] for c in new], lead, size)
            left = np.hstack([seed.astype("<i8").view(np.uint8).reshape(-1, SIGN), left])  # a context may be in two groups, where it is no copy of itself
            level = Level(np.arange(n, len(self.place)), right, left, lead - count + 1, lead, seed)
            self._scan(level)
            for old in self.levels:
                self._scan(old.part(np.isin(old.seed, level.seed)).merged(level.part(np.isin(level.seed, old.seed))))
            self.levels.append(level)
            while len(self.levels) > 1 and len(self.levels[-2]) <= 2 * len(self.levels[-1]):
                b, a = self.levels.pop(), self.levels.pop()
                self.levels.append(a.merged(b))
        return out

    def close(self) -> list[tuple[int, int, int, int]]:
        """What partly repeated contexts cover. Their strings overlap, so the cover is one run."""
        out = []
        for i in np.flatnonzero(self.most >= 0).tolist():
            if (p := self.place[i]) is not None:
                d, h, a, lead, _ = p
                out.append((d, h, a + lead - int(self.most[i]), a + lead - int(self.least[i]) + self.length))
        return out

    def _sides(self, texts: list[bytes], lead: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(b"".join(texts), np.uint8)
        at = np.cumsum(size) - size
        sides = []
        for width, begin, step, have in ((self.length, lead, 1, size - lead), (max(1, self.length - self.seed), lead - 1, -1, lead)):
            rows = np.zeros((len(texts), width), np.uint8)
            for i in range(0, len(texts), 4000):
                c = np.arange(width)
                inside = c < have[i : i + 4000, None]
                where = (at + begin)[i : i + 4000, None] + step * c
                rows[i : i + 4000][inside] = data[where[inside]]
            sides.append(rows)
        return sides[0], sides[1]

    def _scan(self, x: Level) -> None:
        """Marks the repeated strings among the contexts of x."""
        if len(x) < 2:
            return
        order = np.argsort(x.seed, kind="stable")
        edge = runs(x.seed[order])
        group = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
        open_ = np.array([(self.least[i] > lo) or (self.most[i] < hi) for i, lo, hi in zip(x.ids, x.lo, x.hi)], bool)
        some = np.bincount(group, weights=open_[order]) > 0
        keep = np.zeros(len(x), bool)
        keep[order] = ((np.diff(edge) > 1) & some)[group]
        if not keep.any():
            return
        if not keep.all():
            x = x.part(keep)
        n = len(x)
        right, left = _common(x.right, x.by_right), _common(x.left, x.by_left)
        rows = np.arange(n, dtype=np.uint64)
        bits = np.uint64(max(1, int(n).bit_length()))
        cr, cl = np.empty(n, np.uint64), np.empty(n, np.uint64)
        least, most = self.least[x.ids], self.most[x.ids]
        for j in range(int(x.lo.min()), int(x.hi.max()) + 1):
            part = (x.lo <= j) & (j <= x.hi)
            if not part.any():
                continue
            cr[x.by_right] = np.cumsum(right < self.length - j)
            cl[x.by_left] = np.cumsum(left < j + SIGN)
            code = np.sort((((cl << bits) | cr) << bits | rows)[part])
            same = (code[1:] >> bits) == (code[:-1] >> bits)
            if same.any():
                hit = np.zeros(len(code), bool)
                hit[1:] |= same
                hit[:-1] |= same
                r = (code[hit] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
                least[r] = np.minimum(least[r], j)
                most[r] = np.maximum(most[r], j)
        self.least[x.ids], self.most[x.ids] = least, most


def keyed(docs: DataFrame, carry: list[str] = ()) -> DataFrame:
    """(doc, th, doc_id, text, and the carried columns): rows are told apart by id and text, so equal rows are treated alike."""
    text = F.coalesce(F.col("text"), F.lit(""))
    ids = F.col("doc_id").cast("long")
    return docs.select(F.coalesce(ids, F.lit(-(1 << 63))).alias("doc"), F.xxhash64(text).alias("th"), ids.alias("doc_id"), text.alias("text"), *carry)


def covers(rows: DataFrame, length: int) -> DataFrame:
    """(doc, th, spans array<struct<s, e>>): bytes of each document covered by a repeated string; spans may overlap. rows: as of ``keyed``."""
    spark = rows.sparkSession
    prepare(spark)

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, th = (c.to_numpy() for c in batch.columns[:2])
            raw, off = text_arrays(batch.column(2))
            for i, j in slices(off):
                row, *_, seed = anchors(raw[off[i] : off[j]], off[i : j + 1] - off[i], length)
                if len(row):
                    # one row for each seed of a document: how often it is there decides
                    order = np.lexsort((seed, row))
                    row, seed = row[order], seed[order]
                    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (seed[1:] != seed[:-1])]))
                    many = np.diff(np.concatenate([new, [len(row)]])) > 1
                    r = row[new] + i
                    yield pa.RecordBatch.from_arrays([pa.array(seed[new].view(np.int64)), pa.array(doc[r]), pa.array(th[r]), pa.array(many)], ["seed", "doc", "th", "many"])

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by seed; those of a seed that stands alone go."""
        held, told = None, False  # the row that may still be alone
        names = ["seed", "doc", "th"]
        for batch in batches:
            seed, doc, th, many = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(seed):
                continue
            if held is not None:
                seed, doc, th, many = (np.concatenate([[h], c]).astype(c.dtype) for h, c in zip(held, (seed, doc, th, many)))
            twice = many.astype(bool).copy()
            same = seed[1:] == seed[:-1]
            twice[1:] |= same
            twice[:-1] |= same
            held = (seed[-1], doc[-1], th[-1], bool(twice[-1]))
            out = twice.copy()
            if told:
                out[0] = False  # went out with the batch before
            told = bool(twice[-1])
            if out.any():
                yield pa.RecordBatch.from_arrays([pa.array(seed[out]), pa.array(doc[out]), pa.array(th[out])], names)

    half = (length - seed_length(length)) // 2  # bytes before an anchor; with one less, length - half are from it on

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["seed", "lead", "text", "docs", "hashes", "starts"]
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()))

        def group(seed: int, side: bytes) -> int:
            return int.from_bytes(hashlib.blake2b(side, digest_size=8, key=seed.to_bytes(8, "little", signed=True)).digest(), "little", signed=True)

        for batch in batches:
            doc, th = (c.to_numpy() for c in batch.columns[:2])
            raw, off = text_arrays(batch.column(2))
            wanted, hot = batch.column(3), batch.column(4)
            for i, j in slices(off):
                part, base = raw[off[i] : off[j]], off[i : j + 1] - off[i]
                row, anchor, first, last, seed = anchors(part, base, length)
                want = wanted.slice(i, j - i).flatten().to_numpy(zero_copy_only=False)
                many = set(hot.slice(i, j - i).flatten().to_pylist())
                keep = np.isin(seed.view(np.int64), want)
                data = part.tobytes()
                found: dict[tuple[int, bytes], list] = {}
                for r, a, b, c, s in zip(*(v[keep].tolist() for v in (row, anchor, first, last, seed.view(np.int64)))):
                    entry = found.setdefault((a - b, data[b : c + length]), [s, [], [], []])
                    entry[1].append(int(doc[i + r]))
                    entry[2].append(int(th[i + r]))
                    entry[3].append(b - int(base[r]))
                out = []
                for (lead, text), e in found.items():
                    groups = [e[0]]
                    if e[0] in many:
                        groups = [group(e[0], b"<" + text[lead - half : lead])] if lead >= half else []
                        if len(text) - lead > length - half:
                            groups.append(group(e[0], b">" + text[lead : lead + length - half + 1]))
                    out += [(g, lead, text, e[1], e[2], e[3]) for g in groups]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, waiting = Family(length), []

        def rows_of(spans: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*spans)], ["doc", "th", "s", "e"])

        for batch in batches:
            waiting += zip(*(c.to_pylist() for c in batch.columns))
            while len(waiting) >= BATCH:
                spans = family.add(waiting[:BATCH])
                waiting = waiting[BATCH:]
                if spans:
                    yield rows_of(spans)
        spans = (family.add(waiting) if waiting else []) + family.close()
        if spans:
            yield rows_of(spans)

    one = rows.select("doc", "th", "text").mapInArrow(trimmed(seeds), "seed long, doc long, th long, many boolean")
    again = materialise(one.repartition("seed").sortWithinPartitions("seed").mapInArrow(trimmed(repeated), "seed long, doc long, th long"))
    hot = again.groupBy("seed").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("seed", F.lit(True).alias("hot"))
    marked = again.join(hot, "seed", "left")
    wanted = marked.groupBy("doc", "th").agg(F.collect_list("seed").alias("wanted"), F.collect_list(F.when(F.col("hot"), F.col("seed"))).alias("hot"))  # no more than a document's own anchors
    found = rows.select("doc", "th", "text", "doc_id").join(wanted.hint("merge"), ["doc", "th"]).select("doc", "th", "text", "wanted", "hot").mapInArrow(trimmed(contexts), "seed long, lead long, text binary, docs array<long>, hashes array<long>, starts array<long>")
    spans = found.repartition("seed").mapInArrow(trimmed(index), "doc long, th long, s long, e long")
    return spans.groupBy("doc", "th").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def union(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching spans."""
    out: list[list[int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in spans or []):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def repeated_spans(docs: DataFrame, length: int) -> DataFrame:
    """(doc_id, text, spans array<struct<s, e>>): every document with the bytes that repeated strings of ``length`` bytes cover.

    docs: doc_id, text; other columns are ignored. Texts are UTF-8 bytes, a null text is empty; strings never cross documents. A string
    is repeated if it starts anywhere else, in the same document too. Equal rows are copies of each other. An empty
    table gives an empty one.
    """
    rows = keyed(docs)
    return rows.select("doc", "th", "text", "doc_id").join(covers(rows, length).hint("merge"), ["doc", "th"], "left").select("doc_id", "text", "spans")


def cut_repeats(docs: DataFrame, length: int, carry: list[str]) -> DataFrame:
    """(doc_id, text, n_removed, and the carried columns): texts without what repeated strings cover.

    Cuts are moved inwards to whole characters. n_removed: bytes cut. docs as for ``repeated_spans``.
    """
    prepare(docs.sparkSession)
    rows = keyed(docs, carry)
    fields = [f for f in rows.schema if f.name in carry]
    names = ["doc_id", "text", "n_removed", *(f.name for f in fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed = [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data, at, kept, n = text.encode(), 0, [], 0
                for s, e in union(spans):
                    while s < e and data[s] & 0xC0 == 0x80:
                        s += 1
                    while e > s and e < len(data) and data[e] & 0xC0 == 0x80:
                        e -= 1
                    kept.append(data[at:s])
                    at, n = e, n + e - s
                kept.append(data[at:])
                texts.append(b"".join(kept).decode())
                removed.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(removed, pa.int64()), *batch.columns[3:]], names)

    extra = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in fields)
    found = rows.join(covers(keyed(docs), length).hint("merge"), ["doc", "th"], "left")
    return found.select("doc_id", "text", "spans", *(f.name for f in fields)).mapInArrow(trimmed(run), f"doc_id long, text string, n_removed long{extra}")


def digest(found: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        for batch in batches:
            out = []
            for i, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data, at, h, gone = text.encode(), 0, hashlib.sha256(), union(spans)
                for s, e in gone:
                    h.update(data[at:s])
                    at = e
                h.update(data[at:])
                out.append((i, len(data), sum(e - s for s, e in gone), len(gone), h.hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return found.mapInArrow(trimmed(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256): every document without what strings of 400 bytes cover that start elsewhere too; n_bytes counts the input. A null text is empty."""
    return digest(repeated_spans(table(spark, sf_dir, "documents"), 400))
