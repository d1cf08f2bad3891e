"""N-gram Jaccard join by vertical partitioning.

A document's shingles are put in one global order (that of their 64-bit hashes) and the order is cut into fragments. If two sets are
similar enough, they differ in fewer shingles than there are fragments, so in at least one fragment they agree altogether:
equal signatures of fragments give the candidates. A candidate must also have a parity sketch near the other's: a sketch XORs
one bit for each shingle, so two sketches differ in no more bits than the sets do in shingles, and a fragment that holds
nothing but a frequent passage joins no strangers. Candidates are then verified in blocks: each fragment's partial
overlaps are counted apart, as a product of 0/1 matrices, and summed for each pair.

How many fragments are needed depends on the sets' size; sizes are cut into classes, and a set that can
have a partner in the next class signs there too. Documents with equal sets are collapsed to the one with the smallest id
before anything is joined. A bucket's members meet at its first member, where close sketches give a spanning forest, never all
pairs; connected candidates make a cluster, and inside it every pair is compared. Large buckets and clusters are compared in a grid of
block pairs, each of which returns a spanning forest. So no stage emits the pairs of a
group, and no task holds more than two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, Scratch, components, materialise, mix64, powers, prefix_hash, prepare, runs, slices, span_hash, table, text_arrays, trimmed, words

#: Sets that a block of a cluster may hold, and sketches that a block of a bucket's members may.
BLOCK, NEAR_BLOCK = 512, 4096
#: Ratio of the smallest sizes of neighbouring size classes.
CLASS_RATIO = 1.5
#: Columns of a fragment's 0/1 matrix at a time.
FRAGMENT = 4096


def shingles(raw: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of all rows, in order of row and hash; where each row's begin, and the number of all)."""
    n = len(offsets) - 1
    data = LOWER[raw]
    start, end, row = words(data, offsets)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    word = span_hash(prefix_hash(data), start, end)
    # a shingle's hash is a polynomial of its words' hashes
    mult = powers(0xC2B2AE3D27D4EB4F, k + 1)
    m = len(word)
    last = np.minimum(np.searchsorted(row, row, "right"), m)  # end of each word's row
    whole = np.arange(m) + k <= last
    code = np.zeros(m, np.uint64)
    for j in range(k):
        code[: m - j] += word[j:] * mult[j]
    first = np.searchsorted(row, np.arange(n))
    count = np.searchsorted(row, np.arange(n), "right") - first
    for r in np.flatnonzero((count > 0) & (count < k)):  # fewer words than a shingle has: the whole sequence is one
        i = first[r]
        code[i] = (word[i : i + count[r]] * mult[: count[r]]).sum(dtype=np.uint64) + np.uint64(count[r])
        whole[i] = True
    code, row = mix64(code[whole]), row[whole]
    order = np.lexsort((code, row)) if n > 1 else np.argsort(code)
    code, row = code[order], row[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (row[1:] != row[:-1])
    code, row = code[new], row[new]
    return code, np.searchsorted(row, np.arange(n + 1))


class Similarity:
    """Jaccard similarity of at least num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        bounds = [1]
        while bounds[-1] < 1 << 40:
            bounds.append(max(bounds[-1] + 1, int(bounds[-1] * CLASS_RATIO)))
        self.bounds = np.array(bounds, np.int64)

    def linked(self, overlap, a, b):
        return (self.den * overlap >= self.num * (a + b - overlap)) & (overlap > 0)

    def size_class(self, n: int) -> int:
        return int(np.searchsorted(self.bounds, n, "right")) - 1

    def apart(self, total):
        """How many shingles two linked sets of ``total`` shingles together can differ by."""
        # overlap >= num (a + b) / (num + den), so the symmetric difference a + b - 2 overlap is at most (a + b)(den - num) / (den + num)
        return total * (self.den - self.num) // (self.den + self.num)

    def widest(self, c: int) -> int:
        return self.apart(2 * (int(self.bounds[c + 1]) - 1))

    def classes(self, n: int) -> list[int]:
        """The classes a set of size n signs in: its own, and the next if a partner can be there."""
        c = self.size_class(n)
        return [c, c + 1] if self.num * int(self.bounds[c + 1]) <= self.den * n else [c]

    def signatures(self, s: np.ndarray, c: int) -> np.ndarray:
        """Signatures in class c of the fragments of the set s.

        Sets that differ by d agree in all but d of the d + 1 + spare fragments. Empty fragments sign nothing: a set with no more than
        ``spare`` of them still agrees with its partner in one that is not empty. A set with more signs at the next level too, whose order
        and fragments are others; so does a partner that agrees with it in empty fragments only. At the last level empty ones sign.
        """
        d = self.widest(c)
        spare = d // 10 + 1
        f, out = d + 1 + spare, []
        for level in range(8):
            order = s if level == 0 else np.sort(mix64(s + np.uint64(level)))
            total = np.zeros(len(order) + 1, np.uint64)
            np.cumsum(mix64(order), out=total[1:])
            # fragment of a hash: its high 32 bits, scaled to [0, f)
            cut = np.searchsorted((order >> np.uint64(32)) * np.uint64(f) >> np.uint64(32), np.arange(f + 1))
            tag = np.arange(f, dtype=np.uint64) * np.uint64(1 << 20) + np.uint64(c * 16 + level + 1)
            sign = mix64(total[cut[1:]] - total[cut[:-1]] + mix64(tag))
            full = cut[1:] > cut[:-1]
            out.append(sign if level == 7 else sign[full])
            if f - int(full.sum()) <= spare:
                break
        return np.concatenate(out)

    def sketch(self, s: np.ndarray, c: int) -> np.ndarray:
        """Parity sketch of class c: four bits and more for each shingle that linked sets can differ by."""
        bits = 64 * (4 * self.widest(c) // 64 + 1)
        odd = np.bincount((mix64(s) >> np.uint64(32)) * np.uint64(bits) >> np.uint64(32), minlength=bits) & 1
        return np.packbits(odd.astype(np.uint8))


def sketch(docs: DataFrame, k: int, sim: Similarity) -> DataFrame:
    """(doc_id, n, h1, h2, sketches array<struct<c, sketch>>): size, 128-bit digest, and the sketch in each class."""
    prepare(docs.sparkSession)
    kind = pa.list_(pa.struct([("c", pa.int64()), ("sketch", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = text_arrays(batch.column(1))
            for i, j in slices(off):
                code, at = shingles(raw[off[i] : off[j]], off[i : j + 1] - off[i], k)
                digest = []
                for p in (np.uint64(0), np.uint64(0xA5A5A5A5A5A5A5A5)):
                    t = np.zeros(len(code) + 1, np.uint64)
                    np.cumsum(mix64(code ^ p), out=t[1:])
                    digest.append(pa.array((t[at[1:]] - t[at[:-1]]).view(np.int64)))
                sets = [code[at[r] : at[r + 1]] for r in range(j - i)]
                sketches = pa.array([[{"c": c, "sketch": sim.sketch(s, c).tobytes()} for c in sim.classes(len(s))] if len(s) else [] for s in sets], kind)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(at)), *digest, sketches], ["doc_id", "n", "h1", "h2", "sketches"])

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), "doc_id long, n long, h1 long, h2 long, sketches array<struct<c: long, sketch: binary>>")


def sign(docs: DataFrame, k: int, sim: Similarity) -> DataFrame:
    """(sig, doc_id, c): a row for each fragment signature of each document's set, in each of its classes."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column(0).to_numpy()
            raw, off = text_arrays(batch.column(1))
            for i, j in slices(off):
                code, at = shingles(raw[off[i] : off[j]], off[i : j + 1] - off[i], k)
                sigs, docs_, classes = [], [], []
                for r in range(j - i):
                    if at[r + 1] > at[r]:
                        s = code[at[r] : at[r + 1]]
                        for c in sim.classes(len(s)):
                            g = sim.signatures(s, c).view(np.int64)
                            sigs.append(g)
                            docs_.append(np.full(len(g), doc[i + r]))
                            classes.append(np.full(len(g), c, np.int16))
                if sigs:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (sigs, docs_, classes)], ["sig", "doc_id", "c"])

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), "sig long, doc_id long, c short")


def meetings(signed: DataFrame) -> DataFrame:
    """(head, c, doc_id): each document with the first one of every bucket of equal signatures. signed: (sig, doc_id, c).

    Buckets are streamed in sorted order: none is held, whatever its size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first = None, None
        for batch in batches:
            sig, doc, c = (x.to_numpy(zero_copy_only=False) for x in batch.columns)
            if not len(sig):
                continue
            edge = runs(sig)
            head = doc[edge[:-1]].copy()
            if sig[0] == last:
                head[0] = first
            centre = np.repeat(head, np.diff(edge))
            last, first = sig[-1], head[-1]
            keep = centre != doc
            if keep.any():
                rows = np.unique(np.stack([centre[keep], c[keep].astype(np.int64), doc[keep]]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1]), pa.array(rows[2])], ["head", "c", "doc_id"])

    return signed.repartition("sig").sortWithinPartitions("sig", "doc_id").mapInArrow(trimmed(run), "head long, c long, doc_id long").distinct()


def gridded(groups: DataFrame, key: list[str], member: str, block: int) -> DataFrame:
    """groups with (cell, left, right): the members of a group of more than ``block`` are dealt to blocks, and any two blocks meet in a cell of their own.

    Inside a cell, rows that are ``left`` are to be compared with rows that are ``right``. A smaller group is one cell.
    """
    sizes = groups.groupBy(*key).agg(F.ceil(F.count("*") / block).alias("blocks"))
    x = groups.join(sizes.where("blocks > 1"), key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    x = x.withColumn("block", F.pmod(F.xxhash64(member), F.col("blocks")))
    x = x.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cell = F.xxhash64(*key, F.least("block", "other"), F.greatest("block", "other")).alias("cell")
    return x.select(*groups.columns, cell, (F.col("block") <= F.col("other")).alias("left"), (F.col("block") >= F.col("other")).alias("right"))


def near(cells: DataFrame, sim: Similarity) -> DataFrame:
    """(a, b): edges that connect the documents of each cell whose sketches are close. cells: (cell, left, right, doc_id, n, sketch), two blocks at most in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ids, sizes, sketches, left, right = None, [], [], [], [], []

        def close() -> list[tuple[int, int]]:
            m = len(ids)
            if m < 2:
                return []
            # left-only first, then both, then right-only, so that either side is a run
            order = sorted(range(m), key=lambda x: (right[x], not left[x]))
            d = [ids[x] for x in order]
            bits = np.frombuffer(b"".join(sketches[x] for x in order), np.uint64).reshape(m, -1)
            size = np.array(sizes, np.int64)[order]
            n_left, first_right = sum(left), m - sum(right)
            i, j = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for a in range(0, n_left, 256):
                to = min(a + 256, n_left)
                for b in range(max(a, first_right), m, 1024):
                    x, y = size[a:to, None], size[None, b : b + 1024]
                    p, q = np.nonzero(sim.num * np.maximum(x, y) <= sim.den * np.minimum(x, y))
                    fit = p + a < q + b
                    p, q = p[fit] + a, q[fit] + b
                    if len(p):
                        differ = np.zeros(len(p), np.int64)
                        for w in range(0, bits.shape[1], 16):
                            differ += np.bitwise_count(bits[p, w : w + 16] ^ bits[q, w : w + 16]).sum(axis=1, dtype=np.int64)
                        fit = differ <= sim.apart(size[p] + size[q])
                        # reduced tile by tile, so that no group's pairs are held
                        kept = forest(np.concatenate([i, p[fit]]), np.concatenate([j, q[fit]]), m)
                        i, j = np.array([k[0] for k in kept], np.int64), np.array([k[1] for k in kept], np.int64)
            return [(d[p], d[q]) for p, q in zip(i.tolist(), j.tolist())]

        for batch in batches:
            out: list[tuple[int, int]] = []
            for cell, l_, r_, doc, n, sketch in zip(*(x.to_pylist() for x in batch.columns)):
                if cell != last:
                    out += close()
                    last, ids, sizes, sketches, left, right = cell, [], [], [], [], []
                ids.append(doc)
                sizes.append(n)
                sketches.append(sketch)
                left.append(l_)
                right.append(r_)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["a", "b"])
        if out := close():
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["a", "b"])

    return cells.repartition("cell").sortWithinPartitions("cell").select("cell", "left", "right", "doc_id", "n", "sketch").mapInArrow(trimmed(run), "a long, b long")


def overlaps(sets: list[np.ndarray], rows: slice, cols: slice) -> np.ndarray:
    """Sizes of the intersections of sets[rows] with sets[cols]: partial overlaps of each fragment of the global order, summed."""
    size = [len(s) for s in sets]
    code = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(code, kind="stable")
    edge = runs(code[order])
    shared = np.diff(edge) > 1  # a shingle of one set alone overlaps nothing
    col = np.repeat(np.where(shared, np.cumsum(shared) - 1, -1), np.diff(edge))
    owner, col = owner[order][col >= 0], col[col >= 0]
    total = np.zeros((len(range(*rows.indices(len(sets)))), len(range(*cols.indices(len(sets))))), np.float32)
    for f in range(0, int(shared.sum()), FRAGMENT):
        a, b = np.searchsorted(col, [f, f + FRAGMENT])
        m = np.zeros((len(sets), FRAGMENT), np.float32)
        m[owner[a:b], col[a:b] - f] = 1
        total += m[rows] @ m[cols].T
    return total


def forest(i: np.ndarray, j: np.ndarray, n: int) -> list[tuple[int, int]]:
    """A spanning forest of the links (i, j) on n nodes."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in zip(i.tolist(), j.tolist()):
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[rb] = ra
            out.append((a, b))
    return out


def verify(members: DataFrame, k: int, sim: Similarity) -> DataFrame:
    """(a, b): links that connect what is linked in each cell. members: (cell long, left boolean, right boolean, doc_id, text).

    Inside a cell, rows that are ``left`` are compared with rows that are ``right``. Rows come sorted by cell, and a task holds the sets of one cell (two
    blocks at most).
    """
    prepare(members.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ids, sets, left, right = None, [], [], [], []

        def close() -> list[tuple[int, int]]:
            if len(ids) < 2:
                return []
            # left-only first, then both, then right-only, so that either side is a run
            order = sorted(range(len(ids)), key=lambda x: (right[x], not left[x], ids[x]))
            s, d = [sets[x] for x in order], [ids[x] for x in order]
            n_left, first_right = sum(left), len(ids) - sum(right)
            o = overlaps(s, slice(0, n_left), slice(first_right, len(s)))
            size = np.array([len(x) for x in s], np.int64)
            i, j = np.nonzero(sim.linked(o.astype(np.int64), size[:n_left, None], size[None, first_right:]))
            j = j + first_right
            keep = i < j
            return [(d[a], d[b]) for a, b in forest(i[keep], j[keep], len(s))]

        for batch in batches:
            out: list[tuple[int, int]] = []
            raw, off = text_arrays(batch.column(4))
            cell, l_, r_, doc = (c.to_pylist() for c in batch.columns[:4])
            for i, j in slices(off):
                code, at = shingles(raw[off[i] : off[j]], off[i : j + 1] - off[i], k)
                for r in range(i, j):
                    if cell[r] != last:
                        out += close()
                        last, ids, sets, left, right = cell[r], [], [], [], []
                    ids.append(doc[r])
                    sets.append(code[at[r - i] : at[r - i + 1]].copy())
                    left.append(l_[r])
                    right.append(r_[r])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])
        out = close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])

    return members.repartition("cell").sortWithinPartitions("cell").select("cell", "left", "right", "doc_id", "text").mapInArrow(trimmed(run), "a long, b long")


def jaccard_join(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(doc_id, n_shingles, component_id): each document's set size and the smallest doc_id it is linked with, over any number of links.

    docs: doc_id, text; other columns are ignored. Two documents link when den * intersection >= num * union. Null or empty texts, and
    those without words, have an empty set and are linked with nothing. A doc_id on several rows is one document, with the
    smallest of its texts; a null doc_id takes no part. An empty table gives an empty one.
    """
    sim = Similarity(num, den)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    with Scratch(docs.sparkSession) as scratch:
        sets = materialise(sketch(docs, k, sim))
        if sets.count() != sets.select("doc_id").distinct().count():
            docs = docs.groupBy("doc_id").agg(F.min("text").alias("text"))
            sets = materialise(sketch(docs, k, sim))
        # Equal sets. The joins below are merge joins at every size: their small sides grow with the corpus.
        twins = sets.where("n > 0").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"))
        reps = materialise(sets.select("doc_id", "n", "h1", "h2").join(twins, ["h1", "h2", "n"], "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep")))
        only = docs.join(reps.where("doc_id <> rep").select("doc_id").hint("merge"), "doc_id", "left_anti")
        met = materialise(meetings(sign(only, k, sim)))
        groups = met.union(met.select("head", "c", F.col("head").alias("doc_id")).distinct())
        sketches = sets.select("doc_id", "n", F.inline("sketches"))
        clusters = components(near(gridded(groups, ["head", "c"], "doc_id", NEAR_BLOCK).hint("merge").join(sketches, ["doc_id", "c"]), sim))
        cells = gridded(clusters.select(F.col("id").alias("doc_id"), "component"), ["component"], "doc_id", BLOCK)
        joined = components(verify(cells.hint("merge").join(docs, "doc_id"), k, sim))
        scratch.keep(reps)
        scratch.keep(joined)
    out = reps.join(joined, reps["rep"] == joined["id"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document: three-word shingles, similarity of 0.9 or more. Null and empty texts: 0 shingles, a component of their own."""
    return jaccard_join(table(spark, sf_dir, "documents"), 3, 90, 100)


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sh AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM d
), x AS (
  SELECT doc_id, unnest(s) AS g, len(s) AS n FROM sh
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
  HAVING 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))
), r(id, c) AS (
  SELECT a, b FROM links UNION SELECT r.id, links.b FROM r JOIN links ON links.a = r.c
), least_ AS (
  SELECT id, min(c) AS c FROM r GROUP BY 1
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(c, doc_id)) AS component_id FROM sh LEFT JOIN least_ ON id = doc_id
"""
