"""Toxic documents by a support vector machine over sentences with a gapped subsequence kernel.

Two strings are alike by the subsequences of ORDER symbols they share, each weighted by DECAY to the power of the bytes it spans, up to SPAN bytes. Digits and marks are no symbols but count
as bytes of a gap, so an insult with a letter or a mark put in still shares most of its subsequences with the plain one. The blank before a word is a symbol too, so a word's beginning tells
more than the same letters inside another. Single letters with one blank or mark between each two are read without these, as one word.

A sentence is a set of units (words), and scores as its highest unit does. The kernel of a unit is taken with a bounded set of landmark words only (Nystroem's
approximation): its features are the kernel values with the landmarks, whitened by the landmarks' own kernel matrix. A linear support vector machine with squared hinge loss learns on them from
labelled sentences. Labels stand on documents, and each sentence has its document's. In a clean sentence every unit counts as clean; in a toxic one those count as toxic that are clearly more
frequent in toxic sentences than in clean ones, and then, round by round, those that score so, or are the highest of their sentence and not clearly clean. Words that tell toxic sentences are learnt with a letter or mark put into each place, too.

A kernel value is a sum over the unit's subsequences; so is the machine's margin. Its weights are therefore folded into one number for each of the 32^ORDER subsequences once, and scoring a text is a
look-up and a sum for each of its subsequences: nothing is shuffled, and the margin is exactly that of all landmarks. A document's score is that of its highest sentence, made a
probability by a logistic fit (Platt's) of the margins of toxic units against the highest margins of clean documents, so that one insult is enough.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, mix64, prepare, slices, table, text_arrays, trimmed

#: Letters of a subsequence, the most bytes it may span, and what each byte of its span multiplies its weight by.
ORDER, SPAN, DECAY = 4, 8, 0.6
#: Documents of each label that a model is fitted on (all, if there are fewer), and the longest text in characters among them.
TRAIN_DOCS, TRAIN_CHARS = 1500, 10_000
#: Landmark words of each label, different units that are learnt from (those in most sentences), and the cost of a sentence on the wrong side.
LANDMARKS, UNITS, COST = 80, 40_000, 3000.0
#: What the variants of a telling word count together, against the word itself.
VARIANTS = 0.5
#: A longer sentence is cut into pieces of about so many bytes, between words; a longer word is more than one unit.
SENTENCE_BYTES, UNIT_BYTES = 240, 32
#: Rounds of fitting and relabelling, and the margin below which no unit of a sentence is taken for toxic.
ROUNDS, DOUBT = 4, -0.5
#: Bytes that one vectorised step scores.
STEP_BYTES = 1 << 18

_SIZE = 32**ORDER
#: Symbols of bytes: a-z (either case) are 1 to 26; bytes inside other characters are 27 to 30, by their remainder; a blank is 31; all else is 0, no symbol.
_SYMBOL = np.zeros(256, np.int32)
_SYMBOL[0x61:0x7B] = np.arange(1, 27)
_SYMBOL[0x41:0x5B] = np.arange(1, 27)
_SYMBOL[0x80:0xC0] = 27 + np.arange(64) % 4
_SYMBOL[[0x20, *range(0x09, 0x0E)]] = 31
#: The places of a subsequence's letters after its first.
_PATTERNS = [p for p in combinations(range(1, SPAN), ORDER - 1)]


def _is(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_BLANK, _STOP, _BREAK = _is(b" \t\n\v\f\r"), _is(b".!?"), _is(b"\n\r")


def led(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same rows, a blank before each; what stands between single letters that stand apart, three or more, is gone."""
    n = len(data)
    if n:
        letter = np.zeros(n + 4, bool)
        letter[2:-2] = (_SYMBOL[data] > 0) & ~_BLANK[data]
        edge = np.zeros(n + 4, bool)
        edge[offsets + 2] = True
        alone = np.zeros(n + 4, bool)  # letters without one beside them in their row
        alone[2:-2] = letter[2:-2] & ~(letter[1:-3] & ~edge[2:-2]) & ~(letter[3:-1] & ~edge[3:-1])
        between = np.zeros(n + 4, bool)
        between[2:-2] = ~letter[2:-2] & alone[1:-3] & alone[3:-1] & ~edge[2:-2] & ~edge[3:-1]
        gone = between[2:-2] & (between[:-4] | between[4:])
        if gone.any():
            offsets = offsets - np.concatenate([[0], np.cumsum(gone)])[offsets]
            data = data[~gone]
    n = len(offsets) - 1
    out = np.full(len(data) + n, 0x20, np.uint8)
    out[np.arange(len(data)) + np.repeat(np.arange(1, n + 1), np.diff(offsets))] = data
    return out, offsets + np.arange(n + 1)


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, sentence) of the units of rows that begin with a blank. A unit begins at the blank before its word; the first one of a row at the row's first byte.

    A sentence begins with a row, after a line break, and after a word that ends with '.', '!' or '?'; a long one goes on in another.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    blank = _BLANK[data]
    word = ~blank
    word[1:] &= blank[:-1]
    at = np.flatnonzero(word) - 1  # blanks before words
    row = np.searchsorted(offsets, at, "right") - 1
    first = np.ones(len(at), bool)
    first[1:] = row[1:] != row[:-1]
    breaks = np.concatenate([[0], np.cumsum(_BREAK[data])])
    last = np.maximum.accumulate(np.where(blank, 0, np.arange(n)))  # the last byte that is not blank, up to here
    new = first.copy()
    new[1:] |= (breaks[at[1:] + 1] > breaks[at[:-1] + 1]) | _STOP[data[last[at[1:]]]]
    own = at[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(at) else at
    piece = (at - own) // SENTENCE_BYTES
    new[1:] |= piece[1:] > piece[:-1]
    # long words are cut
    size = np.minimum(np.concatenate([at[1:], [n]]), offsets[row + 1]) - at if len(at) else at
    extra = (size - 1) // UNIT_BYTES
    which = np.repeat(np.arange(len(at)), extra)
    place = np.arange(len(which)) - np.repeat(np.cumsum(extra) - extra, extra) + 1
    starts = np.concatenate([np.where(first, offsets[row], at), at[which] + place * UNIT_BYTES])
    of = np.cumsum(new)[np.concatenate([np.arange(len(at)), which])]
    # a row without a word is one unit, of a sentence of its own
    empty = np.setdiff1d(np.arange(len(offsets) - 1), row)
    starts, of = np.concatenate([starts, offsets[empty]]), np.concatenate([of, len(at) + 1 + np.arange(len(empty))])
    order = np.argsort(starts, kind="stable")
    return starts[order], of[order]


def _laid_out(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols with SPAN - 1 blanks after each row, place of each byte of data in them), so that no subsequence crosses rows."""
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    place = np.arange(len(data)) + rows * (SPAN - 1)
    out = np.zeros(len(data) + (len(offsets) - 1) * (SPAN - 1) + SPAN, np.int32)
    out[place] = _SYMBOL[data]
    return out, place


def _codes(symbols: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """For each pattern of gaps: (code of the subsequence that begins at each place, its weight). The last SPAN places begin none."""
    n = len(symbols) - SPAN
    pair = [None] + [(symbols[: n + SPAN - d] << 5) | symbols[d : n + SPAN] for d in range(1, SPAN - 1)]
    for a, b, c in _PATTERNS:
        yield (pair[a][:n] << 10) | pair[c - b][b : b + n], DECAY ** (c + 1)


def margins(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The sum of weights over the subsequences that begin at each byte."""
    symbols, place = _laid_out(data, offsets)
    total = np.zeros(len(symbols) - SPAN, np.float32)
    for code, weight in _codes(symbols):
        total += weights[code] * np.float32(weight)
    return total[place]


def subsequences(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, weight) of every subsequence of letters; a code stands once a row, with the sum of its weights."""
    offsets = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    symbols, place = _laid_out(np.frombuffer(b"".join(words), np.uint8), offsets)
    row_of = np.full(len(symbols), -1)
    row_of[place] = np.repeat(np.arange(len(words)), np.diff(offsets))
    rows, codes, values = [], [], []
    for code, weight in _codes(symbols):
        ok = np.ones(len(code), bool)
        for k in range(ORDER):
            ok &= (code >> 5 * k & 31) > 0
        at = np.flatnonzero(ok)
        rows.append(row_of[at])
        codes.append(code[at])
        values.append(np.full(len(at), weight))
    key = np.concatenate(rows).astype(np.int64) * _SIZE + np.concatenate(codes)
    kinds, back = np.unique(key, return_inverse=True)
    return kinds // _SIZE, kinds % _SIZE, np.bincount(back, np.concatenate(values), len(kinds))


def kernel(a: bytes, b: bytes) -> float:
    """The kernel of two strings, by its definition."""
    r, c, v = subsequences([a, b])
    left, right = dict(zip(c[r == 0].tolist(), v[r == 0])), dict(zip(c[r == 1].tolist(), v[r == 1]))
    return float(sum(x * right.get(k, 0.0) for k, x in left.items()))


@dataclass
class Model:
    """weights: margin of each subsequence; bias: margin of a unit without any; slope, level: of the logistic."""

    weights: np.ndarray
    bias: float
    slope: float
    level: float

    def highest(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The highest margin of each row's units; a row without a word has an empty one, the bias."""
        if len(offsets) < 2:
            return np.zeros(0)
        data, offsets = led(data, offsets)
        starts, _ = units(data, offsets)
        sums = np.add.reduceat(margins(data, offsets, self.weights).astype(np.float64), starts)
        return np.maximum.reduceat(sums, np.searchsorted(starts, offsets[:-1])) + self.bias

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * self.highest(data, offsets) + self.level, -700, 700)))


def svm(x: np.ndarray, toxic: np.ndarray, clean: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, float]:
    """(weights, bias) that minimise |w|^2 / 2 + COST * sum toxic * max(0, 1 - f)^2 + clean * max(0, 1 + f)^2, f = x w + b, by Newton steps with halving. toxic, clean: how often each row is so."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(z.shape[1]), np.ones(z.shape[1])
    ridge[-1] = 1e-6
    scale = COST / max(1.0, float(np.sqrt(toxic.sum() + clean.sum())))
    c1, c0 = scale * toxic, scale * clean

    def loss(f, w_):
        return 0.5 * (ridge * w_ * w_).sum() + (c1 * np.maximum(0, 1 - f) ** 2 + c0 * np.maximum(0, 1 + f) ** 2).sum()

    f = z @ w
    now = loss(f, w)
    for _ in range(rounds):
        up, down = np.where(f < 1, c1, 0.0), np.where(f > -1, c0, 0.0)
        grad = ridge * w + z.T @ (2 * (down * (1 + f) - up * (1 - f)))
        on = (up + down) > 0
        step = np.linalg.solve((z[on].T * (2 * (up + down)[on])) @ z[on] + np.diag(ridge), grad)
        size, zs = 1.0, z @ step
        while loss(f - size * zs, w - size * step) > now - 1e-4 * size * (grad @ step) and size > 1e-6:
            size /= 2
        w, f = w - size * step, f - size * zs
        before, now = now, loss(f, w)
        if before - now <= 1e-8 * before:
            break
    return w[:-1], float(w[-1])


def logistic(margin: np.ndarray, toxic: np.ndarray, weight: np.ndarray, odds: float) -> tuple[float, float]:
    """(slope, level) of Platt's fit with his softened targets to weighted margins; odds: of toxic among all documents to those among the fitted, which moves the level."""
    n1, n0 = weight[toxic].sum(), weight[~toxic].sum()
    target = np.where(toxic, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    z, w = np.stack([margin, np.ones(len(margin))], 1), np.array([0.0, np.log((n1 + 1) / (n0 + 1))])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
        step = np.linalg.solve((z.T * (weight * p * (1 - p))) @ z + 1e-6 * np.eye(2), z.T @ (weight * (p - target)))
        w = w - step * min(1.0, 4.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1] + np.log(odds))


@dataclass
class Bags:
    """Sentences as sets of units. words: the different units, blank first, lower case; unit, sentence: which unit is in which sentence, each pair once; toxic: of each sentence."""

    words: list[bytes]
    unit: np.ndarray
    sentence: np.ndarray
    toxic: np.ndarray


def bags(data: np.ndarray, offsets: np.ndarray, toxic: np.ndarray) -> Bags:
    """The different sentences of each label; ones of the same units count once, so a text that repeats itself has no more say than another. Units beyond the UNITS in most sentences are left out."""
    data, offsets = led(LOWER[data], offsets)
    data[_BLANK[data]] = 0x20
    starts, of = units(data, offsets)
    ends = np.concatenate([starts[1:], [len(data)]])
    raw = data.tobytes()
    names: dict[bytes, int] = {}
    ids = np.array([names.setdefault(raw[a:b].rstrip(), len(names)) for a, b in zip(starts.tolist(), ends.tolist())], np.int64)
    bad = toxic[np.searchsorted(offsets, starts, "right") - 1]
    # a sentence by the set of its units
    pair = np.unique(of * len(names) + ids)
    own, unit = pair // len(names), pair % len(names)
    label = np.zeros(int(own.max()) + 1 if len(own) else 0, bool)
    label[of] = bad
    edge = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1])
    seen: dict[tuple[int, bool], int] = {}
    sums = np.add.reduceat(mix64(unit.astype(np.uint64) + np.uint64(1)), edge) if len(own) else np.zeros(0, np.uint64)
    group = np.repeat(np.arange(len(edge)), np.diff(np.append(edge, len(own))))
    first = np.array([seen.setdefault((h, b), k) == k for k, (h, b) in enumerate(zip(sums.tolist(), label[own[edge]].tolist()))], bool) if len(own) else np.zeros(0, bool)
    keep = first[group]
    unit, group, toxic_ = unit[keep], group[keep], label[own[edge]]
    often = np.bincount(unit, minlength=len(names))
    chosen = np.lexsort((np.arange(len(names)), -often))[:UNITS]
    at = np.full(len(names), -1)
    at[chosen] = np.arange(len(chosen))
    words = list(names)
    ok = at[unit] >= 0
    _, sentence = np.unique(group[ok], return_inverse=True)
    return Bags([words[k] for k in chosen], at[unit[ok]], sentence, toxic_[np.unique(group[ok])])


def variants(word: bytes) -> list[bytes]:
    """A word (blank first) with a letter or a mark put in at each place inside it, or a letter inside it covered by a mark."""
    return [w for k in range(2, len(word)) for w in (word[:k] + b"x" + word[k:], word[:k] + b"*" + word[k:], *([word[:k] + b"*" + word[k + 1 :]] if k + 1 < len(word) else []))]


def landmarks(b: Bags, n: int | None = None) -> tuple[list[int], int, np.ndarray]:
    """(units, how many of them tell, which of all units are clearly more frequent in toxic sentences): at most n that tell toxic sentences by their counts, and n others: the half most like these by the kernel, and the most frequent ones."""
    n = n or LANDMARKS
    bad = b.toxic[b.sentence]
    c1, c0 = (np.bincount(b.unit[m], minlength=len(b.words)) for m in (bad, ~bad))
    n1, n0 = max(1, int(b.toxic.sum())), max(1, int((~b.toxic).sum()))
    # the lead of the share of toxic sentences over that of clean ones, by its standard error
    lead = (c1 / n1 - c0 / n0) / np.sqrt((c1 + 1) / n1**2 + (c0 + 1) / n0**2)
    long = np.array([len(w) > ORDER for w in b.words], bool)
    telling = [int(k) for k in np.argsort(-lead, kind="stable") if lead[k] > 2 and long[k]][:n]
    others = [int(k) for k in np.argsort(-c0, kind="stable") if lead[k] <= 2 and long[k]]
    close: list[int] = []
    if telling and others:
        row, code, value = subsequences([b.words[k] for k in telling + others[: 40 * n]])
        told = row < len(telling)
        kinds = np.unique(code[told])
        known = np.isin(code, kinds)
        f = np.zeros((len(telling) + len(others[: 40 * n]), len(kinds)), np.float32)
        f[row[known], np.searchsorted(kinds, code[known])] = value[known]
        norm = np.sqrt(np.bincount(row, value * value, len(f)))
        near = (f[len(telling) :] @ f[: len(telling)].T).max(axis=1) / np.maximum(norm[len(telling) :], 1e-9)
        close = [others[i] for i in np.argsort(-near, kind="stable")[: n // 2]]
    return list(dict.fromkeys([*telling, *close, *others[: n - n // 2]])), len(telling), lead > 2


def fit(texts: list[str], toxic: np.ndarray, odds: float) -> Model:
    """A model from texts and whether each is toxic; both kinds must be there. odds: see ``logistic``."""
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    b = bags(data, offsets, toxic)
    marks, n_telling, tells = landmarks(b)
    weights, bias = np.zeros(_SIZE, np.float32), 0.0
    if marks:
        # the landmarks' subsequences, whitened: features = kernel with the landmarks times the inverse root of their kernel matrix
        row, code, value = subsequences([b.words[k] for k in marks])
        kinds, code = np.unique(code, return_inverse=True)
        m = np.zeros((len(marks), len(kinds)))
        m[row, code] = value
        m /= np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-12)
        eig, vec = np.linalg.eigh(m @ m.T)
        ok = eig > 1e-6 * eig[-1]
        white = m.T @ (vec[:, ok] / np.sqrt(eig[ok]))  # kinds x features
        own = [(k, v) for k in marks[:n_telling] for v in variants(b.words[k])]
        x = features([*b.words, *(v for _, v in own)], kinds, white)
        origin = np.array([k for k, _ in own], np.int64)
        share = VARIANTS / np.maximum(1, np.bincount(origin, minlength=len(b.words)))[origin]
        bad = b.toxic[b.sentence]
        says = bad & tells[b.unit]  # whether a unit counts as toxic in a sentence
        for _ in range(ROUNDS):
            c1, c0 = (np.bincount(b.unit[k], minlength=len(b.words)).astype(float) for k in (says, ~says))
            w, bias = svm(x, np.concatenate([c1, c1[origin] * share]), np.concatenate([c0, np.zeros(len(own))]))
            margin = (x[: len(b.words)] @ w + bias)[b.unit]
            top = np.full(len(b.toxic), -np.inf)
            np.maximum.at(top, b.sentence, margin)
            before = says
            says = bad & ((margin > 0) | ((margin >= top[b.sentence]) & (margin > DOUBT)))
            if (before == says).all():
                break
        weights[kinds] = (white @ w).astype(np.float32)
    model = Model(weights, bias, 1.0, 0.0)
    high = np.concatenate([model.highest(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in slices(offsets, STEP_BYTES)])
    # one toxic unit is enough: the margins of such units against the highest ones of clean documents
    one = margin[says] if marks and says.any() else high[toxic]
    both = np.concatenate([one, high[~toxic]])
    weight = np.concatenate([np.full(len(one), toxic.sum() / len(one)), np.ones(int((~toxic).sum()))])
    model.slope, model.level = logistic(both, np.arange(len(both)) < len(one), weight, odds)
    return model


def features(words: list[bytes], kinds: np.ndarray, white: np.ndarray, step: int = 4000) -> np.ndarray:
    """The whitened kernel of each word with the landmarks, words in steps of bounded size."""
    out = [np.zeros((0, white.shape[1]))]
    for a in range(0, len(words), step):
        part = words[a : a + step]
        row, code, value = subsequences(part)
        known = np.isin(code, kinds)
        f = np.zeros((len(part), len(kinds)))
        f[row[known], np.searchsorted(kinds, code[known])] = value[known]
        out.append(f @ white)
    return np.concatenate(out)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from docs (doc_id, text) and labels (doc_id, toxic), one row a document: 1 is toxic, any other label clean; documents without a label or text are left out.

    It is fitted on a bounded sample: of each label the TRAIN_DOCS different texts of at most TRAIN_CHARS characters with the smallest hashes. How frequent toxic documents are is counted over all rows.
    Without both labels, every text gets the share of toxic rows (0 without any rows). Only hashes of texts are shuffled.
    """
    marked = labels.where("toxic is not null").select("doc_id", (F.col("toxic") == 1).alias("bad"))
    keyed = docs.where("text is not null").select("doc_id", "text", F.xxhash64("text").alias("h"))
    rows = keyed.select("doc_id", "h", (F.length("text") <= TRAIN_CHARS).alias("short")).join(marked, "doc_id")
    n1, n0 = rows.agg(F.count_if("bad"), F.count_if(~F.col("bad"))).first()
    different = rows.where("short").groupBy("bad", "h").agg(F.min("doc_id").alias("doc_id"))
    one_kind = lambda bad: different.where(F.col("bad") == bad).orderBy("h").limit(TRAIN_DOCS)
    chosen = one_kind(True).unionByName(one_kind(False))  # 2 x TRAIN_DOCS rows at most
    some = keyed.join(F.broadcast(chosen), ["doc_id", "h"]).dropDuplicates(["bad", "h"]).select("h", "text", "bad").collect()
    some.sort(key=lambda r: (r.h, r.bad))
    toxic = np.array([r.bad for r in some], bool)
    k1, k0 = int(toxic.sum()), int((~toxic).sum())
    if not k1 or not k0:
        share = min(max(n1 / max(1, n1 + n0), 1e-9), 1 - 1e-9)
        return Model(np.zeros(_SIZE, np.float32), 0.0, 0.0, float(np.log(share / (1 - share))))
    return fit([r.text for r in some], toxic, (n1 / k1) / (n0 / k0))


def predict(docs: DataFrame, model: Model, *carry: str) -> DataFrame:
    """(the carried columns, score) of every row of docs (text and the carried columns): the chance that it is toxic, by its highest sentence.

    A null or empty text, or one of blanks, has no sentence and scores as one without letters. Whole texts are read; nothing is shuffled; repeated rows score alike; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)  # 32^ORDER floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        for batch in batches:
            raw, off = text_arrays(batch.column(0))
            score = np.zeros(batch.num_rows)
            for i, j in slices(off, STEP_BYTES):
                score[i:j] = m.score(raw[off[i] : off[j]], off[i : j + 1] - off[i])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(score)], [*carry, "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema)
    return docs.select("text", *carry).mapInArrow(trimmed(run), f"{fields}, score double")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document, learnt from the labelled ones that are not held out. A document with several labels is toxic if any says so."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    labels = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    model = train(docs, labels.where(F.coalesce(fold != 2, F.lit(False))))
    scored = predict(docs.select("doc_id", "text", F.coalesce(fold == 2, F.lit(False)).alias("held_out")), model, "doc_id", "held_out")
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
