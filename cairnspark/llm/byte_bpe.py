"""Byte-level BPE encoding and decoding without a regular expression.

Pre-tokenisation: a table maps every code point to a class (letter, number, white space, other, ...), shifts of that array give
each code point a symbol that knows what follows it, and a small automaton says where tokens start. The automaton's
transition functions form a finite monoid, so its run over a text is a prefix product: blocks of symbols are
multiplied side by side by table look-up, block totals are scanned the same way, and no Python code runs per character.
Each slice between two boundaries is merged by rank once and then answered from a cache. Token byte lengths give the
offsets from which the ids are decoded.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import prepare, slices, table, text_arrays, trimmed

# Symbols of the automaton
LETTER, NUMBER, OTHER, CUT1, CUT2, SPACE_THEN, BLANK_THEN, BLANK, RESET = range(9)
# Its states: nothing open; in letters; in numbers; in others; in white space; after a leading space; one or two letters of a contraction to come
FRESH, IN_L, IN_N, IN_O, IN_W, LEAD, C1, C2 = range(8)
#: Code points with the property White_Space (fixed values of the Unicode standard).
WHITE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Cached slices kept by a worker; a full cache is emptied. It only saves time.
CACHE_SLICES = 400_000


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """(next state, whether this code point starts a token)."""
    if symbol == RESET:
        return FRESH, True
    if symbol == SPACE_THEN:  # U+0020 before something: leads the next token
        return LEAD, True
    if symbol == BLANK_THEN:  # other white space before something: a token of its own
        return FRESH, True
    if symbol == BLANK:  # white space before white space or the end
        return IN_W, state != IN_W
    if symbol == LETTER:
        if state in (C1, C2):
            return (FRESH if state == C1 else C1), False
        return IN_L, state not in (IN_L, LEAD)
    if symbol == NUMBER:
        return IN_N, state not in (IN_N, LEAD)
    if state in (IN_O, LEAD):  # an apostrophe inside a run of others opens no contraction
        return IN_O, False
    return {OTHER: IN_O, CUT1: C1, CUT2: C2}[symbol], True


def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(element of each symbol, composition table, table of the elements' functions): the closure of the symbols' transition functions."""
    gens = [tuple(_step(s, y)[0] for s in range(8)) for y in range(9)]
    known = {tuple(range(8)): 0}
    todo = list(known)
    for f in gens:
        if f not in known:
            known[f] = len(known)
            todo.append(f)
    while todo:
        f = todo.pop()
        for g in gens:
            h = tuple(g[x] for x in f)
            if h not in known:
                known[h] = len(known)
                todo.append(h)
    elements = list(known)
    assert len(elements) <= 256
    comp = np.array([[known[tuple(g[x] for x in f)] for g in elements] for f in elements], np.uint8)
    return np.array([known[g] for g in gens], np.uint8), comp, np.array(elements, np.uint8)


ELEMENT, COMPOSE, FUNCTION = _monoid()
_FLAT = COMPOSE.reshape(-1)
_SIZE = len(COMPOSE)
STARTS = np.array([[_step(s, y)[1] for y in range(9)] for s in range(8)])


def scan(elements: np.ndarray, block: int = 64) -> np.ndarray:
    """Inclusive prefix products of monoid elements."""
    n = len(elements)
    if n <= block:
        out = elements.copy()
        for i in range(1, n):
            out[i] = COMPOSE[out[i - 1], out[i]]
        return out
    m = -(-n // block)
    grid = np.zeros((block, m), np.uint8)  # element 0 is the identity
    full = np.zeros(m * block, np.uint8)
    full[:n] = elements
    grid[:] = full.reshape(m, block).T
    for j in range(1, block):
        grid[j] = _FLAT.take(grid[j - 1].astype(np.uint16) * _SIZE + grid[j])
    before = np.zeros(m, np.uint8)
    before[1:] = scan(grid[-1], block)[:-1]
    return _FLAT.take(before.astype(np.uint16)[None, :] * _SIZE + grid).T.reshape(-1)[:n]


_classes: np.ndarray | None = None


def classes() -> np.ndarray:
    """Class of every code point: LETTER, NUMBER, OTHER or BLANK."""
    global _classes
    if _classes is None:
        kind = {"L": LETTER, "N": NUMBER}
        out = np.full(0x110000, OTHER, np.uint8)
        category = unicodedata.category
        for c in range(0x32400):  # letters and numbers end below; planes 4 to 16 hold none
            k = kind.get(category(chr(c))[0])
            if k is not None:
                out[c] = k
        out[WHITE] = BLANK
        _classes = out
    return _classes


def pretokens(data: bytes, offsets: np.ndarray) -> np.ndarray:
    """Byte positions at which pre-tokens start in the texts data[offsets[i]:offsets[i + 1]] (UTF-8)."""
    if not data:
        return np.zeros(0, np.int64)
    raw = np.frombuffer(data, np.uint8)
    lead = np.flatnonzero((raw & 0xC0) != 0x80)
    points = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
    # a separator before each text resets the automaton
    begin = np.searchsorted(lead, offsets[:-1])
    begin = begin[offsets[:-1] < offsets[1:]]
    keep = np.ones(len(points) + len(begin), bool)
    keep[begin + np.arange(len(begin))] = False
    wide = np.full(len(keep), 0xFFFFFFFF, np.uint32)
    wide[keep] = points
    return lead[boundaries(wide, keep)]


def boundaries(wide: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """Which code points start a pre-token; keep is False at the separators in ``wide``, and they are left out of the answer."""
    n = len(wide)
    table_ = classes()
    symbol = np.full(n, RESET, np.uint8)
    symbol[keep] = table_[wide[keep]]
    solid = symbol < BLANK_THEN
    solid &= keep
    blank = keep & ~solid
    follows = np.zeros(n, bool)
    follows[:-1] = solid[1:]
    symbol[blank & follows] = BLANK_THEN
    symbol[(wide == 0x20) & follows] = SPACE_THEN
    mark = np.flatnonzero(wide == 0x27)
    mark = mark[mark + 1 < n]
    if len(mark):
        nxt = wide[mark + 1]
        symbol[mark[np.isin(nxt, [0x73, 0x74, 0x6D, 0x64])]] = CUT1  # 's 't 'm 'd
        two = mark[mark + 2 < n]
        a, b = wide[two + 1], wide[two + 2]
        symbol[two[((a == 0x72) | (a == 0x76)) & (b == 0x65) | (a == 0x6C) & (b == 0x6C)]] = CUT2  # 're 've 'll
    state = np.zeros(n, np.uint8)
    state[1:] = FUNCTION[scan(ELEMENT[symbol])[:-1], 0]
    return STARTS[state, symbol][keep]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class ByteBPE:
    """Encoder and decoder over a rank file; one for each worker process."""

    def __init__(self, path: str):
        self.ranks = read_ranks(path)
        self.pieces = {i: b for b, i in self.ranks.items()}
        self.cache: dict[bytes, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: the adjacent pair of lowest rank is joined first, the leftmost on ties."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(piece) > 200:
            return self._merge_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        none = 1 << 60
        best = [ranks.get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
        while best:
            low = min(best)
            if low == none:
                break
            i = best.index(low)
            parts[i] += parts.pop(i + 1)
            del best[i]
            if i < len(best):
                best[i] = ranks.get(parts[i] + parts[i + 1], none)
            if i:
                best[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        return [ranks[p] for p in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same merges with a heap over a linked list, for pre-tokens of any length."""
        import heapq

        ranks, n = self.ranks, len(piece)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        heap = [(r, i, piece[i : i + 2]) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, joined = heapq.heappop(heap)
            j = nxt[i] if parts[i] is not None else n
            if j >= n or parts[i] + parts[j] != joined:
                continue
            parts[i], parts[j] = joined, None
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
                if (r := ranks.get(joined + parts[nxt[i]])) is not None:
                    heapq.heappush(heap, (r, i, joined + parts[nxt[i]]))
            if (h := prv[i]) >= 0 and (r := ranks.get(parts[h] + joined)) is not None:
                heapq.heappush(heap, (r, h, parts[h] + joined))
        return [ranks[p] for p in parts if p is not None]

    def encode(self, data: bytes, offsets: np.ndarray) -> Iterator[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        starts = pretokens(data, offsets)
        split = np.searchsorted(starts, offsets).tolist()
        cut = starts.tolist()
        cut.append(int(offsets[-1]))
        cache = self.cache
        if len(cache) > CACHE_SLICES:
            cache.clear()
        for r in range(len(offsets) - 1):
            i, j = split[r], split[r + 1]
            keys = [data[a:b] for a, b in zip(cut[i:j], cut[i + 1 : j + 1])]
            try:
                yield b"".join([cache[k] for k in keys])
            except KeyError:
                for k in keys:
                    if k not in cache:
                        cache[k] = np.array(self.merge(k), "<u4").tobytes()
                yield b"".join([cache[k] for k in keys])

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids.tolist()))

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte offset of each token in its text, and the length as last entry."""
        return np.concatenate([[0], np.cumsum([len(self.pieces[i]) for i in ids.tolist()])]).astype(np.int64)


_coders: dict[str, ByteBPE] = {}


def coder(path: str) -> ByteBPE:
    if path not in _coders:
        _coders[path] = ByteBPE(path)
    return _coders[path]


def encode_documents(docs: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, ids array<long>, offsets array<long>), or the digest columns with ``with_ids=False``.

    docs: doc_id, text; other columns are ignored. A null text counts as empty and has no tokens; repeated rows give repeated
    rows; an empty table gives an empty one. Nothing is shuffled. Memory: an Arrow batch, one slice's arrays and the cache.
    """
    prepare(docs.sparkSession)
    schema = "doc_id long, ids array<long>, offsets array<long>" if with_ids else "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in batches:
            raw, off = text_arrays(batch.column(1))
            out: list[tuple] = []
            for i, j in slices(off):
                part = raw[off[i] : off[j]].tobytes()
                for packed in bpe.encode(part, off[i : j + 1] - off[i]):
                    ids = np.frombuffer(packed, "<u4")
                    if with_ids:
                        out.append((ids.astype(np.int64), bpe.offsets(ids)[:-1]))
                    else:
                        out.append((len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()))
            cols = list(zip(*out)) if out else [[] for _ in range(2 if with_ids else 3)]
            if with_ids:
                arrays = [pa.array(list(c), pa.list_(pa.int64())) for c in cols]
                yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", "ids", "offsets"])
            else:
                kinds = (pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(trimmed(run), schema)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document; a null text is empty: no ids."""
    return encode_documents(table(spark, sf_dir, "documents"), default_path(), with_ids=False)
