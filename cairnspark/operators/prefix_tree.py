"""A block of names as a tree of their prefixes, in which many names are sought at a time.

A prefix that no name within the bound can begin with is left with all that is below it. Prefixes are looked at level by level, a row of distances for each name and prefix that is still open.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Cells (rows x columns) of distances that are expanded at a time, and names that are sought at a time.
CELLS, ASKED = 1_000_000, 2048


def _codes(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(names x places: code points from 1 on, 0 behind the end; lengths)."""
    size = np.array([len(n) for n in names], np.int64)
    width = max(1, int(size.max(initial=0)))
    code = np.array(names, f"<U{width}").view("<u4").reshape(len(names), width) + np.uint32(1)
    return np.where(np.arange(width) < size[:, None], code, np.uint32(0)), size


class PrefixTree:
    """names: without repeats, in the order of their code points. longest: of each, the length of the longest text that it stands for (its own, where it is no prefix of others)."""

    def __init__(self, names: list[str], longest: np.ndarray | None = None):
        self.code, self.size = _codes(names)
        self.longest = self.size if longest is None else longest
        apart = self.code[1:] != self.code[:-1]
        shared = np.concatenate([[0], np.argmax(apart, axis=1)]).astype(np.int64)
        # of each level: the first name of every prefix, and where its children begin in the next level
        self.start = [np.zeros(1, np.int64)] + [np.flatnonzero((self.size >= d) & ((shared < d) | (np.arange(len(names)) == 0))) for d in range(1, self.code.shape[1] + 2)]
        self.child = [np.append(np.searchsorted(below, own), len(below)) for own, below in zip(self.start, self.start[1:])]
        self.most = [np.maximum.reduceat(self.longest, own) if len(own) else own for own in self.start]

    def near(self, asked: list[str], least: np.ndarray, by_longer: bool, begins: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (place in asked, place in names) that are at least ``least`` alike, which is given for each asked name; see ``similar.Bound``.

        begins: names are prefixes, and it is asked which of them a text that is alike may begin with.
        """
        replaced = 1 if by_longer else 2
        for a in range(0, len(asked), ASKED):
            code, size = _codes(asked[a : a + ASKED])
            r, place = least[a : a + ASKED], np.arange(code.shape[1] + 1, dtype=np.int16)
            bound = lambda q, other: np.floor((1.0 - r[q]) * (np.maximum(size[q], other) if by_longer else size[q] + other) + 1e-6)  # noqa: B023, E731
            stack = [(0, np.arange(len(size)), np.zeros(len(size), np.int64), np.tile(place, (len(size), 1)))]
            while stack:
                d, q, node, rows = stack.pop()
                begin = self.child[d][node]
                count = self.child[d][node + 1] - begin
                if count.sum() * len(place) > CELLS and len(q) > 1:
                    half = len(q) // 2
                    stack += [(d, q[p], node[p], rows[p]) for p in (slice(0, half), slice(half, None))]
                    continue
                end = self.size[self.start[d][node]] == d
                if end.any():
                    own, name = q[end], self.start[d][node[end]]
                    hit = np.ones(len(own), bool) if begins else rows[end, size[own]] <= bound(own, self.size[name])
                    yield own[hit] + a, name[hit]
                if not count.any():
                    continue
                k = np.repeat(np.arange(len(q)), count)
                below = np.arange(len(k)) + np.repeat(begin - (np.cumsum(count) - count), count)
                own, above = q[k], rows[k]
                same = code[own] == self.code[self.start[d + 1][below], d][:, None]
                new = above + np.int16(1)
                np.minimum(new[:, 1:], above[:, :-1] + np.where(same, np.int16(0), np.int16(replaced)), out=new[:, 1:])
                new = np.minimum.accumulate(new - place, axis=1) + place
                open_ = new.min(axis=1) <= bound(own, self.most[d + 1][below])
                if open_.any():
                    stack.append((d + 1, own[open_], below[open_], new[open_]))
