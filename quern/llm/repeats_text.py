"""Stretches of a text whose windows share one chosen suffix, and the index family of one task.

Of all 100-byte windows, each chooses one of the suffixes that begin in it: the one whose
first ``LEAD`` bytes, inside the window, have the smallest hash, and the leftmost of equals. Equal
windows choose alike wherever they stand. So a sparse suffix array of chosen suffixes
alone, about one byte in forty, finds every repeat of a window. Windows that follow each other and
choose the same suffix form a stretch.
"""

from __future__ import annotations

import numpy as np

WINDOW = 100
LEAD = 24
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_CHUNK = 1 << 15
_TABLES: list[tuple[np.ndarray, np.ndarray]] = []


#: Powers for texts of so many bytes are kept from one text to the next; those for longer ones go with the text.
_KEPT = 1 << 18


def _powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    return [tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, x, np.uint64)])) for x in (b, pow(b, -1, 1 << 64))) for b in _BASES]


def _tables(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers of each base and of its inverse, up to ``n``."""
    if n > _KEPT:
        return _powers(n)
    if not _TABLES or len(_TABLES[0][0]) <= n:
        _TABLES[:] = _powers(min(_KEPT, max(1 << 14, 2 * n)))
    return _TABLES


def mixed(h: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


class Hashes:
    """Hashes of any stretches of one text."""

    def __init__(self, raw: bytes):
        self.n = len(raw)
        self.bytes = np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)
        self.tables = _tables(self.n)
        self.runs: list[np.ndarray | None] = [None, None]

    def of(self, base: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Unmixed hashes of the stretches."""
        up, down = self.tables[base]
        if self.runs[base] is None:
            run = np.zeros(self.n + 1, np.uint64)
            np.cumsum(self.bytes * up[: self.n], out=run[1:])
            self.runs[base] = run
        run = self.runs[base]
        return (run[end] - run[start]) * down[start]

    def all_of(self, base: int, size: int) -> np.ndarray:
        """Mixed hashes of all stretches of one size."""
        up, down = self.tables[base]
        if self.runs[base] is None:
            self.of(base, np.zeros(1, np.int64), np.zeros(1, np.int64))
        run = self.runs[base]
        return mixed((run[size:] - run[:-size]) * down[: self.n - size + 1])


def stretches(h: Hashes, window: int = WINDOW, lead: int = LEAD) -> tuple[np.ndarray, ...]:
    """First and last window start of each stretch, its chosen suffix, the hash of that suffix's first bytes, and the hash of all bytes."""
    n = h.n - window + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    lead_hash = h.all_of(0, lead)
    width = window - lead + 1
    chosen = np.empty(n, np.int64)
    low = np.uint64(0xFFFF)
    for at in range(0, n, _CHUNK):
        stop = min(n, at + _CHUNK)
        least = (lead_hash[at : stop + width - 1] & ~low) | np.arange(stop - at + width - 1, dtype=np.uint64)
        size = 1
        while 2 * size <= width:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < width:
            least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
        chosen[at:stop] = (least & low).astype(np.int64) + at
    edge = np.flatnonzero(chosen[1:] != chosen[:-1]) + 1
    first, last = np.concatenate([[0], edge]), np.concatenate([edge - 1, [n - 1]])
    whole = mixed(h.of(1, first, last + window) + (last - first).astype(np.uint64))
    return first, last, chosen[first], lead_hash[chosen[first]], whole


#: Place of a stretch in one number: first window start, distance to its chosen suffix, number of windows less one.
_BITS = 7


def packed(first: np.ndarray, chosen: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Places of stretches as numbers that keep their order."""
    return (first << 2 * _BITS) | ((chosen - first) << _BITS) | (last - first)


class IndexFamily:
    """Sorted arrays of stretches, each at least twice as long as the next: a new batch is scanned against every level, and levels of like size merge.

    It knows what one task has seen, and tells which stretches occur earlier, in ascending
    order of place. It forgets everything beyond ``most`` entries; what it does not tell is found later.
    """

    def __init__(self, most: int = 3_000_000):
        self.levels: list[list[np.ndarray]] = []
        self.most = most

    def add(self, batch: list[np.ndarray]) -> np.ndarray:
        """``batch``: hash of all bytes, hash of the first, document, copy, place. A mask of those that occur earlier."""
        order = np.lexsort(batch[::-1])
        own = [x[order] for x in batch]
        repeated = np.zeros(len(order), bool)
        repeated[1:] = (own[0][1:] == own[0][:-1]) & (own[1][1:] == own[1][:-1])
        first = np.flatnonzero(~repeated)
        new = [x[first] for x in own]
        late = np.zeros(len(first), bool)
        for level in self.levels:
            at = np.searchsorted(level[0], new[0])
            inside = np.minimum(at, len(level[0]) - 1)
            same = (at < len(level[0])) & (level[0][inside] == new[0]) & (level[1][inside] == new[1])
            before = level[4][inside] < new[4]
            for column in (3, 2):
                a, b = level[column][inside], new[column]
                before = (a < b) | ((a == b) & before)
            late |= same & before
        repeated[first[late]] = True
        self._keep([x[~late] for x in new])
        mask = np.empty(len(order), bool)
        mask[order] = repeated
        return mask

    def _keep(self, level: list[np.ndarray]) -> None:
        while self.levels and len(self.levels[-1][0]) < 2 * len(level[0]):
            both = [np.concatenate(x) for x in zip(self.levels.pop(), level)]
            order = np.lexsort(both[::-1])
            both = [x[order] for x in both]
            first = np.ones(len(order), bool)
            first[1:] = (both[0][1:] != both[0][:-1]) | (both[1][1:] != both[1][:-1])
            level = [x[first] for x in both]
        if len(level[0]):
            self.levels.append(level)
        if sum(len(x[0]) for x in self.levels) > self.most:
            self.levels = []


def sides(h: Hashes, chosen: np.ndarray, window: int = WINDOW, lead: int = LEAD) -> np.ndarray:
    """Sixteen bits for the chosen suffix's first bytes and as many on the right as half a window's rest holds, and sixteen for those on the left; zero where the text ends before."""
    half = (window - lead) // 2
    out = np.zeros(len(chosen), np.int64)
    right = chosen + lead + half <= h.n
    left = chosen >= half
    out[right] = 1 + (mixed(h.of(1, chosen[right], chosen[right] + lead + half)) % np.uint64(65535)).astype(np.int64) << 16
    out[left] |= 1 + (mixed(h.of(1, chosen[left] - half, chosen[left] + lead)) % np.uint64(65535)).astype(np.int64)
    return out
