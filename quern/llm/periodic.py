"""Periodic runs in texts: stretches of words that repeat with some period, and texts with the repeats taken out.

A run is a stretch of consecutive words whose smallest period is ``q``, at least ``LEAST`` words and ``TIMES`` periods long, that no
neighbouring word extends with that period.

The suffix automaton of a stretch has a state for each set of end positions. States are visited from
the longest to the shortest; each gives its ordered set of end positions to the state that its suffix
link names, the smaller set being merged into the larger. Where a position becomes the neighbour of
another at a distance ``d`` no longer than the state, the state's words stand at both, so they overlap or touch and
seed a square of period ``d``; seeds are extended both ways to runs.
Every run is found: let ``L`` words from its start be the same as those ``q`` later. At the state where the run's last position and the one
``q`` before it first meet, the longest common suffix has those ``L`` words, and no position of that state lies between
them, since else the run would have a smaller period. As ``L + q`` is the run's length, shorter seeds are passed over.

A run repeats sixteen words or more at a distance of at most a third of its length. Equal sixteens of words are
found by sorting their hashes in numpy, and only stretches that they cover go to an automaton: most texts have none, and a hash that
two sixteens share makes a stretch longer, never shorter. Words are told by their bytes.

Each text is worked on alone and no row is shuffled. An automaton takes memory in proportion to the stretch: some 600 bytes a word.

Nulls: a null text has no words; a null id stays null, and its text is never changed by `planted`. Repeated rows each give a row. A text
without words, or with fewer than ``LEAST``, has no runs. Very long texts are single rows; Arrow batches hold 4 MB of others.
Columns beside those named are not read. An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from itertools import count
from operator import itemgetter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.runtime import bounded_batches

LEAST, TIMES = 24, 3
#: A run of period q repeats max(LEAST - q, (TIMES - 1) * q) words, and that is least for q = 8.
GRAM = 16
_BASE = np.uint64(0x9E3779B97F4A7C15)

RUNS = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _gram_hashes(ids: np.ndarray) -> np.ndarray:
    """A hash for each ``GRAM`` words in a row, by doubling."""
    h, width, power = ids.astype(np.uint64) + np.uint64(1), 1, _BASE
    while width < GRAM:
        h = h[:-width] * power + h[width:]
        width, power = 2 * width, power * power
    return h


def stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of word ids, as start and end, outside of which no run can stand."""
    n = len(ids)
    if n < LEAST:
        return []
    with np.errstate(over="ignore"):
        hashes = _gram_hashes(ids)
    ordered = np.sort(hashes)
    if not (ordered[1:] == ordered[:-1]).any():
        return []
    order = np.argsort(hashes, kind="stable")
    same = hashes[order[1:]] == hashes[order[:-1]]
    a, b = order[:-1][same], order[1:][same]
    fits = (b - a) * TIMES <= n
    while True:
        a, b = a[fits], b[fits]
        cover = np.zeros(n + 1, np.int64)
        for at in (a, b):
            np.add.at(cover, at, 1)
            np.add.at(cover, at + GRAM, -1)
        inside = np.concatenate([[False], np.cumsum(cover)[:-1] > 0, [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edges[::2], edges[1::2]
        # A repeat counts only within its own stretch, and only at a distance that leaves room for a run there.
        at = np.searchsorted(start, a, "right") - 1
        fits = (b < end[at]) & ((b - a) * TIMES <= end[at] - start[at]) & (end[at] - start[at] >= LEAST) if len(a) else np.ones(0, bool)
        if fits.all():
            return [(int(s), int(e)) for s, e in zip(start, end) if e - s >= LEAST]


def automaton(ids: list[int]) -> tuple[list[int], list[int], list[int]]:
    """The suffix automaton's links, lengths, and for each state the end position that it was made for (-1 for a copy)."""
    follow, link, length, at, last = [{}], [-1], [0], [-1], 0
    for i, c in enumerate(ids):
        new = len(length)
        follow.append({})
        length.append(i + 1)
        at.append(i)
        link.append(0)
        p = last
        while p >= 0 and c not in follow[p]:
            follow[p][c] = new
            p = link[p]
        if p >= 0:
            q = follow[p][c]
            if length[q] != length[p] + 1:
                copy = len(length)
                follow.append(follow[q].copy())
                length.append(length[p] + 1)
                at.append(-1)
                link.append(link[q])
                while p >= 0 and follow[p].get(c) == q:
                    follow[p][c] = copy
                    p = link[p]
                link[q] = copy
                q = copy
            link[new] = q
        last = new
    return link, length, at


def seeds(ids: list[int]) -> Iterator[tuple[int, int, int]]:
    """``(start, end, period)`` of stretches with that period, at least ``LEAST`` words and ``TIMES`` periods long; some stand in longer ones or have a smaller period."""
    link, length, at = automaton(ids)
    # Ascending sets of negated positions: shorter states of a periodic text add earlier positions, which then go to the end.
    ends: list[list[int] | None] = [[-x] if x >= 0 else [] for x in at]
    for state in sorted(range(1, len(length)), key=length.__getitem__, reverse=True):
        up = link[state]
        if up == 0:
            ends[state] = None
            continue
        large, small, long = ends[up], ends[state], length[up]
        if len(large) < len(small):
            large, small = small, large
        for x in small:
            i = bisect_left(large, x)
            if i < len(large):
                d = large[i] - x
                if 2 * d <= long and d + long >= LEAST:
                    yield 1 - large[i] - long, 1 - x, d
            if i:
                d = x - large[i - 1]
                if 2 * d <= long and d + long >= LEAST:
                    yield 1 - x - long, 1 - large[i - 1], d
            large.insert(i, x)
        ends[up], ends[state] = large, None


def _primitive(ids: np.ndarray, d: int) -> bool:
    """Whether the first ``d`` ids are no power of a shorter stretch."""
    left, p = d, 2
    while left > 1:
        if p * p > left:
            p = left
        if left % p == 0:
            if (ids[: d - d // p] == ids[d // p : d]).all():
                return False
            while left % p == 0:
                left //= p
        p += 1
    return True


def runs_of(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs, by start and period."""
    found = []
    for begin, stop in stretches(ids):
        part = ids[begin:stop]
        plain, n = part.tolist(), stop - begin
        known: dict[int, list[tuple[int, int]]] = {}  # by period: stretches that cannot be extended, in order; none lies in another
        for start, end, d in seeds(plain):
            of_period = known.setdefault(d, [])
            at = bisect_right(of_period, start, key=itemgetter(0))
            if at and end <= of_period[at - 1][1]:
                continue
            while start and plain[start - 1] == plain[start - 1 + d]:
                start -= 1
            while end < n and plain[end] == plain[end - d]:
                end += 1
            insort(of_period, (start, end))
        for d, of_period in known.items():
            found += [(begin + s, e - s, d) for s, e in of_period if e - s >= max(LEAST, TIMES * d) and _primitive(part[s:e], d)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """For one document in ten, the place from which each of its ``n`` words is taken, so that its end repeats; None for others."""
    if doc_id is None or n == 0 or (h := crc32(str(doc_id).encode())) % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def _collapsed(words: list[bytes], ids: np.ndarray, runs: list[tuple[int, int, int]], changed: bool) -> bytes:
    """Words that are in no run beyond its first period, joined by a space. A word's id is the place where it first stands."""
    if not runs and not changed:
        return b" ".join(words)
    gone = np.zeros(len(ids) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return b" ".join([words[k] for k in ids[np.cumsum(gone)[:-1] == 0].tolist()])


def _scans(plant: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows = batch.column("doc_id"), []
            for key, text in zip(keys.to_pylist(), batch.column("text").cast(pa.binary())):
                words = (text.as_py() or b"").split()
                first: dict[bytes, int] = {}
                ids = np.fromiter(map(first.setdefault, words, count()), np.int64, len(words))
                at = planted(key, len(words)) if plant else None
                ids = ids if at is None else ids[at]
                runs = runs_of(ids)
                rows.append((len(words), [dict(zip(("start", "length", "period"), r)) for r in runs], _collapsed(words, ids, runs, at is not None)))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            columns = [keys, pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], kind), pa.array([r[2] for r in rows], pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = False) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` for each row; with ``plant``, texts are first changed by `planted`."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_scans(plant), RUNS)


def most_repeated(runs: Column) -> Column:
    """Of an array of runs by start and period, the one with the greatest length by period; of equals the first. Compared as whole numbers."""
    better = lambda r, best: r["length"] * best["period"] > best["length"] * r["period"]
    return F.when(F.size(runs) > 0, F.aggregate(runs, runs[0], lambda best, r: F.when(better(r, best), r).otherwise(best)))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the runs of all ``documents``, of which one in ten is made to repeat."""
    found = periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), plant=True).withColumn("best", most_repeated(F.col("runs")))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )
