"""Audit of how text filters interact: what each removes, alone and after the others, in every order.

A scan reads texts as Arrow buffers: a table of 256 entries gives each byte its class, and prefix sums
of the classes, taken at the documents' offsets, are their numbers of code points, words, capitals
and symbols. Each word has a hash; a document's hashes are sorted, and of equal neighbours the bytes are
compared, so that distinct words are counted exactly. Which filters a document fails is a mask of
five bits. Copies are told by digest: the smallest id of each digest is an aggregate, and a document is first
if its id and digest are found there, so that no group of copies is ever brought together.

What any order of filters removes depends on masks alone: documents are counted by part and mask (32 masks at
most), and the rows of all 120 orders are made from those counts.

Filters: A fewer than 200 words; B distinct words fewer than half; C capitals ``A-Z`` above 2 of 100 code points;
D a symbol of ``#$%&*|``; E the text of a smaller id in the whole table.

Nulls: a null text is empty; a null or empty source is the part ``''``; a null id is never a copy and no other's original, and
has no labels. Rows that share the smallest id of a text are all first. Of several labels of an id any 1 counts.
An empty text fails A alone (and E, if an empty text has a smaller id). A text of any length is one row of an Arrow batch; batches of
shorter texts hold 4 MB. Columns beside those named are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.runtime import bounded_batches, discard, materialise

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PCT, MAX_CAPITALS_PCT, SYMBOLS = 200, 50, 2, b"#$%&*|"
ORDERS = ["".join(p) for p in permutations(FILTERS)]

_SPACE, _CAPITAL, _SYMBOL, _INSIDE = 1, 2, 4, 8
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = _SPACE
_CLASS[ord("A") : ord("Z") + 1] = _CAPITAL
_CLASS[list(SYMBOLS)] = _SYMBOL
_CLASS[0x80:0xC0] = _INSIDE  # further bytes of a code point
BASE = 0x9E3779B97F4A7C15

MEASURES = "doc_id long, part string, digest binary, n_chars long, n_words long, n_distinct long, n_capitals long, n_symbols long"


def _at(marks: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many marks stand in each document, by a prefix sum."""
    total = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _word_hashes(data: np.ndarray, inside: np.ndarray, start: np.ndarray, length: np.ndarray, base: int) -> np.ndarray:
    """A polynomial hash of each word: bytes of words side by side, weighted by their place in the word, and summed from start to start."""
    at = np.concatenate([[0], np.cumsum(length)[:-1]])
    place = np.arange(int(length.sum())) - np.repeat(at, length)
    powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(int(length.max()), base, np.uint64)]))
    hashes = np.add.reduceat((data[inside].astype(np.uint64) + np.uint64(1)) * powers[place], at)
    return hashes ^ (hashes >> np.uint64(29))


def _unequal(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the stretches of ``length`` bytes at ``a`` and ``b`` differ, for each pair."""
    at = np.concatenate([[0], np.cumsum(length)[:-1]])
    step = np.arange(int(length.sum())) - np.repeat(at, length)
    return np.add.reduceat((data[np.repeat(a, length) + step] != data[np.repeat(b, length) + step]).astype(np.int64), at) > 0


def count_distinct(data: np.ndarray, bounds: np.ndarray, start: np.ndarray, length: np.ndarray, n_words: np.ndarray, inside: np.ndarray, base: int = BASE) -> np.ndarray:
    """Distinct words of each document. Where words of one document share a hash but not their bytes, that document's words are counted as they are."""
    n = len(n_words)
    if not len(start):
        return np.zeros(n, np.int64)
    hashes = _word_hashes(data, inside, start, length, base)
    owner = np.repeat(np.arange(n), n_words)
    order = np.argsort(hashes, kind="stable")
    by_owner = owner[order].astype(np.uint16 if n < 1 << 16 else np.int64)  # short integers are sorted by digits
    order = order[np.argsort(by_owner, kind="stable")]
    a, b = order[:-1], order[1:]
    same = (owner[a] == owner[b]) & (hashes[a] == hashes[b])
    a, b = a[same], b[same]
    wrong = length[a] != length[b]
    if (fit := ~wrong).any():
        wrong[fit] = _unequal(data, start[a[fit]], start[b[fit]], length[a[fit]])
    distinct = n_words - np.bincount(owner[b], minlength=n)
    for k in np.unique(owner[b[wrong]]):
        distinct[k] = len(set(data[bounds[k] : bounds[k + 1]].tobytes().split()))
    return distinct


def scan(texts: pa.Array, base: int = BASE) -> dict[str, np.ndarray | list]:
    """The measures of an Arrow array of strings, read from its buffers."""
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    wide = pa.types.is_large_string(texts.type)
    bounds = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = texts.buffers()[2] if n else None
    data = np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    kind = _CLASS[data]
    inside = kind != _SPACE
    edge = np.zeros(len(data) + 1, bool)  # a word ends where a document ends
    edge[bounds] = True
    padded = np.concatenate([[False], inside])
    begins = inside & (~padded[:-1] | edge[:-1])
    start = np.flatnonzero(begins)
    ends = np.flatnonzero(inside & (~np.concatenate([inside[1:], [False]]) | edge[1:])) + 1
    n_words = _at(begins, bounds)
    return {
        "digest": [hashlib.sha256(data[bounds[k] : bounds[k + 1]]).digest() for k in range(n)],
        "n_chars": np.diff(bounds) - _at(kind == _INSIDE, bounds),
        "n_words": n_words,
        "n_distinct": count_distinct(data, bounds, start, ends - start, n_words, inside, base),
        "n_capitals": _at(kind == _CAPITAL, bounds),
        "n_symbols": _at(kind == _SYMBOL, bounds),
    }


def _scans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = scan(batch.column("text"))
        columns = [batch.column("doc_id"), batch.column("part"), pa.array(found["digest"], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns + [pa.array(found[c], pa.int64()) for c in ("n_chars", "n_words", "n_distinct", "n_capitals", "n_symbols")], names=[c.split()[0] for c in MEASURES.split(", ")])


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, part, digest, n_chars, n_words, n_distinct, n_capitals, n_symbols`` for each row."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_scans, MEASURES)


def failures(measured: DataFrame) -> DataFrame:
    """``doc_id, part, digest, fails``: a bit for each of the filters A to D."""
    words, chars = F.col("n_words"), F.col("n_chars")
    bad = [words < MIN_WORDS, 100 * F.col("n_distinct") < MIN_DISTINCT_PCT * words, 100 * F.col("n_capitals") > MAX_CAPITALS_PCT * chars, F.col("n_symbols") > 0]
    fails = sum(F.when(x, 1 << k).otherwise(0) for k, x in enumerate(bad))
    return measured.select("doc_id", "part", "digest", fails.cast("int").alias("fails"))


_REMOVED = np.zeros((len(ORDERS), 5, 32), bool)
_KEPT, _REDUNDANT, _UNIQUE = _REMOVED.copy(), _REMOVED.copy(), _REMOVED.copy()
for _o, _order in enumerate(ORDERS):
    _gone = np.zeros(32, bool)
    for _k, _letter in enumerate(_order):
        _bit = 1 << FILTERS.index(_letter)
        _fails = (np.arange(32) & _bit) > 0
        _REMOVED[_o, _k], _REDUNDANT[_o, _k], _UNIQUE[_o, _k] = _fails & ~_gone, _fails & _gone, np.arange(32) == _bit
        _gone = _gone | _fails
        _KEPT[_o, _k] = ~_gone
#: Rows of one part, in order: all orders, each with its five steps.
_FILTER = np.array([[FILTERS.index(x) for x in o] for o in ORDERS])

AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def orders_of(n: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> dict[str, np.ndarray]:
    """The audit's counts, 120 x 5 each, from the numbers of documents by mask."""
    removed = _REMOVED @ n
    by_filter = np.array([removed[_FILTER == f].sum() for f in range(5)])
    return {"kept": _KEPT @ n, "removed": removed, "redundant": _REDUNDANT @ n, "unique_fails": _UNIQUE @ n, "good_lost": _REMOVED @ good, "toxic_lost": _REMOVED @ toxic, "shapley": by_filter[_FILTER]}


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    order = pa.array([o for o in ORDERS for _ in range(5)])
    step = pa.array(np.tile(np.arange(1, 6, dtype=np.int32), len(ORDERS)))
    for batch in batches:
        for row in batch.to_pylist():
            cells = np.zeros((3, 32), np.int64)
            for c in row["cells"]:
                cells[:, c["fails"]] = c["n"], c["good"], c["toxic"]
            counts = orders_of(*cells)
            yield pa.RecordBatch.from_arrays([pa.array([row["part"]] * len(order)), order, step, *(pa.array(counts[c.split()[0]].ravel().astype(np.int64)) for c in AUDIT.split(", ")[3:])], names=[c.split()[0] for c in AUDIT.split(", ")])


def audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """``part, filter_order, step`` and the counts of that step, for each part of ``docs``. ``labels(doc_id, quality, toxic)``."""
    rows = materialise(failures(measures(docs, **columns)), "filter_rows")
    first = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    told = rows.join(first, ["digest", "doc_id"], "left")
    copy = F.col("doc_id").isNotNull() & F.col("is_first").isNull()
    told = told.select("doc_id", "part", (F.col("fails") + F.when(copy, 16).otherwise(0)).cast("int").alias("fails"))
    flags = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    cells = told.join(flags.where("good = 1 or toxic = 1"), "doc_id", "left").groupBy("part", "fails")
    cells = cells.agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))
    cells = materialise(cells, "filter_cells")
    discard(rows)
    return cells.groupBy("part").agg(F.collect_list(F.struct("fails", "n", "good", "toxic")).alias("cells")).mapInArrow(_audits, AUDIT)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: how the five filters interact over all ``documents``, by source, with ``labels``."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return audit(read("documents"), read("labels"))
