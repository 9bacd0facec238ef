"""Benchmark decontamination with suffix arrays of the training text.

The training documents are cut into shards of bounded size, each inside one task. A shard
has a suffix array over its words: the suffixes, as ids of benchmark words, in order. It is
sparse and lossless: a suffix whose first words are not the first words of some test suffix
can match none and is left out. Every test suffix is searched in each shard's array by
bisection; the range of suffixes that begin with its window gives the places, and words are
compared further from there for the longest verbatim match.

The benchmark is read in blocks of a bounded number of bytes, and each block is searched
in all documents: what is sent to tasks never grows with the data. An ordinary benchmark is
one block.

Nulls: a null text has no words; an item without words has no window and occurs nowhere. A
null item id occurs as the empty string; a null ``doc_id`` is kept as null. Items that share
a window all occur where it does; repeated item ids count once for a document. Empty tables: no
documents give no rows, no items leave every document clean. Of longest matches that tie, the first item's counts, and
of its the first in the document. Texts of any length are searched whole, in a shard of their own if need be. Other columns are not read,
or kept under ``row``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.rows import carried, released
from quern.runtime import bounded_batches

WINDOW = 13
LONGEST = pa.struct([("words", pa.int64()), ("item", pa.string()), ("at", pa.int64())])
#: A document goes if at least one word in so many is hit.
ONE_IN = 20
#: Bytes of benchmark text in a block, and of document text in a shard.
BLOCK_BYTES = 16 << 20
SHARD_BYTES = 4 << 20
#: Words of a suffix that must begin a test suffix: at most so many, and no more than the shortest window has.
LEAD = 4
#: ASCII letters and digits in lower case stay, other ASCII characters part words, all else stays.
_KEEP = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_KEEP).split() if text else []


class TestSuffixes:
    """The windows of a block of benchmark items, numbered words, and what begins a suffix."""

    __test__ = False

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.items: list[str] = []
        self.words: list[np.ndarray] = []
        at: dict[bytes, list[tuple[int, int]]] = {}
        for name, text in items:
            ids = np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(text)], ">i4")
            if not len(ids):
                continue
            n = len(self.items)
            self.items.append(name)
            self.words.append(ids)
            m = min(window, len(ids))
            for i in range(len(ids) - m + 1):
                key = ids[i : i + m].tobytes()
                at.setdefault(key, []).append((n, i))
        self.windows = list(at)
        self.places = list(at.values())
        self.owners = [sorted({n for n, _ in p}) for p in self.places]
        self.lead = min([LEAD, *(len(k) // 4 for k in self.windows)])
        self.base = np.int64(len(self.vocab) + 1)
        leads = {k[: 4 * self.lead] for k in self.windows}
        self.leads = np.sort(np.array([self._code(np.frombuffer(x, ">i4").reshape(1, -1))[0] for x in leads], np.uint64))

    def _code(self, rows: np.ndarray) -> np.ndarray:
        """Numbers of word rows; rows that differ may rarely agree, which only keeps a suffix that then matches nothing."""
        out = np.zeros(len(rows), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(rows.shape[1]):
                out = out * np.uint64(self.base) + rows[:, j].astype(np.uint64)
        return out

    def suffixes(self, ids: np.ndarray) -> np.ndarray:
        """Places in ``ids`` (zero: no benchmark word) where a test suffix can begin."""
        if not self.windows or len(ids) < self.lead:
            return np.zeros(0, np.int64)
        ok = ids[: len(ids) - self.lead + 1] > 0
        for j in range(1, self.lead):
            ok &= ids[j : len(ids) - self.lead + 1 + j] > 0
        at = np.flatnonzero(ok)
        if not len(at):
            return at
        code = self._code(np.stack([ids[at + j] for j in range(self.lead)], axis=1))
        found = np.searchsorted(self.leads, code)
        return at[(found < len(self.leads)) & (self.leads[np.minimum(found, len(self.leads) - 1)] == code)]


class SuffixArray:
    """Sorted suffixes of one shard, each cut at the window's length. Documents end with a zero word, so no match crosses them."""

    def __init__(self, ids: np.ndarray, test: TestSuffixes):
        at = test.suffixes(ids)
        padded = np.concatenate([ids, np.zeros(test.window, ids.dtype)]).astype(">i4")
        rows = np.lib.stride_tricks.sliding_window_view(padded, test.window)[at] if len(at) else np.zeros((0, test.window), ">i4")
        # Suffixes end at a document's end: words behind a zero are not part of them.
        rows = np.where(np.minimum.accumulate(rows > 0, axis=1), rows, 0).astype(">i4") if len(at) else rows
        keys = np.ascontiguousarray(rows).view(f"S{4 * test.window}").reshape(-1)
        order = np.argsort(keys, kind="stable")
        self.keys, self.at, self.test = keys[order], at[order], test

    def search(self) -> Iterator[tuple[int, np.ndarray]]:
        """Window numbers and the places where they occur."""
        size = 4 * self.test.window
        if not len(self.keys):
            return
        low = np.array([w for w in self.test.windows], f"S{size}")
        high = np.array([w.ljust(size, b"\xff") for w in self.test.windows], f"S{size}")
        a, b = np.searchsorted(self.keys, low, "left"), np.searchsorted(self.keys, high, "right")
        for i in np.flatnonzero(b > a).tolist():
            yield i, self.at[a[i] : b[i]]


def _shard(batch: pa.RecordBatch, test: TestSuffixes) -> Iterator[tuple[int, int, list[int], np.ndarray]]:
    """Parts of a batch, as rows from, to, word counts, and the numbered words with a zero behind each document."""
    texts, start = batch.column(1), 0
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    get = test.vocab.get
    while start < batch.num_rows:
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + SHARD_BYTES, "right")))
        counts, ids = [], []
        for text in texts[start:stop].to_pylist():
            w = words_of(text)
            counts.append(len(w))
            ids += [get(x, 0) for x in w]
            ids.append(0)
        yield start, stop, counts, np.array(ids, np.int32)
        start = stop


def _longest(test: TestSuffixes, window: int, p: int, ids: np.ndarray, begin: int, end: int) -> Iterator[tuple[int, int, int]]:
    """Words, item and the item's word of each match at place ``p`` of a document from ``begin`` to ``end`` that cannot be extended to the left."""
    m = len(test.windows[window]) // 4
    for n, i in test.places[window]:
        words = test.words[n]
        if i and p > begin and ids[p - 1] == words[i - 1]:
            continue
        more = min(len(words) - i, end - p)
        differ = np.flatnonzero(words[i + m : i + more] != ids[p + m : p + more])
        yield (int(differ[0]) + m if len(differ) else more), n, i


def _hits(batches: Iterator[pa.RecordBatch], test: TestSuffixes) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, stop, counts, ids in _shard(batch, test):
            edge = np.zeros(len(ids) + 1, np.int64)
            ends = np.cumsum(np.array(counts) + 1)
            items: list[set[int]] = [set() for _ in counts]
            longest: list[tuple[int, int, int]] = [(0, 0, 0)] * len(counts)  # words, and the earliest item and place of those, negative
            for window, places in SuffixArray(ids, test).search():
                m = len(test.windows[window]) // 4
                np.add.at(edge, places, 1)
                np.add.at(edge, places + m, -1)
                for p, d in zip(places.tolist(), np.searchsorted(ends, places, "right").tolist()):
                    items[d].update(test.owners[window])
                    begin = int(ends[d]) - counts[d] - 1
                    for k, n, _ in _longest(test, window, p, ids, begin, begin + counts[d]):
                        longest[d] = max(longest[d], (k, -n, begin - p))
            covered = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
            begins = ends - np.array(counts) - 1
            hit = covered[begins + np.array(counts)] - covered[begins]
            spans = [_spans(edge, b, n) if h else [] for b, n, h in zip(begins.tolist(), counts, hit.tolist())]
            names = [sorted({test.items[i] for i in x}) for x in items]
            ids_out = batch.column(0)[start:stop]
            columns = [ids_out, pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(names, pa.list_(pa.string()))]
            columns.append(pa.array([{"words": k, "item": test.items[-n], "at": -at} if k else None for k, n, at in longest], LONGEST))
            kept = [batch.column(i)[start:stop] for i in range(2, batch.num_columns)]
            yield pa.RecordBatch.from_arrays(columns + kept, names=["doc_id", "n_words", "spans", "items", "longest", *batch.schema.names[2:]])


def _spans(edge: np.ndarray, begin: int, n: int) -> list[int]:
    """Hit runs of a document as from, to, from, to."""
    deep = np.concatenate([[0], (np.cumsum(edge[begin : begin + n]) > 0).astype(np.int8), [0]])
    return np.flatnonzero(np.diff(deep)).tolist()


def benchmark_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, id_col: str = "item_id", text_col: str = "text") -> Iterator[list[tuple[str, str | None]]]:
    """The benchmark in blocks of so many bytes, read one after the other."""
    held, size = [], 0
    for row in benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), text_col).toLocalIterator():
        if held and size + len(row[1] or "") > block_bytes:
            yield held
            held, size = [], 0
        held.append((row[0], row[1]))
        size += len(row[1] or "")
    yield held


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Columns ``doc_id, n_words, spans, items, longest`` for each document, then those named in ``carry`` under ``row``.

    ``spans`` holds the hit runs of words as from, to, from, to; ``items`` the item ids whose windows occur, in order; ``longest`` the longest
    verbatim match, null if there is none: its number of words, the item and the document's word where it begins.
    """
    bounded_batches(docs.sparkSession)
    row = carried(carry)
    blocks = benchmark_blocks(benchmark, block_bytes)
    block, found = next(blocks), None
    while block is not None:
        after = next(blocks, None)
        test = docs.sparkSession.sparkContext.broadcast(TestSuffixes(block, window))
        # While further blocks follow, the text travels with the row, and then what was found before.
        if found is None:
            text = F.col(f"`{text_col}`")
            rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.struct(row, *([text.alias("text")] if after else [])).alias("held"))
        else:
            kept = F.struct(F.col("held.row").alias("row"), F.col("spans").alias("spans"), F.col("items").alias("items"), F.col("longest").alias("longest"), *([F.col("held.text").alias("text")] if after else []))
            rows = found.select("doc_id", F.col("held.text").alias("text"), kept.alias("held"))
        kind = rows.schema["held"].dataType.simpleString()
        got = rows.mapInArrow(lambda it, test=test: _hits(it, test.value), f"doc_id long, n_words long, spans array<bigint>, items array<string>, longest struct<words:bigint,item:string,at:bigint>, held {kind}")
        if found is not None:
            items = F.array_sort(F.array_union("items", "held.items"))
            best = F.when(F.coalesce(F.col("longest.words"), F.lit(0)) > F.coalesce(F.col("held.longest.words"), F.lit(0)), F.col("longest")).otherwise(F.col("held.longest"))
            got = got.select("doc_id", "n_words", _joined(F.col("spans"), F.col("held.spans")).alias("spans"), items.alias("items"), best.alias("longest"), "held")
        found, block = got, after
    return found.select("doc_id", "n_words", "spans", "items", "longest", F.col("held.row").alias("row"))


def _joined(a: Column, b: Column) -> Column:
    """Two lists of runs as one."""
    pairs = lambda x: F.when(F.size(x) > 0, F.transform(F.sequence(F.lit(0), F.size(x) - 2, F.lit(2)), lambda i: F.struct(F.get(x, i).alias("a"), F.get(x, i + 1).alias("b")))).otherwise(F.expr("cast(array() as array<struct<a:bigint,b:bigint>>)"))
    merged = F.aggregate(
        F.array_sort(F.concat(pairs(a), pairs(b))),
        F.expr("cast(array() as array<bigint>)"),
        lambda done, x: F.when((F.size(done) > 0) & (F.element_at(done, -1) >= x["a"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.greatest(F.element_at(done, -1), x["b"])))).otherwise(F.concat(done, F.array(x["a"], x["b"]))),
    )
    return merged


def n_hit(spans: Column) -> Column:
    """Words in hit runs."""
    return F.aggregate(F.transform(spans, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda s, x: s + x)


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Longest verbatim matches and where they are: ``doc_id, doc_word, item_id, item_word, n_words``, for matches of a window or more that cannot be extended to the left."""

    def run(batches: Iterator[pa.RecordBatch], test: TestSuffixes) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, counts, ids in _shard(batch, test):
                ends, rows = np.cumsum(np.array(counts) + 1), []
                names = batch.column(0)[start:stop].to_pylist()
                for w, places in SuffixArray(ids, test).search():
                    for p in places.tolist():
                        d = int(np.searchsorted(ends, p, "right"))
                        begin = int(ends[d]) - counts[d] - 1
                        rows += [(names[d], p - begin, test.items[n], i, k) for k, n, i in _longest(test, w, p, ids, begin, begin + counts[d])]
                types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, types)], names=["doc_id", "doc_word", "item_id", "item_word", "n_words"])

    found = None
    for block in benchmark_blocks(benchmark, block_bytes):
        test = docs.sparkSession.sparkContext.broadcast(TestSuffixes(block, window))
        part = docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(lambda it, test=test: run(it, test.value), "doc_id long, doc_word long, item_id string, item_word long, n_words long")
        found = part if found is None else found.union(part)
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, with the columns they came with."""
    found = contamination(docs, benchmark, carry=docs.columns, **options)
    hit = n_hit(F.col("spans"))
    return released(found.where((hit == 0) | (hit * ONE_IN < F.col("n_words"))), docs.columns)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: what of ``benchmark`` occurs in each document of ``documents``."""
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = found.withColumn("n_hit", n_hit(F.col("spans")))
    return hit.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * ONE_IN >= F.col("n_words"))).alias("contaminated"),
        F.col("longest.words").alias("longest_words"),
        F.col("longest.item").alias("longest_item"),
        F.col("longest.at").alias("longest_at"),
    )
