"""Removal of repeated 100-byte strings with a sparse suffix array and a logarithmic index family.

A byte goes if a 100-byte string covers it that also starts earlier: in a document with a
smaller id, or in the same one. Strings are judged on the input.

1. Every document's windows choose suffixes (see `repeats_text`); windows in a row that choose
   the same one are a stretch. Inside a task, batches of stretches are scanned against an
   index family of sorted arrays whose levels merge geometrically, which takes out most copies
   before anything is shuffled.
2. Stretches are brought together by the first bytes of their suffix, in order. One whose
   bytes all occur earlier is repeated as a whole. One that is the first of its kind,
   while others begin alike, is on the edge of a repeat: only some of its windows may be
   repeated. All others are done with; they are by far the most.
3. Edges whose bytes on neither side of the suffix's first are shared are done with too; so
   is the half of the windows that need a side that is not shared. The windows left, a few hundredths of all, are
   compared one by one, by 128 bits of hash, in ``ROUNDS`` rounds by hash: only one round's shuffles
   are on disk at a time.
4. Repeated stretches and windows are joined to their documents, and the bytes are taken out.

Hot groups: copies are mostly taken out inside tasks. Where many different stretches of a
batch begin alike, all but two are known to be edges and are dealt out by all their bytes
instead. Counts and minima of edges and windows are taken by partial aggregation, and the joins that
follow have two shuffled sides that Spark can split.

Nulls: a null text is an empty one. A null id comes before all others. Rows with the same id
follow each other by text, repeated rows in any order. Documents of fewer than 100 bytes
lose nothing; very long ones are worked on whole, each as one row. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm import repeats_text as R
from quern.runtime import bounded_batches, drop_finished_shuffles, materialise, work_path

#: In a batch, of more stretches than this that begin alike, two stand for all.
ALIKE = 8
OPEN, WHOLE, EDGE = 0, 1, 2
#: Windows are compared in so many rounds; each has all windows of the hashes that fall to it.
ROUNDS = 4
_STRETCHES = "deal long, key long, whole long, doc long, copy int, place long, sides long, state int"
_WINDOWS = "h1 long, h2 long, doc long, copy int, start long, round int"
_MOST_BYTES = 8 << 20


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _parts(batch: pa.RecordBatch, column: int = 2) -> Iterator[list[list]]:
    """The batch in parts of a bounded number of bytes."""
    rows = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
    start = size = 0
    for i, text in enumerate(rows[column]):
        size += len(text or "")
        if size >= _MOST_BYTES:
            yield [r[start : i + 1] for r in rows]
            start, size = i + 1, 0
    if start < batch.num_rows:
        yield [r[start:] for r in rows]


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    family = R.IndexFamily()
    for batch in batches:
        for docs, copies, texts in _parts(batch):
            got: list[list[np.ndarray]] = [[] for _ in range(6)]
            for doc, copy, text in zip(docs, copies, texts):
                h = R.Hashes(_raw(text))
                first, last, chosen, key, whole = R.stretches(h)
                if len(first):
                    row = (whole, key, np.full(len(first), doc), np.full(len(first), copy, np.int32), R.packed(first, chosen, last), R.sides(h, chosen))
                    for x, y in zip(got, row):
                        x.append(y)
            if not got[0]:
                continue
            whole, key, doc, copy, place, sides = (np.concatenate(x) for x in got)
            state = np.where(family.add([whole, key, doc, copy, place]), WHOLE, OPEN).astype(np.int32)
            # Repeated ones are dealt out anyhow; of many open ones that begin alike, the smallest and the largest stand for all.
            deal = np.where(state == WHOLE, R.mixed(doc.astype(np.uint64) ^ place.astype(np.uint64)), key)
            rest = np.flatnonzero(state == OPEN)
            rest = rest[np.lexsort([whole[rest], key[rest]])]
            _, at, n = np.unique(key[rest], return_index=True, return_counts=True)
            for a, m in zip(at[n > ALIKE].tolist(), n[n > ALIKE].tolist()):
                inner = rest[a + 1 : a + m - 1]
                state[inner], deal[inner] = EDGE, whole[inner]
            columns = [deal.view(np.int64), key.view(np.int64), whole.view(np.int64), doc, copy, place, sides, state]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c.split()[0] for c in _STRETCHES.split(", ")])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """128-bit hashes of the windows in question, and the rounds they fall to."""
    for batch in batches:
        for docs, copies, texts, ranges in _parts(batch):
            for doc, copy, text, spans in zip(docs, copies, texts, ranges):
                h = R.Hashes(_raw(text))
                start = np.concatenate([np.arange(a, b + 1) for a, b in zip(spans[::2], spans[1::2])])
                columns = [R.mixed(h.of(i, start, start + R.WINDOW)).view(np.int64) for i in (0, 1)]
                columns += [np.full(len(start), doc), np.full(len(start), copy, np.int32), start]
                columns.append((columns[1].view(np.uint64) % np.uint64(ROUNDS)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["h1", "h2", "doc", "copy", "start", "round"])


RESULT = "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def removed_runs(n: int, ranges: list[int] | None, starts: list[int] | None) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the windows in ``ranges`` (from, to, from, to) and at ``starts`` cover."""
    edge = np.zeros(n + 1, np.int64)
    a = np.array((ranges or [])[::2] + (starts or []), np.int64)
    b = np.array((ranges or [])[1::2] + (starts or []), np.int64)
    np.add.at(edge, a, 1)
    np.add.at(edge, b + R.WINDOW, -1)
    cover = np.concatenate([[0], (np.cumsum(edge[:-1]) > 0).astype(np.int8), [0]])
    turn = np.flatnonzero(np.diff(cover)).tolist()
    return list(zip(turn[::2], turn[1::2]))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for doc, text, ranges, starts in zip(*(batch.column(i).to_pylist() for i in range(4))):
            raw = _raw(text)
            runs = removed_runs(len(raw), ranges, starts) if ranges or starts else []
            kept = hashlib.sha256()
            at = 0
            for a, b in runs:
                kept.update(raw[at:a])
                at = b
            kept.update(raw[at:])
            out.append((doc, len(raw), sum(b - a for a, b in runs), len(runs), kept.hexdigest()))
        if out:
            types = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=[c.split()[0] for c in RESULT.split(", ")])


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc, copy, text``; rows that share an id are numbered, which is only done where some do."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("doc"), F.col(text_col).alias("text"))
    shared = materialise(rows.groupBy("doc").count().where("count > 1").select("doc"), "shared_ids")
    single = rows.select("doc", F.lit(0).alias("copy"), "text")
    if shared.isEmpty():
        return single
    order = Window.partitionBy("doc").orderBy(F.asc_nulls_first("text"))
    several = rows.join(shared, "doc", "left_semi").select("doc", (F.row_number().over(order) - 1).cast("int").alias("copy"), "text")
    return single.join(shared, "doc", "left_anti").union(several)


def _later(windows: DataFrame) -> DataFrame:
    """Places of windows that also start earlier."""
    at = F.struct("doc", "copy", "start")
    least = windows.groupBy("h1", "h2").agg(F.min(at).alias("least"), F.count("*").alias("n")).where("n > 1").select("h1", "h2", "least")
    return windows.join(least, ["h1", "h2"]).where(F.col("least") != at).select("doc", "copy", "start")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The documents, numbered, and for each that loses bytes ``ranges`` of window starts and single ``starts``."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = _numbered(docs, id_col, text_col)
    with drop_finished_shuffles(spark):
        alike = Window.partitionBy("deal", "key")
        order = alike.orderBy("whole", "doc", "copy", "place")
        found = rows.mapInArrow(_find, _STRETCHES)
        found = found.withColumn("again", F.coalesce(F.lag("whole").over(order) == F.col("whole"), F.lit(False)))
        found = found.withColumn("shared", F.min("whole").over(alike) != F.max("whole").over(alike))
        state = F.when(F.col("again") | (F.col("state") == WHOLE), WHOLE).when(F.col("shared") | (F.col("state") == EDGE), EDGE).otherwise(OPEN)
        found = materialise(found.withColumn("state", state).where(F.col("state") != OPEN).select("key", "doc", "copy", "place", "sides", "state"), "stretches")

        first = F.shiftright("place", 14)
        chosen = first + F.shiftright("place", 7).bitwiseAND(F.lit(127))
        last = first + F.col("place").bitwiseAND(F.lit(127))
        edges = found.where(F.col("state") == EDGE).select("key", "doc", "copy", first.alias("first"), last.alias("last"), chosen.alias("chosen"), F.shiftright("sides", 16).alias("right"), F.col("sides").bitwiseAND(F.lit(65535)).alias("left"))
        for side in ("right", "left"):
            many = edges.where(F.col(side) > 0).groupBy("key", side).agg(F.count("*").alias("n")).where("n > 1").select("key", side, F.lit(True).alias(f"{side}_shared"))
            edges = edges.join(many, ["key", side], "left")
        # Windows that begin up to half their rest before the suffix have that much on its right, others on its left.
        half = (R.WINDOW - R.LEAD) // 2
        low = F.when(F.col("left_shared"), F.col("first")).otherwise(F.greatest("first", F.col("chosen") - half))
        high = F.when(F.col("right_shared"), F.col("last")).otherwise(F.least("last", F.col("chosen") - half))
        edges = edges.where("left_shared or right_shared").select("doc", "copy", low.alias("low"), high.alias("high")).where("low <= high")
        spans = materialise(edges.groupBy("doc", "copy").agg(F.flatten(F.collect_list(F.array("low", "high"))).alias("spans")), "spans")
        windows = rows.join(spans, ["doc", "copy"]).select("doc", "copy", "text", "spans").mapInArrow(_windows, _WINDOWS)
        path = work_path(spark, "windows")
        windows.write.partitionBy("round").parquet(path)
        windows = spark.read.schema(_WINDOWS).parquet(path)
        later = reduce(DataFrame.union, (materialise(_later(windows.where(F.col("round") == i)), "later") for i in range(ROUNDS)))
        whole = found.where(F.col("state") == WHOLE).groupBy("doc", "copy").agg(F.flatten(F.collect_list(F.array(first, last))).alias("ranges"))
        single = later.groupBy("doc", "copy").agg(F.collect_list("start").alias("starts"))
        return rows, materialise(whole.join(single, ["doc", "copy"], "full"), "repeats")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of each document."""
    rows, lost = repeats(docs, id_col, text_col)
    cut = rows.join(lost, ["doc", "copy"], "left").select("doc", "text", "ranges", "starts").mapInArrow(_cut, RESULT)
    return cut.withColumn("doc", F.nullif("doc", F.lit(-(1 << 63)))).withColumnRenamed("doc", "doc_id")


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: every document of ``documents`` without what repeats."""
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
