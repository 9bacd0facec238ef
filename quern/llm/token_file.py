"""Token-ID output: equal-length sequences of token ids and masks in Arrow stream files.

One shard is written by each task, in ascending order of document id:

* ``shard-NNNNN.arrows``: an Arrow stream of record batches with the columns
  ``ids fixed_size_list<uint16 or uint32>[L]`` and ``mask fixed_size_list<bool>[L]``. Every
  batch but the last holds the same number of sequences, so sequence ``i`` is in batch
  ``i // per_batch``; `open_sequences` maps the file into memory and gives views of it without a copy. Buffers are
  not compressed for that reason. The mask is false on the padding at a shard's end.
* ``shard-NNNNN.index.arrows``: ``doc_id, start, n_tokens`` of each document, ``start``
  counted in the shard.
* ``manifest``: a Parquet table with a row for each shard.

Files are written under a name of the attempt's own and then moved, and a task that is run again writes
the same bytes, so lost executors and attempts that run side by side do no harm.

Nulls: a null text is an empty one and has only the end id; a null ``doc_id`` sorts first.
Equal ids are ordered by text, null first, repeated rows each get their own place. A text of any length is
encoded whole; memory grows with the longest one. An empty table gives no shards and no rows.
Other columns are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.bpe import GROUP_BYTES, shared_encoder
from quern.runtime import bounded_batches, materialise, work_path

SEQUENCE = 2048
PER_BATCH = 64
MANIFEST = "shard int, data string, index string, n_docs long, n_tokens long, n_sequences long"


class ShardWriter:
    """Packs the ids of documents into sequences of one shard."""

    def __init__(self, folder: str, shard: int, dtype: np.dtype, length: int, per_batch: int, attempt: int = 0):
        from pyarrow import fs

        self.fs, base = fs.FileSystem.from_uri(folder)
        self.fs.create_dir(base, recursive=True)
        self.dtype, self.length, self.per_batch = dtype, length, per_batch
        self.names = [f"{base}/shard-{shard:05d}{end}" for end in (".arrows", ".index.arrows")]
        self.parts = [f"{n}.{attempt}.part" for n in self.names]
        value = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(value, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.index_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.sinks = [self.fs.open_output_stream(p) for p in self.parts]
        self.data = pa.ipc.new_stream(self.sinks[0], self.schema)
        self.index = pa.ipc.new_stream(self.sinks[1], self.index_schema)
        self.held = np.zeros(0, dtype)
        self.n_tokens = self.n_docs = self.n_sequences = 0

    def _put(self, ids: np.ndarray, real: int) -> None:
        n = len(ids) // self.length
        mask = np.arange(len(ids)) < real
        arrays = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.data.write_batch(pa.RecordBatch.from_arrays(arrays, schema=self.schema))
        self.n_sequences += n

    def add(self, doc_ids: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        """Documents with so many ids each, one after the other in ``ids``."""
        starts = self.n_tokens + np.cumsum(counts) - counts
        self.n_tokens += int(counts.sum())
        self.n_docs += len(doc_ids)
        full = self.length * self.per_batch
        joined = np.concatenate([self.held, ids])
        whole = len(joined) // full * full
        for at in range(0, whole, full):
            self._put(joined[at : at + full], full)
        self.held = joined[whole:].copy()
        self.index.write_batch(pa.record_batch([doc_ids, pa.array(starts), pa.array(counts)], schema=self.index_schema))

    def close(self) -> None:
        rest = self.held
        if len(rest):
            pad = np.zeros(-len(rest) % self.length, self.dtype)
            self._put(np.concatenate([rest, pad]), len(rest))
        for x in (self.data, self.index, *self.sinks):
            x.close()
        for part, name in zip(self.parts, self.names):
            self.fs.move(part, name)


class Sequences:
    """Random access to the sequences of one shard. ``[i]`` gives ids and mask of the sequence as views of the mapped file."""

    def __init__(self, path: str):
        self.file = pa.memory_map(path.removeprefix("file://"))
        self.batches = list(pa.ipc.open_stream(self.file))
        self.per_batch = self.batches[0].num_rows if self.batches else 1

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def __getitem__(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        if not 0 <= i < len(self):
            raise IndexError(i)
        batch, row = self.batches[i // self.per_batch], i % self.per_batch
        ids, mask = batch.column("ids"), batch.column("mask")
        n = ids.type.list_size
        return ids.values[row * n : (row + 1) * n].to_numpy(zero_copy_only=True), mask.values[row * n : (row + 1) * n]


def open_sequences(path: str) -> Sequences:
    """A shard's data file, mapped into memory."""
    return Sequences(path)


def read_shard(data: str, index: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Groups of documents of one shard: ids, starts and numbers of tokens, and the token ids of each, taken from the sequences under the mask."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(data)
    with store.open_input_stream(path) as a, store.open_input_stream(fs.FileSystem.from_uri(index)[1]) as b:
        batches, held, at = iter(pa.ipc.open_stream(a)), np.zeros(0, np.uint16), 0
        for docs in pa.ipc.open_stream(b):
            ids, starts, counts = (docs.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            got = []
            for start, n in zip(starts.tolist(), counts.tolist()):
                parts, have = [held[start - at :]], len(held) - (start - at)
                at = start
                while have < n:
                    x = next(batches)
                    values = x.column("ids").values.to_numpy()
                    mask = x.column("mask").values
                    if mask.true_count < len(values):
                        values = values[mask.to_numpy(zero_copy_only=False)]
                    parts.append(values)
                    have += len(values)
                held = np.concatenate(parts) if len(parts) > 1 else parts[0]
                got.append(held[:n])
            yield docs.column("doc_id"), starts, counts, got


def grouped(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Batches put together until they hold so many bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.nbytes for b in held) >= size:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def ids_with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with one more behind each document's."""
    out = np.full(len(ids) + len(counts), end_id, ids.dtype)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
    return out, counts + 1


def write_token_files(
    docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int | None = 0, length: int = SEQUENCE, per_batch: int = PER_BATCH, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Encode all documents, write the shards, and return the manifest. Shards follow each other in ascending document id."""
    spark = docs.sparkSession
    bounded_batches(spark)
    folder = folder or work_path(spark, "tokens")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        shard, encoder, out = context.partitionId(), None, None
        for table in grouped(batches, GROUP_BYTES):
            if encoder is None:
                encoder = shared_encoder(tokenizer)
                out = ShardWriter(folder, shard, encoder.dtype, length, per_batch, context.taskAttemptId())
            at, doc_ids = 0, table.column(0).combine_chunks()
            for ids, counts in encoder.encode_array(table.column(1).combine_chunks()):
                docs = doc_ids[at : at + len(counts)]
                at += len(counts)
                out.add(docs, *(ids_with_end(ids, counts, end_id) if end_id is not None else (ids, counts)))
        if out is not None:
            out.close()
            kind = folder.partition("://")[0] + "://" if "://" in folder else "file://"
            row = [shard, *(kind + n for n in out.names), out.n_docs, out.n_tokens, out.n_sequences]
            types = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=["shard", "data", "index", "n_docs", "n_tokens", "n_sequences"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Each document as the files have it: its place among all ids, its number of ids and their checksum."""
    # One row for each file: a window over them all is small.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    placed = materialise(placed, "manifest")
    shards = placed.count()
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, shard int"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for ids, starts, counts, got in read_shard(row["data"], row["index"]):
                    crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in got]
                    columns = [ids, pa.array(starts + row["base"]), pa.array(counts), pa.array(crc, pa.int64()), pa.array([row["shard"]] * len(crc), pa.int32())]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "shard"])

    return placed.repartition(max(1, shards)).mapInArrow(read, schema)


def token_ids(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write token files and read them back."""
    return read_token_files(write_token_files(docs, tokenizer, **options))


def default_tokenizer(name: str = "byte_bpe_50k.json") -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: every document of ``documents`` in token files, read back."""
    return token_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
