"""Scores of texts under a unigram model and a causal self-attention model.

Documents are dealt out by a digest and read once, in blocks: texts become numbers of the block's distinct words, which are encoded to subword ids
once, and windows to learn from. Words' numbers in training documents are summed over all blocks and go back to the block: no table of all
words is ever sent to a task, and a frequent word has one row for each block.

The attention model (see `attention`) predicts subword ids. Its classes are counts over all training
documents, and its weights are learned from the same: every text is cut into windows, whole, so that each of its ids and its end are
predicted once. In each of ``ROUNDS`` rounds
tasks train once on ``TASK_WINDOWS`` windows or less each, and their changes are averaged in a tree; only the average comes to the
driver, and no text does.

Each task scores whole blocks: overlapping windows score each id once, in batches.

Nulls: a null text is an empty one: its only token is the end. A null id counts as held out.
Repeated rows each get a row and count as often. Texts of any length are scored whole; a block holds at least one text.
If there is nothing to learn from, counts are zero and the model is as it starts. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from quern.llm import attention
from quern.llm.bpe import WordEncoder, shared_word_encoder
from quern.runtime import bounded_batches, drop_finished_shuffles, materialise, work_path

FOLDS, HELD_OUT = 7, 2
BLOCK_CHARS = 8_000_000
#: A text is one run of words, however long, and every run is learned from: nothing is drawn.
RUN, ONE_IN = 1 << 62, 1
#: Rounds of training, and windows of a task in one.
ROUNDS, TASK_WINDOWS = 4, 32768


def words_of(texts: pa.Array | pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts one after the other, ASCII letters in lower case, and how many each text has."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = pa.array([], pa.string()) if texts.type == pa.null() else texts
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, text = parts.flatten(), pc.list_parent_indices(parts)
    full = pc.greater(pc.binary_length(words), 0)  # white space at either end leaves an empty one
    return words.filter(full), np.bincount(text.filter(full).to_numpy(), minlength=len(texts))


def held_out(doc_id: Column, folds: int = FOLDS, fold: int = HELD_OUT) -> Column:
    """Whether a document is in the fold that is not learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(True))


def default_ranks() -> str:
    """The public byte-level BPE's ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


#: What is read of the documents, one kind of rows beside the other.
WORDS, SUBWORDS, DOCUMENTS, WINDOWS = range(4)
CODED = pa.schema(
    [("kind", pa.int32()), ("block", pa.int64()), ("word", pa.string()), ("place", pa.int32()), ("n", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()),
     ("places", pa.binary()), ("times", pa.binary()), ("ids", pa.binary()), ("round", pa.int32()), ("spread", pa.int64())]
)


def _rows(kind: int, size: int, /, **columns: pa.Array) -> pa.RecordBatch:
    """Rows of one kind; all other columns are null."""
    columns["kind"] = pa.array(np.full(size, kind, np.int32))
    return pa.RecordBatch.from_arrays([columns[x.name] if x.name in columns else pa.nulls(size, x.type) for x in CODED], schema=CODED)


def _binary(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary of so many values for each row."""
    ends = np.concatenate([[0], np.cumsum(sizes * values.itemsize)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])


def _coder(tokenizer: str, block_chars: int):
    """Function for `mapInArrow` of ``doc_id, text, held_out``: rows as in ``CODED``, block by block.

    A block's distinct words stand with their places in it and their numbers in its training documents; its documents are lists of places, and one row beside them has
    all words' subword ids. Subword ids stand with their numbers in training documents.
    """

    def coded(table: pa.Table, block: int) -> Iterator[pa.RecordBatch]:
        encoder = shared_word_encoder(tokenizer)
        words, sizes = words_of(table.column("text"))
        named = words.dictionary_encode()
        names, at = named.dictionary, named.indices.to_numpy()
        ids, times = encoder.encode(names.to_pylist())
        held = table.column("held_out").to_numpy()
        learn = np.repeat(~held, sizes)
        counts = np.bincount(at[learn], minlength=len(names))
        own = pa.array(np.full(len(names), block))
        yield _rows(WORDS, len(names), block=own, word=names, place=pa.array(np.arange(len(names), dtype=np.int32)), n=pa.array(counts))
        subwords = np.bincount(ids, weights=np.repeat(counts, times), minlength=1).astype(np.int64)
        some = np.flatnonzero(subwords)
        yield _rows(SUBWORDS, len(some), place=pa.array(some.astype(np.int32)), n=pa.array(subwords[some]))
        yield _rows(DOCUMENTS, 1, block=pa.array([block]), ids=pa.array([ids.tobytes()], pa.binary()), times=pa.array([times.astype("<i4").tobytes()], pa.binary()))
        doc_ids, texts = table.column("doc_id").combine_chunks(), table.column("text")
        yield _rows(DOCUMENTS, len(sizes), block=pa.array(np.full(len(sizes), block)), doc_id=doc_ids, held_out=pa.array(held), places=_binary(at.astype("<i4"), sizes))
        if not held.all():
            free = pa.array(~held)
            windows = _windows(doc_ids.filter(free), texts.filter(free), sizes[~held], at[learn], ids, times, encoder)
            yield _rows(WINDOWS, len(windows[0]), **dict(zip(("round", "spread", "ids"), windows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= block_chars:
                yield from coded(pa.Table.from_batches(held), block)
                block, held, size = block + 1, [], 0
        if held:
            yield from coded(pa.Table.from_batches(held), block)

    return run


def read_once(rows: DataFrame, parts: int, tokenizer: str) -> DataFrame:
    """What is learned from and scored, as in ``CODED``, of ``rows(doc_id, text, held_out)``; tasks hold a block of ``BLOCK_CHARS``, and one text at least.

    Each kind is a folder of its own, written without a sort, and can go by itself (`_discard`).
    """
    spark, key = rows.sparkSession, "spark.sql.maxConcurrentOutputFileWriters"
    before, path = spark.conf.get(key), work_path(spark, "coded")
    spark.conf.set(key, "8")
    try:
        rows.select("doc_id", "text", "held_out").repartition(parts, "doc_id", "text").mapInArrow(_coder(tokenizer, BLOCK_CHARS), from_arrow_schema(CODED)).write.partitionBy("kind").parquet(path)
    finally:
        spark.conf.set(key, before)
    found = spark.read.schema(from_arrow_schema(CODED)).parquet(path)
    found._work_path = path
    return found


def _discard(coded: DataFrame, kind: int) -> None:
    """Delete the rows of one kind, once nothing reads them any more."""
    spark = coded.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{coded._work_path}/kind={kind}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def word_counts(coded: DataFrame) -> DataFrame:
    """``(block, place, c, first)``: each block's words with their numbers in all training documents; one row of a word is its first."""
    same = Window.partitionBy("word")
    words = coded.where(F.col("kind") == WORDS).select("block", "word", "place", F.sum("n").over(same).alias("c"), (F.min("block").over(same) == F.col("block")).alias("first"))
    return materialise(words.select("block", "place", "c", "first"), "word_counts")


def subword_counts(coded: DataFrame, size: int) -> np.ndarray:
    """Numbers of subword ids in all training documents; a row for each id goes through the driver."""
    out = np.zeros(size)
    for i, n in coded.where(F.col("kind") == SUBWORDS).groupBy("place").agg(F.sum("n")).collect():
        out[i] = n
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _windows(doc_ids: pa.Array, texts: pa.Array | pa.ChunkedArray, sizes: np.ndarray, at: np.ndarray, ids: np.ndarray, times: np.ndarray, encoder: WordEncoder) -> list[pa.Array]:
    """``round, spread, ids`` of texts whose words are given by their places in a list of ids and numbers of ids.

    A window begins at the last id of the one before, so that every id and the end are predicted once.
    """
    n = times[at]
    own = np.diff(np.concatenate([[0], np.cumsum(n)])[np.cumsum(sizes)], prepend=0)
    # Texts one after the other, an end before and behind each.
    begins = np.cumsum(own + 2) - (own + 2)
    stream = np.full(int((own + 2).sum()), encoder.end, encoder.dtype)
    stream[np.repeat(begins + 1 - (np.cumsum(own) - own), own) + np.arange(own.sum())] = ids[np.repeat((np.cumsum(times) - times)[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    windows = -(-(own + 1) // attention.WINDOW)
    place = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    start = np.repeat(begins, windows) + place * attention.WINDOW
    long = np.minimum(attention.WINDOW + 1, np.repeat(begins + own + 2, windows) - start)
    packed = stream[np.repeat(start - (np.cumsum(long) - long), long) + np.arange(long.sum())]
    text_seeds = np.array([zlib.crc32((t or "").encode()) for t in texts.to_pylist()], np.uint64)
    seeds = text_seeds ^ _mixed(pc.fill_null(doc_ids, 0).to_numpy().astype(np.uint64))
    spread = _mixed(_mixed(seeds).repeat(windows) + place.astype(np.uint64))
    return [pa.array((spread % np.uint64(ROUNDS)).astype(np.int32)), pa.array((spread >> np.uint64(8)).astype(np.int64)), _binary(packed, long)]


def training_windows(rows: DataFrame, tokenizer: str) -> DataFrame:
    """``(round, spread, ids)``: windows of ids of every document of ``rows(doc_id, text)``, whole. A batch's distinct words are encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            encoder = shared_word_encoder(tokenizer)
            words, sizes = words_of(batch.column(1))
            named = words.dictionary_encode()
            ids, times = encoder.encode(named.dictionary.to_pylist())
            yield pa.RecordBatch.from_arrays(_windows(batch.column(0), batch.column(1), sizes, named.indices.to_numpy(), ids, times, encoder), names=["round", "spread", "ids"])

    return rows.select("doc_id", "text").mapInArrow(run, "round int, spread long, ids binary")


def _averaged(changes: DataFrame, tasks: int) -> np.ndarray | None:
    """The mean change of weights, weighted by numbers of windows, in a tree of tasks."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean = 0, None
        for batch in batches:
            for row in batch.to_pylist():
                change = np.frombuffer(row["change"], np.float32)
                n += row["n"]
                mean = change.copy() if mean is None else mean + (change - mean) * np.float32(row["n"] / n)
        if mean is not None:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([mean.tobytes()], pa.binary())], names=["n", "change"])

    while tasks > 1:
        tasks = -(-tasks // 32)
        changes = changes.repartition(tasks).mapInArrow(add, "n long, change binary")
    row = changes.coalesce(1).mapInArrow(add, "n long, change binary").first()
    return np.frombuffer(row.change, np.float32) if row else None


def fit(coded: DataFrame, n_documents: int, tokenizer: str) -> attention.Model:
    """The attention model from the windows and the counts of ``coded``."""
    encoder = shared_word_encoder(tokenizer)
    subwords = subword_counts(coded, encoder.vocab_size)
    subwords[encoder.end] = n_documents
    model = attention.Model.new(attention.Vocabulary.of(subwords), subwords, encoder.end)
    windows = coded.where(F.col("kind") == WINDOWS).select("round", "spread", "ids")
    numbers = {r["round"]: r.n for r in windows.groupBy("round").agg(F.count("*").alias("n")).collect()}
    dtype = encoder.dtype
    for turn in sorted(numbers):
        tasks = -(-numbers[turn] // TASK_WINDOWS)
        rate = attention.RATE * (1 - turn / ROUNDS)

        def train(batches: Iterator[pa.RecordBatch], model=model, rate=rate) -> Iterator[pa.RecordBatch]:
            found = [np.frombuffer(x, dtype) for batch in batches for x in batch.column(0).to_pylist()]
            if found:
                padded = np.full((len(found), attention.WINDOW + 1), -1, np.int32)
                sizes = np.array([len(x) for x in found])
                padded[np.arange(attention.WINDOW + 1) < sizes[:, None]] = np.concatenate(found)
                change = model.trained(padded, rate, len(found)).packed() - model.packed()
                yield pa.RecordBatch.from_arrays([pa.array([len(found)]), pa.array([change.tobytes()], pa.binary())], names=["n", "change"])

        dealt = windows.where(F.col("round") == turn).repartition(tasks, "spread").sortWithinPartitions("spread", "ids").select("ids")
        change = _averaged(dealt.mapInArrow(train, "n long, change binary"), tasks)
        model = model if change is None else model.moved(change)
    return model


def _by_text(ids: np.ndarray, times: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """The ids of each text, from how many each word has and how many words each text has."""
    ends = np.concatenate([[0], np.cumsum(times)])[np.cumsum(sizes)]
    return np.split(ids, ends[:-1]) if len(sizes) else []


def _packed(column: pa.ChunkedArray, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """A binary column's ids and where each row's begin and the last one's end."""
    array = column.combine_chunks()
    if not len(array):
        return np.zeros(0, dtype), np.zeros(1, np.int64)
    _, ends, data = array.buffers()
    ends = np.frombuffer(ends, np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(dtype), (ends - ends[0]) // dtype.itemsize


def _scorer(model: attention.Model, dtype: np.dtype):
    """Function of a block's documents and words for `applyInArrow`."""

    def run(docs: pa.Table, table: pa.Table) -> pa.Table:
        of_block = pc.is_valid(docs.column("ids"))
        block, docs = docs.filter(of_block), docs.filter(pc.invert(of_block))
        ids, times = _packed(block.column("ids"), dtype)[0], _packed(block.column("times"), np.dtype("<i4"))[0].astype(np.int64)
        begins = np.concatenate([[0], np.cumsum(times)])
        at, ends = _packed(docs.column("places"), np.dtype("<i4"))
        sizes = np.diff(ends)
        count = np.zeros(len(times), np.int64)
        count[table.column("place").to_numpy()] = table.column("c").to_numpy()
        text = np.repeat(np.arange(len(sizes)), sizes)
        sums = np.bincount(text, weights=np.log10(count + 1.0)[at], minlength=len(sizes)).astype(np.float64)  # whole numbers where there are no words
        known = np.bincount(text, weights=count[at] > 0, minlength=len(sizes)).astype(np.int64)
        scores: list[np.ndarray] = []
        ends = np.cumsum(sizes)
        # Whole texts at a time, about half a million words.
        cuts = [0, *(np.flatnonzero(np.diff(ends // 500_000)) + 1).tolist(), len(sizes)]
        for a, b in zip(cuts, cuts[1:]):
            own = at[ends[a] - sizes[a] if a < len(sizes) else 0 : ends[b - 1] if b else 0]
            n = times[own]
            from_ = np.repeat(begins[own] - (np.cumsum(n) - n), n)
            scores.append(model.score(_by_text(ids[from_ + np.arange(len(from_))], n, sizes[a:b])))
        columns = [docs.column("doc_id"), docs.column("held_out"), pa.array(sizes + 1, pa.int64()), pa.array(known), pa.array(sums), pa.array(np.concatenate(scores))]
        return pa.table(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "sums", "score"])

    return run


def score(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of each document."""
    spark = docs.sparkSession
    bounded_batches(spark)
    tokenizer = tokenizer or default_ranks()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), held_out(F.col(id_col).cast("long")).alias("held_out"))
    chars, n_documents = rows.agg(F.sum(F.length("text")), F.count_if(~F.col("held_out"))).first()
    parts = max(spark.sparkContext.defaultParallelism, 1 + (chars or 0) // BLOCK_CHARS)
    with drop_finished_shuffles(spark):
        coded = read_once(rows, parts, tokenizer)
        counts = word_counts(coded)
        _discard(coded, WORDS)
        n, v = counts.where("first and c > 0").agg(F.sum("c"), F.count("*")).first()
        n, v = (n or 0) + n_documents, v + (n_documents > 0)
        model = fit(coded, n_documents, tokenizer)
        _discard(coded, WINDOWS)
    docs = coded.where(F.col("kind") == DOCUMENTS).select("block", "doc_id", "held_out", "places", "times", "ids")
    # Scoring takes long for each block: the number of parts is fixed, so that adaptive execution does not put blocks together.
    docs, counts = docs.repartition(2 * parts, "block"), counts.select("block", "place", "c").repartition(2 * parts, "block")
    found = docs.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(_scorer(model, shared_word_encoder(tokenizer).dtype), "doc_id long, held_out boolean, n_tokens long, n_known long, sums double, score double")
    end, total = F.lit(float(np.log10(n_documents + 1))), F.lit(float(np.log10(n + v + 1)))
    return found.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.lit(int(n_documents > 0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("sums") + end - F.col("n_tokens") * total).alias("base_score"),
        "score",
    )


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: scores of all ``documents`` under both models."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
