"""MinHash fingerprints of documents, and near-duplicates through signature bands.

A text's shingles are hashed in numpy, all at once: a running sum of bytes times powers of an
odd number gives the hash of any stretch of words. Each of ``PERMUTATIONS`` universal hash functions
``(a x + b) mod 2^64`` is taken over all shingles, and its smallest value is kept.

`compared` needs for each document the one after it in descending order of ids. Bounds from quantiles of the ids cut the order into ranges, one
for each partition; only the first row of each range is sent to the range before it, so
that texts are shuffled once and no order is made in one task.

`near_duplicates` and `representatives` join bands of signatures of different texts and check
the Jaccard likeness of the shingles themselves.

Nulls: a null text is an empty one. A text without words has a fingerprint of its own, equal
to that of any other such text; one with fewer words than a shingle is one shingle. Null ids
come last in descending order; rows with equal ids are ordered by text, null first. A table
with one row is its own next document. An empty table gives no rows. A very long text is one row; it is hashed
in steps of ``_STEP`` shingles, and its tables of powers go with it. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.components import components
from quern.runtime import bounded_batches, discard, materialise

WIDTH = 5
PERMUTATIONS = 128
THRESHOLD = 0.8
#: Rows of a band: at a likeness of 0.8, 25 bands of 5 miss one pair in twenty thousand.
BAND_ROWS = 5
#: Rounds against one text of each band before all pairs that are left, and how many of those for each text end the rounds early.
ROUNDS, PAIRS_PER_TEXT = 2, 4
_SEED = 20240607
_BASE = 0x9E3779B97F4A7C15
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_STEP = 512


class Hasher:
    """Signatures of texts; keeps tables of powers for texts of up to ``KEPT`` bytes, those for longer ones go with the text."""

    KEPT = 1 << 18

    def __init__(self, permutations: int = PERMUTATIONS, width: int = WIDTH):
        rng = np.random.Generator(np.random.PCG64(_SEED))
        self.width = width
        self.a = rng.integers(0, 1 << 63, permutations, np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, permutations, np.uint64) * np.uint64(2)
        self.buffer = np.empty((_STEP, permutations), np.uint64)
        self.up, self.down = self._powers(1 << 14)

    @staticmethod
    def _powers(n: int) -> tuple[np.ndarray, ...]:
        return tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, x, np.uint64)])) for x in (_BASE, pow(_BASE, -1, 1 << 64)))

    def shingles(self, text: str) -> np.ndarray:
        """A 32-bit hash of each shingle, repeats included."""
        words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
        if not words:
            return np.zeros(0, np.uint64)
        raw = np.frombuffer(b" ".join(words), np.uint8)
        up, down = self.up, self.down
        if len(raw) >= len(up):
            up, down = self._powers(len(raw) if len(raw) > self.KEPT else min(self.KEPT, 2 * len(raw)))
            if len(raw) <= self.KEPT:
                self.up, self.down = up, down
        gaps = np.flatnonzero(raw == 32)
        k = min(self.width, len(words))
        starts = np.concatenate([[0], gaps + 1])[: len(words) - k + 1]
        ends = np.concatenate([gaps, [len(raw)]])[k - 1 :]
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)])])
        h = (run[ends] - run[starts]) * down[starts]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h >> np.uint64(32)

    def signature(self, text: str) -> np.ndarray:
        """The smallest value of each hash function, high 32 bits."""
        x = self.shingles(text)
        if not len(x):
            return np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        least = None
        for at in range(0, len(x), _STEP):
            part = x[at : at + _STEP, None]
            buffer = self.buffer[: len(part)]
            np.multiply(part, self.a, out=buffer)
            buffer += self.b
            low = buffer.min(axis=0)
            least = low if least is None else np.minimum(least, low)
        return (least >> np.uint64(32)).astype(np.uint32)


def printed(signature: np.ndarray) -> str:
    """The low sixteen bits of each value in hexadecimal: the high ones of a smallest value say little."""
    return (signature & np.uint32(0xFFFF)).astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the printed values that agree."""
    return float(np.mean((a & np.uint32(0xFFFF)) == (b & np.uint32(0xFFFF))))


COMPARED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by range, own rows before the copy of the next range's first, in descending order."""
    hasher = Hasher()
    out: list[tuple] = []
    held = None  # range, doc_id, text, signature of the row that waits for its next

    def finish(row: tuple, text: str, signature: np.ndarray) -> None:
        _, doc_id, own, mine = row
        half = len(own) // 2
        edited = own[: len(own) - half] + text[:half]
        other = mine if edited == own else hasher.signature(edited)
        digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        out.append((doc_id, len(own), digest, printed(mine), printed(other), likeness(mine, other), likeness(mine, signature)))

    def flush() -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=[c.split()[0] for c in COMPARED.split(", ")])
        out.clear()
        return batch

    for batch in batches:
        for part, copy, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            text = text or ""
            if copy and (held is None or held[0] != part):
                continue  # a second row with the first one's id
            signature = held[3] if held is not None and held[2] == text else hasher.signature(text)
            if held is not None:
                finish(held, text, signature)
            held = None if copy else (part, doc_id, text, signature)
            if len(out) >= 2000:
                yield flush()
    if out:
        yield flush()


def compared(docs: DataFrame, partitions: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document."""
    spark = docs.sparkSession
    bounded_batches(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    last = -(1 << 63)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("place", F.coalesce("doc_id", F.lit(last)))
    ids = rows.select("place")
    bounds = sorted(set(map(int, (ids.agg(F.percentile_approx("place", [i / n for i in range(1, n)], 10_000)).first()[0] or []) if n > 1 else [])))
    # Ranges are numbered from the highest ids down.
    part = F.lit(len(bounds)) - F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("place"))) if bounds else F.lit(0)
    rows = rows.withColumn("part", part)
    # One row for each partition goes through the driver: the id that begins its range.
    first = sorted(map(tuple, rows.groupBy("part").agg(F.max("place")).collect()))
    heads = [(place, first[i - 1][0]) for i, (_, place) in enumerate(first)]
    if not heads:
        return spark.createDataFrame([], COMPARED)
    to = F.broadcast(spark.createDataFrame(heads, "place long, to int"))
    copies = rows.join(to, "place").select(F.col("to").alias("part"), F.lit(True).alias("copy"), "place", "doc_id", "text")
    both = rows.select("part", F.lit(False).alias("copy"), "place", "doc_id", "text").union(copies)
    dealt = both.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", "copy", F.desc("place"), F.asc("text"))
    return dealt.select("part", "copy", "doc_id", "text").mapInArrow(_pairs, COMPARED)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A number for each band of each text's signature; the band's place is part of what is hashed."""
    hasher, places = Hasher(), [bytes([i]) for i in range(PERMUTATIONS // BAND_ROWS)]
    for batch in batches:
        found = []
        for text in batch.column(2).to_pylist():
            rows = hasher.signature(text)[: len(places) * BAND_ROWS].reshape(-1, BAND_ROWS)
            found.append([int.from_bytes(hashlib.blake2b(r.tobytes(), digest_size=8, salt=i).digest(), "big", signed=True) for i, r in zip(places, rows)])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "key", "bands"])


def shingle_set(text: str, width: int = WIDTH) -> set[bytes]:
    """The shingles of a text's words, ASCII letters in lower case; the whole sequence where there are fewer words."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    k = min(width, len(words))
    return {b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def text_key(text_col: str = "text") -> Column:
    """The digest that names a text; a null one is an empty one."""
    return F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))


def _verified(pairs: DataFrame, rows: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``(a, b)`` of nodes whose texts' shingles have at least that Jaccard likeness. Only texts in pairs are moved, and only while this runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                p, q = shingle_set(x), shingle_set(y)
                good.append(len(p & q) >= threshold * len(p | q))
            kept = batch.filter(pa.array(good, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], names=["a", "b"])

    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(classes.select("node", "key"), "node")
    texts = materialise(rows.join(wanted, "key").select("node", "text").dropDuplicates(["node"]), "near_texts")
    both = pairs.join(texts.toDF("a", "x"), "a").join(texts.toDF("b", "y"), "b").select("a", "b", "x", "y")
    found = materialise(both.mapInArrow(run, "a long, b long"), "near_pairs")
    discard(texts)
    return found


def _shares(asked: DataFrame, rows: DataFrame, kept: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """``node, size, common`` of the texts ``asked(node, key)``: how many different shingles each has, and how many of them another of these texts has too."""
    from xxhash import xxh64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.array([xxh64_intdigest(s) for s in shingle_set(t)], np.uint64).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["node", "shingles"])

    texts = rows.select("key", "text").join(asked, "key").groupBy("node").agg(F.first("text").alias("text"))
    shingles = kept(texts.mapInArrow(run, "node long, shingles array<long>"), "shingles")
    # A shingle of one text only has one row; texts of equal hashes only seem to share more.
    own = shingles.select("node", F.explode("shingles").alias("h")).groupBy("h").agg(F.count("*").alias("n"), F.min("node").alias("node")).where("n = 1")
    own = own.groupBy("node").agg(F.count("*").alias("own"))
    return shingles.join(own, "node", "left").select("node", F.size("shingles").alias("size"), (F.size("shingles") - F.coalesce("own", F.lit(0))).alias("common"))


def _text_groups(rows: DataFrame, threshold: float, among: DataFrame | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """``key, rep, component`` of each different text of ``rows(doc_id, key, text)``, or of those with a key in ``among``; ``rep`` is its smallest id.

    Under a band that several texts share, all are first compared with one of them: the one that shares most bands with most
    texts, which is the text that near copies were made from if it is there. Rounds against drawn ones follow. Texts that are linked by then need no comparison; of those in different
    components each pair that can be alike is compared in the end, under the first band that it shares. What two texts have in common is no more than either
    shares with any other text, so shingles that no other text in question has rule pairs out, exactly: a copy with many edits has
    many such shingles, and is paired with none. So a group of near copies makes about as many
    pairs as it has texts. What is left are texts that share a band and nearly all shingles with some texts, and are still unlike each other: they are
    compared pair by pair, and nothing is left out.

    The second result lists working tables, to be deleted once the first is written.
    """
    made: list[DataFrame] = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        made.append(materialise(df, name))
        return made[-1]

    marked = kept(rows.select("doc_id", "key", "text").mapInArrow(_bands, "doc_id long, key binary, bands array<long>"), "marked")
    classes = marked.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    if among is not None:
        classes = classes.join(among.select("key"), "key", "left_semi")
    classes = kept(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    bands = classes.select("node", F.explode("bands").alias("value"))
    shared = bands.groupBy("value").agg(F.count("*").alias("n")).where("n > 1")
    met = kept(bands.join(shared, "value"), "shared_bands")
    often = met.groupBy("node").agg(F.sum("n").alias("often"))
    grouped = kept(met.select("node", "value", F.col("n").alias("was")).join(often, "node").select("value", "node", "often", "was"), "grouped_bands")
    n_nodes = classes.count()

    def can(na: str, oa: str, nb: str, ob: str) -> Column:
        """Whether two texts with so many shingles, of which others have so many, can be alike enough."""
        return F.least(oa, ob) * (1 + threshold) >= (F.col(na) + F.col(nb)) * threshold - 1e-6

    def kept_pairs(df: DataFrame) -> DataFrame:
        made.append(df)
        return df

    tested = links = label = None
    for turn in range(ROUNDS + 1):
        if turn == 0:
            open_, choice = grouped.withColumns({"component": F.col("node"), "size": F.lit(0), "common": F.lit(0)}), F.struct(-F.col("often"), F.col("node"))
        else:
            # The first time, to find the texts in question; then those of them that can have a partner.
            for found_common in (False, True) if turn == 1 else (True,):
                joined = grouped.join(label.withColumnRenamed("label", "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
                sizes = joined.groupBy("value", "component").agg(F.count("*").alias("n"), F.max("was").alias("was"))
                sizes = sizes.groupBy("value").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("same"), F.max("was").alias("was"))
                # Bands of two texts are done with; one of more that has two left may not be: its first text may be gone.
                sizes = sizes.where("n * n > same and was > 2").drop("was")
                sizes = kept(sizes, "open_bands")
                left = sizes.agg(F.sum((F.col("n") * F.col("n") - F.col("same")) / 2)).first()[0] or 0
                if not left:
                    break
                if not found_common:
                    asked = joined.join(sizes.select("value"), "value", "left_semi").select("node").distinct()
                    shares = kept(_shares(asked.join(classes.select("node", "key"), "node"), rows, kept), "shares")
                    grouped = kept(grouped.join(shares.where(F.col("common") >= F.col("size") * threshold - 1e-6), "node"), "grouped_bands")
            if not left:
                break
            open_, choice = joined.join(sizes.select("value"), "value"), F.xxhash64("node", "value", F.lit(turn))
            if left <= PAIRS_PER_TEXT * n_nodes or turn == ROUNDS:
                open_ = open_.select("value", "node", "component", "size", "common").join(classes.select("node", "bands"), "node").select("value", "node", "component", "size", "common", "bands")
                x, y = open_.toDF("value", "a", "ca", "na", "oa", "xs"), open_.toDF("value", "b", "cb", "nb", "ob", "ys")
                once = F.element_at(F.array_intersect("xs", "ys"), 1) == F.col("value")
                pairs = x.join(y, "value").where(F.expr("a < b and ca <> cb") & can("na", "oa", "nb", "ob") & once).select("a", "b").join(tested, ["a", "b"], "left_anti")
                links = links.union(kept_pairs(_verified(kept(pairs, "pairs"), rows, classes, threshold)))
                label = components(links).toDF("node", "label")
                break
        star = open_.groupBy("value").agg(F.min_by(F.struct("node", "component", "size", "common"), choice).alias("first"))
        pairs = open_.join(star, "value").where("node <> first.node" if turn == 0 else "component <> first.component").where(can("size", "common", "first.size", "first.common"))
        pairs = pairs.select(F.least("first.node", "node").alias("a"), F.greatest("first.node", "node").alias("b")).distinct()
        pairs = kept(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        tested = pairs if tested is None else tested.union(pairs)
        found = kept_pairs(_verified(pairs, rows, classes, threshold))
        links = found if links is None else links.union(found)
        label = kept(components(links).toDF("node", "label"), "labels")
    return classes.join(label, "node", "left").select("key", "rep", F.coalesce("label", "node").alias("component")), made


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    return rows.withColumn("key", text_key())


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, component_id`` of each document with an id: the smallest id that links of the threshold reach. Equal texts are one text from the start."""
    rows = _rows(docs, id_col, text_col).where("doc_id is not null")
    found, made = _text_groups(rows, threshold)
    named = materialise(found, "near_groups")
    discard(*made)
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    return rows.select("doc_id", "key").join(named.select("key", "component"), "key").join(least, "component").select("doc_id", "component_id")


def representatives(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", among: DataFrame | None = None) -> DataFrame:
    """``key, rep``: of each group of near-duplicates the text with the smallest id, and that id. ``among(key)`` names the texts that take part, all if none.

    Rows without an id take part; they stand for a group only if none in it has an id.
    """
    named, made = _text_groups(_rows(docs, id_col, text_col), threshold, among)
    first = F.min(F.struct(F.col("rep").isNull().alias("unnamed"), "rep", "key")).alias("first")
    found = materialise(named.groupBy("component").agg(first).select("first.key", "first.rep"), "representatives")
    discard(*made)
    return found


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: fingerprints of all ``documents``, of their edited texts, and how near they are."""
    return compared(spark.read.parquet(f"{sf_dir}/documents.parquet"))
