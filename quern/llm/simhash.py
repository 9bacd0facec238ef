"""SimHash near-duplicates: fingerprints, pigeonhole blocks, a check of the Hamming distance, and groups.

A fingerprint has 64 bits in five blocks. Two fingerprints that differ in at most two bits
agree in at least three blocks, so they meet under one of the ten choices of three blocks.
Fingerprints, not documents, are joined: equal ones are one node.

* Under a key that few fingerprints share, they are joined in pairs and their distance is checked.
* Under a key that many share, pairs would grow with the square. Two words differ in at
  most two bits exactly if some word is within one bit of both; so each fingerprint is put
  under itself and under each flip of one bit outside the key's blocks. All that meet there
  are linked, and a link from each to the smallest is enough for the groups. At most as
  many can meet as there are bits, so no group is large, and no link is lost.

Nulls: a null text has no words, as an empty one; its fingerprint is zero and linked like
any other. Documents with a null id take part, and a group's name is the smallest id that is
not null. Repeated rows each get a row. Texts of any length are read whole, hashes a few thousand at a time; ties in the
vote over a bit leave it zero. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.components import components
from quern.runtime import bounded_batches, materialise

SEED = 42
SHINGLE = 3
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
DISTANCE = 2
#: Under a key that more fingerprints share than this, they are linked through flips of a bit.
PAIRS_UP_TO = 24
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None, width: int = SHINGLE, step: int = 1 << 15) -> int:
    """SimHash of the shingles of a whole text: a bit is one if it is set in over half of the hashes."""
    from xxhash import xxh64_digest

    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= width:
        hashes = [xxh64_digest(whole, SEED)]
    else:
        size = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(size + 1) - 1
        cuts = map(slice, (ends - size)[: 1 - width].tolist(), ends[width - 1 :].tolist())
        hashes = list(map(xxh64_digest, map(whole.__getitem__, cuts), repeat(SEED)))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), step):
        part = np.frombuffer(b"".join(hashes[at : at + step]), np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp)``, the fingerprint as a signed long."""

    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "doc_id long, fp long")


def _mask(chosen: tuple[int, ...]) -> int:
    bits = sum(((1 << BLOCKS[i][1]) - 1) << BLOCKS[i][0] for i in chosen)
    return bits - (1 << 64) if bits >> 63 else bits


def _bits_outside(chosen: tuple[int, ...]) -> list[int]:
    out = [1 << b for i, (at, n) in enumerate(BLOCKS) if i not in chosen for b in range(at, at + n)]
    return [0, *(b - (1 << 64) if b >> 63 else b for b in out)]


def links(fps: DataFrame) -> DataFrame:
    """Links ``(a, b)`` between different fingerprints ``fps(fp)``, enough to connect all that are within the distance."""
    choices = list(combinations(range(len(BLOCKS)), len(BLOCKS) - DISTANCE))
    keys = [F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(_mask(c))).alias("key")) for i, c in enumerate(choices)]
    keyed = fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.choice", "k.key")
    shared = keyed.groupBy("choice", "key").agg(F.count("*").alias("n")).where("n > 1")
    keyed = materialise(keyed.join(shared, ["choice", "key"]), "simhash_keys")

    few = keyed.where(F.col("n") <= PAIRS_UP_TO)
    a, b = few.alias("a"), few.alias("b")
    near = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= DISTANCE
    same = (F.col("a.choice") == F.col("b.choice")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp"))
    pairs = a.join(b, same).where(near).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))

    flips: Column = F.element_at(F.array(*(F.array(*map(F.lit, _bits_outside(c))) for c in choices)), F.col("choice") + 1)
    many = keyed.where(F.col("n") > PAIRS_UP_TO).select("fp", "choice", F.explode(flips).alias("flip"))
    met = many.select("fp", "choice", F.col("fp").bitwiseXOR(F.col("flip")).alias("middle"))
    least = F.min("fp").over(Window.partitionBy("choice", "middle"))
    stars = met.select("fp", least.alias("least")).where((F.col("fp") != F.col("least")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("least"))) <= DISTANCE))
    return pairs.union(stars.select("least", "fp")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp, component_id)`` of each document."""
    marked = materialise(fingerprints(docs, id_col, text_col, width), "simhash")
    nodes = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash_nodes")
    found = components(links(nodes.select("fp")))
    # A component's name is the smallest document of all its fingerprints.
    joined = nodes.join(found.withColumnRenamed("node", "fp"), "fp")
    names = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = joined.join(names, "component").select("fp", "component_id")
    alone = nodes.join(found.select(F.col("node").alias("fp")), "fp", "left_anti").where("n > 1").select("fp", F.col("least").alias("component_id"))
    named = materialise(linked.union(alone), "simhash_groups")
    return marked.join(named, "fp", "left").select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))


def representatives(docs: DataFrame, key: Column, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """``key, rep``: of each group of near-duplicates the text, named by ``key``, with the smallest id, and that id.

    Rows without an id take part; they stand for a group only if none in it has an id. Of texts with that id, the smallest key stands.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.struct(F.col(id_col).cast("long").alias("id"), key.alias("key")).alias("row"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["row", "fp"])

    marked = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, fp long")
    first = F.struct(F.col("row.id").isNull().alias("unnamed"), F.col("row.id").alias("rep"), F.col("row.key").alias("key"))
    nodes = materialise(marked.groupBy("fp").agg(F.min(first).alias("first")), "simhash_nodes")
    found = components(links(nodes.select("fp"))).withColumnRenamed("node", "fp")
    groups = nodes.join(found, "fp", "left").groupBy(F.coalesce("component", "fp").alias("component"))
    return materialise(groups.agg(F.min("first").alias("first")).select("first.key", "first.rep"), "simhash_representatives")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: fingerprint and near-duplicate group of every document of ``documents``."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
