"""A corpus pipeline of five operators; each stage works on what its predecessor kept.

All stages take nulls in any column, empty and very long texts, repeated rows, empty tables and
columns of any other names, and say what becomes of them. All but the last keep the columns of the documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm import decontaminate, language, minhash, mixing, simhash, token_file
from quern.llm.rows import carried, released
from quern.runtime import work_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go, and with them texts that are null or have no letter. It learns from all labelled documents that it is given.

    Where none is labelled, every document is rejected. Repeated rows stay or go together.
    """
    return language.identified(docs, language.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document with the smallest id stays, in one row.

    SimHash groups come first. Fingerprints within two bits catch only some of the copies that
    share four fifths of their five-word shingles, so what is left goes through MinHash bands,
    with that likeness verified. Texts without words are near-duplicates of each other. A group's row is named by its text and
    id, so ids may be null or stand on several texts; rows with one id and text are one row, the first by its other columns.
    """
    left = simhash.representatives(docs, minhash.text_key())
    keep = minhash.representatives(docs, among=left)
    rows = docs.select(minhash.text_key().alias("key"), F.col("doc_id").cast("long").alias("id"), carried(docs.columns))
    found = rows.join(keep, "key").where(F.col("id").eqNullSafe(F.col("rep")))
    # What ties is one id and text: the first by the other columns.
    order = Window.partitionBy("key").orderBy(*(F.col(f"row.`{c}`") for c in docs.columns if c not in ("doc_id", "text")))
    first = found.withColumn("place", F.row_number().over(order)).where("place = 1")
    return released(first, docs.columns)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more is in windows of the benchmark go. Null and empty texts are clean, and without a benchmark all are."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: each row by itself, and never one without words."""
    return mixing.mixed(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and where each document is in them: rows in ascending order of id, then text; null ids first. A row without text has the end id alone."""
    return token_file.token_ids(docs, token_file.default_tokenizer())


def _tidied(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage after which Spark removes the shuffle files of what has ended: the next stage reads a table."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", _tidied(identify_language)),
    ("near_duplicates", _tidied(drop_near_duplicates)),
    ("decontamination", _tidied(decontaminate_benchmark)),
    ("mixing", _tidied(mix_sources)),
    ("token_ids", _tidied(write_token_ids)),
]

#: SQL can express neither the classifier, nor the fingerprints, nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = work_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
