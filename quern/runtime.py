"""Session helpers: the shared work folder and reading of input tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a URI.

    It is the session's ``spark.checkpoint.dir``. Only where that is unset in a local
    session, as in tests, a temporary folder is made and set: on a cluster each machine would have its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root if "://" in root or root.startswith("file:") else "file://" + os.path.abspath(root)


def work_path(spark: SparkSession, name: str) -> str:
    """A new path for a working table below the shared folder."""
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back: lineage is cut, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._work_path = path
    return found


def bucketed(df: DataFrame, name: str, key: str, parts: int | None = None) -> DataFrame:
    """As `materialise`, but what has one ``key`` stays together: what is read back is in ``parts`` by ``key``, and grouping by it shuffles nothing. Rows that are in so many parts by ``key`` already are written as they are."""
    spark = df.sparkSession
    path, writers = work_path(spark, name), "spark.sql.maxConcurrentOutputFileWriters"
    before, named = spark.conf.get(writers), f"{name}_{uuid.uuid4().hex}"
    spark.conf.set(writers, "8")
    try:
        df.write.format("parquet").option("path", path).bucketBy(parts or int(spark.conf.get("spark.sql.shuffle.partitions")), key).saveAsTable(named)
    finally:
        spark.conf.set(writers, before)
    found = spark.table(named)
    found._work_path, found._work_table = path, named
    return found


def discard(*tables: DataFrame) -> None:
    """Delete tables that `materialise` or `bucketed` wrote, once nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        if hasattr(df, "_work_table"):
            spark.sql(f"drop table if exists {df._work_table}")
        path = spark._jvm.org.apache.hadoop.fs.Path(df._work_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, key: str, text: str, share: int = 4 << 20) -> DataFrame:
    """Rows dealt out by ``key`` in parts of about ``share`` characters of ``text``, however many there are: what a task holds does not grow with the table.

    The number of parts is fixed by one look at the lengths, so that adaptive execution does not put them together again.
    """
    spark = rows.sparkSession
    total = rows.agg(F.sum(F.length(text).cast("long"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, -(-total // share))
    found = rows.repartition(parts, key)
    found._parts = parts
    return found


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt out by ``key`` over all cores, for work that takes long for each row: a small table is one file of one part. The number of parts is fixed, so that adaptive execution does not put small ones together."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), key)


def bounded_batches(spark: SparkSession, size: str = "4m") -> None:
    """Arrow batches of a session's queries hold at most so many bytes from now on, unless a bound was set: texts may be long, and a Python worker holds a whole batch."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":
        spark.conf.set(key, size)


@contextmanager
def drop_finished_shuffles(spark: SparkSession) -> Iterator[None]:
    """While this lasts, Spark removes an execution's shuffle files when it ends: what comes after reads tables, and disks are bounded."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)
