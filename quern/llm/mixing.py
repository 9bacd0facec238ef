"""Mixing sources to target weights by weighted sampling without replacement.

Each document has the key ``-ln(u) / w`` with ``u`` drawn from a digest of its id and text and ``w`` its
quality weight (Efraimidis and Spirakis): in ascending order of keys, documents of a source
come as a weighted sample without replacement. A source takes as many complete epochs of
all its documents as its target holds, and then documents in order of their keys until the
budget that is left is met; the document on the border is taken if that comes nearer.

The order within a source is never made in one task. Keys fall into ``SLICES`` slices by
``1 - exp(-key)``; slices of a source are summed first, a running sum over a source's slices
(at most ``SLICES`` rows) finds the slice on the border, and only that slice's documents are
ordered. All of it is DataFrame operations.

Sizes are numbers of words. Targets: sources in order of code points, null last, have the
weights in turn, and share ``share`` times all words; no target is above ``most`` times its
source's words, and what exceeds that is shared out again by weight.

Nulls: a null text has size 0; null is a source of its own; a null or other label has the
neutral weight; of several labels the greatest counts. A null id takes part like any other; as
keys depend on texts too, documents without an id don't share one. Rows with one id and text tie: they are
ordered by size alone, stand for each other, and each is taken by itself. A text of any length is one row, and a source without
words has target 0. An empty table gives no rows, no labels leave all weights neutral. `mixed` keeps all columns, whatever their
names, and gives each row as often as that row is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.rows import carried, released
from quern.runtime import materialise

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
SLICES = 4096
SEED = "mix"
#: Quality weight by label; any other value, or none, weighs 1.
QUALITY = {1: 2.0, 0: 0.5}


def n_words(text: Column) -> Column:
    """Number of runs of characters other than space and U+0009 to U+000D."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) from the first 48 bits of an MD5 digest."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null")), F.md5(F.coalesce(text, F.lit("")))))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 48))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``(source, source_size, target)`` from ``sizes(source, source_size)``, a row for each source.

    Resharing until none is above its limit ends at one level: each source has the smaller
    of its limit and its weight times the level. In order of limit by weight, the sources
    up to some place are at their limit; running sums give the level for each place.
    """
    place = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(place) - 1) % len(weights) + 1)
    ranked = sizes.withColumn("w", turn).withColumn("most", F.col("source_size") * F.lit(most))
    order = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(share)
    level = (total - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("w").over(after)
    # A source is at its limit if the level at its place reaches it; the first that is not sets the level for all after it.
    placed = ranked.withColumn("level", level).withColumn("full", F.col("level") * F.col("w") >= F.col("most"))
    first = F.min(F.when(~F.col("full"), F.struct(F.col("most") / F.col("w"), F.col("source").isNull(), "source", "level"))).over(Window.partitionBy())
    return placed.withColumn("at", first["level"]).select("source", "source_size", F.when(F.col("full") | F.col("at").isNull(), F.col("most")).otherwise(F.least(F.col("w") * F.col("at"), F.col("most"))).alias("target"))


def mix(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, carry: list[str] | None = None) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken, row`` for each document; ``taken`` counts words, repeats included, and ``row`` has the columns in ``carry``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), uniform(F.col(id_col).cast("long"), F.col(text_col), seed).alias("u"), carried(carry))
    if labels is None:
        rows = rows.withColumn("quality", F.lit(None).cast("int"))
    else:
        rows = rows.join(labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality")), "doc_id", "left")
    weight = F.lit(1.0)
    for value, w in QUALITY.items():
        weight = F.when(F.col("quality") == value, F.lit(w)).otherwise(weight)
    key = -F.log("u") / weight
    rows = rows.withColumn("key", key).withColumn("slice", F.least(F.floor((F.lit(1.0) - F.exp(-F.col("key"))) * SLICES), F.lit(SLICES - 1)).cast("int"))
    rows = rows.select("doc_id", "source", "size", "key", "slice", "row")
    if not carry:  # short rows are written once; whole documents are read twice instead
        rows = materialise(rows, "mix_rows")

    slices = materialise(rows.groupBy("source", "slice").agg(F.sum("size").alias("words")), "mix_slices")
    goals = targets(slices.groupBy("source").agg(F.sum("words").alias("source_size")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goals = goals.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    goals = materialise(goals, "mix_targets")

    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    running = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    summed = slices.withColumn("before", F.coalesce(F.sum("words").over(running), F.lit(0)))
    g = goals.select(F.col("source").alias("g_source"), "rest")
    border = summed.join(g, summed["source"].eqNullSafe(g["g_source"]))
    border = border.where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest")))
    border = border.groupBy("source").agg(F.min(F.struct("slice", "before")).alias("b"))
    plan = goals.join(border.select(F.col("source").alias("b_source"), F.col("b.slice").alias("at"), F.col("b.before").alias("before")), goals["source"].eqNullSafe(F.col("b_source")), "left").drop("b_source")
    plan = materialise(plan, "mix_plan")

    p = plan.withColumnRenamed("source", "p_source")
    joined = rows.join(p, rows["source"].eqNullSafe(p["p_source"])).drop("p_source")
    inside = F.coalesce(F.col("slice") == F.col("at"), F.lit(False))
    whole = F.col("size") * (F.col("epochs") + F.when(F.col("at").isNull() | (F.col("slice") < F.col("at")), F.when(F.col("rest") > 0, 1).otherwise(0)).otherwise(0))
    easy = joined.where(~inside).withColumn("taken", whole)
    order = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    done = F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0))
    hard = joined.where(inside).withColumn("done", done)
    hard = hard.withColumn("taken", F.col("size") * (F.col("epochs") + F.when(F.col("done") + F.col("size") / 2 <= F.col("rest"), 1).otherwise(0)))
    out = ["doc_id", "source", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), "row"]
    return easy.select(*out).union(hard.select(*out))


def mixed(docs: DataFrame, labels: DataFrame | None = None, **options) -> DataFrame:
    """The documents that the mix takes, with the columns they came with, each row as often as it is taken."""
    found = mix(docs, labels, carry=docs.columns, **options)
    copies = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0).cast("int")
    rows = found.select("row", copies.alias("copies")).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return released(rows, docs.columns)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: what a mix of all ``documents`` takes, with quality weights from ``labels``."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return mix(read("documents"), read("labels")).select("doc_id", "size", "source_size", "target", "taken")
