"""Decks, folders, study counts, keyed changes and exports as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import fixed as X
from quern.functions import text as T
from quern.operators.schedule import is_due

UNFILED = "unfiled"


def folder_of(decks: DataFrame, folders: DataFrame) -> DataFrame:
    """Decks with the folder they are shown in; a folder that is gone counts as none."""
    known = folders.select(F.col("folder_id"), F.col("folder_id").cast("string").alias("folder"))
    return decks.join(known, "folder_id", "left").withColumn("folder", F.coalesce("folder", F.lit(UNFILED)))


def decks_by_folder(decks: DataFrame, folders: DataFrame) -> DataFrame:
    """Number of decks of every folder, empty ones included, and of decks without one."""
    all_folders = folders.select(F.col("folder_id").cast("string").alias("folder")).union(folders.sparkSession.range(1).select(F.lit(UNFILED).alias("folder")))
    counts = folder_of(decks, folders).groupBy("folder").agg(F.count("*").alias("n"))
    return all_folders.join(counts, "folder", "left").select("folder", F.coalesce("n", F.lit(0)).cast("long").alias("n_decks"))


def library_order(decks: DataFrame, by: str = "name") -> DataFrame:
    """Decks with their ``position``: by name, digits by value and case ignored, or newest first."""
    keys = [T.sort_key(F.col("name")), F.desc("created_at"), F.col("deck_id")] if by == "name" else [F.desc("created_at"), F.col("deck_id")]
    return decks.withColumn("position", F.row_number().over(Window.partitionBy("folder_id").orderBy(*keys)).cast("long"))


def study_counts(cards: DataFrame, now_ms: int, new_limit: int = X.NEW_PER_SESSION) -> DataFrame:
    """Per deck: due and new cards, what a session shows, and when the next card is due if it shows none."""
    now = F.lit(now_ms).cast("long")
    due = is_due(F.col("due_ms"), now)
    counted = cards.groupBy("deck_id").agg(
        F.count("*").alias("n_cards"),
        F.count_if(due).alias("due"),
        F.count_if(F.col("due_ms").isNull()).alias("new"),
        F.min(F.when(~due, F.col("due_ms"))).alias("next_due"),
    )
    fresh = F.least("new", F.lit(new_limit).cast("long"))
    return counted.withColumn("session_new", fresh).withColumn("next_due", F.when(F.col("due") + F.col("session_new") == 0, F.col("next_due")))


def session_queue(cards: DataFrame, now_ms: int, seed: str = "queue", new_limit: int = X.NEW_PER_SESSION) -> DataFrame:
    """Cards of a review session with their ``position``: due ones in seeded order, then the first new ones in order of id."""
    due = is_due(F.col("due_ms"), F.lit(now_ms).cast("long"))
    kind = F.when(due, 0).when(F.col("due_ms").isNull(), 1)
    key = F.when(due, F.md5(F.concat(F.lit(seed), F.lit(":"), F.col("card_id").cast("string")))).otherwise("")
    ranked = cards.withColumns({"kind": kind, "key": key}).where("kind is not null")
    within = Window.partitionBy("deck_id", "kind").orderBy("key", "card_id")
    kept = ranked.withColumn("rank", F.row_number().over(within)).where((F.col("kind") == 0) | (F.col("rank") <= new_limit))
    return kept.withColumn("position", F.row_number().over(Window.partitionBy("deck_id").orderBy("kind", "rank")).cast("long")).select("deck_id", "card_id", "position")


def requeued(queue: Column, position: Column, card: Column, gap: int = X.REQUEUE_GAP) -> Column:
    """A queue with a card put back some places behind ``position``, counted from 0."""
    at = F.least(position + 1 + gap, F.size(queue))
    return F.concat(F.slice(queue, F.lit(1), at), F.array(card), F.slice(queue, at + 1, F.size(queue)))


def answer_tally(answers: DataFrame) -> DataFrame:
    """Per question: times asked, times right, and whether the last answer was right."""
    return answers.groupBy("question_id").agg(F.count("*").alias("asked"), F.count_if("correct").alias("right"), F.max_by("correct", "seq").alias("last_correct"))


def scores(answers: DataFrame, by: str) -> DataFrame:
    """Right answers, misses and the rounded percentage for each group; 0 where there is none."""
    grouped = answers.groupBy(by).agg(F.count_if("correct").alias("right"), F.count_if(~F.col("correct")).alias("missed"))
    n = F.col("right") + F.col("missed")
    return grouped.withColumn("percent", F.when(n > 0, F.floor(F.col("right") * 100 / n + 0.5)).otherwise(0).cast("long"))


def rate_limited(requests: DataFrame, limit: int, window_ms: int = X.RATE_WINDOW_MS) -> DataFrame:
    """``hits`` of an address in the window that ends with each request, refused ones included, and whether it is ``limited``."""
    # Requests of the same millisecond come one after the other: those that follow are taken off again.
    frame = Window.partitionBy("address").orderBy("at_ms").rangeBetween(-(window_ms - 1), 0)
    later = Window.partitionBy("address", "at_ms").orderBy(F.desc("seq"))
    hits = (F.count("*").over(frame) - (F.row_number().over(later) - 1)).cast("long")
    return requests.withColumn("hits", hits).withColumn("limited", F.col("hits") > limit)


def export(cards: DataFrame, decks: DataFrame) -> DataFrame:
    """Each deck's cards as one delimited text, in order; a deck without cards has an empty one."""
    field = F.concat(T.export_field(F.col("front")), F.lit("&"), T.export_field(F.col("back")))
    rows = F.array_sort(F.collect_list(F.struct("ord", field.alias("row"))))
    told = cards.groupBy("deck_id").agg(F.concat(F.array_join(F.transform(rows, lambda r: r["row"]), ";"), F.lit(";")).alias("export"))
    return decks.join(told, "deck_id", "left").select("deck_id", F.coalesce("export", F.lit("")).alias("export"))


def updated(rows: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows with the columns of the changes that name them; changes to rows that are gone are ignored."""
    new = changes.select(key, *(F.col(c).alias(f"_{c}") for c in columns), F.lit(True).alias("_changed"))
    kept = [F.when(F.col("_changed"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns]
    return rows.join(new, key, "left").select(*kept)


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among those deleted."""
    return rows.join(gone.select(key), key, "left_anti")


def orphans(questions: DataFrame, cards: DataFrame) -> DataFrame:
    """Questions whose card is gone."""
    return questions.join(cards.select("card_id"), "card_id", "left_anti")


def unfiled(decks: DataFrame, gone: DataFrame) -> DataFrame:
    """Decks after folders were deleted: they stay, without a folder."""
    lost = gone.select("folder_id", F.lit(True).alias("_gone"))
    return decks.join(lost, "folder_id", "left").withColumn("folder_id", F.when(F.col("_gone").isNull(), F.col("folder_id"))).drop("_gone")


def needing_questions(cards: DataFrame, questions: DataFrame, style: str = "recall") -> DataFrame:
    """Cards without an up-to-date question of a style, and whether they are ``skipped``: of a card's questions of the style the last one counts, and its hash must be the card's.

    ``cards(card_id, hash, skip_hash)``, ``questions(card_id, style, seq, hash)``; a question without a style is a recall question. Only
    application questions can be skipped, for the card's present text.
    """
    own = questions.where(F.coalesce("style", F.lit("recall")) == style)
    last = own.groupBy("card_id").agg(F.max_by("hash", "seq").alias("hash"))
    skipped = F.coalesce(F.col("skip_hash") == F.col("hash"), F.lit(False)) & F.lit(style == "application")
    return cards.join(last, ["card_id", "hash"], "left_anti").withColumn("skipped", skipped)


def first_of_key(rows: DataFrame, key: Column, *order: str) -> DataFrame:
    """``kept`` is true for the first row of each key."""
    return rows.withColumn("key", key).withColumn("kept", F.row_number().over(Window.partitionBy("key").orderBy(*order)) == 1)


def batches(rows: DataFrame, size: int, by: str, *order: str) -> DataFrame:
    """``batch`` numbers rows of a group in batches of a fixed size, from 0."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1
    return rows.withColumn("batch", F.floor(place / size).cast("long"))
