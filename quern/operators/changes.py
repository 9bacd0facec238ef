"""Keyed changes of the library's tables: additions, deletions with their cascades, folders, and schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import schedule as S


def next_positions(cards: DataFrame) -> DataFrame:
    """``deck_id, next``: the position of a card that is added to a deck; a deck whose cards have none begins at 0."""
    return cards.groupBy("deck_id").agg((F.coalesce(F.max("ord"), F.lit(-1)) + 1).cast("long").alias("next"))


def added(cards: DataFrame, decks: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cards and decks after ``new(deck_id, card_id)`` came to the ends of their decks; cards of decks that are gone are kept, but counted nowhere."""
    place = F.row_number().over(Window.partitionBy("deck_id").orderBy("card_id")) - 1
    placed = new.withColumn("place", place).join(next_positions(cards), "deck_id", "left")
    placed = placed.select("deck_id", "card_id", (F.coalesce("next", F.lit(0)) + F.col("place")).cast("long").alias("ord"))
    more = new.groupBy("deck_id").agg(F.count("*").alias("more"))
    counted = decks.join(more, "deck_id", "left").withColumn("card_count", (F.col("card_count") + F.coalesce("more", F.lit(0))).cast("long")).drop("more")
    return cards.select("deck_id", "card_id", "ord").union(placed), counted


def cards_deleted(cards: DataFrame, decks: DataFrame, questions: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cards, decks and questions after ``gone(card_id)``: questions of a card go with it, and no deck counts less than 0."""
    gone = gone.select("card_id").distinct()
    less = cards.join(gone, "card_id", "left_semi").groupBy("deck_id").agg(F.count("*").alias("less"))
    counted = decks.join(less, "deck_id", "left").withColumn("card_count", F.greatest(F.lit(0), F.col("card_count") - F.coalesce("less", F.lit(0))).cast("long")).drop("less")
    return cards.join(gone, "card_id", "left_anti"), counted, questions.join(gone, "card_id", "left_anti")


def decks_deleted(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """All tables with a ``deck_id``, without the rows of ``gone(deck_id)``."""
    return {name: rows.join(gone.select("deck_id"), "deck_id", "left_anti") for name, rows in tables.items()}


def pruned(questions: DataFrame, live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Questions whose card is live, and for each deck how many went."""
    kept = questions.join(live.select("card_id"), "card_id", "left_semi")
    lost = questions.join(live.select("card_id"), "card_id", "left_anti")
    return kept, lost.groupBy("deck_id").agg(F.count("*").alias("removed"))


def folder_requests(requests: DataFrame, folders: DataFrame) -> DataFrame:
    """``outcome`` of ``requests(request_id, folder_id, name)``: ``empty``, ``duplicate`` or ``ok``, with the cleaned name.

    A request without a folder creates one, others rename theirs. A name is taken if another folder has it but for case and space.
    """
    key = lambda c: F.lower(T.folder_name(F.col(c)))
    taken = folders.groupBy(key("name").alias("key")).agg(F.count("*").alias("n"), F.min("folder_id").alias("one"), F.max("folder_id").alias("other"))
    asked = requests.withColumn("key", key("name")).join(taken, "key", "left")
    own = F.col("folder_id").isNotNull() & (F.col("one") == F.col("folder_id")) & (F.col("other") == F.col("folder_id"))
    outcome = F.when(F.col("key") == "", "empty").when(F.coalesce(F.col("n") > 0, F.lit(False)) & ~F.coalesce(own, F.lit(False)), "duplicate").otherwise("ok")
    return asked.select("request_id", "folder_id", T.folder_name(F.col("name")).alias("name"), outcome.alias("outcome"))


def moved(decks: DataFrame, moves: DataFrame, folders: DataFrame) -> DataFrame:
    """Decks after ``moves(deck_id, folder_id)``; a move to a folder that is gone changes nothing, one to null unfiles."""
    known = folders.select(F.col("folder_id").alias("to"), F.lit(True).alias("exists"))
    good = moves.withColumnRenamed("folder_id", "to").join(known, "to", "left").where("exists or to is null").select("deck_id", "to", F.lit(True).alias("changed"))
    return decks.join(good, "deck_id", "left").withColumn("folder_id", F.when(F.col("changed"), F.col("to")).otherwise(F.col("folder_id"))).drop("to", "changed")


def upserted(rows: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows with those of ``new`` in the place of rows with their key; an empty ``new`` changes nothing."""
    return rows.join(new.select(key), key, "left_anti").unionByName(new.select(*rows.columns))


def counters_upserted(questions: DataFrame, tally: DataFrame) -> DataFrame:
    """Questions with an answer tally added to their counters: ``times_asked, times_correct, last_correct``. Answers to questions that are gone are ignored."""
    more = tally.select("question_id", F.col("asked").alias("more"), F.col("right").alias("good"), F.col("last_correct").alias("last"))
    joined = questions.join(more, "question_id", "left")
    new = {
        "times_asked": (F.col("times_asked") + F.coalesce("more", F.lit(0))).cast("long"),
        "times_correct": (F.col("times_correct") + F.coalesce("good", F.lit(0))).cast("long"),
        "last_correct": F.when(F.col("more").isNotNull(), F.col("last")).otherwise(F.col("last_correct")),
    }
    return joined.withColumns(new).drop("more", "good", "last")


def infographics_read(rows: DataFrame) -> DataFrame:
    """Infographics that have a text, newest first within a deck by ``position``; others are left out, as if they were gone."""
    kept = rows.where(F.length("html") > 0)
    return kept.withColumn("position", F.row_number().over(Window.partitionBy("deck_id").orderBy(F.desc("created_at"), "infographic_id")).cast("long"))


def reviewed(states: DataFrame, grades: DataFrame, now: Column) -> DataFrame:
    """``states(card_id, s)`` after one review of the cards in ``grades(card_id, grade)``; grades of cards that are gone are ignored."""
    after = S.applied(F.col("s"), F.col("grade"), now).cast(S.STATE)
    return states.join(grades, "card_id", "left").withColumn("s", F.when(F.col("grade").isNotNull(), after).otherwise(F.col("s"))).drop("grade")


def relearned(states: DataFrame, answers: DataFrame, now: Column) -> DataFrame:
    """States after a test, ``answers(card_id, correct)``: each card missed is graded ``again`` once, right answers change nothing."""
    missed = answers.where(~F.col("correct")).select("card_id").distinct().withColumn("grade", F.lit("again"))
    return reviewed(states, missed, now)


def saved_together(tables: dict[str, DataFrame], root: str) -> str:
    """Write tables as one new version below ``root``, which a reader sees whole or not at all; the version's name.

    All tables are written into the version's folder first. Then its mark is renamed into place, in one step of the file system, so a
    writer that stops before leaves nothing that `read_together` finds.
    """
    import uuid

    spark = next(iter(tables.values())).sparkSession
    version = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{root}/data/{version}/{name}")
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path(f"{root}/marks"))
    at = max([int(s.getPath().getName().split("-")[0]) for s in fs.listStatus(path(f"{root}/marks"))], default=-1) + 1
    fs.create(path(f"{root}/data/{version}/mark")).close()
    if not fs.rename(path(f"{root}/data/{version}/mark"), path(f"{root}/marks/{at:08d}-{version}")):
        raise RuntimeError("the version could not be marked")
    return version


def read_together(spark: SparkSession, root: str, names: list[str]) -> dict[str, DataFrame]:
    """The tables of the last version that was saved whole."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    last = max(s.getPath().getName() for s in fs.listStatus(path(f"{root}/marks"))).split("-")[1]
    return {name: spark.read.parquet(f"{root}/data/{last}/{name}") for name in names}
