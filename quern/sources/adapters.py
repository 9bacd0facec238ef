"""Study tables from the driver's tables: cards, lines, decks, folders, review and request logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.runtime import spread, table
from quern.sources import fixtures

#: Event types as grades; others are no reviews.
GRADES = {"error": "again", "view": "hard", "click": "good", "purchase": "easy"}
#: "Now" for study counts, as milliseconds: 1997-01-01 00:00 UTC.
NOW_MS = 852_076_800_000


def millis(ts: Column) -> Column:
    """Milliseconds since 1970 of a time without zone, which is taken as UTC."""
    return F.floor(F.unix_micros(F.to_utc_timestamp(ts.cast("timestamp"), "UTC")) / 1000).cast("long")


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``deck_id, ord, front, back, has_code, has_image``: a user's turn and the assistant's turn that follows it, and the fixture's cards."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    turns = table(spark, sf_dir, "conversations").withColumns({"next_role": F.lead("role").over(order), "back": F.lead("text").over(order)})
    found = turns.where("role = 'user' and next_role = 'assistant' and text is not null and back is not null")
    found = found.select(F.col("conv_id").alias("deck_id"), F.col("turn").alias("ord"), F.col("text").alias("front"), "back", F.lit(False).alias("has_code"), F.lit(False).alias("has_image"))
    return found.union(fixtures.CARDS.frame(spark))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, source, text`` of documents with a text, the fixture's included."""
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "source", "text").union(fixtures.DOCUMENTS.frame(spark))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, source, line_no, line`` of each document. Texts are dealt out over all cores before they are cut: a file of few row groups would be read, and its lines be looked at, by few tasks."""
    split = spread(documents(spark, sf_dir), "doc_id").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return split.withColumn("line_no", F.col("line_no").cast("long"))


def decks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as decks in folders that may not exist."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("deck_id"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("long").alias("folder_id"), F.col("c_acctbal").alias("created_at"))


def folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as folders; those of the last region are left out, so that some decks' folder is gone."""
    return table(spark, sf_dir, "nation").where("n_regionkey < 4").select(F.col("n_nationkey").cast("long").alias("folder_id"), F.col("n_name").alias("name"))


def study_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as cards of a customer's deck; open orders are new, others are due at their date."""
    due = F.when(F.col("o_orderstatus") != "O", millis(F.col("o_orderdate")))
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("deck_id"), F.col("o_orderkey").alias("card_id"), due.alias("due_ms"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as answers to questions about parts, in order of ``seq``."""
    seq = F.struct(millis(F.col("l_shipdate")).alias("ms"), "l_orderkey", "l_linenumber")
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("question_id"), seq.alias("seq"), (F.col("l_returnflag") == "N").alias("correct"))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``card_id, seq, at_ms, grade`` of each review in the event log."""
    grade = F.create_map(*(F.lit(x) for pair in GRADES.items() for x in pair))
    found = table(spark, sf_dir, "events").select(F.col("user_id").alias("card_id"), F.col("event_id").alias("seq"), millis(F.col("ts")).alias("at_ms"), F.try_element_at(grade, F.col("event_type")).alias("grade"))
    return found.where("grade is not null")
