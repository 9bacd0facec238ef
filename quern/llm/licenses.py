"""Licence scan: labels of documents by diagonals of shared word k-grams with licence templates.

Words are runs of letters, digits and characters beyond ASCII; ``A-Z`` are lower-cased. The hashes of all rolling
k-grams of a document's words are joined to the positions of those in the templates (a table of some hundred rows that
does not grow with the data, and is broadcast). A document position less the template position is a
diagonal: copies of a template vote for one, and a word put in or left out moves the votes to a near one. Votes are summed by
diagonal; diagonals at most ``SLACK`` apart are merged to one span. A hash is only a candidate: each vote's words are compared, and a span is
verified if its votes cover at least ``COVER`` of the template's words within a stretch that is no longer than ``STRETCH``
times the template.

Base phrases are templates of a single k-gram, so each of their diagonals is a place. A template of three words
or more has grams of three, a shorter one of two. All is DataFrame operations; one shuffle, of the votes and one row for each
document, brings a document's rows together by a row number.

Nulls: a null text has no words; a null id is kept. Repeated rows each give a row. Documents without words or hits have counts 0, null
places, empty labels and score 0. A text's words are one array, whatever its length. Of equal labels one is named. Columns beside those named
are not read. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Base phrases and their labels.
BASE = [
    ("cc-by", "cc by"),
    ("gpl", "general public license"),
    ("reserved", "all rights reserved"),
]
# The words of common notices, and a label for each.
NOTICES = [
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
]
WIDEST = 3
SLACK, COVER, STRETCH = 4, 0.8, 1.5
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text. Of characters beyond ASCII only the Kelvin sign has a lower case within it, and is set apart."""
    return F.regexp_extract_all(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ĸ"))), F.lit(WORD), F.lit(0))


def _grams(found: Column, at: Column) -> list[Column]:
    """The two or three words from a place on; beyond the end they are null."""
    return [F.get(found, at + i) for i in range(WIDEST)]


def templates(spark: SparkSession, base: list[tuple[str, str]] = BASE, notices: list[tuple[str, str]] = NOTICES) -> DataFrame:
    """``tid, label, is_base, size, k, t_at, key, hash, grams``: a row for each k-gram of each template. ``key`` is the hash of its first two words."""
    told = [(i, label, i < len(base), text) for i, (label, text) in enumerate([*base, *notices])]
    if any(not 2 <= len(t[3].split()) <= 60 for t in told) or any(len(t[1].split()) > WIDEST for t in base):
        raise ValueError("templates have 2 to 60 words, base phrases 2 or 3")
    rows = F.array(*(F.struct(F.lit(i).alias("tid"), F.lit(label).alias("label"), F.lit(b).alias("is_base"), F.split(F.lit(text), " ").alias("w")) for i, label, b, text in told))
    t = spark.range(1, numPartitions=1).select(F.inline(rows)).withColumn("size", F.size("w")).withColumn("k", F.least(F.size("w"), F.lit(WIDEST)))
    t = t.select("*", F.explode(F.sequence(F.lit(0), F.col("size") - F.col("k"))).alias("t_at"))
    a, b, c = _grams(F.col("w"), F.col("t_at"))
    third = F.when(F.col("k") == WIDEST, c)
    return t.select("tid", "label", "is_base", "size", "k", "t_at", F.xxhash64(a, b).alias("key"), F.when(F.col("k") == WIDEST, F.xxhash64(a, b, c)).otherwise(F.xxhash64(a, b)).alias("hash"), a.alias("t_a"), b.alias("t_b"), third.alias("t_c"))


def votes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kinds: list[tuple[str, str]]) -> DataFrame:
    """``rid, doc_id, n_words, at, tid, label, is_base, size, k, t_at`` for each verified k-gram, and at least one row, perhaps without a template, for each document."""
    d = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc_id"), words(F.col(text_col).cast("string")).alias("w"))
    d = d.select("rid", "doc_id", F.size("w").cast("long").alias("n_words"), "w", F.posexplode_outer("w").alias("at", "word"))
    a, b, c = F.col("word"), F.get("w", F.col("at") + 1), F.get("w", F.col("at") + 2)
    d = d.select("rid", "doc_id", "n_words", "at", a.alias("a"), b.alias("b"), c.alias("c"))
    t = templates(docs.sparkSession, **kinds)
    alike = F.when(F.col("k") == WIDEST, F.xxhash64("a", "b", "c") == F.col("hash")).otherwise(F.lit(True))
    verified = (F.col("a") == F.col("t_a")) & (F.col("b") == F.col("t_b")) & (F.col("t_c").isNull() | (F.col("c") == F.col("t_c")))
    joined = d.join(F.broadcast(t), (F.xxhash64("a", "b") == F.col("key")) & alike & verified, "left")
    return joined.where("tid is not null or at is null or at = 0").select("rid", "doc_id", "n_words", "at", "tid", "label", "is_base", "size", "k", "t_at")


def spans(voted: DataFrame) -> DataFrame:
    """``rid, doc_id, n_words, label, is_base, size, start, end, cover`` of merged diagonals, ``end`` excluded; a row with a null label stands for each document without votes, and beside others for some."""
    bit = F.expr("shiftleft(1L, t_at)")
    one = ["rid", "doc_id", "n_words", "tid", "label", "is_base", "size", "k"]
    lines = voted.repartition("rid").withColumn("diagonal", F.col("at") - F.col("t_at"))
    lines = lines.groupBy(*one, "diagonal").agg(F.bit_or(bit).alias("bits"), F.min("at").alias("start"), (F.max("at") + F.first("k")).alias("end"))
    order = Window.partitionBy("rid", "tid").orderBy("diagonal")
    fresh = F.col("is_base") | F.lag("diagonal").over(order).isNull() | (F.col("diagonal") - F.lag("diagonal").over(order) > SLACK)
    merged = lines.withColumn("fresh", fresh.cast("int")).withColumn("nth", F.sum("fresh").over(order))
    merged = merged.groupBy(*one, "nth").agg(F.bit_or("bits").alias("bits"), F.min("start").alias("start"), F.max("end").alias("end"))
    covered = F.col("bits")
    for i in range(1, WIDEST):
        covered = covered.bitwiseOR(F.when(F.col("k") > i, F.shiftleft("bits", i)).otherwise(F.lit(0)))
    return merged.withColumn("cover", F.bit_count(covered) / F.col("size")).select("rid", "doc_id", "n_words", "label", "is_base", "size", "start", "end", "cover")


def scan(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans`` for each row of ``docs``; ``score`` is the greatest share of a template that a span covers."""
    found = spans(votes(docs, **options))
    good = F.col("is_base") | ((F.col("cover") >= COVER) & (F.col("end") - F.col("start") <= STRETCH * F.col("size")))
    base = F.when(F.col("is_base"), F.lit(True))
    told = lambda x: F.array_join(F.array_sort(F.collect_set(x)), ",")
    span = F.when(good, F.struct("start", "end", "label", "cover"))
    return found.groupBy("rid", "doc_id", "n_words").agg(
        F.count(base).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        told(F.when(base, F.col("label"))).alias("base_labels"),
        told(F.when(good, F.col("label"))).alias("labels"),
        F.coalesce(F.max(F.when(good, F.col("cover"))), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(span)).alias("spans"),
    ).drop("rid")


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: licence labels of all ``documents``."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
