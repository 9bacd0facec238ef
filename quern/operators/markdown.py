"""Lists, tables and code of Markdown, from a table of lines.

``lines(doc_id, line_no, line)``. Which fence opens and which closes is told by a fold over a document's fences alone, with one sign for each; a line is code if the
last fence before it opened. Lines with pipes side by side are an island, and from the first header with a delimiter under it on an island is a table. Items, the lines that continue
them and blank lines are a run, broken by any other line; an item's number is a running count. A fence begins code wherever it stands, and a header with a delimiter under it a table,
even where a list would go on. All windows are by document; a document is one group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import addresses as U
from quern.functions import fixed as X
from quern.functions import text as T


def cells_of(line: Column) -> Column:
    """The cells of a table's line, without inline marks; an escaped pipe is part of a cell."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(line, r"^\s+|\s+$", ""), r"^\|", ""), r"\|$", "")
    parts = F.split(F.replace(bare, F.lit("\\|"), F.lit("\x01")), r"\|", -1)
    return F.transform(parts, lambda c: U.without_marks(F.replace(c, F.lit("\x01"), F.lit("|"))))


def clean_item(text: Column) -> Column:
    """An item's text without a box to tick and without marks, an emphasised term before its definition."""
    return U.without_marks(U.term_pair(F.regexp_replace(text, r"^\[[ xX]\]\s*", "")))


def fenced(lines: DataFrame) -> DataFrame:
    """``fence``: ``o`` where a fence opens, ``c`` where it closes and null elsewhere; ``code``: whether a line is in fenced code, the fences included; ``block``, the number of the last fence that opened."""
    mark = F.regexp_extract("line", X.FENCE, 1)
    marks = lines.select("doc_id", "line_no", mark.alias("mark")).where("mark <> ''")
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "mark")))

    def step(s: Column, x: Column) -> Column:
        closes = (F.substring(x["mark"], 1, 1) == F.substring(s["opened"], 1, 1)) & (F.length(x["mark"]) >= F.length(s["opened"]))
        sign = F.when(s["opened"] == "", "o").when(closes, "c").otherwise("x")
        return F.struct(F.when(sign == "o", x["mark"]).when(sign == "c", F.lit("")).otherwise(s["opened"]).alias("opened"), F.concat(s["signs"], sign).alias("signs"))

    folded = marks.groupBy("doc_id").agg(ordered.alias("marks")).withColumn("signs", F.aggregate("marks", F.struct(F.lit("").alias("opened"), F.lit("").alias("signs")), step)["signs"])
    signs = folded.select("doc_id", F.inline(F.transform("marks", lambda x, i: F.struct(x["line_no"].alias("line_no"), F.substring(F.col("signs"), i + 1, F.lit(1)).alias("fence"))))).where("fence <> 'x'")
    order = Window.partitionBy("doc_id").orderBy("line_no")
    before = F.last("fence", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    found = lines.join(signs, ["doc_id", "line_no"], "left").withColumn("code", F.col("fence").isNotNull() | F.coalesce(before == "o", F.lit(False)))
    return found.withColumn("block", F.sum(F.when(F.col("fence") == "o", 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def code_blocks(lines: DataFrame) -> DataFrame:
    """``doc_id, line_no, language, text``: fenced code without the indentation that its lines share, from the line of its fence; one that is never closed goes to the end. Empty ones give no row."""
    found = fenced(lines).where("code")
    indent = F.when(~F.col("line").rlike(r"^\s*$"), F.length(F.regexp_extract("line", r"^\s*", 0)))
    opens = F.col("fence") == "o"
    body = F.col("fence").isNull()
    blocks = found.groupBy("doc_id", "block").agg(
        F.min(F.when(opens, F.col("line_no"))).alias("line_no"),
        F.max(F.when(opens, F.regexp_extract("line", X.FENCE, 2))).alias("language"),
        F.coalesce(F.min(F.when(body, indent)), F.lit(0)).alias("shared"),
        F.array_sort(F.collect_list(F.when(body, F.struct("line_no", "line")))).alias("body"),
    )
    text = F.array_join(F.transform("body", lambda x: F.substring(x["line"], F.col("shared") + 1, F.length(x["line"]))), "\n")
    blocks = blocks.withColumn("text", F.regexp_replace(text, r"^\s+|\s+$", "")).where("text <> ''")
    return blocks.select("doc_id", "line_no", F.substring("language", 1, X.LANGUAGE_CHARS).alias("language"), T.truncated_code(F.col("text")).alias("text"))


def placed(lines: DataFrame) -> DataFrame:
    """Lines with ``kind``: K code, T table, B blank, L begins an item, C may continue one, O other; and for tables ``island`` and ``first``, the line of the header."""
    rows = fenced(lines)
    order = Window.partitionBy("doc_id").orderBy("line_no")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    line = F.col("line")
    blank = line.rlike(r"^\s*$")
    rows = rows.withColumn("pipe", ~F.col("code") & ~blank & line.contains("|"))
    starts = F.col("pipe") & F.coalesce(F.lead("pipe").over(order) & F.lead("line").over(order).rlike(X.TABLE_DELIMITER), F.lit(False))
    rows = rows.withColumn("starts", starts).withColumn("starts", F.col("starts") & (F.size(cells_of(line)) >= 2))
    rows = rows.withColumn("island", F.sum((~F.col("pipe")).cast("int")).over(so_far))
    rows = rows.withColumn("first", F.min(F.when(F.col("starts"), F.col("line_no"))).over(Window.partitionBy("doc_id", "island")))
    in_table = F.col("pipe") & F.coalesce(F.col("line_no") >= F.col("first"), F.lit(False))
    continues = line.rlike(r"^\s") & ~line.rlike(X.ATX_HEADING)
    kind = F.when(F.col("code"), "K").when(in_table, "T").when(blank, "B").when(line.rlike(X.LIST_ITEM), "L").when(continues, "C").otherwise("O")
    return rows.select("doc_id", "line_no", "line", kind.alias("kind"), "island", "first")


def tables(rows: DataFrame) -> DataFrame:
    """``doc_id, line_no, kind, text``: tables, their rows as lines with cells parted by tabs and as many as the header has; ``rows`` where the header has a hole or there is no other row: each row's cells joined. ``rows`` are from `placed`."""
    found = rows.where((F.col("kind") == "T") & (F.col("line_no") != F.col("first") + 1)).withColumn("cells", cells_of(F.col("line")))
    found = found.groupBy("doc_id", F.col("first").alias("line_no")).agg(F.array_sort(F.collect_list(F.struct("line_no", "cells"))).alias("grid"))
    header = F.get("grid", F.lit(0))["cells"]
    width = F.size(header)
    square = F.transform("grid", lambda r: F.transform(F.sequence(F.lit(1), width), lambda i: F.coalesce(F.get(r["cells"], i - 1), F.lit(""))))
    real = (F.size("grid") > 1) & ~F.exists(header, lambda c: c == "")
    lines = F.transform(square, lambda r: F.when(real, F.array_join(r, "\t")).otherwise(F.array_join(F.filter(r, lambda c: c != ""), " — ")))
    return found.select("doc_id", "line_no", F.when(real, "table").otherwise("rows").alias("kind"), F.array_join(F.when(real, lines).otherwise(F.filter(lines, lambda x: x != "")), "\n").alias("text")).where("text <> ''")


def lists(rows: DataFrame) -> DataFrame:
    """``doc_id, line_no, text``: lists, an item for each line of the text, from their first item's line on. Items within items are items; empty ones go. ``rows`` are from `placed`."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    so_far, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("kind") != "C", F.col("kind")), ignorenulls=True).over(before)
    rows = rows.withColumn("more", (F.col("kind") == "C") & F.coalesce(last == "L", F.lit(False)))
    rows = rows.withColumn("run", F.sum((~F.col("kind").isin("L", "B") & ~F.col("more")).cast("int")).over(so_far))
    of_run = Window.partitionBy("doc_id", "run").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    item = F.col("kind") == "L"
    # A line of dashes begins no list, but within one it is an item.
    rows = rows.withColumn("begun", F.max(item & ~F.col("line").rlike(X.THEMATIC_BREAK)).over(of_run)).where((item | F.col("more")) & F.col("begun"))
    rows = rows.withColumn("item", F.sum(item.cast("int")).over(of_run))
    rows = rows.withColumn("text", clean_item(F.when(item, F.regexp_extract("line", X.LIST_ITEM, 2)).otherwise(F.regexp_replace("line", r"^\s+|\s+$", ""))))
    joined = lambda at, by: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct(at, "text")))), lambda x: x["text"]), by)
    items = rows.groupBy("doc_id", "run", "item").agg(F.min("line_no").alias("line_no"), joined("line_no", " ").alias("text"))
    return items.groupBy("doc_id", "run").agg(F.min("line_no").alias("line_no"), joined("item", "\n").alias("text")).where("text <> ''").select("doc_id", "line_no", "text")


def readers(lines: DataFrame) -> DataFrame:
    """``doc_id, line_no, kind, language, text`` of all lists, tables and code."""
    rows, none = placed(lines), F.lit(None).cast("string")
    found = code_blocks(lines).select("doc_id", "line_no", F.lit("code").alias("kind"), "language", "text")
    found = found.union(tables(rows).select("doc_id", "line_no", "kind", none, "text"))
    return found.union(lists(rows).select("doc_id", "line_no", F.lit("list"), none, "text"))
