"""Structure of documents: furniture, contexts, clusters, anchors and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import fixed as X
from quern.functions import text as T
from quern.operators.folds import signed


def signature(text: Column) -> Column:
    """The beginning of a block, by which repeats are told."""
    return F.lower(F.substring(text, 1, X.SIGNATURE_CHARS))


def without_furniture(blocks: DataFrame) -> DataFrame:
    """Blocks that do not repeat across a document's sections.

    ``blocks(document, section, block, text)``. Nothing goes where there are fewer than four
    sections. The threshold needs counts only, which are summed before they are shuffled.
    """
    b = blocks.withColumn("signature", signature(F.col("text")))
    sections = blocks.select("document", "section").distinct().groupBy("document").agg(F.count("*").alias("n"))
    seen = b.where("signature <> ''").select("document", "section", "signature").distinct().groupBy("document", "signature").agg(F.count("*").alias("c"))
    often = seen.join(sections, "document").where((F.col("n") >= 4) & (F.col("c") >= F.greatest(F.lit(3), F.ceil(F.col("n") * 0.3))))
    return b.join(often.select("document", "signature"), ["document", "signature"], "left_anti").drop("signature")


def without_navigation(blocks: DataFrame, titles: DataFrame) -> DataFrame:
    """Blocks but for short ones that say another section's title, where a document has four sections or more. ``titles(document, section, title)``; of equal titles the last section's counts."""
    many = blocks.groupBy("document").agg(F.count_distinct("section").alias("n")).where("n >= 4").select("document")
    titles = titles.join(many, "document", "left_semi")
    owner = titles.withColumn("slug", T.slug(F.col("title"))).where("slug <> ''").groupBy("document", "slug").agg(F.max("section").alias("owner"))
    b = blocks.withColumn("slug", F.when(F.length("text") <= X.NAVIGATION_CHARS, T.slug(F.col("text"))))
    joined = b.join(owner, ["document", "slug"], "left")
    return joined.where(F.col("owner").isNull() | (F.col("owner") == F.col("section"))).drop("slug", "owner")


def _numbered(values: DataFrame, by: list[str], value: str, tolerance: float) -> DataFrame:
    """Values with the number of their ``cluster``: a gap above the tolerance begins a new one."""
    order = Window.partitionBy(*by).orderBy(value)
    opened = F.coalesce((F.col(value) - F.lag(value).over(order) > tolerance).cast("int"), F.lit(0))
    # A frame by value, not by row: equal values are of one cluster in whichever order they come.
    return values.withColumn("opened", opened).withColumn("cluster", F.sum("opened").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))).drop("opened")


def clusters(values: DataFrame, by: list[str], value: str, tolerance: float) -> DataFrame:
    """Means of one-dimensional clusters: a gap above the tolerance begins a new one."""
    return _numbered(values, by, value, tolerance).groupBy(*by, "cluster").agg(F.avg(value).alias("anchor"), F.count("*").alias("n"))


def headings_down(lines: DataFrame, heading: Column) -> DataFrame:
    """``context`` of each line: the last heading above it, itself if it is one."""
    order = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("context", F.last(F.when(heading, F.col("line")), ignorenulls=True).over(order))


def unpivoted(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``row_key, col, header, value``: one row for each cell that is not empty."""
    cells = F.array(*(F.struct(F.lit(i).cast("long").alias("col"), F.lit(c).alias("header"), F.col(c).cast("string").alias("value")) for i, c in enumerate(columns)))
    found = rows.select(F.trim(F.col(key)).alias("row_key"), F.inline(cells))
    return found.where("row_key <> '' and trim(value) <> ''")


def most_frequent(rows: DataFrame, by: str, value: str, order: str) -> DataFrame:
    """The most frequent value of each group; of several, the one seen first, and of those the largest."""
    counted = rows.groupBy(by, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counted.groupBy(by).agg(F.max_by(value, F.struct("n", -F.col("first"), value)).alias(value), F.max("n").alias("n"))


def joined_without_space(before: Column, after: Column, gap: Column, font: Column, either: bool = False) -> Column:
    """Whether two fragments of a line are one word: they are near, and a dash, a bracket or a short stub says so. With ``either``, null where it hangs on a space before the first one."""
    left, right = F.rtrim(before), F.ltrim(after)
    end, start = F.substring(left, -1, 1), F.substring(right, 1, 1)
    short = (F.length(left) <= 3) | (F.length(right) <= 3)
    if either:
        short = F.when((F.length(left) != 3) | (F.length(right) <= 3), short)
    return (
        F.when(gap >= font * X.NO_SPACE_GAP, False)
        .when(end.isin(*"-–—") | start.isin(*"-–—"), True)
        .when(end.isin(*"([{") | start.isin(*")]}"), True)
        .when(end.isin(*".,:;!?") | start.between("A", "Z"), False)
        .otherwise(short)
    )


def column_anchors(lines: DataFrame, tolerance: float = X.ANCHOR_TOLERANCE, least: int = X.MIN_ROWS) -> DataFrame:
    """``page, anchor, place``: means of clusters of ``x`` near which lines on enough baselines begin, from left to right. ``lines(page, x, y)``.

    Clusters are more than a tolerance apart, so a line is near its own cluster's mean or, where a mean is rounded, near that of one beside it: three to look at, and pages stay together.
    """
    rows = _numbered(lines.select("page", "x", "y"), ["page"], "x", tolerance)
    rows = rows.withColumn("anchor", F.avg("x").over(Window.partitionBy("page", "cluster")))
    up = Window.partitionBy("page").orderBy("cluster")
    down = Window.partitionBy("page").orderBy(F.desc("cluster"))
    for name, order in (("before", up), ("behind", down)):
        # The mean of the cluster next to a row's, on either side: told where a cluster begins, and carried on.
        rows = rows.withColumns({"other": F.lag("anchor").over(order), "begins": F.lag("cluster").over(order) != F.col("cluster")})
        rows = rows.withColumn(name, F.last(F.when(F.col("begins"), F.col("other")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    near = rows.select("page", "x", "y", F.explode(F.array("before", "anchor", "behind")).alias("anchor")).where(F.abs(F.col("x") - F.col("anchor")) <= tolerance)
    found = near.groupBy("page", "anchor").agg(F.count_distinct(F.floor(F.col("y") + 0.5)).alias("n")).where(F.col("n") >= least)
    return found.select("page", "anchor", (F.row_number().over(Window.partitionBy("page").orderBy("anchor")) - 1).cast("long").alias("place"))


def column_of(lines: DataFrame, anchors: DataFrame) -> DataFrame:
    """Lines with the ``place`` of the nearest anchor of their page, the first of equals; 0 where a page has none."""
    of_page = anchors.groupBy("page").agg(F.array_sort(F.collect_list("anchor")).alias("anchors"))
    nearest = F.array_min(F.transform("anchors", lambda a, i: F.struct(F.abs(F.col("x") - a).alias("away"), i.alias("place"))))["place"]
    return lines.join(of_page, "page", "left").withColumn("place", F.coalesce(nearest, F.lit(0)).cast("long")).drop("anchors")


def page_titles(lines: DataFrame) -> DataFrame:
    """``page, body, title``: the body's size is the most frequent one, to half a point, the first of equals; the title is the first line of more than two characters in the largest size, if that is clearly larger. ``lines(page, place, size, text)``."""
    half = F.floor(F.col("size") * 2 + 0.5) / 2
    body = most_frequent(lines.withColumn("body", half), "page", "body", "place").select("page", "body")
    title = F.min_by("text", F.struct((-F.col("size")).alias("s"), "place"))
    largest = lines.groupBy("page").agg(F.max("size").alias("largest"))
    first = lines.join(largest, "page").where((F.col("size") == F.col("largest")) & (F.length("text") > 2)).groupBy("page", "largest").agg(title.alias("title"))
    return body.join(first, "page", "left").select("page", "body", F.when(F.col("largest") > F.col("body") + 2, F.col("title")).alias("title"))


def without_appendices(blocks: DataFrame) -> DataFrame:
    """Blocks without appendices: a heading of that kind goes, with all below it up to the next heading of its level or a higher one. ``blocks(doc_id, place, kind, level, text)``."""
    order = Window.partitionBy("doc_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    heading, appendix = F.col("kind") == "heading", F.col("text").rlike(X.APPENDIX)
    gone = F.lit(False)
    for level in range(1, 7):
        # The last appendix of this level is open if no heading of its level or a higher one follows it.
        opened = F.max(F.when(heading & appendix & (F.col("level") == level), F.col("place"))).over(order)
        last = F.max(F.when(heading & (F.col("level") <= level), F.col("place"))).over(order)
        gone = gone | F.coalesce(opened == last, F.lit(False))
    return blocks.withColumn("gone", gone).where("not gone").drop("gone")


def without_crumbs(blocks: DataFrame) -> DataFrame:
    """Blocks from the first heading on, if all before it are short paragraphs; else all. ``blocks(doc_id, place, kind, text)``."""
    doc = Window.partitionBy("doc_id")
    first = F.min(F.when(F.col("kind") == "heading", F.col("place"))).over(doc)
    crumb = (F.col("kind") == "paragraph") & (F.length("text") <= X.NAVIGATION_CHARS)
    trail = F.coalesce(F.bool_and(F.when(F.col("place") < F.col("first"), crumb)).over(doc), F.lit(True))
    marked = blocks.withColumn("first", first).withColumn("trail", trail)
    return marked.where(F.col("first").isNull() | ~F.col("trail") | (F.col("place") >= F.col("first"))).drop("first", "trail")


def card_estimate(blocks: DataFrame) -> DataFrame:
    """``section_id, cards``: about how many cards each section gives. ``blocks(section_id, kind, n_items, n_rows, n_headers)``."""
    worth = F.when(F.col("kind") == "heading", 0).when(F.col("kind") == "list", F.col("n_items")).when(F.col("kind") == "table", F.col("n_rows") * F.greatest(F.lit(1), F.col("n_headers") - 1)).otherwise(1)
    return blocks.groupBy("section_id").agg(F.sum(worth.cast("long")).alias("cards"))


def section_batches(sections: DataFrame, most_sections: int = X.BATCH_SECTIONS, most_cards: int = X.BATCH_CARDS) -> DataFrame:
    """``doc_id, place, batch``: sections packed in order. A batch has one source, so many sections and, unless it is one section, so many cards at most.

    ``sections(doc_id, place, source, cards)``. Whether a section begins a batch depends on the batch so far: a fold over a document's sections gives each one sign, and batches are counted.
    """

    def step(s: Column, x: Column) -> dict[str, Column]:
        joins = (s["n"] > 0) & s["source"].eqNullSafe(x["source"]) & (s["n"] < most_sections) & (s["cards"] + x["cards"] <= most_cards)
        return {"source": x["source"], "n": F.when(joins, s["n"] + 1).otherwise(1), "cards": F.when(joins, s["cards"] + x["cards"]).otherwise(x["cards"]), "sign": F.when(joins, "0").otherwise("1")}

    rows = sections.select("doc_id", F.col("place").cast("long").alias("place"), F.col("source").cast("string").alias("source"), F.col("cards").cast("long").alias("cards"))
    told = signed(rows, ["doc_id"], ["place"], {"source": F.lit(None).cast("string"), "n": F.lit(0), "cards": F.lit(0).cast("long")}, step)
    batch = F.sum((F.col("sign") == "1").cast("long")).over(Window.partitionBy("doc_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)) - 1
    return told.select("doc_id", "place", batch.alias("batch"))
