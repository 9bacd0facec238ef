"""Cards by rule from the blocks of sections: what a block is asked about depends on the blocks before it, which windows over a section tell.

``blocks(section_id, place, kind, level, text, heading, items, headers, rows, language, output, src, alt, caption)``, ``sections(section_id, doc_id,
place, label, title)``. Kinds are heading, paragraph, list, table, code and image.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import fixed as X
from quern.functions import phrasing as P
from quern.functions import text as T
from quern.operators.folds import signed
from quern.operators.duplicates import deduped
from quern.runtime import materialise

BLOCKS = (
    "section_id long, place long, kind string, level int, text string, heading string, items array<string>, headers array<string>, rows array<array<string>>, "
    "language string, output string, src string, alt string, caption string"
)
_CARD = "struct<front:string,back:string,front_code:string,back_code:string,language:string,image:string>"


def _card(front: Column, back: Column, **media: Column) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(front.alias("front"), back.alias("back"), *(media.get(n, none).alias(n) for n in ("front_code", "back_code", "language", "image"))).cast(_CARD)


def _none() -> Column:
    return F.array().cast(f"array<{_CARD}>")


def _some(*cards: Column) -> Column:
    """Those of the cards that are not null."""
    return F.array_compact(F.array(*cards))


def heading_age(heading: Column) -> Column:
    """``(name, age)`` of a heading with an age or a duration in brackets behind it; null for others."""
    pattern = r"^(.{2,60}?)\s*\(([^)]*\d[^)]*)\)\s*$"
    clean = F.trim(heading)
    name, age = (F.trim(F.regexp_extract(clean, pattern, i)) for i in (1, 2))
    return F.when(clean.rlike(pattern) & age.rlike(X.DURATION.replace(r"\b(", "(?<![A-Za-z0-9_])(").replace(r")\b", ")(?![A-Za-z0-9_])")), F.struct(name.alias("name"), age.alias("age")))


def table_cards(headers: Column, rows: Column, scope: Column) -> Column:
    """A card for each cell with a row key and a header, and one back from a row's first cell if that is long enough."""
    row_header = F.get(headers, 0)

    def of_row(row: Column) -> Column:
        key = F.get(row, 0)
        cells = F.slice(row, 2, F.greatest(F.size(row) - 1, F.lit(0)))
        asked = F.transform(cells, lambda cell, i: F.when((cell != "") & (F.coalesce(F.get(headers, i + 1), F.lit("")) != ""), _card(P.table_question(row_header, key, F.get(headers, i + 1), scope), T.tidy(cell))))
        first = T.tidy(F.get(cells, 0))
        reverse = F.when(F.length(first) > 12, _card(P.reverse_question(row_header, first), T.tidy(key)))
        return F.when(F.coalesce(key, F.lit("")) != "", F.array_compact(F.concat(asked, F.array(reverse)))).otherwise(_none())

    return F.flatten(F.transform(rows, of_row))


def code_cards(code: Column, language: Column, output: Column, topic: Column, prose: Column) -> Column:
    """What a program prints, and how it is written if a sentence and a topic say what it does."""
    prints = F.when(F.coalesce(output, F.lit("")) != "", _card(P.output_question(topic, language), output, front_code=code, language=language))
    written = F.when(T.meaningful_label(topic) & prose.isNotNull(), _card(P.code_question(topic, language), prose, back_code=code, language=language))
    return _some(prints, written)


def image_cards(src: Column, caption: Column, topic: Column, prose: Column) -> Column:
    """A card for a picture with a topic and a caption or a sentence."""
    return _some(F.when(T.meaningful_label(topic) & F.coalesce(caption, prose).isNotNull(), _card(P.diagram_question(topic), F.coalesce(caption, prose), image=src)))


def list_cards(items: Column, heading: Column, chip: Column) -> Column:
    """Cards of a list: each term with its definition where half of the items are such; else all items under their heading, and its age."""
    terms = F.transform(items, T.term_definition)
    named = T.meaningful_label(heading)
    each = F.zip_with(items, terms, lambda item, t: F.when(t.isNotNull(), _card(P.term_question(t["term"]), t["def"])).when(named, _card(F.concat(heading, F.lit(" — which item?")), item)))
    split = heading_age(heading)
    name = P.softened(F.coalesce(split["name"], heading))
    front = F.when(split.isNotNull(), P.heading_question(name)).otherwise(P.list_question(name))
    age = F.coalesce(split["age"], chip)
    whole = _some(_card(front, F.array_join(F.transform(items, lambda i: F.concat(F.lit("• "), i)), "\n")), F.when(age.isNotNull(), _card(F.concat(name, F.lit(" — what age range?")), age)))
    many = F.size(F.array_compact(terms)) >= F.ceil(F.size(items) / 2)
    return F.when(F.size(items) == 0, _none()).when(many, F.array_compact(each)).when(named, whole).otherwise(_none())


def paragraph_cards(text: Column, heading: Column, pending: Column, chip: Column) -> Column:
    """Cards of a paragraph that is no chip: under its own label, under the heading before it, or the definitions that it holds."""
    labelled = _some(_card(P.label_question(heading), text))
    under = _some(_card(P.heading_question(pending), text), F.when(chip.isNotNull(), _card(F.concat(pending, F.lit(" — what age range?")), chip)))
    pair = T.term_definition(text)
    mined = F.flatten(F.transform(T.sentences(text), lambda s: F.transform(T.definitions(s), lambda d: _card(P.term_question(d["term"]), d["def"]))))
    return F.when(F.coalesce(T.meaningful_label(heading), F.lit(False)), labelled).when(pending.isNotNull(), under).when(pair.isNotNull(), _some(_card(P.term_question(pair["term"]), pair["def"]))).otherwise(mined)


def section_cards(blocks: DataFrame, sections: DataFrame, most: int = X.SECTION_CARDS) -> DataFrame:
    """``section_id, card, front, back, front_code, back_code, language, image, context``: the cards of each section, in order.

    A heading waits for the block that it asks about; a level-one heading, a table, a snippet, a picture, a list with items and any paragraph but a
    chip end the wait. A chip, a short paragraph that begins with a number, is an age that waits for the next heading's text or list. The last short
    paragraph is the answer to a snippet or a picture. A section without lists, tables, snippets and pictures begins with its summary.
    Blocks with their sections' titles are a working table: cards and summaries both begin there.
    """
    order = Window.partitionBy("section_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    c = F.col
    b = blocks.join(sections.select("section_id", "title"), "section_id")
    text = T.tidy(c("text"))
    b = b.withColumns({"clean": text, "said": F.filter(F.transform("items", lambda i: T.tidy(i)), lambda i: i != "")})
    paragraph, heading = c("kind") == "paragraph", c("kind") == "heading"
    built = F.max(c("kind").isin("table", "list", "code", "image")).over(Window.partitionBy("section_id"))
    b = materialise(b.withColumn("built", built).where("title is not null or built"), "blocks")
    b = b.withColumn("chip_text", F.when(paragraph & c("clean").rlike(r"^\s*\d") & (F.length("clean") <= 24) & ~c("clean").rlike("[.!?]$"), c("clean")))
    filled = (c("kind") == "list") & (F.size("said") > 0)
    # Events that set or end the wait, as structs: a null inside ends it, no struct leaves it.
    said = F.when(heading & (c("level") > 1) & T.meaningful_label(c("text")), F.struct(c("text").alias("x")))
    ends = (heading & (c("level") == 1)) | c("kind").isin("table", "code", "image") | filled | (paragraph & c("chip_text").isNull())
    b = b.withColumn("pending", F.last(F.when(ends, F.struct(F.lit(None).cast("string").alias("x"))).otherwise(said), ignorenulls=True).over(order)["x"])
    prose = F.when(paragraph & (F.size(T.words(c("clean"))) <= X.PROSE_WORDS), c("clean"))
    b = b.withColumn("prose", F.last(prose, ignorenulls=True).over(order))
    topic = F.coalesce("heading", "pending")
    own = F.coalesce(T.meaningful_label(c("heading")), F.lit(False))
    by_text = paragraph & c("chip_text").isNull() & ~own & c("pending").isNotNull()
    terms = F.size(F.array_compact(F.transform("said", T.term_definition)))
    by_list = filled & (terms < F.ceil(F.size("said") / 2)) & F.coalesce(T.meaningful_label(topic), F.lit(False))
    spent = (heading & (c("level") == 1)) | by_text | by_list
    chip = F.when(c("chip_text").isNotNull(), F.struct(c("chip_text").alias("x"))).when(spent, F.struct(F.lit(None).cast("string").alias("x")))
    b = b.withColumn("chip", F.last(chip, ignorenulls=True).over(order)["x"])
    about = F.coalesce("heading", "pending", "title")
    cards = (
        F.when(c("kind") == "table", table_cards(c("headers"), c("rows"), c("title")))
        .when(paragraph & c("chip_text").isNull(), paragraph_cards(c("clean"), c("heading"), c("pending"), c("chip")))
        .when(c("kind") == "code", code_cards(c("text"), c("language"), c("output"), about, c("prose")))
        .when(c("kind") == "image", image_cards(c("src"), c("caption"), about, c("prose")))
        .when(c("kind") == "list", list_cards(c("said"), topic, c("chip")))
    )
    drawn = b.select("section_id", "place", "title", F.posexplode(cards).alias("turn", "card"))
    # The summary of a section's paragraphs comes first, before place 0.
    plain = b.where(~c("built") & paragraph).groupBy("section_id", "title").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("p"))
    best = T.summary(c("title"), F.array_join(F.transform("p", lambda x: x["text"]), "\n"))
    summed = plain.withColumn("s", best).where("s is not null").select("section_id", F.lit(-1).cast("long").alias("place"), "title", F.lit(0).alias("turn"), _card(P.term_question(F.trim("title")), c("s.back")).alias("card"))
    every = drawn.unionByName(summed).withColumn("card_no", (F.row_number().over(Window.partitionBy("section_id").orderBy("place", "turn")) - 1).cast("long"))
    return every.where(c("card_no") < most).select("section_id", F.col("card_no").alias("card"), "card.front", "card.back", "card.front_code", "card.back_code", "card.language", "card.image", c("title").alias("context"))


def drafted(blocks: DataFrame, sections: DataFrame) -> DataFrame:
    """All cards of documents by rule: usable ones, without those that repeat an earlier one of their document, and ``include`` false where a front points at what is not there."""
    cards = section_cards(blocks, sections).join(sections.select("section_id", "doc_id", F.col("place").alias("at")), "section_id").where(T.usable_card(F.col("front"), F.col("back")))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("at", "card")) - 1
    # They are looked at twice: to tell which repeat, and to take those that stay.
    cards = materialise(cards.withColumn("ord", place.cast("long")), "drafted")
    code = F.col("front_code").isNotNull() | F.col("back_code").isNotNull()
    kept = deduped(cards.select(F.col("doc_id").alias("deck_id"), "ord", "front", "back", code.alias("has_code"), F.col("image").isNotNull().alias("has_image")))
    found = cards.join(kept.withColumnRenamed("deck_id", "doc_id"), ["doc_id", "ord"])
    dangling = T.dangling_reference(F.col("front"), F.col("front_code").isNotNull())
    return found.select("doc_id", "ord", "section_id", "front", "back", "front_code", "back_code", "language", "image", "context", dangling.isNull().alias("include"))


def attached_outputs(blocks: DataFrame) -> DataFrame:
    """``doc_id, place, kind, text, output``: a block of code behind the label Output becomes the output of the program before the label, if that has none and only paragraphs and headings stand between, three blocks back at most.

    Which block is taken depends on those taken before: a fold carries the last four blocks as letters (p paragraph or heading, c code without an output, x another, - taken) and
    gives each block its distance to its program, 0 if it has none. Windows put texts where they belong.
    """

    def step(s: Column, x: Column) -> dict[str, Column]:
        known, n = s["known"], F.length(s["known"])
        between = F.regexp_extract(F.reverse(F.substring(known, F.lit(1), n - 1)), "^([p-]*)c", 1)
        hit = s["label"] & (x["kind"] == "code") & F.reverse(F.substring(known, F.lit(1), n - 1)).rlike("^[p-]*c")
        back = F.length(between) + 2
        told = F.concat(F.substring(known, F.lit(1), n - back), F.lit("x"), F.substring(known, n - back + 2, back - 2), F.lit("--"))
        own = F.when(x["kind"].isin("paragraph", "heading"), "p").when((x["kind"] == "code") & (F.coalesce(x["output"], F.lit("")) == ""), "c").otherwise("x")
        new = F.when(hit, told).otherwise(F.concat(known, own))
        return {"known": F.substring(new, -X.OUTPUT_LOOKBACK - 1, X.OUTPUT_LOOKBACK + 1), "label": x["kind"].isin("paragraph", "heading") & x["text"].rlike(X.OUTPUT_LABEL), "sign": F.when(hit, back.cast("string")).otherwise("0")}

    rows = blocks.select("doc_id", F.col("place").cast("long").alias("place"), "kind", F.coalesce("text", F.lit("")).alias("text"), F.col("output").cast("string").alias("output"))
    told = signed(rows, ["doc_id"], ["place"], {"known": F.lit(""), "label": F.lit(False)}, step)
    order = Window.partitionBy("doc_id").orderBy("place")
    given = F.coalesce(*(F.when(F.lead("sign", k).over(order) == str(k), F.lead("text", k).over(order)) for k in range(2, X.OUTPUT_LOOKBACK + 2)))
    told = told.withColumn("given", given).withColumn("gone", (F.col("sign") != "0") | F.coalesce(F.lead("sign").over(order) != "0", F.lit(False)))
    return told.where("not gone").select("doc_id", "place", "kind", "text", F.coalesce("given", "output").alias("output"))


def runs(blocks: DataFrame, budget: int = X.SECTION_CHARS, deepest: int = X.SPLIT_LEVEL) -> DataFrame:
    """``doc_id, place, run, titles``: blocks divided into sections. ``blocks(doc_id, place, kind, level, text, size)``; headings that divide go.

    A run is divided at its highest headings, no deeper than ``deepest``, if it is too long or all of it stands under one heading. Every round divides all runs
    of all documents at once, and there are as many rounds as levels.
    """
    doc = blocks.withColumns({"run": F.array().cast("array<bigint>"), "titles": F.array().cast("array<string>"), "from": F.lit(1), "open": F.lit(True)})
    for _ in range(deepest):
        of_run = Window.partitionBy("doc_id", "run")
        divides = (F.col("kind") == "heading") & F.col("level").between(F.col("from"), F.lit(deepest))
        doc = doc.withColumn("cut", F.when(F.col("open"), F.min(F.when(divides, F.col("level"))).over(of_run)))
        head = (F.col("kind") == "heading") & F.coalesce(F.col("level") == F.col("cut"), F.lit(False))
        doc = doc.withColumn("head", head).withColumn("group", F.count_if("head").over(of_run.orderBy("place")).cast("long"))
        part = Window.partitionBy("doc_id", "run", "group")
        title = F.first(F.when(F.col("head"), F.col("text")), ignorenulls=True).over(part.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        long = F.sum(F.when(~F.col("head"), F.col("size") + 1).otherwise(0)).over(part) > budget
        lone = F.min("group").over(of_run) == F.max("group").over(of_run)
        again = F.col("cut").isNotNull() & (long | (lone & F.col("title").isNotNull()))
        doc = doc.withColumn("title", title).withColumn("again", again)
        doc = doc.withColumns({"run": F.when(F.col("cut").isNotNull(), F.concat("run", F.array("group"))).otherwise(F.col("run")), "titles": F.when(F.col("cut").isNotNull() & F.col("title").isNotNull(), F.concat("titles", F.array("title"))).otherwise(F.col("titles")), "open": F.col("open") & F.col("again"), "from": F.col("cut") + 1})
        doc = doc.where("not head").drop("cut", "head", "group", "title", "again")
    return doc.select("doc_id", "place", "kind", "level", "text", "run", "titles")


def payload(blocks: DataFrame) -> DataFrame:
    """``batch_id, payload``: a batch's blocks as compact JSON. Snippets and pictures are numbered over the batch, and addresses of pictures are kept back.

    ``blocks(batch_id, place, kind, text, language, alt)``.
    """
    before = Window.partitionBy("batch_id", "kind").orderBy("place")
    number = F.row_number().over(before).cast("string")
    numbered = blocks.withColumn("id", F.when(F.col("kind") == "code", F.concat(F.lit("c"), number)).when(F.col("kind") == "image", F.concat(F.lit("i"), number)))
    said = F.struct(F.col("kind").alias("type"), F.col("id"), F.when(F.col("kind") != "image", F.col("text")).alias("text"), F.when(F.col("kind") == "code", F.col("language")).alias("language"), F.when(F.col("kind") == "image", F.col("alt")).alias("alt"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("place", said.alias("b")))), lambda x: x["b"])
    return numbered.groupBy("batch_id").agg(F.to_json(ordered).alias("payload"))


def with_halved(batches: DataFrame, sizes: str = "size", most: int = X.PAYLOAD_CHARS) -> DataFrame:
    """``batch_id, place, half``: rows of a batch whose sizes come to too much are dealt into two halves, the first one not the smaller; one row stays alone."""
    batch = Window.partitionBy("batch_id")
    n, total = F.count("*").over(batch), F.sum(sizes).over(batch)
    turn = F.row_number().over(batch.orderBy("place"))
    return batches.select("batch_id", "place", F.when((total > most) & (n > 1) & (turn > F.ceil(n / 2)), 1).otherwise(0).cast("long").alias("half"))


def union_of(frames: list[DataFrame]) -> DataFrame:
    """Sections of several sources, cards of a model and those by rule: rows one after the other, by column name."""
    return reduce(DataFrame.unionByName, frames)
