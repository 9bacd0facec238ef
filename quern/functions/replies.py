"""Model replies as rows: the JSON objects that a reply closes, and what their fields must be. All in Column functions, by Spark's variant type.

An object is found by its braces, with strings and one level of objects inside it, so a fence, prose around an array and an array that was cut off do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import fixed as X
from quern.functions import text as T
from quern.operators.duplicates import kept_options
from quern.runtime import spread

#: Possessive, so that Java's engine neither backtracks nor nests.
_STRING = r'"(?:[^"\\]++|\\.)*+"'
OBJECT = r"(?s)\{(?:[^{}\"]++|" + _STRING + r"|\{(?:[^{}\"]++|" + _STRING + r")*+\})*+\}"


def fence_stripped(text: Column) -> Column:
    """A reply without the code fence around it."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"^\s*```\w*", ""), r"```\s*$", ""), r"^\s+|\s+$", "")


def objects(text: Column) -> Column:
    """The texts of the objects in a reply, in order; those that are no JSON are left out."""
    return F.filter(F.regexp_extract_all(fence_stripped(text), F.lit(OBJECT), F.lit(0)), lambda o: F.try_parse_json(o).isNotNull())


def is_string(value: Column, path: str) -> Column:
    """Whether there is a string."""
    return F.coalesce(F.schema_of_variant(F.try_variant_get(value, path, "variant")) == "STRING", F.lit(False))


def string(value: Column, path: str) -> Column:
    """A string, trimmed; anything else is an empty one."""
    return F.when(is_string(value, path), F.trim(F.try_variant_get(value, path, "string"))).otherwise("")


def strings(value: Column, path: str) -> Column:
    """The strings of an array; null where there is none."""
    found = F.try_variant_get(value, path, "array<variant>")
    return F.transform(F.filter(found, lambda x: F.coalesce(F.schema_of_variant(x) == "STRING", F.lit(False))), lambda x: F.try_variant_get(x, "$", "string"))


def _exploded(replies: DataFrame) -> DataFrame:
    """``reply_id, place, o`` of ``replies(reply_id, text)``."""
    # Replies are dealt out before they are read, which is the work: a table of them may be one part, and one core would read it all.
    found = spread(replies.select("reply_id", "text"), "reply_id").select("reply_id", F.posexplode(objects(F.col("text"))).alias("place", "o"))
    return found.select("reply_id", F.col("place").cast("long").alias("place"), F.try_parse_json("o").alias("o"))


def cards(replies: DataFrame) -> DataFrame:
    """``reply_id, place, front, back, context, source, front_code, back_code, image``: objects with both halves of a card; blank references are null."""
    o = F.col("o")
    kept = _exploded(replies).where(is_string(o, "$.front") & is_string(o, "$.back"))
    text = {n: F.when(is_string(o, f"$.{n}"), string(o, f"$.{n}")).alias(n) for n in ("context", "source")}
    asset = {n: F.nullif(string(o, f"$.{k}"), F.lit("")).alias(n) for n, k in (("front_code", "frontCode"), ("back_code", "backCode"), ("image", "image"))}
    return kept.select("reply_id", "place", string(o, "$.front").alias("front"), string(o, "$.back").alias("back"), *text.values(), *asset.values())


def _questions(o: Column, n: int, vignette: str) -> list[Column]:
    names = ("id", "stem", "correct", "explanation")
    return [*(string(o, f"$.{x}").alias(x) for x in names), kept_options(string(o, "$.correct"), strings(o, "$.distractors"), n).alias("distractors"), F.nullif(string(o, f"$.{vignette}"), F.lit("")).alias("vignette")]


_USABLE = "id <> '' and stem <> '' and correct <> '' and explanation <> '' and distractors is not null"


def questions(replies: DataFrame, n: int = 3) -> DataFrame:
    """``reply_id, place, id, stem, correct, explanation, distractors, vignette``: questions with all fields and ``n`` good distractors, the first of each id."""
    found = _exploded(replies).select("reply_id", "place", *_questions(F.col("o"), n, "vignette")).where(_USABLE)
    return found.withColumn("turn", F.row_number().over(Window.partitionBy("reply_id", "id").orderBy("place"))).where("turn = 1").drop("turn")


def application_questions(replies: DataFrame, n: int = 3) -> DataFrame:
    """``reply_id, place, id, skip`` and, where ``skip`` is null, the question with its ``code``: the first usable object of each id.

    A skip has a reason and no stem. A question needs a scenario or a program; one whose program is no text, too long or too many lines goes.
    """
    o = F.col("o")
    code = F.try_variant_get(o, "$.code", "variant")
    has = code.isNotNull() & (F.schema_of_variant(code) != "VOID")
    text = F.when(is_string(o, "$.code.text"), F.regexp_replace(F.try_variant_get(o, "$.code.text", "string"), r"\s+$", "")).otherwise("")
    good = (F.trim(text) != "") & (F.length(text) <= X.APPLICATION_CHARS) & (F.size(F.split(text, "\n")) <= X.APPLICATION_LINES)
    found = _exploded(replies).select("reply_id", "place", *_questions(o, n, "scenario"), string(o, "$.skip").alias("reason"), F.coalesce(has, F.lit(False)).alias("has"), good.alias("good"), text.alias("code"))
    skip = (F.col("reason") != "") & (F.col("stem") == "")
    usable = F.expr(_USABLE) & (~F.col("has") | F.col("good")) & (F.col("has") | F.col("vignette").isNotNull())
    kept = found.where((F.col("id") != "") & (skip | usable)).withColumn("skip", F.when(skip, F.col("reason")))
    first = kept.withColumn("turn", F.row_number().over(Window.partitionBy("reply_id", "id").orderBy("place"))).where("turn = 1")
    return first.select("reply_id", "place", "id", "skip", *(F.when(F.col("skip").isNull(), F.col(c)).alias(c) for c in ("stem", "correct", "explanation", "distractors", "vignette")), F.when(F.col("skip").isNull() & F.col("has"), F.col("code")).alias("code"))


def verdicts(replies: DataFrame) -> DataFrame:
    """``reply_id, id, ok, failed``: the last verdict on each id; only a true one passes."""
    o = F.col("o")
    ok = F.coalesce(F.schema_of_variant(F.try_variant_get(o, "$.ok", "variant")) == "BOOLEAN", F.lit(False)) & F.coalesce(F.try_variant_get(o, "$.ok", "boolean"), F.lit(False))
    named = F.filter(F.transform(F.coalesce(strings(o, "$.failed"), F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    found = _exploded(replies).select("reply_id", "place", string(o, "$.id").alias("id"), ok.alias("ok"), named.alias("failed")).where("id <> ''")
    last = F.max_by(F.struct("ok", "failed"), "place").alias("v")
    return found.groupBy("reply_id", "id").agg(last).select("reply_id", "id", "v.ok", "v.failed")


def audited(asked: DataFrame, replies: DataFrame) -> DataFrame:
    """``asked(reply_id, id)`` with ``ok``: a question without a verdict fails."""
    return asked.join(verdicts(replies), ["reply_id", "id"], "left").select("reply_id", "id", F.coalesce("ok", F.lit(False)).alias("ok"))


def pages_read(replies: DataFrame, pages: DataFrame) -> DataFrame:
    """``reply_id, page, place, kind, level, text, context`` of the blocks that a transcription gives for ``pages(reply_id, label, page)``.

    A page is known by the label that the reply repeats; headings, paragraphs and lists with a text are kept, a title comes first. Lists' items stand on lines.
    """
    o, b = F.col("o"), F.col("b")
    entry = _exploded(replies).where(is_string(o, "$.page")).withColumn("label", F.try_variant_get(o, "$.page", "string"))
    entry = entry.join(pages, ["reply_id", "label"]).withColumn("title", F.nullif(string(o, "$.title"), F.lit("")))
    blocks = entry.select("reply_id", "page", F.col("place").alias("entry"), "title", F.posexplode(F.try_variant_get(o, "$.blocks", "array<variant>")).alias("place", "b"))
    items = F.array_join(F.filter(strings(b, "$.items"), lambda x: F.trim(x) != ""), "\n")
    kind, text = string(b, "$.type"), string(b, "$.text")
    blocks = blocks.select("reply_id", "page", "entry", (F.col("place") + 1).cast("long").alias("place"), kind.alias("kind"), F.when(kind == "heading", 2).alias("level"), F.when(kind == "list", F.coalesce(items, F.lit(""))).otherwise(text).alias("text"), "title")
    blocks = blocks.where("kind in ('heading', 'paragraph', 'list') and text <> ''")
    titles = entry.where("title is not null").select("reply_id", "page", F.col("place").alias("entry"), F.lit(0).cast("long").alias("place"), F.lit("heading").alias("kind"), F.lit(1).alias("level"), F.col("title").alias("text"), "title")
    return titles.unionByName(blocks).select("reply_id", "page", "entry", "place", "kind", "level", "text", F.when(F.col("kind") != "heading", F.col("title")).alias("context"))


def extraction(replies: DataFrame, detail: str = "standard") -> DataFrame:
    """``reply_id, title, lede, core_concept, items, comparisons, key_takeaway`` of replies that are an object with an item at least.

    Every text is cut to its length between words; items need a label and a detail, comparisons a name and a value, and only so many of each are
    kept. A title that is missing is the deck's, ``replies(reply_id, text, deck)``. Pairs of the core concept come in order of their keys.
    """
    n = X.INFOGRAPHIC_CHARS
    o = F.col("o")
    whole = spread(replies.select("reply_id", "text", "deck"), "reply_id").select("reply_id", "deck", F.try_parse_json(F.regexp_extract(fence_stripped(F.col("text")), r"(?s)\{.*\}", 0)).alias("o")).where("o is not null")
    clamp = lambda v, name, most: F.when(is_string(v, f"$.{name}"), T.clamped(F.try_variant_get(v, f"$.{name}", "string"), most))

    def parts(name: str, fields: tuple[str, ...], need: tuple[str, ...], most: int) -> Column:
        made = F.transform(F.try_variant_get(o, f"$.{name}", "array<variant>"), lambda v: F.struct(*(clamp(v, f, n[f]).alias(f) for f in fields)))
        return F.slice(F.filter(made, lambda x: F.forall(F.array(*(x[f].isNotNull() for f in need)), lambda b: b)), 1, most)

    pairs = F.transform(F.map_entries(F.try_variant_get(o, "$.coreConcept", "map<string,variant>")), lambda e: F.struct(T.clamped(e["key"], n["concept"]).alias("key"), F.when(F.schema_of_variant(e["value"]) == "STRING", T.clamped(F.try_variant_get(e["value"], "$", "string"), n["meaning"])).alias("value")))
    core = F.slice(F.array_sort(F.filter(pairs, lambda e: e["key"].isNotNull() & e["value"].isNotNull())), 1, X.CORE_PAIRS)
    found = whole.select(
        "reply_id",
        F.coalesce(clamp(o, "title", n["title"]), F.col("deck")).alias("title"),
        F.coalesce(clamp(o, "lede", n["lede"]), F.lit("")).alias("lede"),
        core.alias("core_concept"),
        parts("items", ("label", "detail", "meta"), ("label", "detail"), X.INFOGRAPHIC_ITEMS[detail]).alias("items"),
        parts("comparisons", ("name", "value"), ("name", "value"), X.COMPARISONS).alias("comparisons"),
        F.coalesce(clamp(o, "keyTakeaway", n["keyTakeaway"]), F.lit("")).alias("key_takeaway"),
    )
    return found.where(F.size("items") > 0)
