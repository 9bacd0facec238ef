"""Web pages as tables: a row for each element and text, elements as intervals of a page's tokens.

There is no tree in memory. A page's tokens are numbered; an element begins at its tag ``n`` and ends before the token
``stop``. End tags are matched to begin tags of their name by the depth of that name, a running sum. What HTML leaves open is defined so:

* Void elements hold nothing. End tags without a begin tag are passed over.
* ``p`` ends at the next tag that is no inline one, begin or end; so does an inline element that is never closed.
* ``li``, ``dt`` and ``dd``, ``tr``, ``td`` and ``th`` end at the next tag of their group on the same level.
* These, and any other element that is never closed, end at the latest where the element around them does, or at the end of the page. The tags of ``thead``, ``tbody`` and ``tfoot`` only end rows and cells.

What an element holds is then a difference of running sums at its two ends, what holds a text is the last element begun
at that depth, and what lies in none of some elements is found by the running maximum of their ends. All windows are by page, so a page's rows are shuffled
once, and a page is one group. ``pages(page_id, html)``: an id names one page; a null page has no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quern.functions import addresses as U
from quern.functions import fixed as X
from quern.functions import markup as M
from quern.runtime import dealt, discard, materialise

_GROUPS = {"li": ("li",), "dx": ("dt", "dd"), "row": ("tr", *M.SECTIONS), "cell": ("td", "th", "tr", *M.SECTIONS)}
_HEADINGS = tuple(f"h{i}" for i in range(1, 7))


def _page() -> WindowSpec:
    return Window.partitionBy("page_id")


def _so_far() -> WindowSpec:
    return _page().orderBy("n").rowsBetween(Window.unboundedPreceding, 0)


def _before() -> WindowSpec:
    return _page().orderBy("n").rowsBetween(Window.unboundedPreceding, -1)


def _after() -> WindowSpec:
    return _page().orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)


def _events() -> WindowSpec:
    """Begins and ends of elements in one order: what ends at a token ends before it, the innermost first."""
    return _page().orderBy("at", "begins", F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)


def _inline() -> Column:
    return F.col("name").isin(*X.INLINE_ELEMENTS)


def tokens(pages: DataFrame) -> DataFrame:
    """``page_id, n, token, kind, name``: begin tags (``open``, ``void``), end tags (``close``) and texts. Comments and elements of raw text are left out."""
    # Pages are dealt out before they are cut: no window over a part of a page needs another shuffle.
    # Parts have so many characters however many pages there are, so a task's sorts do not grow with the table.
    found = dealt(pages.select("page_id", "html"), "page_id", "html").select("page_id", F.posexplode(M.tokens(F.col("html"))).alias("n", "token"))
    name = F.lower(F.regexp_extract("token", M.NAME, 1))
    found = found.select("page_id", F.col("n").cast("long").alias("n"), "token", name.alias("name"))
    void = F.col("name").isin(*M.VOID)
    ends = F.col("token").startswith("</")
    told = F.when(F.col("token").rlike(r"^<[!?]") | F.col("name").isin(*M.RAW) | (ends & void), "none").when(F.col("name") == "", "text").when(ends, "close").when(void, "void").otherwise("open")
    return found.withColumn("kind", told).where("kind <> 'none'")


def elements(pages: DataFrame) -> DataFrame:
    """``page_id, n, token, kind, name, stop``: elements and texts in order; ``stop`` is null for texts."""
    optional = F.col("name").isin("p", *(x for group in _GROUPS.values() for x in group))
    step = F.when(optional | F.col("kind").isin("text", "void"), 0).when(F.col("kind") == "open", 1).otherwise(-1)
    named = Window.partitionBy("page_id", "name").orderBy("n")
    all_named = named.rowsBetween(Window.unboundedPreceding, 0)
    t = tokens(pages).withColumn("step", step).withColumn("sum", F.sum("step").over(all_named))
    t = t.withColumn("floor", F.min(F.least("sum", F.lit(0))).over(all_named))
    stray = (F.col("step") == -1) & (F.col("sum") < F.coalesce(F.lag("floor").over(named), F.lit(0)))
    t = t.withColumn("stray", stray).withColumn("depth", F.col("sum") - F.col("floor") + F.when((F.col("step") == -1) & ~F.col("stray"), 1).otherwise(0))
    pair = Window.partitionBy("page_id", "name", "depth").orderBy("n")
    partner = F.when((F.col("step") == 1) & (F.lead("step").over(pair) == -1), F.lead("n").over(pair)).when((F.col("step") == -1) & ~F.col("stray"), F.lag("n").over(pair))
    t = t.withColumn("partner", partner).withColumn("turn", F.when(F.col("partner").isNull(), 0).otherwise(F.col("step")))
    t = t.withColumn("level", F.coalesce(F.sum("turn").over(_before()), F.lit(0)))
    later = Window.partitionBy("page_id", "level").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    tag = F.col("kind").isin("open", "close")
    t = t.withColumn("around", F.min(F.when(F.col("turn") == -1, F.col("n"))).over(later))
    for group, names in _GROUPS.items():
        t = t.withColumn(group, F.min(F.when(tag & F.col("name").isin(*names), F.col("n"))).over(later))
    t = t.withColumn("block", F.min(F.when((tag & ~_inline()) | (F.col("name") == "hr"), F.col("n"))).over(_after())).withColumn("last", F.max("n").over(_page()) + 1)
    own = F.when((F.col("name") == "p") | _inline(), F.col("block"))
    for group, names in _GROUPS.items():
        own = own.when(F.col("name").isin(*(x for x in names if group != "cell" or x != "tr")), F.col(group))
    stop = F.when(F.col("kind") == "void", F.col("n") + 1).when(F.col("kind") == "open", F.coalesce("partner", F.least(own, "around", "last")))
    held = (F.col("kind") != "close") & ~F.col("name").isin(*M.SECTIONS)
    return t.withColumn("stop", stop).where(held).select("page_id", "n", "token", "kind", "name", "stop")


def noise_marked(rows: DataFrame) -> DataFrame:
    """``noise``, whether an element is removed with all it holds, and ``gone``, whether a row lies in such an element. A header or footer within an article is none for its name alone."""
    tag = F.col("token")
    kept = F.col("name").isin("header", "footer") & F.coalesce(F.max(F.when(F.col("name").isin("article", "main"), F.col("stop"))).over(_before()) > F.col("n"), F.lit(False))
    by_name = F.col("name").isin("head", *X.NOISE_ELEMENTS) & ~F.col("exempt")
    marked = M.value(tag, "aria-hidden") == "true"
    marked = marked | tag.rlike(r"(?i)\shidden[\s=/>]") | M.value(tag, "role").isin(*X.NOISE_ROLES) | M.has_class(tag, X.NOISE_CLASSES)
    rows = rows.withColumn("exempt", kept).withColumn("noise", (F.col("kind") != "text") & (by_name | marked)).drop("exempt")
    return rows.withColumn("gone", F.coalesce(F.max(F.when(F.col("noise"), F.col("stop"))).over(_so_far()) > F.col("n"), F.lit(False)))


def without_noise(rows: DataFrame) -> DataFrame:
    """Elements and texts that lie in no noise."""
    return noise_marked(rows).where("not gone").drop("noise", "gone")


def with_pieces(rows: DataFrame) -> DataFrame:
    """``piece``: a text as it joins the page's text, with a space before it where two words would run together; empty for elements."""
    raw = F.when(F.col("kind") == "text", M.decoded(F.col("token"))).otherwise("")
    rows = rows.withColumn("raw", raw)
    before = F.last(F.when(F.col("raw") != "", F.substring("raw", -1, 1)), ignorenulls=True).over(_before())
    return rows.withColumn("piece", F.when(M.parted(before, F.col("raw")), F.concat(F.lit(" "), "raw")).otherwise(F.col("raw"))).drop("raw")


def held(rows: DataFrame, **amounts: Column) -> DataFrame:
    """For each row, ``<name>_before`` and ``<name>_held``: totals of an amount over the rows before it, and over those that the element holds."""
    events = F.array(F.struct(F.col("n").alias("at"), F.lit(True).alias("begins")))
    both = F.concat(events, F.array(F.struct(F.col("stop").alias("at"), F.lit(False).alias("begins"))))
    e = rows.withColumns({f"{k}_own": v.cast("long") for k, v in amounts.items()}).select("*", F.inline(F.when(F.col("stop").isNull(), events).otherwise(both)))
    e = e.withColumns({f"{k}_run": F.sum(F.when(F.col("begins"), F.col(f"{k}_own")).otherwise(0)).over(_events()) for k in amounts})
    ends = Window.partitionBy("page_id", "n").orderBy(F.desc("begins"))
    e = e.withColumns({f"{k}_held": F.coalesce(F.lead(f"{k}_run").over(ends) - F.col(f"{k}_run"), F.lit(0)) for k in amounts})
    e = e.withColumns({f"{k}_before": F.col(f"{k}_run") - F.col(f"{k}_own") for k in amounts}).where("begins")
    return e.drop("at", "begins", *(f"{k}_{x}" for k in amounts for x in ("own", "run")))


def holders(rows: DataFrame, member: Column, into: str) -> DataFrame:
    """``into``: of the elements that are members, the ``n`` of the innermost that holds the row; null if there is none."""
    rows = rows.withColumn("member", member & F.col("stop").isNotNull())
    events = F.array(F.struct(F.col("n").alias("at"), F.lit(True).alias("begins")))
    both = F.concat(events, F.array(F.struct(F.col("stop").alias("at"), F.lit(False).alias("begins"))))
    e = rows.select("*", F.inline(F.when(F.col("member"), both).otherwise(events)))
    e = e.withColumn("deep", F.sum(F.when(~F.col("member"), 0).when(F.col("begins"), 1).otherwise(-1)).over(_events())).where("begins")
    # A member is told from on its own depth, and asks one depth further out.
    asks = F.array(F.struct((F.col("deep") - F.col("member").cast("int")).alias("layer"), F.lit(True).alias("asks")))
    tells = F.array(F.struct(F.col("deep").alias("layer"), F.lit(False).alias("asks")))
    e = e.select("*", F.inline(F.when(F.col("member"), F.concat(asks, tells)).otherwise(asks)))
    layer = Window.partitionBy("page_id", "layer").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    last = F.when(F.col("layer") > 0, F.last(F.when(~F.col("asks"), F.col("n")), ignorenulls=True).over(layer))
    return e.withColumn(into, last).where("asks").drop("member", "at", "begins", "deep", "layer", "asks")


def content_rank(name: Column, classes: Column, ident: Column, role: Column) -> Column:
    """The place in the list of where articles stand, of the first that an element fits; null for others."""
    rank = F.lit(None).cast("int")
    for i, told in reversed(list(enumerate(X.CONTENT))):
        fits = F.array_contains(F.split(classes, r"\s+"), told[1:]) if told[0] == "." else ident == told[1:] if told[0] == "#" else role == told[1:-1] if told[0] == "[" else name == told
        rank = F.when(fits, i).otherwise(rank)
    return rank


def texts(rows: DataFrame) -> DataFrame:
    """Elements with ``text``, all text that they hold, and ``n_blocks, n_links, n_images``, how many of what they hold is no inline element, a link or an image.

    A page's text is made once; an element's is a stretch of it, from the characters before the element on.
    """
    rows = with_pieces(rows)
    element = F.col("kind") != "text"
    told = held(rows, chars=F.length("piece"), blocks=(element & ~_inline()).cast("int"), links=(F.col("name") == "a").cast("int"), images=(F.col("name") == "img").cast("int"))
    whole = rows.where("kind = 'text'").groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "piece"))), lambda x: x["piece"]), "").alias("whole"))
    found = told.where(element).join(whole, "page_id", "left")
    stretch = F.substring(F.coalesce("whole", F.lit("")), F.col("chars_before").cast("int") + 1, F.col("chars_held").cast("int"))
    columns = ["page_id", "n", "token", "kind", "name", "stop", *(F.col(f"{x}_held").alias(f"n_{x}") for x in ("blocks", "links", "images"))]
    return found.select(*columns, stretch.alias("stretch"), M.text_of(stretch).alias("text"))


def content_roots(told: DataFrame) -> DataFrame:
    """``page_id, root, root_stop, name``: of elements with 400 characters, the first of the most specific kind; else the body if it holds an element, else the whole page. ``told`` is from `texts`."""
    told = told.select("page_id", "n", "name", "stop", "text", *(M.value(F.col("token"), a).alias(f"a_{a}") for a in ("class", "id", "role")))
    rank = F.when(F.length("text") >= X.CONTENT_CHARS, content_rank(F.col("name"), F.col("a_class"), F.col("a_id"), F.col("a_role")))
    body = F.when((F.col("name") == "body") & F.col("full"), len(X.CONTENT))
    follows = F.lead("n").over(_page().orderBy("n"))
    ranked = told.withColumn("full", F.coalesce(follows < F.col("stop"), F.lit(False))).withColumn("rank", F.coalesce(rank, body))
    best = F.min(F.when(F.col("rank").isNotNull(), F.struct("rank", "n", "stop", "name")))
    whole = F.max("stop")
    found = ranked.groupBy("page_id").agg(best.alias("best"), whole.alias("whole"))
    return found.select("page_id", F.coalesce("best.n", F.lit(-1)).alias("root"), F.coalesce("best.stop", "whole").alias("root_stop"), F.col("best.name").alias("name"))


def link_rows(told: DataFrame) -> DataFrame:
    """``link_chars`` and ``link_row``: whether two links or more make up nine tenths of an element's text. ``told`` is from `texts`."""
    told = held(told, link=F.when(F.col("name") == "a", F.length("text")).otherwise(0))
    row = (F.col("n_links") >= 2) & (F.length("text") > 0) & (F.col("link_held") >= X.LINK_SHARE * F.length("text"))
    return told.withColumn("link_row", row).withColumnRenamed("link_held", "link_chars").drop("link_before")


def own_texts(rows: DataFrame, owner: str, parted: bool = True) -> DataFrame:
    """``page_id, <owner>, text``: the texts of each owner joined in order, with spaces where words would run together. ``owner`` holds its ``n``."""
    order = Window.partitionBy("page_id", owner).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    raw = rows.where(F.col("kind") == "text").where(F.col(owner).isNotNull()).withColumn("raw", M.decoded(F.col("token")))
    if parted:
        before = F.last(F.when(F.col("raw") != "", F.substring("raw", -1, 1)), ignorenulls=True).over(order)
        raw = raw.withColumn("raw", F.when(M.parted(before, F.col("raw")), F.concat(F.lit(" "), "raw")).otherwise(F.col("raw")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "raw"))), lambda x: x["raw"]), "")
    return raw.groupBy("page_id", owner).agg(joined.alias("text"))


def list_items(rows: DataFrame) -> DataFrame:
    """``page_id, list, n, text``: items of each outermost list in order, those of lists within it among them; an item's text leaves lists in it out. Empty items and page furniture go. ``rows`` are from `elements`."""
    lists = F.col("name").isin("ul", "ol")
    outer = F.coalesce(F.max(F.when(lists, F.col("stop"))).over(_before()) <= F.col("n"), F.lit(True))
    outermost = F.last(F.when(lists & outer, F.struct("n", "stop")), ignorenulls=True).over(_so_far())
    found = holders(rows, F.col("name").isin("li", "ul", "ol"), "owner").withColumn("top", outermost)
    items = found.where(F.col("name") == "li").where(F.col("top.stop") > F.col("n")).select("page_id", F.col("top.n").alias("list"), "n")
    said = own_texts(found, "owner").withColumnRenamed("owner", "n").withColumn("text", M.tidy_inline(F.col("text")))
    return items.join(said, ["page_id", "n"]).where(~U.chrome(F.col("text"))).select("page_id", "list", "n", "text")


def table_rows(rows: DataFrame, told: DataFrame) -> DataFrame:
    """``page_id, table, place, kind, cells``: rows of each outermost table in order.

    With two rows or more of which the first has two cells or more, none of them empty, and another row with cells, the first is the
    ``header`` and the others are ``row``, padded or cut to its width. Otherwise each row's cells are joined as a ``paragraph``, if that is no page furniture;
    a table of one row gives nothing. Rows of tables within a cell are rows as well, each with its own cells.
    """
    tables = F.col("name") == "table"
    outer = F.coalesce(F.max(F.when(tables, F.col("stop"))).over(_before()) <= F.col("n"), F.lit(True))
    top = F.last(F.when(tables & outer, F.struct("n", "stop")), ignorenulls=True).over(_so_far())
    placed = holders(rows, F.col("name") == "tr", "tr").withColumn("top", top).where(F.col("top.stop") > F.col("n"))
    lines = placed.where(F.col("name") == "tr").groupBy("page_id", F.col("top.n").alias("table")).agg(F.count("*").alias("n_rows"))
    cells = placed.where(F.col("name").isin("td", "th") & F.col("tr").isNotNull()).select("page_id", F.col("top.n").alias("table"), "tr", "n")
    cells = cells.join(told.select("page_id", "n", "text"), ["page_id", "n"])
    grid = cells.groupBy("page_id", "table", "tr").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]).alias("cells"))
    order = Window.partitionBy("page_id", "table").orderBy("tr")
    grid = grid.join(lines.where("n_rows >= 2"), ["page_id", "table"]).withColumn("place", F.row_number().over(order) - 1)
    of_table = Window.partitionBy("page_id", "table")
    grid = grid.withColumn("header", F.first("cells").over(order)).withColumn("count", F.count("*").over(of_table))
    real = (F.size("header") >= 2) & (F.col("count") >= 2) & ~F.exists("header", lambda c: c == "")
    square = F.transform(F.sequence(F.lit(1), F.size("header")), lambda i: F.coalesce(F.get("cells", i - 1), F.lit("")))
    plain = F.array(F.array_join(F.filter("cells", lambda c: c != ""), " — "))
    kind = F.when(~real, "paragraph").when(F.col("place") == 0, "header").otherwise("row")
    found = grid.select("page_id", "table", "tr", "place", kind.alias("kind"), F.when(real, square).otherwise(plain).alias("cells"))
    return found.where((F.col("kind") != "paragraph") | ~U.chrome(F.get("cells", F.lit(0))))


def blocks(pages: DataFrame) -> DataFrame:
    """``page_id, place, kind, level, text``: the content of each page as headings, paragraphs, lists, tables and code in order.

    An element is read as a whole if its kind says so or if it holds only inline elements; of such elements the outermost counts, and what
    lies around them gives a paragraph if its own text is long enough. Items of a list, and rows of a table (cells parted by tabs), are lines of its text. Images give no block; a summary in details is a heading of level 5.
    """
    rows = materialise(without_noise(elements(pages)), "page_rows")
    told = materialise(link_rows(texts(rows)), "page_texts")
    roots = content_roots(told).drop("name")
    name = F.col("name")
    whole = name.isin(*_HEADINGS, "pre", "img", "ul", "ol", "dl", "table", "p", "figcaption") | (F.col("n_blocks") == 0) | ((name == "figure") & (F.col("n_images") > 0)) | ((name == "summary") & F.col("in_details"))
    details = F.coalesce(F.max(F.when(name == "details", F.col("stop"))).over(_before()) > F.col("n"), F.lit(False))
    inside = told.withColumn("in_details", details).join(roots, "page_id").where((F.col("n") > F.col("root")) & (F.col("n") < F.col("root_stop")))
    inside = inside.withColumn("whole", whole)
    free = F.coalesce(F.max(F.when(F.col("whole"), F.col("stop"))).over(_before()) <= F.col("n"), F.lit(True))
    inside = inside.withColumn("free", free).where("free")

    read = inside.where("whole")
    heading = name.isin(*_HEADINGS)
    summary = (name == "summary") & F.col("in_details")
    level = F.when(summary | F.col("text").rlike(X.CALLOUT), 5).otherwise(F.substring("name", 2, 1).cast("int"))
    told_apart = name.isin("img", "ul", "ol", "dl", "table", "figure")
    good = ~U.chrome(F.col("text"))
    heads = read.where((heading | summary) & good).select("page_id", "n", F.lit("heading").alias("kind"), level.alias("level"), "text")
    code = F.regexp_replace("stretch", r"^\s*\n|\s+$", "")
    codes = read.where(name == "pre").select("page_id", "n", F.lit("code").alias("kind"), F.lit(None).cast("int").alias("level"), code.alias("text")).where(F.length("text") >= 3)
    prose = read.where(~(heading | summary | told_apart | (name == "pre")) & ~F.col("link_row") & good).select("page_id", "n", F.lit("paragraph").alias("kind"), F.lit(None).cast("int").alias("level"), "text")

    lists = read.where(name.isin("ul", "ol") & ~F.col("link_row")).select("page_id", F.col("n").alias("list"))
    items = list_items(rows).join(lists, ["page_id", "list"]).select("page_id", F.col("list").alias("n"), F.col("n").alias("item"), "text")
    defined = _definitions(rows, told).join(read.where(name == "dl").select("page_id", "n"), ["page_id", "n"])
    in_lines = lambda df, kind: df.groupBy("page_id", "n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item", "text"))), lambda x: x["text"]), "\n").alias("text")).select("page_id", "n", F.lit(kind).alias("kind"), F.lit(None).cast("int").alias("level"), "text")
    tables = table_rows(rows, told).join(read.where(name == "table").select("page_id", F.col("n").alias("table")), ["page_id", "table"])
    cells = tables.select("page_id", F.col("table").alias("n"), F.col("tr").alias("item"), F.array_join("cells", "\t").alias("text"), "kind")
    loose = own_texts(holders(rows, F.lit(True), "parent"), "parent", parted=False).withColumnRenamed("parent", "n")
    loose = loose.select("page_id", "n", F.trim(F.regexp_replace(F.replace("text", F.lit(" "), F.lit(" ")), r"\s+", " ")).alias("loose"))
    loose = inside.where("not whole").select("page_id", "n").join(loose, ["page_id", "n"]).where((F.length("loose") >= X.LOOSE_CHARS) & ~U.chrome(F.col("loose")))

    found = heads.unionByName(codes).unionByName(prose).unionByName(in_lines(items.unionByName(defined), "list")).unionByName(in_lines(cells.where("kind <> 'paragraph'").drop("kind"), "table")).withColumn("item", F.lit(0).cast("long"))
    found = found.unionByName(loose.select("page_id", "n", F.lit("paragraph").alias("kind"), F.lit(None).cast("int").alias("level"), F.col("loose").alias("text"), F.lit(0).cast("long").alias("item")))
    found = found.unionByName(cells.where("kind = 'paragraph'").select("page_id", "n", "kind", F.lit(None).cast("int").alias("level"), "text", "item"))
    place = F.row_number().over(_page().orderBy("n", "item")) - 1
    found = materialise(found.select("page_id", place.cast("long").alias("place"), "kind", "level", "text"), "page_blocks")
    discard(rows, told)
    return found


def _definitions(rows: DataFrame, told: DataFrame) -> DataFrame:
    """``page_id, n, item, text``: of each definition list ``n`` the definitions, each behind its term."""
    found = holders(rows, F.col("name") == "dl", "dl").where(F.col("name").isin("dt", "dd") & F.col("dl").isNotNull()).select("page_id", "n", "dl")
    found = found.join(told.select("page_id", "n", "name", "text"), ["page_id", "n"])
    order = Window.partitionBy("page_id", "dl").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("term", F.coalesce(F.last(F.when(F.col("name") == "dt", F.col("text")), ignorenulls=True).over(order), F.lit("")))
    said = F.when(F.col("term") != "", F.concat("term", F.lit(": "), "text")).otherwise(F.col("text"))
    return found.where("name = 'dd' and text <> ''").select("page_id", F.col("dl").alias("n"), F.col("n").alias("item"), said.alias("text"))
