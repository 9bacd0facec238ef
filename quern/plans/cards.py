"""Queries over card drafting, and their SQL; where a rule has no SQL, the rows that it must give are written out."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import fixed as X
from quern.functions import text as T
from quern.operators import drafting as G
from quern.operators import library as L
from quern.plans import duck as D
from quern.plans.queries import _STEM, query
from quern.sources import adapters as A
from quern.sources.fixtures import Fixture

_TOPICS = f"s as (select doc_id, line_no, line as topic, {_STEM} as stem, lag(line) over (partition by doc_id order by line_no) as prose, ['JSX', 'bash', 'none'][doc_id % 3 + 1] as lang, case when line_no % 2 = 0 then 'out ' || line_no end as output from lines where doc_id >= 0), t as (select *, case lower(lang) when 'jsx' then 'JSX' when 'bash' then 'Bash' end as name, {D.label('topic')} as good from s)"


def _topics(spark, sf):
    order = Window.partitionBy("doc_id").orderBy("line_no")
    language = F.element_at(F.array(*map(F.lit, ("JSX", "bash", "none"))), (F.col("doc_id") % 3 + 1).cast("int"))
    lines = A.lines(spark, sf).where("doc_id >= 0").withColumn("prose", F.lag("line").over(order))
    return lines.select("doc_id", "line_no", F.col("line").alias("topic"), "prose", language.alias("lang"), F.when(F.col("line_no") % 2 == 0, F.concat(F.lit("out "), F.col("line_no").cast("string"))).alias("output"))


@query("crd_08_code_cards", f"""with {D.LINES}, {_TOPICS} select doc_id, line_no, case when stem = '' then 'What does this ' || coalesce(name || ' ', '') || 'program print?' else stem || ' — what does this ' || coalesce(name || ' ', '') || 'program print?' end as front, output as back from t where output is not null
union all select doc_id, line_no, case when {D.like('stem', X.QUESTION_WORD)} then stem || '?' else stem || ' — how is this written' || coalesce(' in ' || name, '') || '?' end, prose from t where good and prose is not null""")
def crd_08(spark, sf):
    cards = G.code_cards(F.lit("code"), F.col("lang"), F.col("output"), F.col("topic"), F.col("prose"))
    return _topics(spark, sf).select("doc_id", "line_no", F.inline(cards)).select("doc_id", "line_no", "front", "back")


@query("crd_09_image_cards", f"with {D.LINES}, {_TOPICS} select doc_id, line_no, case when {D.like('stem', X.QUESTION_WORD)} then stem || '?' else stem || ' — what does it look like?' end as front, coalesce(output, prose) as back from t where good and coalesce(output, prose) is not null")
def crd_09(spark, sf):
    cards = G.image_cards(F.lit("a.png"), F.col("output"), F.col("topic"), F.col("prose"))
    return _topics(spark, sf).select("doc_id", "line_no", F.inline(cards)).select("doc_id", "line_no", "front", "back")


_NAMES = [c.split()[0] for c in G.BLOCKS.replace("array<array<string>>", "x").split(", ")]


def _block(section: int, place: int, kind: str, **k) -> tuple:
    return tuple({"section_id": section, "place": place, "kind": kind, **k}.get(n) for n in _NAMES)


BLOCKS = Fixture(
    G.BLOCKS,
    [
        _block(1, 0, "heading", level=1, text="Plant cells"), _block(1, 1, "paragraph", text="3-6 months"), _block(1, 2, "heading", level=3, text="Germination stage"), _block(1, 3, "paragraph", text="The seed takes up water and swells."),
        _block(1, 4, "heading", level=2, text="For example"), _block(1, 5, "paragraph", text="Chloroplast: the organelle that turns light into sugar"), _block(1, 6, "list", heading="Organelles", items=["Nucleus", "", "Vacuole"]),
        _block(1, 7, "list", heading="ROOT GROWTH (2 weeks)", items=["water", "soil"]), _block(1, 8, "table", headers=["Part", "Function"], rows=[["Leaf", "Photosynthesis in daylight"], ["Root", "short"]]),
        _block(2, 0, "paragraph", text="However, plant hormones are the signals that tell a plant when to grow and when to stop growing."),
        _block(3, 0, "code", heading="Loop over cells", text="for c in cells: print(c)", language="python", output="a b"), _block(3, 1, "paragraph", text="A loop visits each cell in turn."), _block(3, 2, "code", heading="Loop over cells", text="for c in cells: pass", language="python"),
        _block(3, 3, "image", heading="Cell wall", src="w.png", caption="A wall of cellulose."), _block(3, 4, "image", heading="here below", src="x.png"),
    ],
)
SECTIONS = Fixture("section_id long, doc_id long, place long, label string, title string", [(1, 1, 0, "Page 1", "Plant cells"), (2, 1, 1, "Page 2", "Plant hormones"), (3, 2, 0, "Page 1", None)])
CARDS = Fixture(
    "section_id long, card long, front string, back string, code string, image string",
    [
        (1, 0, "What characterizes Germination stage?", "The seed takes up water and swells.", None, None), (1, 1, "Germination stage — what age range?", "3-6 months", None, None),
        (1, 2, "What is Chloroplast?", "the organelle that turns light into sugar", None, None), (1, 3, "What are the organelles?", "• Nucleus\n• Vacuole", None, None),
        (1, 4, "What characterizes Root Growth?", "• water\n• soil", None, None), (1, 5, "Root Growth — what age range?", "2 weeks", None, None),
        (1, 6, "What is the function of the Leaf part?", "Photosynthesis in daylight", None, None), (1, 7, "Which part is characterized by: Photosynthesis in daylight?", "Leaf", None, None), (1, 8, "What is the function of the Root part?", "short", None, None),
        (2, 0, "What are Plant hormones?", "plant hormones are the signals that tell a plant when to grow and when to stop growing.", None, None), (2, 1, "What are plant hormones?", "the signals that tell a plant when to grow and when to stop growing", None, None),
        (3, 0, "Loop over cells — what does this Python program print?", "a b", "for c in cells: print(c)", None), (3, 1, "Loop over cells — how is this written in Python?", "A loop visits each cell in turn.", "for c in cells: pass", None),
        (3, 2, "Cell wall — what does it look like?", "A wall of cellulose.", None, "w.png"),
    ],
)


def _lines_as_blocks(spark, sf):
    """Lines of all documents as blocks, a document as a section under its first line."""
    line, n = F.col("line"), F.col("line_no")
    kind = F.when(T.meaningful_label(line), "heading").when(n % 7 == 5, "code").when(n % 11 == 9, "image").when(F.col("line").contains(": "), "list").otherwise("paragraph")
    lines = A.lines(spark, sf).where("line <> '' and line_no > 0").withColumn("kind", kind)
    firsts = A.documents(spark, sf).withColumn("line", F.substring_index("text", "\n", 1)).where("line <> ''")
    none = F.lit(None).cast("string")
    blocks = lines.select(
        F.col("doc_id").alias("section_id"), n.alias("place"), "kind", F.lit(2).alias("level"), line.alias("text"), none.alias("heading"), F.when(F.col("kind") == "list", F.array(line)).alias("items"),
        F.lit(None).cast("array<string>").alias("headers"), F.lit(None).cast("array<array<string>>").alias("rows"), F.lit("python").alias("language"), none.alias("output"), F.lit("x.png").alias("src"), none.alias("alt"), none.alias("caption"),
    )
    sections = firsts.select(F.col("doc_id").alias("section_id"), F.coalesce("source", F.lit("")).alias("doc_id"), F.col("doc_id").alias("place"), F.lit("Page").alias("label"), line.alias("title"))
    return blocks, sections


def with_fixture(spark, sf):
    """Blocks and sections of all documents and of the fixture, whose sections have ids below zero."""
    blocks, sections = _lines_as_blocks(spark, sf)
    own = SECTIONS.frame(spark).withColumn("section_id", -100 - F.col("section_id")).withColumn("doc_id", F.concat(F.lit("fixture "), F.col("doc_id").cast("string")))
    return blocks.unionByName(BLOCKS.frame(spark).withColumn("section_id", -100 - F.col("section_id"))), sections.unionByName(own)


@query("crd_02_section_cards")
def crd_02(spark, sf):
    """SQL would repeat every rule of phrasing; a walk from block to block in Python is the test."""
    cards = G.section_cards(*with_fixture(spark, sf))
    return cards.select("section_id", "card", "front", "back", F.coalesce("front_code", "back_code").alias("code"), "image")


@query("crd_01_drafted")
def crd_01(spark, sf):
    """SQL would repeat every rule of phrasing; a walk from card to card in Python is the test."""
    return G.drafted(*with_fixture(spark, sf)).select("doc_id", "ord", "section_id", "front", "back", "include")


PROGRAMS = Fixture(
    "doc_id long, place long, kind string, text string, output string",
    [
        (1, 0, "code", "print(1)", None), (1, 1, "paragraph", "It prints.", None), (1, 2, "heading", "OUTPUT :", None), (1, 3, "code", "1", None), (1, 4, "paragraph", "output", None), (1, 5, "code", "2", None),
        (2, 0, "code", "a", None), (2, 1, "list", "x", None), (2, 2, "paragraph", "Output", None), (2, 3, "code", "b", None), (3, 0, "code", "a", None), (3, 1, "paragraph", "Output", None), (3, 2, "code", "b", None),
    ],
)
ATTACHED = Fixture("doc_id long, place long, output string", [(1, 0, "1"), (1, 1, None), (1, 4, None), (1, 5, None), (2, 0, None), (2, 1, None), (2, 2, None), (2, 3, None), (3, 0, "b")])


_TURN = "(line_no + doc_id % 5) % 6"
_PROGRAM_BLOCKS = f"""programs as (select doc_id, line_no as place, case {_TURN} when 0 then 'code' when 1 then 'paragraph' when 2 then case when doc_id % 2 = 0 then 'heading' else 'paragraph' end when 3 then 'code' when 4 then case when line_no % 4 = 0 then 'paragraph' else 'list' end else 'code' end as kind,
 case when {_TURN} = 2 then 'Output:' when {_TURN} = 4 and line_no % 4 = 0 then 'OUTPUT' else line end as text, case when {_TURN} = 5 and line_no % 3 = 0 then 'own' end as output from lines where doc_id >= 0 union all select -doc_id, place, kind, text, output from {PROGRAMS.sql})"""
_BEFORE = "reverse(left(s.known, length(s.known) - 1))"
_HIT = f"(s.label and x.kind = 'code' and {D.like(_BEFORE, '^[p-]*c')})"
_BACK = f"(length({D.part(_BEFORE, '^([p-]*)c', 1)}) + 2)"
_OWN = "case when x.kind in ('paragraph', 'heading') then 'p' when x.kind = 'code' and coalesce(x.output, '') = '' then 'c' else 'x' end"
_KNOWN = f"right(case when {_HIT} then left(s.known, length(s.known) - {_BACK}) || 'x' || substring(s.known, length(s.known) - {_BACK} + 2, {_BACK} - 2) || '--' else s.known || {_OWN} end, {X.OUTPUT_LOOKBACK + 1})"
_LABEL = f"x.kind in ('paragraph', 'heading') and {D.like('x.text', X.OUTPUT_LABEL)}"


@query(
    "str_31_outputs",
    f"""with {D.LINES}, {_PROGRAM_BLOCKS}, folded as (select doc_id, list(place order by place) as places, list_reduce(list_prepend({{'kind': '', 'text': '', 'output': null::varchar, 'known': '', 'label': false, 'signs': ''}},
 list({{'kind': kind, 'text': text, 'output': output, 'known': '', 'label': false, 'signs': ''}} order by place)), lambda s, x: {{'kind': x.kind, 'text': x.text, 'output': x.output, 'known': {_KNOWN}, 'label': {_LABEL}, 'signs': s.signs || case when {_HIT} then {_BACK}::varchar else '0' end}}).signs as signs from programs group by doc_id),
signs as (select doc_id, unnest(places) as place, unnest(string_split(signs, '')) as sign from folded),
given as (select p.*, sign, coalesce({', '.join(f"case when lead(sign, {k}) over w = '{k}' then lead(text, {k}) over w end" for k in range(2, X.OUTPUT_LOOKBACK + 2))}) as given, lead(sign) over w as behind from programs p join signs using (doc_id, place) window w as (partition by doc_id order by place))
select doc_id, place, coalesce(given, output) as output from given where sign = '0' and coalesce(behind, '0') = '0'""",
)
def str_31(spark, sf):
    """Lines of all documents as programs, labels and prose in turn, and the fixture."""
    turn, line = F.expr(_TURN), F.col("line")
    kind = F.when(turn == 1, "paragraph").when(turn == 2, F.when(F.col("doc_id") % 2 == 0, "heading").otherwise("paragraph")).when(turn == 4, F.when(F.col("line_no") % 4 == 0, "paragraph").otherwise("list")).otherwise("code")
    text = F.when(turn == 2, "Output:").when((turn == 4) & (F.col("line_no") % 4 == 0), "OUTPUT").otherwise(line)
    blocks = A.lines(spark, sf).where("doc_id >= 0").select("doc_id", F.col("line_no").alias("place"), kind.alias("kind"), text.alias("text"), F.when((turn == 5) & (F.col("line_no") % 3 == 0), "own").alias("output"))
    return G.attached_outputs(blocks.union(PROGRAMS.frame(spark).withColumn("doc_id", -F.col("doc_id")))).select("doc_id", "place", "output")


DIVIDED = Fixture(
    "doc_id long, place long, kind string, level int, text string, size int, titles string",
    [
        (1, 0, "heading", 1, "Doc", 3, None), (1, 1, "paragraph", None, "lead", 10, "Doc"), (1, 2, "heading", 2, "A", 1, None), (1, 3, "paragraph", None, "a", 2000, "Doc > A"), (1, 4, "heading", 3, "A1", 2, None), (1, 5, "paragraph", None, "a1", 10, "Doc > A > A1"),
        (1, 6, "heading", 2, "B", 1, None), (1, 7, "paragraph", None, "b", 10, "Doc > B"), (1, 8, "heading", 5, "deep", 4, "Doc > B"), (2, 0, "paragraph", None, "none", 9000, ""), (3, 0, "heading", 2, "X", 1, None), (3, 1, "paragraph", None, "x", 5, "X"), (3, 2, "heading", 2, "Y", 1, None), (3, 3, "heading", 3, "Z", 1, "Y"), (3, 4, "paragraph", None, "z", 5, "Y"),
    ],
)


def _divided_sql() -> str:
    """The division, level by level."""
    made, before = [f"d0 as (select *, []::bigint[] as run, []::varchar[] as titles, 1 as from_, true as open_ from sized)"], "d0"
    for i in range(1, X.SPLIT_LEVEL + 1):
        made += [
            f"c{i} as (select *, case when open_ then min(case when kind = 'heading' and level between from_ and {X.SPLIT_LEVEL} then level end) over (partition by doc_id, run) end as cut from {before})",
            f"h{i} as (select *, kind = 'heading' and coalesce(level = cut, false) as head from c{i})", f"g{i} as (select *, sum(case when head then 1 else 0 end) over (partition by doc_id, run order by place)::bigint as grp from h{i})",
            f"t{i} as (select *, max(case when head then text end) over p as title, sum(case when not head then size + 1 else 0 end) over p > {X.SECTION_CHARS} as long_, min(grp) over r = max(grp) over r as lone from g{i} window p as (partition by doc_id, run, grp), r as (partition by doc_id, run))",
            f"d{i} as (select doc_id, place, kind, level, text, size, case when cut is not null then list_append(run, grp) else run end as run, case when cut is not null and title is not null then list_append(titles, title) else titles end as titles, cut + 1 as from_, open_ and cut is not null and (long_ or (lone and title is not null)) as open_ from t{i} where not head)",
        ]
        before = f"d{i}"
    return ", ".join(made) + f" select doc_id, place, array_to_string(titles, ' > ') as titles from {before}"


_SIZED = f"sized as (select doc_id, line_no as place, case when line_no > 0 and {D.label('line')} or line_no % 6 = 1 then 'heading' else 'paragraph' end as kind, case when line_no > 0 and {D.label('line')} or line_no % 6 = 1 then 1 + length(line) % 5 end as level, line as text, length(line) as size from lines where doc_id >= 0 union all select -doc_id, place, kind, level, text, size from (select * exclude (titles) from {DIVIDED.sql}))"


@query("str_14_sections", f"with {D.LINES}, {_SIZED}, {_divided_sql()}")
def str_14(spark, sf):
    """Lines of all documents, some of them headings of five levels, and the fixture."""
    heading = ((F.col("line_no") > 0) & T.meaningful_label(F.col("line"))) | (F.col("line_no") % 6 == 1)
    size = F.length("line")
    blocks = A.lines(spark, sf).where("doc_id >= 0").select("doc_id", F.col("line_no").alias("place"), F.when(heading, "heading").otherwise("paragraph").alias("kind"), F.when(heading, 1 + size % 5).alias("level"), F.col("line").alias("text"), size.alias("size"))
    blocks = blocks.union(DIVIDED.frame(spark).drop("titles").withColumn("doc_id", -F.col("doc_id")))
    return G.runs(blocks).select("doc_id", "place", F.array_join("titles", " > ").alias("titles"))


PARTS = Fixture("batch_id long, place long, kind string, text string, language string, alt string", [(1, 0, "code", "x = 1", "python", None), (1, 1, "image", "http://secret", None, "a cell"), (1, 2, "paragraph", "Text.", None, None), (1, 3, "code", "y", None, None), (2, 0, "image", "z", None, None)])
SAID = Fixture("batch_id long, payload string", [
    (1, '[{"type":"code","id":"c1","text":"x = 1","language":"python"},{"type":"image","id":"i1","alt":"a cell"},{"type":"paragraph","text":"Text."},{"type":"code","id":"c2","text":"y"}]'), (2, '[{"type":"image","id":"i1"}]'),
])


_SERIAL = f"""parts as (select doc_id as batch_id, line_no as place, ['code', 'paragraph', 'image'][line_no % 3 + 1] as kind, line as text, case when doc_id % 2 = 0 then 'sql' end as language, case when line_no % 2 = 0 then source end as alt from lines where doc_id >= 0 union all select -batch_id, place, kind, text, language, alt from {PARTS.sql})"""
_FIELD = lambda name, value: f"case when {value} is not null then ',\"{name}\":' || to_json({value})::varchar else '' end"


@query(
    "bat_04_payload",
    f"""with {D.LINES}, {_SERIAL}, n as (select *, row_number() over (partition by batch_id, kind order by place) as i from parts), o as (select batch_id, place,
 '{{"type":' || to_json(kind)::varchar || case kind when 'code' then ',"id":"c' || i || '"' when 'image' then ',"id":"i' || i || '"' else '' end || {_FIELD('text', "case when kind <> 'image' then text end")} || {_FIELD('language', "case when kind = 'code' then language end")} || {_FIELD('alt', "case when kind = 'image' then alt end")} || '}}' as o from n)
select batch_id, md5('[' || string_agg(o, ',' order by place) || ']') as payload_md5 from o group by batch_id""",
)
def bat_04(spark, sf):
    """A document's lines as snippets, paragraphs and pictures in turn, and the fixture."""
    lines = A.lines(spark, sf).where("doc_id >= 0")
    kind = F.element_at(F.array(*map(F.lit, ("code", "paragraph", "image"))), (F.col("line_no") % 3 + 1).cast("int"))
    parts = lines.select(F.col("doc_id").alias("batch_id"), F.col("line_no").alias("place"), kind.alias("kind"), F.col("line").alias("text"), F.when(F.col("doc_id") % 2 == 0, "sql").alias("language"), F.when(F.col("line_no") % 2 == 0, F.col("source")).alias("alt"))
    return G.payload(parts.union(PARTS.frame(spark).withColumn("batch_id", -F.col("batch_id")))).select("batch_id", F.md5("payload").alias("payload_md5"))


@query("bat_02_batches", f"with {D.CARDS}, b as (select deck_id, ord, (row_number() over (partition by deck_id order by ord) - 1) // 8 as batch, length(front) * 40 + length(back) * 200 as size from cards), h as (select *, count(*) over w as n, sum(size) over w as total, row_number() over (partition by deck_id, batch order by ord) as turn from b window w as (partition by deck_id, batch)) select deck_id, batch, ord, case when total > {X.PAYLOAD_CHARS} and n > 1 and turn > ceil(n / 2) then 1 else 0 end as half from h")
def bat_02(spark, sf):
    cards = L.batches(A.cards(spark, sf), 8, "deck_id", "ord").withColumn("batch_id", F.struct("deck_id", "batch"))
    found = G.with_halved(cards.select("batch_id", F.col("ord").alias("place"), (F.length("front") * 40 + F.length("back") * 200).alias("size")))
    return found.select("batch_id.deck_id", "batch_id.batch", F.col("place").alias("ord"), "half")
