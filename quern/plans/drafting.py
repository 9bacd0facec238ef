"""Queries over near-duplicates, layout, blocks, addresses and replies, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import addresses as U
from quern.functions import fixed as X
from quern.functions import replies as J
from quern.operators import duplicates as N
from quern.operators import library as L
from quern.operators import structure as R
from quern.plans import duck as D
from quern.plans.queries import _PAIRS, query
from quern.runtime import spread, table
from quern.sources import adapters as A
from quern.sources.fixtures import Fixture, literal

# Near-duplicates

_NEAR = f"""{_PAIRS}, near as (select deck_id, kept, later from pairs where not {D.conflicting('abn', 'bbn')} and not {D.conflicting('afn', 'bfn')} and not code and not image
 and least(len(afw), len(bfw)) >= {X.MIN_WORDS} and least(len(abw), len(bbw)) >= {X.MIN_WORDS} and {D.overlap('afw', 'bfw')} >= {X.DUPLICATE_FRONT}::double and {D.overlap('abw', 'bbw')} >= {X.DUPLICATE_BACK}::double)"""


@query("dup_05_near_cards", f"with {D.CARDS}, {_NEAR} select deck_id, kept as a, later as b from near")
def dup_05(spark, sf):
    return N.near_cards(A.cards(spark, sf))


@query(
    "dup_06_deduped",
    f"""with {D.CARDS}, {_NEAR}, slugs as (select deck_id, ord, {D.slug('front')} as slug from cards),
edges as (select * from near union select a.deck_id, a.ord, b.ord from slugs a join slugs b on a.deck_id = b.deck_id and a.slug = b.slug and a.ord < b.ord),
nodes as (select c.deck_id, c.ord, coalesce(list(e.kept) filter (e.kept is not null), []) as before from cards c left join edges e on e.deck_id = c.deck_id and e.later = c.ord group by all),
walks as (select deck_id, list_reduce(list_prepend({{'ord': -1::bigint, 'before': []::bigint[]}}, list({{'ord': ord::bigint, 'before': before::bigint[]}} order by ord)), lambda s, c: {{'ord': -1::bigint, 'before': case when list_has_any(s.before, c.before) then s.before else list_append(s.before, c.ord) end}}).before as kept from nodes group by deck_id)
select deck_id, unnest(kept) as ord from walks""",
)
def dup_06(spark, sf):
    return N.deduped(A.cards(spark, sf))


_ASKED = f"{D.ANSWERS}, tally as (select question_id, count(*) as asked, arg_max(correct, seq) as last_correct from answers group by question_id), pool as (select p_brand as deck_id, p_partkey as question_id, 'Which kind is the ' || p_name || ' in size ' || p_size % 25 || '?' as stem, p_type || ' ' || p_name || ' of size ' || p_size % 25 as answer, coalesce(asked, 0) as asked, last_correct from part left join tally on p_partkey = question_id)"
_SAME = f"""q as (select *, {D.content_words('stem')} as sw, {D.content_words('answer')} as aw, {D.numbers('stem')} as sn, {D.numbers('answer')} as an from pool),
same as (select a.deck_id, a.question_id as a, b.question_id as b from q a join q b on a.deck_id = b.deck_id and a.question_id < b.question_id where least(len(a.aw), len(b.aw)) >= {X.MIN_ANSWER_WORDS} and not {D.conflicting('a.an', 'b.an')} and not {D.conflicting('a.sn', 'b.sn')}
 and {D.overlap('a.sw', 'b.sw')} >= {X.SAME_STEM}::double and {D.overlap('a.aw', 'b.aw')} >= {X.SAME_ANSWER}::double)"""


def _pool(spark, sf):
    """Parts as questions; parts of one name and type and a like size ask the same."""
    size = (F.col("p_size") % 25).cast("string")
    stem = F.concat(F.lit("Which kind is the "), "p_name", F.lit(" in size "), size, F.lit("?"))
    pool = table(spark, sf, "part").select(F.col("p_brand").alias("deck_id"), F.col("p_partkey").alias("question_id"), stem.alias("stem"), F.concat("p_type", F.lit(" "), "p_name", F.lit(" of size "), size).alias("answer"))
    pool = pool.join(L.answer_tally(A.answers(spark, sf)), "question_id", "left").withColumn("asked", F.coalesce("asked", F.lit(0)).cast("long"))
    return pool.select("deck_id", "question_id", "stem", "answer", "asked", "last_correct")


@query("dup_08_near_questions", f"with {_ASKED}, {_SAME} select deck_id, a, b from same")
def dup_08(spark, sf):
    return N.near_questions(_pool(spark, sf))


@query(
    "sel_01_draw",
    f"""with {_ASKED}, {_SAME}, w as (select *, md5('draw:' || question_id) as rnd, not coalesce(last_correct, true) as missed, least(25, count(*) over (partition by deck_id)) as wanted from pool),
quota as (select deck_id, max(wanted) as wanted, least(count(*) filter (missed), ceil(max(wanted) * {X.MISSED_SHARE}::double))::bigint as quota from w group by deck_id),
walk as (select deck_id, question_id, 1 as phase, 0::bigint as asked, rnd from w where missed union all select deck_id, question_id, 2, asked, rnd from w),
near as (select deck_id, a, b from same union all select deck_id, b, a from same),
nodes as (select k.*, coalesce((select list(n.b) from near n where n.deck_id = k.deck_id and n.a = k.question_id), [])::bigint[] as near from walk k),
zero as (select deck_id, list({{'id': question_id::bigint, 'phase': phase::bigint, 'near': near, 'first': 0::bigint}} order by phase, asked, rnd, question_id) as l from nodes group by deck_id),
fold as (select deck_id, list_reduce(list_prepend({{'id': -1::bigint, 'phase': 0::bigint, 'near': []::bigint[], 'first': 0::bigint}}, l), lambda s, c: {{'id': s.id, 'phase': s.phase,
 'near': case when list_contains(s.near, c.id) or list_has_any(s.near, c.near) or (c.phase = 1 and len(s.near) >= quota) or len(s.near) >= wanted then s.near else list_append(s.near, c.id) end,
 'first': case when c.phase = 1 and not (list_contains(s.near, c.id) or list_has_any(s.near, c.near) or len(s.near) >= quota or len(s.near) >= wanted) then s.first + 1 else s.first end}}) as s from zero join quota using (deck_id))
select deck_id, unnest(s.near) as question_id, unnest(list_transform(range(len(s.near)), lambda i: i < s.first)) as "first", unnest(range(1, len(s.near) + 1)) as place from fold""",
)
def sel_01(spark, sf):
    return N.draw(_pool(spark, sf), 25)


_BANNED = literal(X.BANNED_OPTIONS)


def _options(correct: str, distractors: str, n: int) -> str:
    said = f"list_filter(list_transform({distractors}, lambda x: trim(x, ' ')), lambda x: x <> '')"
    keys = f"list_transform({said}, lambda x: {D.slug('x')})"
    good = f"list_filter({said}, lambda x, i: {D.slug('x')} <> '' and {D.slug('x')} <> {D.slug(correct)} and not list_contains({_BANNED}, {D.slug('x')}) and list_position({keys}, {D.slug('x')}) = i)"
    return f"case when trim({correct}, ' ') <> '' and not list_contains({_BANNED}, {D.slug(correct)}) and len({good}) >= {n} then {good}[1:{n}] end"


_OFFERED = "(select p_partkey, case when p_size = 7 then 'All of the above.' else p_name end as correct, [p_brand, ' ' || upper(p_name) || '!', p_type, 'None of the above', '', p_brand || '?', case when p_size % 2 = 0 then p_type else p_brand || ' b' end, '…', 'last'] as d from part)"


@query("dup_10_options", f"select p_partkey, array_to_string({_options('correct', 'd', 4)}, '|') as options from {_OFFERED}")
def dup_10(spark, sf):
    correct = F.when(F.col("p_size") == 7, "All of the above.").otherwise(F.col("p_name"))
    text = lambda x: F.lit(x)
    d = F.array("p_brand", F.concat(text(" "), F.upper("p_name"), text("!")), "p_type", text("None of the above"), text(""), F.concat("p_brand", text("?")), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(F.concat("p_brand", text(" b"))), text("…"), text("last"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(N.kept_options(correct, d, 4), "|").alias("options"))


# Layout

_FRAGMENTS = f"f as (select doc_id, line_no, unnest(range(1, len(w))) as place, unnest(w[:-2]) as a, unnest(w[2:]) as b from (select doc_id, line_no, string_split(line, ' ') as w from lines) where len(w) > 1)"


@query("str_02_joins", f"""with {D.LINES}, {_FRAGMENTS}, e as (select *, length(a) % 5 as gap, right(rtrim(a, ' '), 1) as e, left(ltrim(b, ' '), 1) as s from f)
select doc_id, line_no, place, case when gap >= 12 * {X.NO_SPACE_GAP}::double then false when {D.like('e', '[-–—]')} or {D.like('s', '[-–—]')} then true when {D.like('e', r'[(\[{]')} or {D.like('s', r'[)\]}]')} then true when {D.like('e', '[.,:;!?]')} or {D.like('s', '[A-Z]')} then false else length(a) <= 3 or length(b) <= 3 end as joined from e""")
def str_02(spark, sf):
    w = A.lines(spark, sf).select("doc_id", "line_no", F.split("line", " ").alias("w")).where(F.size("w") > 1)
    pairs = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.struct(i.cast("long").alias("place"), F.element_at("w", i).alias("a"), F.element_at("w", i + 1).alias("b")))
    f = w.select("doc_id", "line_no", F.inline(pairs))
    return f.select("doc_id", "line_no", "place", R.joined_without_space(F.col("a"), F.col("b"), F.length("a") % 5, F.lit(12)).alias("joined"))


_PLACED = "p as (select p_partkey // 40 as page, p_partkey as item, (p_size % 9) * 60 + p_partkey % 7 as x, (p_partkey % 20) * 15 + 0.5::double as y from part)"
_ANCHORS = f"{_PLACED}, g as (select page, x, case when x - lag(x) over w > 12 then 1 else 0 end as opened from p window w as (partition by page order by x)), c as (select page, x, sum(opened) over (partition by page order by x rows unbounded preceding) as cluster from g), a as (select page, avg(x) as anchor from c group by page, cluster), anchors as (select a.page, anchor, row_number() over (partition by a.page order by anchor) - 1 as place from a join p on a.page = p.page and abs(p.x - anchor) <= 12 group by a.page, anchor having count(distinct floor(y + 0.5)) >= 3)"


def _placed(spark, sf):
    x = (F.col("p_size") % 9) * 60 + F.col("p_partkey") % 7
    return table(spark, sf, "part").select(F.floor(F.col("p_partkey") / 40).alias("page"), F.col("p_partkey").alias("item"), x.alias("x"), ((F.col("p_partkey") % 20) * 15 + F.lit(0.5)).alias("y"))


@query("str_06_anchors", f"with {_ANCHORS} select page, anchor, place from anchors")
def str_06(spark, sf):
    return R.column_anchors(_placed(spark, sf))


@query("str_07_columns", f"with {_ANCHORS} select p.page, item, coalesce(arg_min(place, {{'d': abs(x - anchor), 'p': place}}), 0) as place from p left join anchors a on a.page = p.page group by p.page, item")
def str_07(spark, sf):
    lines = _placed(spark, sf)
    return R.column_of(lines, R.column_anchors(lines)).select("page", "item", "place")


@query("jon_06_near_anchors", f"with {_ANCHORS} select p.page, item, count(*) as anchors from p join anchors a on a.page = p.page and abs(x - anchor) <= 12 group by all")
def jon_06(spark, sf):
    lines = _placed(spark, sf)
    anchors = R.column_anchors(lines)
    bin_ = lambda c: F.floor(c / X.ANCHOR_TOLERANCE).cast("long")
    spread = anchors.withColumn("bin", F.explode(F.sequence(bin_(F.col("anchor")) - 1, bin_(F.col("anchor")) + 1)))
    met = lines.withColumn("bin", bin_(F.col("x"))).join(spread, ["page", "bin"]).where(F.abs(F.col("x") - F.col("anchor")) <= X.ANCHOR_TOLERANCE)
    return met.groupBy("page", "item").agg(F.count("*").alias("anchors"))


_SIZED = f"s as (select doc_id as page, line_no as place, line as text, case when line_no = length(line) % 3 then 18 when {D.label('line')} then 14.2::double else 9 + (length(line) % 3) * 0.25::double end as size from lines)"


@query("str_13_page_titles", f"with {D.LINES}, {_SIZED}, n as (select page, floor(size * 2 + 0.5) / 2 as body, count(*) as n, min(place) as first from s group by all), b as (select page, arg_max(body, {{'n': n, 'f': -first}}) as body from n group by page), l as (select page, max(size) as largest from s group by page), t as (select s.page, largest, arg_min(text, place) as title from s join l using (page) where size = largest and length(text) > 2 group by all) select b.page, body, case when largest > body + 2 then title end as title from b left join t using (page)")
def str_13(spark, sf):
    lines = A.lines(spark, sf)
    from quern.functions import text as T

    size = F.when(F.col("line_no") == F.length("line") % 3, 18.0).when(T.meaningful_label(F.col("line")), 14.2).otherwise(9 + (F.length("line") % 3) * 0.25)
    return R.page_titles(lines.select(F.col("doc_id").alias("page"), F.col("line_no").alias("place"), F.col("line").alias("text"), size.alias("size")))


# Blocks

BLOCKS = Fixture(
    "doc_id long, place long, kind string, level int, text string",
    [
        (-11, 0, "paragraph", None, "Home"), (-11, 1, "paragraph", None, "Guide"), (-11, 2, "heading", 1, "Tides"), (-11, 3, "paragraph", None, "Tides are slow waves."), (-11, 4, "heading", 2, "References"),
        (-11, 5, "paragraph", None, "A book."), (-11, 6, "heading", 3, "See also"), (-11, 7, "paragraph", None, "Another."), (-11, 8, "heading", 2, "More tides"), (-11, 9, "paragraph", None, "Kept again."),
        (-11, 10, "heading", 3, "Further reading"), (-11, 11, "heading", 4, "Deep"), (-11, 12, "paragraph", None, "Gone"), (-11, 13, "heading", 3, "Contents"), (-11, 14, "heading", 1, "Last"), (-11, 15, "code", None, "print(1)"),
        (-12, 0, "paragraph", None, "A lead that is much longer than any crumb could be, so all that stands before stays."), (-12, 1, "heading", 1, "Title"), (-13, 0, "heading", 1, "Comments"), (-13, 1, "paragraph", None, "x"), (-14, 0, "paragraph", None, "no heading"),
        (-15, 0, "image", None, "pic"), (-15, 1, "heading", 2, "More in memory"), (-15, 2, "heading", 2, "Kept"),
    ],
)
_BLOCKS = f"blocks as (select doc_id, line_no as place, case when line_no > 0 and {D.label('line')} then 'heading' when line_no % 5 = 3 then 'code' else 'paragraph' end as kind, case when line_no > 0 and {D.label('line')} then 1 + length(line) % 4 end as level, line as text from lines union all select * from {BLOCKS.sql})"


def _blocks(spark, sf):
    from quern.functions import text as T

    heading = (F.col("line_no") > 0) & T.meaningful_label(F.col("line"))
    kind = F.when(heading, "heading").when(F.col("line_no") % 5 == 3, "code").otherwise("paragraph")
    lines = A.lines(spark, sf).select("doc_id", F.col("line_no").alias("place"), kind.alias("kind"), F.when(heading, 1 + F.length("line") % 4).alias("level"), F.col("line").alias("text"))
    return lines.union(BLOCKS.frame(spark))


@query("str_30_appendices", f"with {D.LINES}, {_BLOCKS}, open as (select b.doc_id, b.place from blocks b join blocks a on a.doc_id = b.doc_id and a.place <= b.place and a.kind = 'heading' and {D.like('a.text', X.APPENDIX)} where not exists (select 1 from blocks h where h.doc_id = a.doc_id and h.kind = 'heading' and h.level <= a.level and h.place > a.place and h.place <= b.place)) select doc_id, place, kind from blocks anti join open using (doc_id, place)")
def str_30(spark, sf):
    return R.without_appendices(_blocks(spark, sf)).select("doc_id", "place", "kind")


@query("str_32_crumbs", f"with {D.LINES}, {_BLOCKS}, f as (select doc_id, min(place) filter (kind = 'heading') as first from blocks group by doc_id), t as (select doc_id, coalesce(bool_and(kind = 'paragraph' and length(text) <= {X.NAVIGATION_CHARS}) filter (place < first), true) as trail from blocks join f using (doc_id) group by doc_id) select doc_id, place, kind from blocks join f using (doc_id) join t using (doc_id) where first is null or not trail or place >= first")
def str_32(spark, sf):
    return R.without_crumbs(_blocks(spark, sf)).select("doc_id", "place", "kind")


_TEXTS = Fixture("doc_id long, line_no long, line string", [(-21, i, t) for i, t in enumerate((
    "Edit this page", "ok", "Read more", "**Osmosis** — water moves freely", "__Diffusion__: spreads out", "*Term:* - text", "_a b_ – c", "**No pair**", "plain — text", "![alt](x.png) and [label](http://a.b/c)", "see [^1] and [a][b] <https://ex.org> <b>bold</b>",
    "``code`` `x` ***all*** **bold** *it*", "(__strong__) snake_case_name _em_ ~~gone~~", "escaped \\* star \\_ and \\`", "___both___ x", "Was this helpful?",
))])
_SOME = f"several as (select doc_id, line_no, line from lines union all select * from {_TEXTS.sql})"


def _some(spark, sf):
    return A.lines(spark, sf).select("doc_id", "line_no", "line").union(_TEXTS.frame(spark))


@query("str_23_chrome", f"with {D.LINES}, {_SOME} select doc_id, line_no, length(trim(line, ' ')) < 3 or {D.like(D.trim('line'), X.CHROME_TEXT)} as chrome from several")
def str_23(spark, sf):
    return _some(spark, sf).select("doc_id", "line_no", U.chrome(F.col("line")).alias("chrome"))


def _pairs_sql() -> str:
    # RE2 has no back-references: each mark has a pattern of its own.
    cases = []
    for mark in (r"\*\*", "__", r"\*", "_"):
        p = rf"^{mark}(.{{2,60}}?){mark}\s*[—–:-]\s+(.+)$"
        term, rest = D.trim(D.sub(D.trim(D.part("t", p, 1)), "[:—–-]+$", "")), D.trim(D.part("t", p, 2))
        cases.append(f"when {D.like('t', p)} then case when {term} <> '' and {rest} <> '' then {term} || ': ' || {rest} else line end")
    return f"with {D.LINES}, {_SOME}, t as (select *, {D.trim('line')} as t from several) select doc_id, line_no, case {' '.join(cases)} else line end as line from t"


@query("str_36_term_pairs", _pairs_sql())
def str_36(spark, sf):
    return _some(spark, sf).select("doc_id", "line_no", U.term_pair(F.col("line")).alias("line"))


def _marks_sql() -> str:
    # RE2 has no look-ahead: the sign behind is matched and put back.
    x = "line"
    for pattern, by in X.INLINE_MARKS:
        if "(?!" in pattern:
            pattern, by = pattern.replace("(?![A-Za-z0-9_])", "([^A-Za-z0-9_]|$)"), by + r"\3"
        x = D.sub(x, pattern, by)
    return f"with {D.LINES}, {_SOME} select doc_id, line_no, {D.trim(D.sub(x, r'\s+', ' '))} as line from several"


@query("str_34_without_marks", _marks_sql())
def str_34(spark, sf):
    return _some(spark, sf).select("doc_id", "line_no", U.without_marks(F.col("line")).alias("line"))


FILES = Fixture("file_id long, name string, content_type string", [(i, n, t) for i, (n, t) in enumerate((
    ("unit-7_summary.md", "text/plain"), ("Deck.PPTX", ""), ("paper.pdf", "application/pdf"), ("page.HTML", "text/html"), ("a__b--c.Markdown", "text/markdown; charset=utf-8"), ("none", "text/plain"), ("x.docx", None), ("raw.mkd?x=1", "TEXT/PLAIN"), ("raw.mdown#a", "text/plain"), ("notes.md.txt", "text/plain"),
))])


@query("src_09_readers", f"with n as (select c_custkey as file_id, c_name || ['.pdf', '.md', '.txt', '.htm'][c_custkey % 4 + 1] as name from customer union all select -1 - file_id, name from {FILES.sql}), e as (select *, lower(regexp_extract(name, '\\.([A-Za-z0-9]+)$', 1)) as e from n) select file_id, case when e = 'pdf' then 'pdf' when e = 'pptx' then 'pptx' when e in ('md', 'markdown', 'mdown', 'mkd') then 'markdown' when e in ('html', 'htm') then 'html' end as reader from e")
def src_09(spark, sf):
    names = table(spark, sf, "customer").select(F.col("c_custkey").alias("file_id"), F.concat("c_name", F.element_at(F.array(*map(F.lit, (".pdf", ".md", ".txt", ".htm"))), (F.col("c_custkey") % 4 + 1).cast("int"))).alias("name"))
    names = names.union(FILES.frame(spark).select(-1 - F.col("file_id"), "name"))
    return names.select("file_id", U.reader_of(F.col("name")).alias("reader"))


_MIME = ("text/markdown", "text/plain; charset=utf-8", "TEXT/PLAIN", "text/html", None)
_ENDINGS = (".md", ".markdown#top", "/readme.mkd?raw=1", ".mdown", ".txt", "/notes.md/raw")
_SERVED = f"served as (select page_id as file_id, regexp_replace(url, '[?#].*$', '') || [{', '.join(map(literal, _ENDINGS))}][page_id % {len(_ENDINGS)} + 1] as name, [{', '.join(map(literal, _MIME))}][page_id % {len(_MIME)} + 1] as content_type from pages union all select -1 - file_id, name, content_type from {FILES.sql})"


@query("src_10_markdown", f"with {_SERVED} select file_id, coalesce(regexp_matches(content_type, '(?i)text/markdown') or (regexp_matches(content_type, '(?i)text/plain') and regexp_matches(name, '(?i)\\.(md|markdown|mdown|mkd)(\\?|#|$)')), false) as markdown from served")
def src_10(spark, sf):
    """Addresses of pages with endings and content types in turn, and the fixture's."""
    pick = lambda values: F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), (F.col("page_id") % len(values) + 1).cast("int"))
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("file_id"), F.concat(F.regexp_replace("url", "[?#].*$", ""), pick(_ENDINGS)).alias("name"), pick(_MIME).alias("content_type"))
    rows = pages.union(FILES.frame(spark).select(-1 - F.col("file_id"), "name", "content_type"))
    return rows.select("file_id", F.coalesce(U.serves_markdown(F.col("name"), F.col("content_type")), F.lit(False)).alias("markdown"))


@query("str_37_file_titles", f"select file_id, trim(regexp_replace(regexp_replace(regexp_replace(name, '(?i)\\.(md|markdown|mdown|mkd)$', ''), '[_-]+', ' ', 'g'), '\\s+', ' ', 'g'), ' ') as title from (select c_custkey as file_id, replace(c_name, '#', '_-') || '.md' as name from customer union all select -1 - file_id, name from {FILES.sql})")
def str_37(spark, sf):
    names = table(spark, sf, "customer").select(F.col("c_custkey").alias("file_id"), F.concat(F.replace("c_name", F.lit("#"), F.lit("_-")), F.lit(".md")).alias("name"))
    return names.union(FILES.frame(spark).select(-1 - F.col("file_id"), "name")).select("file_id", U.file_title(F.col("name")).alias("title"))


PASTED = Fixture("paste_id long, text string, expected array<string>", [
    (1, "docs.example.net/start  https://ex.org/a,https://ex.org/b;www.ex.net/c", ["https://docs.example.net/start", "https://ex.org/a", "https://ex.org/b", "https://www.ex.net/c"]),
    (2, "[One](https://ex.org/s)[Two](https://ex.org/r) and <https://ex.org/q?f=a,b>", ["https://ex.org/s", "https://ex.org/r", "https://ex.org/q?f=a,b"]),
    (3, "EX.org/Path https://ex.org/path/ http://ex.org/path#x ex.org:8080/y and word.", ["https://EX.org/Path", "https://ex.org:8080/y"]),
    (4, "nothing here", []), (5, "", []),
])


@query("scl_30_url_lists", f"select paste_id, array_to_string(expected, ' ') as urls from {PASTED.sql} union all select page_id, url from pages")
def scl_30(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", F.concat(F.lit("see "), "url", F.lit(", "), "url", F.lit(".")).alias("text"))
    rows = PASTED.frame(spark).select("paste_id", "text").union(pages)
    return rows.select("paste_id", F.array_join(U.url_list(F.col("text")), " ").alias("urls"))


_NAMED = "(case when h = '' then url else regexp_replace(h || regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/$', '') end)"


@query("scl_31_deck_names", f"with p as (select page_id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) as h from pages), n as (select page_id, page_id % 40 as list_id, {_NAMED} as name from p), f as (select list_id, list(name order by page_id) as l from n group by list_id) select page_id, name, case when length(name) > 34 then rtrim(left(name, 33), ' ') || '…' else name end as short, 'Read ' || list_id || ' of ' || (list_id + len(l)) || ' pages. Skipped: ' || array_to_string(list_transform(l[:3], lambda x: x || ' — late'), '; ') || case when len(l) > 3 then '; and ' || (len(l) - 3) || ' more' else '' end as failures from n join f using (list_id)")
def scl_31(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", (F.col("page_id") % 40).alias("list_id"), "url")
    failed = F.transform(F.array_sort(F.collect_list(F.struct("page_id", "url"))), lambda x: F.struct(x["url"].alias("url"), F.lit("late").alias("error")))
    lists = pages.groupBy("list_id").agg(failed.alias("failed"))
    name = U.deck_name(F.col("url"))
    return pages.join(lists, "list_id").select("page_id", name.alias("name"), U.shortened(name).alias("short"), U.failures(F.col("failed"), F.col("list_id")).alias("failures"))


# Batches

_SECTIONS = "sections as (select o_custkey as doc_id, o_orderkey as place, case when o_orderkey % 9 < 6 then 'a' when o_orderkey % 9 > 7 then 'b' end as source, o_orderkey % 17 as cards from orders)"


@query(
    "bat_01_section_batches",
    f"""with {_SECTIONS}, l as (select doc_id, list({{'source': source, 'n': 0::bigint, 'cards': cards, 'batch': -1::bigint, 'out': [place::bigint]}} order by place) as l from sections group by doc_id),
f as (select doc_id, list_reduce(list_prepend({{'source': null::varchar, 'n': 0::bigint, 'cards': 0::bigint, 'batch': -1::bigint, 'out': []::bigint[]}}, l), lambda s, x: case when s.batch >= 0 and s.source is not distinct from x.source and s.n < {X.BATCH_SECTIONS} and s.cards + x.cards <= {X.BATCH_CARDS}
 then {{'source': x.source, 'n': s.n + 1, 'cards': s.cards + x.cards, 'batch': s.batch, 'out': list_append(s.out, s.batch)}} else {{'source': x.source, 'n': 1::bigint, 'cards': x.cards, 'batch': s.batch + 1, 'out': list_append(s.out, s.batch + 1)}} end).out as b from l)
select doc_id, place, b[row_number() over (partition by doc_id order by place)] as batch from sections join f using (doc_id)""",
)
def bat_01(spark, sf):
    source = F.when(F.col("o_orderkey") % 9 < 6, "a").when(F.col("o_orderkey") % 9 > 7, "b")
    return R.section_batches(table(spark, sf, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("place"), source.alias("source"), (F.col("o_orderkey") % 17).alias("cards")))


@query("bat_03_page_chunks", f"with p as (select page_id, page_id % 9 as doc_id from pages) select doc_id, page_id, (row_number() over (partition by doc_id order by page_id) - 1) // {X.BATCH_PAGES} as batch from p")
def bat_03(spark, sf):
    pages = table(spark, sf, "pages").select((F.col("page_id") % 9).alias("doc_id"), "page_id")
    return L.batches(pages, X.BATCH_PAGES, "doc_id", "page_id").select("doc_id", "page_id", "batch")


_KINDS = "case l_linenumber % 4 when 0 then 'heading' when 1 then 'list' when 2 then 'table' else 'paragraph' end"


@query("crd_17_card_estimate", f"select l_orderkey as section_id, sum(case {_KINDS} when 'heading' then 0 when 'list' then l_quantity::bigint when 'table' then l_quantity::bigint * greatest(1, l_suppkey % 4 - 1) else 1 end)::bigint as cards from lineitem group by l_orderkey")
def crd_17(spark, sf):
    kind = F.element_at(F.array(*map(F.lit, ("heading", "list", "table", "paragraph"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    n = F.col("l_quantity").cast("long")
    return R.card_estimate(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("section_id"), kind.alias("kind"), n.alias("n_items"), n.alias("n_rows"), (F.col("l_suppkey") % 4).alias("n_headers")))


# Replies

REPLIES = Fixture("reply_id long, text string", [
    (-1, '```json\n[{"front": " What {is} it? ", "back": "A \\"thing\\"", "context": 5, "frontCode": " c1 ", "image": " "}, {"front": "only"}, {"front": 7, "back": "x"}]\n```'),
    (-2, 'Here you are: [{"front": "a", "back": "b", "source": " Page 1 "}, {"front": "cut", "back": "of'),
    (-3, "no json at all"), (-4, '[{"front": "x", "back": "y"}, {bad}, {"front": "", "back": "z"}]'), (-5, ""),
])
#: RE2 needs no possessive quantifiers.
_OBJECT = J.OBJECT.replace("++", "+").replace("*+", "*")
_OBJECTS = f"objects as (select reply_id, unnest(range(len(l))) as place, unnest(l) as o from (select reply_id, list_filter(regexp_extract_all(text, {D.q(_OBJECT)}), lambda o: json_valid(o)) as l from replies))"


def _string(name: str, o: str = "o") -> str:
    return f"(case when json_type({o}, '$.{name}') = 'VARCHAR' then trim(json_extract_string({o}, '$.{name}'), ' ') else '' end)"


def _strings(name: str) -> str:
    return f"(case when json_type(o, '$.{name}') = 'ARRAY' then list_transform(list_filter(json_extract(o, '$.{name}[*]'), lambda x: json_type(x) = 'VARCHAR'), lambda x: json_extract_string(x, '$')) end)"


_CARD_REPLIES = f"{D.CARDS}, replies as (select deck_id as reply_id, 'Cards: ' || to_json(list({{'front': front, 'back': back, 'source': deck_id::varchar}} order by ord))::varchar as text from cards group by deck_id having deck_id > 0 union all select * from {REPLIES.sql})"


def _card_replies(spark, sf):
    made = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("ord", "front", "back"))), lambda c: F.struct(c["front"].alias("front"), c["back"].alias("back"), F.col("deck_id").cast("string").alias("source"))))
    replies = A.cards(spark, sf).where("deck_id > 0").groupBy("deck_id").agg(F.concat(F.lit("Cards: "), made).alias("text"))
    return replies.select(F.col("deck_id").alias("reply_id"), "text").union(REPLIES.frame(spark))


@query("jsn_03_objects", f"with {_CARD_REPLIES}, {_OBJECTS} select reply_id, count(*) as n from objects group by reply_id")
def jsn_03(spark, sf):
    return _card_replies(spark, sf).select("reply_id", F.explode(J.objects(F.col("text")))).groupBy("reply_id").agg(F.count("*").alias("n"))


@query("jsn_04_cards", f"with {_CARD_REPLIES}, {_OBJECTS} select reply_id, place, {_string('front')} as front, {_string('back')} as back, case when json_type(o, '$.context') = 'VARCHAR' then {_string('context')} end as context, case when json_type(o, '$.source') = 'VARCHAR' then {_string('source')} end as source, nullif({_string('frontCode')}, '') as front_code, nullif({_string('backCode')}, '') as back_code, nullif({_string('image')}, '') as image from objects where json_type(o, '$.front') = 'VARCHAR' and json_type(o, '$.back') = 'VARCHAR'")
def jsn_04(spark, sf):
    return J.cards(_card_replies(spark, sf))


ASKED = Fixture("reply_id long, text string", [
    (-1, '[{"id": "q1", "stem": "S?", "correct": "Right", "explanation": "E", "distractors": ["a", "A!", "right", "All of the above", 5, "", "b", "c", "d"]}, {"id": "q1", "stem": "again", "correct": "x", "explanation": "E", "distractors": ["a", "b", "c"]}]'),
    (-2, '[{"id": "q2", "stem": "S?", "correct": "None of the above", "explanation": "E", "distractors": ["a", "b", "c"]}, {"id": "q3", "stem": "S", "correct": "R", "explanation": "E", "distractors": ["a", "b"]}, {"id": " q4 ", "stem": "S", "correct": "R", "explanation": "E", "vignette": " A man. ", "distractors": ["a", "b", "c"]}'),
    (-3, '[{"id": "q5", "skip": "nothing to apply"}, {"id": "q6", "skip": "x", "stem": "S", "correct": "R", "explanation": "E", "scenario": "Once.", "distractors": ["a", "b", "c"]}, {"id": "q7", "stem": "S", "correct": "R", "explanation": "E", "distractors": ["a", "b", "c"]}, {"id": "q8", "stem": "S", "correct": "R", "explanation": "E", "code": {"language": "c", "text": "int x;  "}, "distractors": ["a", "b", "c"]}]'),
    (-4, '[{"id": "q9", "stem": "S", "correct": "R", "explanation": "E", "code": {"text": " "}, "scenario": "x", "distractors": ["a", "b", "c"]}, {"id": "q9", "stem": "S", "correct": "R", "explanation": "E", "code": null, "scenario": "x", "distractors": ["a", "b", "c"]}, {"id": "qa", "stem": "S", "correct": "R", "explanation": "E", "code": "int", "scenario": "x", "distractors": ["a", "b", "c"]}, {"stem": "no id"}]'),
])
_PART_REPLIES = f"""replies as (select p_partkey as reply_id, '[' || to_json({{'id': 'q' || p_size, 'stem': p_name, 'correct': p_type, 'explanation': p_brand, 'scenario': case when p_size % 3 = 0 then p_name else '' end, 'vignette': '', 'distractors': [p_brand, p_name, p_brand || '!', case when p_size % 5 = 0 then 'none of the above' else p_name || ' x' end, 'y']}})::varchar as text from part union all select * from {ASKED.sql})"""


def _part_replies(spark, sf):
    d = F.array("p_brand", "p_name", F.concat("p_brand", F.lit("!")), F.when(F.col("p_size") % 5 == 0, "none of the above").otherwise(F.concat("p_name", F.lit(" x"))), F.lit("y"))
    o = F.struct(F.concat(F.lit("q"), F.col("p_size").cast("string")).alias("id"), F.col("p_name").alias("stem"), F.col("p_type").alias("correct"), F.col("p_brand").alias("explanation"), F.when(F.col("p_size") % 3 == 0, F.col("p_name")).otherwise("").alias("scenario"), F.lit("").alias("vignette"), d.alias("distractors"))
    return spread(table(spark, sf, "part"), "p_partkey").select(F.col("p_partkey").alias("reply_id"), F.concat(F.lit("["), F.to_json(o)).alias("text")).union(ASKED.frame(spark))


_FIELDS = f"{_string('id')} as id, {_string('stem')} as stem, {_string('correct')} as correct, {_string('explanation')} as explanation, {_strings('distractors')} as given"
_USABLE = "id <> '' and stem <> '' and correct <> '' and explanation <> '' and distractors is not null"


@query("jsn_05_questions", f"with {_PART_REPLIES}, {_OBJECTS}, f as (select reply_id, place, {_FIELDS}, nullif({_string('vignette')}, '') as vignette from objects), q as (select *, {_options('correct', 'given', 3)} as distractors from f), k as (select *, row_number() over (partition by reply_id, id order by place) as turn from q where {_USABLE}) select reply_id, place, id, stem, correct, explanation, array_to_string(distractors, '|') as distractors, vignette from k where turn = 1")
def jsn_05(spark, sf):
    return J.questions(_part_replies(spark, sf)).withColumn("distractors", F.array_join("distractors", "|"))


_CODE = "case when json_type(o, '$.code.text') = 'VARCHAR' then regexp_replace(json_extract_string(o, '$.code.text'), '\\s+$', '') else '' end"


@query("jsn_06_application", f"""with {_PART_REPLIES}, {_OBJECTS}, f as (select reply_id, place, {_FIELDS}, nullif({_string('scenario')}, '') as vignette, {_string('skip')} as reason, coalesce(json_type(o, '$.code'), 'NULL') <> 'NULL' as has, {_CODE} as code from objects), q as (select *, {_options('correct', 'given', 3)} as distractors, trim(code, ' ') <> '' and length(code) <= {X.APPLICATION_CHARS} and len(string_split(code, chr(10))) <= {X.APPLICATION_LINES} as good, reason <> '' and stem = '' as skips from f),
k as (select *, row_number() over (partition by reply_id, id order by place) as turn from q where id <> '' and (skips or ({_USABLE} and (not has or good) and (has or vignette is not null))))
select reply_id, place, id, case when skips then reason end as skip, case when not skips then stem end as stem, case when not skips then array_to_string(distractors, '|') end as distractors, case when not skips then vignette end as vignette, case when not skips and has then code end as code from k where turn = 1""")
def jsn_06(spark, sf):
    return J.application_questions(_part_replies(spark, sf)).select("reply_id", "place", "id", "skip", "stem", F.array_join("distractors", "|").alias("distractors"), "vignette", "code")


AUDITS = Fixture("reply_id long, text string", [(-1, '[{"id": "q1", "ok": true, "failed": ["NEW"]}, {"id": "q2", "ok": false, "failed": ["NEW", " APPLIED ", 4, ""]}, {"id": "q3", "ok": "true"}, {"id": "q2", "ok": true, "failed": "x"}, {"ok": true}]'), (-2, "cut [{")])
_AUDITS = f"replies as (select o_custkey as reply_id, to_json(list({{'id': 'q' || o_orderkey, 'ok': o_orderstatus = 'F', 'failed': [o_orderstatus, o_orderpriority]}} order by o_orderkey))::varchar as text from orders where o_orderkey % 5 <> 3 group by o_custkey union all select * from {AUDITS.sql}), {_OBJECTS}, v as (select reply_id, place, {_string('id')} as id, coalesce(json_extract(o, '$.ok')::varchar = 'true', false) as ok, list_filter(list_transform(coalesce({_strings('failed')}, []), lambda x: trim(x, ' ')), lambda x: x <> '') as failed from objects), last as (select reply_id, id, arg_max({{'ok': ok, 'failed': failed}}, place) as v from v where id <> '' group by all)"


def _audits(spark, sf):
    o = F.struct(F.concat(F.lit("q"), F.col("o_orderkey").cast("string")).alias("id"), (F.col("o_orderstatus") == "F").alias("ok"), F.array("o_orderstatus", "o_orderpriority").alias("failed"))
    made = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", o.alias("o")))), lambda x: x["o"]))
    return table(spark, sf, "orders").where("o_orderkey % 5 <> 3").groupBy(F.col("o_custkey").alias("reply_id")).agg(made.alias("text")).union(AUDITS.frame(spark))


@query("jsn_07_verdicts", f"with {_AUDITS} select reply_id, id, v.ok as ok, array_to_string(v.failed, '|') as failed from last")
def jsn_07(spark, sf):
    return J.verdicts(_audits(spark, sf)).withColumn("failed", F.array_join("failed", "|"))


@query("jsn_07_audited", f"with {_AUDITS}, asked as (select o_custkey as reply_id, 'q' || o_orderkey as id from orders) select a.reply_id, a.id, coalesce(v.ok, false) as ok from asked a left join last using (reply_id, id)")
def jsn_07_audited(spark, sf):
    asked = table(spark, sf, "orders").select(F.col("o_custkey").alias("reply_id"), F.concat(F.lit("q"), F.col("o_orderkey").cast("string")).alias("id"))
    return J.audited(asked, _audits(spark, sf))


SCANS = Fixture("reply_id long, text string", [
    (-1, '[{"page": "Page 2", "title": " Memory ", "blocks": [{"type": "paragraph", "text": " Kept. "}, {"type": "list", "items": ["a", " ", "b"]}, {"type": "heading", "text": "Sub"}, {"type": "table", "text": "x"}, {"type": "paragraph", "text": ""}]}, {"page": "Page 9", "blocks": []}, {"page": 3}]'),
    (-2, '[{"page": "Page 1", "blocks": [{"type": "paragraph", "text": "one"}]}, {"page": "Page 1", "title": "T"}'),
])


@query("str_38_scanned_pages", f"""with replies as (select * from {SCANS.sql} union all select p_partkey, to_json([{{'page': 'Page ' || (p_size % 5 + 1), 'title': p_name, 'blocks': [{{'type': 'paragraph', 'text': p_type || ' ' || p_brand, 'items': []}}, {{'type': 'list', 'text': '', 'items': [p_brand, ' ', p_name]}}, {{'type': case when p_size % 2 = 0 then 'heading' else 'image' end, 'text': p_name, 'items': []}}]}}, {{'page': 'Page 2', 'title': ' ', 'blocks': [{{'type': 'paragraph', 'text': p_type, 'items': []}}]}}])::varchar from part), pages_ as (select r.reply_id, 'Page ' || n as label, n as page from replies r, range(1, 5) t(n)), entries as (select reply_id, unnest(range(len(l))) as entry, unnest(l) as o from (select reply_id, [json_extract(text || case when reply_id = -2 then ']' else '' end, '$[' || i || ']') for i in range(3)] as l from replies)),
e as (select e.reply_id, page, entry, o, nullif({_string('title')}, '') as title from entries e join pages_ p on p.reply_id = e.reply_id and p.label = json_extract_string(o, '$.page')),
b as (select reply_id, page, entry, title, unnest(range(1, 6)) as place, unnest([json_extract(o, '$.blocks[' || i || ']') for i in range(5)]) as b from e),
t as (select reply_id, page, entry, title, place, {_string('type', 'b')} as kind, case when {_string('type', 'b')} = 'list' then array_to_string(list_filter(json_extract_string(b, '$.items[*]'), lambda x: trim(x, ' ') <> ''), chr(10)) else {_string('text', 'b')} end as text from b where b is not null)
select reply_id, page, entry, place, kind, case when kind = 'heading' then 2 end as level, text, case when kind <> 'heading' then title end as context from t where kind in ('heading', 'paragraph', 'list') and text <> '' union all select reply_id, page, entry, 0, 'heading', 1, title, null from e where title is not null""")
def str_38(spark, sf):
    block = lambda kind, text, items=None: F.struct(kind.alias("type"), text.alias("text"), (items if items is not None else F.array().cast("array<string>")).alias("items"))
    name, lit = F.col("p_name"), F.lit
    first = F.struct(
        F.concat(lit("Page "), (F.col("p_size") % 5 + 1).cast("string")).alias("page"), name.alias("title"),
        F.array(block(lit("paragraph"), F.concat("p_type", lit(" "), "p_brand")), block(lit("list"), lit(""), F.array(F.col("p_brand"), lit(" "), name)), block(F.when(F.col("p_size") % 2 == 0, "heading").otherwise("image"), name)).alias("blocks"),
    )
    second = F.struct(lit("Page 2").alias("page"), lit(" ").alias("title"), F.array(block(lit("paragraph"), F.col("p_type"))).alias("blocks"))
    scans = SCANS.frame(spark).union(spread(table(spark, sf, "part"), "p_partkey").select("p_partkey", F.to_json(F.array(first, second))))
    labels = F.array(*(F.struct(F.lit(f"Page {i}").alias("label"), F.lit(i).cast("long").alias("page")) for i in range(1, 5)))
    return J.pages_read(scans, scans.select("reply_id", F.inline(labels)))


@query("jsn_01_fence", f"select reply_id, md5(trim(regexp_replace(regexp_replace(text, '^\\s*```\\w*', ''), '```\\s*$', ''), ' ')) as text from (select reply_id, replace(text, chr(10), ' ') as text from {REPLIES.sql} union all select p_partkey, case when p_size % 2 = 0 then '```json ' || p_name || ' ```  ' else p_name end from part)")
def jsn_01(spark, sf):
    fenced = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("```json "), "p_name", F.lit(" ```  "))).otherwise(F.col("p_name"))
    rows = REPLIES.frame(spark).select("reply_id", F.replace("text", F.lit("\n"), F.lit(" ")).alias("text")).union(table(spark, sf, "part").select("p_partkey", fenced))
    return rows.select("reply_id", F.md5(J.fence_stripped(F.col("text"))).alias("text"))


_LONG = "A sentence with many words that goes on and on so that it must be cut somewhere before it ends, between two of its words and not inside one of them"
EXTRACTIONS = Fixture("reply_id long, deck string, text string", [
    (-1, "Deck", '```json\n{"title": " ' + _LONG + '", "lede": "Short.", "coreConcept": {"b": "two", "a": "one", "c": 3, "d": " ", "e": "five", "f": "six", "g": "seven"}, "items": [{"label": "L", "detail": "' + _LONG + " " + _LONG + '", "meta": 5}, {"label": "", "detail": "x"}, {"detail": "y"}, {"label": "M", "detail": "d", "meta": "' + _LONG + '"}], "comparisons": [{"name": "n", "value": "v"}, {"name": "n"}, 7], "keyTakeaway": null}\n``` done'),
    (-2, "Other", 'So: {"items": [{"label": "' + "x" * 120 + '", "detail": "d"}]}'), (-3, "None", '{"title": "T", "items": []}'), (-4, "Cut", '{"items": [{"label": "a", "detail": "b"}'), (-5, "No", "nothing"),
    (-6, "Many", '{"items": [' + ", ".join(f'{{"label": "l{i}", "detail": "d{i}"}}' for i in range(12)) + '], "comparisons": [' + ", ".join(f'{{"name": "n{i}", "value": "v{i}"}}' for i in range(9)) + "]}"),
])


def _clamp(x: str, most: int) -> str:
    t, c = f"trim({x}, ' ')", f"left(trim({x}, ' '), {most})"
    last = f"(case when contains({c}, ' ') then length({c}) - strpos(reverse({c}), ' ') else -1 end)"
    return f"(case when {t} = '' then null when length({t}) <= {most} then {t} else rtrim(case when {last} > {most * 0.6} then left({c}, {last}::bigint) else {c} end, ' ') || '…' end)"


def _text_of(o: str, name: str, key: str | None = None) -> str:
    return f"(case when json_type({o}, '$.{name}') = 'VARCHAR' then {_clamp(f'json_extract_string({o}, {D.q(chr(36) + chr(46) + name)})', X.INFOGRAPHIC_CHARS[key or name])} end)"


def _parts(name: str, fields: tuple[str, ...], most: int) -> str:
    made = ", ".join(f"'{f}': {_text_of('v', f)}" for f in fields)
    kept = f"list_filter(list_transform(json_extract(o, '$.{name}[*]'), lambda v: {{{made}}}), lambda x: x.{fields[0]} is not null and x.{fields[1]} is not null)[1:{most}]"
    return f"array_to_string(list_transform({kept}, lambda x: {' || chr(124) || '.join(f'coalesce(x.{f}, {D.q(chr(45))})' for f in fields)}), ';')"


@query("jsn_08_extraction", f"""with r as (select reply_id, deck, regexp_extract(text, '(?s)\\{{.*\\}}') as o from {EXTRACTIONS.sql} union all select p_partkey, p_name, to_json({{'title': repeat(p_type || ' ', p_size), 'items': [{{'label': p_brand, 'detail': repeat(p_name || ' ', p_size)}}]}})::varchar from part), j as (select * from r where json_valid(o)),
f as (select reply_id, coalesce({_text_of('o', 'title')}, deck) as title, coalesce({_text_of('o', 'lede')}, '') as lede, {_parts('items', ('label', 'detail', 'meta'), 9)} as items, {_parts('comparisons', ('name', 'value'), 6)} as comparisons, coalesce({_text_of('o', 'keyTakeaway')}, '') as key_takeaway,
 array_to_string(list_sort(list_filter(list_transform(coalesce(json_keys(o, '$.coreConcept'), []), lambda k: case when json_type(o, '$.coreConcept.' || k) = 'VARCHAR' and trim(json_extract_string(o, '$.coreConcept.' || k), ' ') <> '' then k || '|' || trim(json_extract_string(o, '$.coreConcept.' || k), ' ') end), lambda x: x is not null))[1:4], ';') as core_concept from j)
select reply_id, title, lede, items, coalesce(comparisons, '') as comparisons, key_takeaway, core_concept from f where items <> ''""")
def jsn_08_extraction(spark, sf):
    made = F.to_json(F.struct(F.repeat(F.concat("p_type", F.lit(" ")), F.col("p_size")).alias("title"), F.array(F.struct(F.col("p_brand").alias("label"), F.repeat(F.concat("p_name", F.lit(" ")), F.col("p_size")).alias("detail"))).alias("items")))
    replies = EXTRACTIONS.frame(spark).select("reply_id", "deck", "text").union(spread(table(spark, sf, "part"), "p_partkey").select("p_partkey", "p_name", made))
    joined = lambda c, fields: F.coalesce(F.array_join(F.transform(c, lambda x: F.concat_ws("|", *(F.coalesce(x[f], F.lit("-")) for f in fields))), ";"), F.lit(""))
    got = J.extraction(replies)
    return got.select("reply_id", "title", "lede", joined("items", ("label", "detail", "meta")).alias("items"), joined("comparisons", ("name", "value")).alias("comparisons"), "key_takeaway", joined("core_concept", ("key", "value")).alias("core_concept"))
