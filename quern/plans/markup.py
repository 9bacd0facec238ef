"""Queries over web pages and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import fixed as X
from quern.functions import markup as M
from quern.operators import markup as K
from quern.plans import duck as D
from quern.plans.queries import query
from quern.runtime import table
from quern.sources.fixtures import Fixture

_LONG = "A paragraph of the article that is long enough to make its element count as content. " * 5
PAGES = Fixture(
    "page_id long, url string, html string",
    [
        (-1, "https://ex.org/lists", f"<body><main><h1>Stores<sup>2</sup></h1><p>{_LONG}</p><ul><li>One<ul><li>Inner <b>bold</b> item<li>Second inner</ul> tail</li><li>Two  words .<li>ok<li><p>Para</p><p>Next</p></ul><ol><li><a href='#a'>First link</a></li><li><a href='#b'>Second link</a></li></ol></main><aside><p>Not this</p></aside></body>"),
        (-2, "https://ex.org/tables", f"<div class='post content'><article><header><h2>Title in header ¶</h2></header><p>{_LONG}</p><table><thead><tr><th>Age<th>Words</thead><tbody><tr><td>1<td>ten<td>extra<tr><td>2</tbody></table><table><tr><th>a</th><th></th></tr><tr><td>layout cell</td><td>and other</td></tr></table><table><tr><td>only one</td></tr></table><table><tr><th>k</th><th>v</th></tr><tr><td>x<table><tr><td>in</td><td>ner</td></tr></table></td><td>y</td></tr></table></article></div><header><p>Site</p></header>"),
        (-3, "https://ex.org/mixed", "<p>First para<div>Loose words in a wrapper that are long enough to stay as they are.<p>Second<i>Word</i> and <b>b</b>old ( a ) .<blockquote><p>Quoted one</p><p>Quoted two</p></blockquote><blockquote>One line quote</blockquote></div><hr><h3>Note</h3><h4>Menu</h4><pre>\n  x = 1\n    y = 2\n</pre><dl><dt>Span</dt><dd>items held</dd><dd>again</dd><dt>Empty<dd></dl><details><summary>More of it</summary><p>Hidden text</p></details><figure><img src='a.png'><figcaption>A picture</figcaption></figure><figure><p>No picture</p></figure>"),
        (-4, "https://ex.org/noise", "<div hidden>Gone</div><div aria-hidden=\"true\">Gone</div><div role=search>Gone</div><div class=\"x toc y\">Gone<div>Gone too</div></div><div class=tocs>Stays here</div><section role=\"main\"><footer>Stays out</footer><p>Short text</p></section><form><p>Gone</p></form><!-- <p>never</p> --><script>if (a < b) '</p>'</script><textarea><p>x</textarea><p title=\"a > b\">Kept &lt;as&gt; it&nbsp;is &amp;amp; more</p></div></p>stray < sign"),
        (-5, "https://ex.org/open", "<div><div><p>Never closed<b>Bold<p>New one <i>it</b>alic</i><div>End<span>ing</div>After<!-- open"),
        (-6, "https://ex.org/empty", ""),
        (-7, "https://ex.org/rows", f"<div id=content><p>{_LONG}</p><p><a href='/1'>One page</a> | <a href='/2'>Two page</a></p><p>A sentence with <a href='/3'>one link</a> and <a href='/4'>another</a> in it.</p><div><span>Deep Dive</span><span>How it works</span></div></div><div class=content><p>{_LONG}</p></div>"),
    ],
)


def names(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(map(D.q, values)) + ")"


def value(tag: str, name: str) -> str:
    return "(" + " || ".join(D.part(tag, M.attribute(name), i) for i in (1, 2, 3)) + ")"


def tidy_inline(x: str) -> str:
    x = D.sub(D.sub(f"replace({x}, chr(160), ' ')", r"\s+", " "), r"\s+([,.;:!?%)\]}])", r"\1")
    return D.trim(D.sub(x, r"([(\[{])\s+", r"\1"))


def text_of(x: str) -> str:
    return D.sub(tidy_inline(x), r"\s*[#¶]\s*$", "")


def decoded(x: str) -> str:
    for entity, by in M.ENTITIES:
        x = f"replace({x}, {D.q(entity)}, {D.q(by)})"
    return x


def parted(before: str, after: str) -> str:
    return f"""coalesce({D.like(before, '''[a-z0-9,.:;?!)"']$''')} and {D.like(after, '^[A-Z(]')}, false)"""


def chrome(x: str) -> str:
    return f"(length({D.trim(x)}) < 3 or {D.like(D.trim(x), X.CHROME_TEXT)})"


INLINE = f"name in {names(X.INLINE_ELEMENTS)}"
_GROUPS = {"li": ("li",), "dx": ("dt", "dd"), "trs": ("tr", *M.SECTIONS), "tds": ("td", "th", "tr", *M.SECTIONS)}
_OPTIONAL = names(("p", "li", "dt", "dd", "tr", "td", "th", *M.SECTIONS))
_NEXT = ", ".join(f"min(case when tag and name in {names(v)} then n end) over later as {k}" for k, v in _GROUPS.items())
HIDDEN, NOISY, CODE_EDGES = r"(?i)\shidden[\s=/>]", r"(?:^|\s)(?:" + "|".join(X.NOISE_CLASSES) + r")(?:\s|$)", r"^\s*\n|\s+$"
_LISTS, _TABLE = "name in ('ul', 'ol')", "name = 'table'"
_RAW_TAG = "regexp_matches(token, '^<[!?]')"
#: Elements and texts of pages in order, with the noise marked.
ELEMENTS = f"""all_pages as (select page_id, html from pages union all select page_id, html from {PAGES.sql}),
cut as (select page_id, unnest(range(len(t))) as n, unnest(t) as token from (select page_id, regexp_extract_all(html, {D.q(M.TOKEN)}) as t from all_pages)),
called as (select *, lower(regexp_extract(token, {D.q(M.NAME)}, 1)) as name from cut),
kinds as (select *, case when {_RAW_TAG} or name in {names(M.RAW)} or (token like '</%' and name in {names(M.VOID)}) then 'none' when name = '' then 'text' when token like '</%' then 'close' when name in {names(M.VOID)} then 'void' else 'open' end as kind from called),
steps as (select *, case when name in {_OPTIONAL} or kind in ('text', 'void') then 0 when kind = 'open' then 1 else -1 end as step from kinds where kind <> 'none'),
sums as (select *, sum(step) over (partition by page_id, name order by n) as s from steps),
floors as (select *, min(least(s, 0)) over (partition by page_id, name order by n) as f from sums),
strays as (select *, step = -1 and s < coalesce(lag(f) over (partition by page_id, name order by n), 0) as stray from floors),
depths as (select *, s - f + (case when step = -1 and not stray then 1 else 0 end) as depth from strays),
partners as (select *, case when step = 1 and lead(step) over w = -1 then lead(n) over w when step = -1 and not stray then lag(n) over w end as partner from depths window w as (partition by page_id, name, depth order by n)),
turns as (select *, case when partner is null then 0 else step end as turn, kind in ('open', 'close') as tag from partners),
levels as (select *, coalesce(sum(turn) over (partition by page_id order by n rows between unbounded preceding and 1 preceding), 0) as level from turns),
nexts as (select *, min(case when turn = -1 then n end) over later as around, {_NEXT},
  min(case when (tag and not {INLINE}) or name = 'hr' then n end) over after as block, max(n) over (partition by page_id) + 1 as last
  from levels window later as (partition by page_id, level order by n desc rows between unbounded preceding and 1 preceding), after as (partition by page_id order by n desc rows between unbounded preceding and 1 preceding)),
elements as (select page_id, n, token, kind, name, case when kind = 'void' then n + 1 when kind = 'open' then coalesce(partner, least(
  case when name = 'p' or {INLINE} then block when name = 'li' then li when name in ('dt', 'dd') then dx when name in ('tr', 'thead', 'tbody', 'tfoot') then trs when name in ('td', 'th') then tds end, around, last)) end as stop
  from nexts where kind <> 'close' and name not in {names(M.SECTIONS)}),
exempts as (select *, name in ('header', 'footer') and coalesce(max(case when name in ('article', 'main') then stop end) over (partition by page_id order by n rows between unbounded preceding and 1 preceding) > n, false) as exempt from elements),
noisy as (select *, kind <> 'text' and ((name in {names(("head", *X.NOISE_ELEMENTS))} and not exempt) or {value('token', 'aria-hidden')} = 'true' or {D.like('token', HIDDEN)}
  or {value('token', 'role')} in {names(X.NOISE_ROLES)} or {D.like(value('token', 'class'), NOISY)}) as noise from exempts),
marked as (select *, coalesce(max(case when noise then stop end) over (partition by page_id order by n) > n, false) as gone from noisy)"""
KEPT = ELEMENTS + ", rows as (select page_id, n, token, kind, name, stop from marked where not gone)"
ALL = ELEMENTS + ", rows as (select page_id, n, token, kind, name, stop from elements)"


def held(source: str, into: str, **amounts: str) -> str:
    own = ", ".join(f"{v} as {k}_own" for k, v in amounts.items())
    run = ", ".join(f"sum(case when ev.b then {k}_own else 0 end) over (partition by page_id order by ev.p, ev.b, n desc rows unbounded preceding) as {k}_run" for k in amounts)
    inside = ", ".join(f"coalesce(lead({k}_run) over (partition by page_id, n order by ev.b desc) - {k}_run, 0)::bigint as {k}_held, ({k}_run - {k}_own)::bigint as {k}_before" for k in amounts)
    gone = ", ".join(["ev", *(f"{k}_{x}" for k in amounts for x in ("own", "run"))])
    return (
        f"{into}_e as (select *, {own}, unnest(case when stop is null then [{{'p': n, 'b': true}}] else [{{'p': n, 'b': true}}, {{'p': stop, 'b': false}}] end) as ev from {source}), "
        f"{into}_r as (select *, {run} from {into}_e), {into}_h as (select *, {inside} from {into}_r), {into} as (select * exclude ({gone}) from {into}_h where ev.b)"
    )


def holders(source: str, into: str, member: str, column: str) -> str:
    return (
        f"{into}_m as (select *, ({member}) and stop is not null as member from {source}), "
        f"{into}_e as (select *, unnest(case when member then [{{'p': n, 'b': true}}, {{'p': stop, 'b': false}}] else [{{'p': n, 'b': true}}] end) as ev from {into}_m), "
        f"{into}_d as (select *, sum(case when not member then 0 when ev.b then 1 else -1 end) over (partition by page_id order by ev.p, ev.b, n desc rows unbounded preceding) as deep from {into}_e), "
        f"{into}_a as (select *, unnest(case when member then [{{'layer': deep - 1, 'asks': true}}, {{'layer': deep, 'asks': false}}] else [{{'layer': deep, 'asks': true}}] end) as la from {into}_d where ev.b), "
        f"{into}_l as (select *, case when la.layer > 0 then last_value(case when not la.asks then n end ignore nulls) over (partition by page_id, la.layer order by n rows unbounded preceding) end as {column} from {into}_a), "
        f"{into} as (select * exclude (member, ev, deep, la) from {into}_l where la.asks)"
    )


def _behind(by: str) -> str:
    return f"last_value(case when raw <> '' then right(raw, 1) end ignore nulls) over (partition by {by} order by n rows between unbounded preceding and 1 preceding)"


def own_texts(source: str, into: str, owner: str, spaced: bool = True) -> str:
    piece = f"case when {parted(_behind(f'page_id, {owner}'), 'raw')} then ' ' || raw else raw end" if spaced else "raw"
    return (
        f"{into}_w as (select page_id, {owner}, n, {decoded('token')} as raw from {source} where kind = 'text' and {owner} is not null), {into}_p as (select *, {piece} as piece from {into}_w), "
        f"{into} as (select page_id, {owner}, string_agg(piece, '' order by n) as text from {into}_p group by page_id, {owner})"
    )


TEXTS = (
    f"raws as (select *, case when kind = 'text' then {decoded('token')} else '' end as raw from rows), pieces as (select * exclude (raw), case when {parted(_behind('page_id'), 'raw')} then ' ' || raw else raw end as piece from raws), "
    + held("pieces", "amounts", chars="length(piece)", blocks=f"(kind <> 'text' and not {INLINE})::int", links="(name = 'a')::int", images="(name = 'img')::int")
    + f""", wholes as (select page_id, string_agg(piece, '' order by n) as whole from pieces where kind = 'text' group by page_id),
stretches as (select page_id, n, token, kind, name, stop, blocks_held as n_blocks, links_held as n_links, images_held as n_images, substring(coalesce(whole, ''), chars_before + 1, chars_held) as stretch from amounts left join wholes using (page_id) where kind <> 'text'),
texts as (select *, {text_of('stretch')} as text from stretches), """
    + held("texts", "linked", link="case when name = 'a' then length(text) else 0 end")
    + f", told as (select * exclude (link_held, link_before), link_held as link_chars, n_links >= 2 and length(text) > 0 and link_held >= {X.LINK_SHARE} * length(text) as link_row from linked)"
)


def _rank() -> str:
    cases = []
    for i, c in enumerate(X.CONTENT):
        fits = f"list_contains(string_split_regex({value('token', 'class')}, '\\s+'), '{c[1:]}')" if c[0] == "." else f"{value('token', 'id')} = '{c[1:]}'" if c[0] == "#" else f"{value('token', 'role')} = '{c[1:-1]}'" if c[0] == "[" else f"name = '{c}'"
        cases.append(f"when {fits} then {i}")
    return f"coalesce(case when length(text) >= {X.CONTENT_CHARS} then case {' '.join(cases)} end end, case when name = 'body' and full_ then {len(X.CONTENT)} end)"


ROOTS = f"""fulls as (select *, coalesce(lead(n) over (partition by page_id order by n) < stop, false) as full_ from told), ranked as (select *, {_rank()} as rank from fulls),
roots as (select page_id, coalesce(arg_min(n, {{'r': rank, 'n': n}}) filter (where rank is not null), -1) as root, coalesce(arg_min(stop, {{'r': rank, 'n': n}}) filter (where rank is not null), max(stop)) as root_stop,
  arg_min(name, {{'r': rank, 'n': n}}) filter (where rank is not null) as name from ranked group by page_id)"""
_OUTER = lambda what: f"coalesce(max(case when {what} then stop end) over (partition by page_id order by n rows between unbounded preceding and 1 preceding) <= n, true)"
_TOP = lambda what: f"last_value(case when ({what}) and outer_ then {{'n': n, 'stop': stop}} end ignore nulls) over (partition by page_id order by n rows unbounded preceding) as top_"
ITEMS = (
    holders("rows", "owned", "name in ('li', 'ul', 'ol')", "owner")
    + f", l_outer as (select *, {_OUTER(_LISTS)} as outer_ from rows), l_top as (select *, {_TOP(_LISTS)} from l_outer), "
    + own_texts("owned", "l_texts", "owner")
    + f", items as (select page_id, top_.n as list, n, {tidy_inline('t.text')} as text from l_top l join (select page_id, owner as n, text from l_texts) t using (page_id, n) where name = 'li' and top_.stop > n and not {chrome(tidy_inline('t.text'))})"
)
TABLES = (
    holders("rows", "t_held", "name = 'tr'", "tr")
    + f", t_outer as (select *, {_OUTER(_TABLE)} as outer_ from t_held), t_top as (select *, {_TOP(_TABLE)} from t_outer), placed as (select *, top_.n as tab from t_top where top_.stop > n),"
    f" t_lines as (select page_id, tab from placed where name = 'tr' group by page_id, tab having count(*) >= 2), t_cells as (select p.page_id, tab, tr, p.n, t.text from placed p join told t on p.page_id = t.page_id and p.n = t.n where p.name in ('td', 'th') and tr is not null),"
    f" t_grid as (select page_id, tab, tr, list(text order by n) as cells from t_cells semi join t_lines using (page_id, tab) group by page_id, tab, tr), t_heads as (select *, row_number() over w - 1 as place, first_value(cells) over w as header, count(*) over (partition by page_id, tab) as c from t_grid window w as (partition by page_id, tab order by tr)),"
    f" t_real as (select *, len(header) >= 2 and c >= 2 and not list_contains(header, '') as good from t_heads),"
    f" table_rows as (select * from (select page_id, tab, tr, place, case when not good then 'paragraph' when place = 0 then 'header' else 'row' end as kind, case when good then list_transform(range(1, len(header) + 1), lambda i: coalesce(cells[i], '')) else [array_to_string(list_filter(cells, lambda x: x <> ''), ' — ')] end as cells from t_real) where kind <> 'paragraph' or not {chrome('cells[1]')})"
)
_H = names(tuple(f"h{i}" for i in range(1, 7)))
BLOCKS = (
    f"{KEPT}, {TEXTS}, {ROOTS}, {ITEMS}, {TABLES}, "
    + f"""detailed as (select *, coalesce(max(case when name = 'details' then stop end) over (partition by page_id order by n rows between unbounded preceding and 1 preceding) > n, false) as in_details from told),
rooted as (select d.*, coalesce(name in {_H} or name in ('pre', 'img', 'ul', 'ol', 'dl', 'table', 'p', 'figcaption') or n_blocks = 0 or (name = 'figure' and n_images > 0) or (name = 'summary' and in_details), false) as whole
  from detailed d join (select page_id, root, root_stop from roots) using (page_id) where n > root and n < root_stop),
freed as (select * from (select *, {_OUTER('whole')} as free from rooted) where free), reads as (select *, name in {_H} as is_h, name = 'summary' and in_details as is_s from freed where whole),
"""
    + holders("rows", "d_held", "name = 'dl'", "dl")
    + f""", d_texts as (select h.page_id, h.n, dl, t.name, t.text from d_held h join told t on h.page_id = t.page_id and h.n = t.n where h.name in ('dt', 'dd') and dl is not null),
d_terms as (select *, coalesce(last_value(case when name = 'dt' then text end ignore nulls) over (partition by page_id, dl order by n rows unbounded preceding), '') as term from d_texts),
"""
    + holders("rows", "parents", "true", "parent")
    + ", "
    + own_texts("parents", "l_own", "parent", spaced=False)
    + f""", loose as (select f.page_id, f.n, {D.trim(D.sub("replace(l.text, chr(160), ' ')", r"\s+", " "))} as text from freed f join l_own l on f.page_id = l.page_id and f.n = l.parent where not whole),
parts as (
  select page_id, n, 0 as item, 'heading' as kind, case when is_s or {D.like('text', X.CALLOUT)} then 5 else substring(name, 2, 1)::int end as level, text from reads where (is_h or is_s) and not {chrome('text')}
  union all select page_id, n, 0, 'code', null, {D.sub('stretch', CODE_EDGES, '')} from reads where name = 'pre' and length(text) >= 3
  union all select page_id, n, 0, 'paragraph', null, text from reads where not is_h and not is_s and name not in ('img', 'ul', 'ol', 'dl', 'table', 'figure', 'pre') and not link_row and not {chrome('text')}
  union all select page_id, list, 0, 'list', null, string_agg(text, chr(10) order by n) from items semi join (select page_id, n as list from reads where name in ('ul', 'ol') and not link_row) using (page_id, list) group by page_id, list
  union all select page_id, dl, 0, 'list', null, string_agg(case when term <> '' then term || ': ' || text else text end, chr(10) order by n) from d_terms semi join (select page_id, n as dl from reads where name = 'dl') using (page_id, dl) where name = 'dd' and text <> '' group by page_id, dl
  union all select page_id, tab, case when kind = 'paragraph' then tr else 0 end, case when kind = 'paragraph' then kind else 'table' end, null, string_agg(array_to_string(cells, chr(9)), chr(10) order by tr) from table_rows semi join (select page_id, n as tab from reads where name = 'table') using (page_id, tab) group by page_id, tab, 3, 4
  union all select page_id, n, 0, 'paragraph', null, text from loose where length(text) >= {X.LOOSE_CHARS} and not {chrome('text')}
), blocks as (select page_id, row_number() over (partition by page_id order by n, item) - 1 as place, kind, level, text from parts)"""
)


def _pages(spark, sf):
    return table(spark, sf, "pages").select("page_id", "url", "html").union(PAGES.frame(spark))


@query("str_19_noise", f"with {ELEMENTS}, outermost as (select *, noise and coalesce(max(case when noise then stop end) over (partition by page_id order by n rows between unbounded preceding and 1 preceding) <= n, true) as first from marked) select page_id, count(*) filter (where first) as removed, count(*) filter (where not gone) as kept, md5(coalesce(string_agg(token, '' order by n) filter (where not gone), '')) as kept_md5 from outermost group by page_id")
def str_19(spark, sf):
    before = Window.partitionBy("page_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    rows = K.noise_marked(K.elements(_pages(spark, sf)))
    rows = rows.withColumn("first", F.col("noise") & F.coalesce(F.max(F.when(F.col("noise"), F.col("stop"))).over(before) <= F.col("n"), F.lit(True)))
    kept = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("gone"), F.struct("n", "token")))), lambda x: x["token"]), "")
    return rows.groupBy("page_id").agg(F.count(F.when(F.col("first"), True)).alias("removed"), F.count(F.when(~F.col("gone"), True)).alias("kept"), F.md5(kept).alias("kept_md5"))


@query("str_20_root", f"with {KEPT}, {TEXTS}, {ROOTS} select page_id, root, root_stop, name from roots")
def str_20(spark, sf):
    return K.content_roots(K.texts(K.without_noise(K.elements(_pages(spark, sf))))).select("page_id", "root", "root_stop", "name")


@query("str_21_dom_text", f"with {KEPT}, {TEXTS} select page_id, n, name, text from texts where text <> ''")
def str_21(spark, sf):
    return K.texts(K.without_noise(K.elements(_pages(spark, sf)))).where("text <> ''").select("page_id", "n", "name", "text")


@query("str_22_link_rows", f"with {ALL}, {TEXTS} select page_id, n, name, n_links, link_chars, length(text) as chars, link_row from told where n_links > 0")
def str_22(spark, sf):
    """With the noise kept: there the pages have their links."""
    return K.link_rows(K.texts(K.elements(_pages(spark, sf)))).where("n_links > 0").select("page_id", "n", "name", "n_links", "link_chars", F.length("text").cast("long").alias("chars"), "link_row")


@query("str_25_blocks", f"with {BLOCKS} select page_id, place, kind, level, text from blocks")
def str_25(spark, sf):
    return K.blocks(_pages(spark, sf))


@query("str_26_html_tables", f"with {KEPT}, {TEXTS}, {TABLES} select page_id, tab as \"table\", place, kind, array_to_string(cells, chr(9)) as cells from table_rows")
def str_26(spark, sf):
    rows = K.without_noise(K.elements(_pages(spark, sf)))
    return K.table_rows(rows, K.texts(rows)).select("page_id", "table", F.col("place").cast("long").alias("place"), "kind", F.array_join("cells", "\t").alias("cells"))


@query("str_27_html_lists", f"with {ALL}, {ITEMS} select page_id, list, n, text from items")
def str_27(spark, sf):
    """With the noise kept: there the pages have their lists."""
    return K.list_items(K.elements(_pages(spark, sf)))
