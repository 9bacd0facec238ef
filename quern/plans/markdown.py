"""The query over Markdown lines and its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import fixed as X
from quern.operators import markdown as W
from quern.plans import duck as D
from quern.plans.queries import query
from quern.sources import adapters as A
from quern.sources.fixtures import Fixture

_TEXTS = {
    -101: "- one\n- [x] **Two** — second item\n  goes on\n  and on\n\n\n* three\n  - nested\n\n  apart\n- - -\nend\n1) a\n2. \n- - -\n+ b",
    -102: "intro | none\n| A | B **x** | C |\n|---|:-:|---|\n| 1 | 2 |\n a | b\\|c | d | e\n|---|---|\nno pipe\n| h | |\n|-|-|\n| v | |\n| only | header |\n",
    -103: "```py\n    x = 1\n\n      y = 2\n  ```\n~~~~\n```\n~~~\n- no item\n~~~~~\n```\n\n```\n````sql extra\n- no item\n```\n   last",
    -104: "| X | Y |\n|---|---|\n\n***\n- - -\n  no continuation\n- item\n# head\n  text\n12. twelve\n   # head too\n- `a` | b\n- c | d\n|---|---|\n| e | f |",
    -105: "~~~ " + "l" * 30 + "\n" + "\n".join(f"    line {i} of long code, which is cut at a line's end" for i in range(40)),
}
LINES = Fixture("doc_id long, line_no long, line string", [(d, i, x) for d, t in _TEXTS.items() for i, x in enumerate(t.split("\n"))])
#: What becomes of a document's lines in turn, so that all of them are Markdown.
_DRESS = ["# {}", "- {}", "   {}", "2. [x] {}", "", "* {}", "{}", "| {5} | **{9}** |", "|---|:-:|", "| {}", "```sql", "    {}", "      {}", "```"]


def _dressed_sql() -> str:
    cases = []
    for i, form in enumerate(_DRESS):
        text = D.q(form).replace("{}", "' || line || '").replace("{5}", "' || left(line, 5) || '").replace("{9}", "' || left(line, 9) || '")
        cases.append(f"when {i} then {text}")
    return f"(case (line_no + doc_id) % {len(_DRESS)} {' '.join(cases)} end)"


def _dressed(line):
    out = F.lit(None).cast("string")
    for i, form in reversed(list(enumerate(_DRESS))):
        for key, n in (("{}", None), ("{5}", 5), ("{9}", 9)):
            form = form.replace(key, f"\0{n or ''}\0")
        parts = form.split("\0")
        text = F.concat(*(F.lit(p) if k % 2 == 0 else F.substring(line, 1, int(p)) if p else line for k, p in enumerate(parts)))
        out = F.when((F.col("line_no") + F.col("doc_id")) % len(_DRESS) == i, text).otherwise(out)
    return out


def term_pair(x: str) -> str:
    """RE2 has no back-references: each mark has a pattern of its own."""
    cases, t = [], D.trim(x)
    for mark in (r"\*\*", "__", r"\*", "_"):
        p = rf"^{mark}(.{{2,60}}?){mark}\s*[—–:-]\s+(.+)$"
        term, rest = D.trim(D.sub(D.trim(D.part(t, p, 1)), "[:—–-]+$", "")), D.trim(D.part(t, p, 2))
        cases.append(f"when {D.like(t, p)} then case when {term} <> '' and {rest} <> '' then {term} || ': ' || {rest} else {x} end")
    return f"(case {' '.join(cases)} else {x} end)"


def without_marks(x: str) -> str:
    """RE2 has no look-ahead: the sign behind is matched and put back."""
    for pattern, by in X.INLINE_MARKS:
        if "(?!" in pattern:
            pattern, by = pattern.replace("(?![A-Za-z0-9_])", "([^A-Za-z0-9_]|$)"), by + r"\3"
        x = D.sub(x, pattern, by)
    return D.trim(D.sub(x, r"\s+", " "))


_EDGES, _INDENT, _SOLID, _LEADS = r"^\s+|\s+$", r"^(\s*)", r"\S", r"^\s"
_BARE = f"regexp_replace(regexp_replace({D.sub('line', _EDGES, '')}, '^\\|', ''), '\\|$', '')"
CELLS = f"list_transform(string_split(replace({_BARE}, '\\|', chr(1)), '|'), lambda c: {without_marks("replace(c, chr(1), '|')")})"
_CODE = f"left(text, {X.CODE_CHARS})"
_CUT = f"(length({_CODE}) - strpos(reverse({_CODE}), chr(10)))"
_TRUNCATED = f"case when length(text) <= {X.CODE_CHARS} then text else (case when strpos({_CODE}, chr(10)) > 0 and {_CUT} > 0 then left({_CODE}, {_CUT}) else {_CODE} end) || chr(10) || '…' end"
_FOLD = "case when s.opened = '' then {'mark': '', 'opened': x.mark, 'signs': s.signs || 'o'} when left(x.mark, 1) = left(s.opened, 1) and length(x.mark) >= length(s.opened) then {'mark': '', 'opened': '', 'signs': s.signs || 'c'} else {'mark': '', 'opened': s.opened, 'signs': s.signs || 'x'} end"
_ITEM = f"case when kind = 'L' then {D.part('line', X.LIST_ITEM, 2)} else {D.sub('line', _EDGES, '')} end"
_BOX = r"^\[[ xX]\]\s*"
SQL = f"""with {D.LINES}, md as (select doc_id, line_no, {_dressed_sql()} as line from lines union all select * from {LINES.sql}),
marks as (select doc_id, line_no, {D.part('line', X.FENCE, 1)} as mark from md where {D.like('line', X.FENCE)}),
folded as (select doc_id, list(line_no order by line_no) as places, list_reduce(list_prepend({{'mark': '', 'opened': '', 'signs': ''}}, list({{'mark': mark, 'opened': '', 'signs': ''}} order by line_no)), lambda s, x: {_FOLD}).signs as signs from marks group by doc_id),
signs as (select * from (select doc_id, unnest(places) as line_no, unnest(string_split(signs, '')) as fence from folded) where fence <> 'x'),
coded as (select *, fence is not null or coalesce(last_value(fence ignore nulls) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding) = 'o', false) as code, sum(case when fence = 'o' then 1 else 0 end) over (partition by doc_id order by line_no) as block from md left join signs using (doc_id, line_no)),
bodies as (select doc_id, block, min(line_no) filter (where fence = 'o') as line_no, max({D.part('line', X.FENCE, 2)}) filter (where fence = 'o') as language,
  coalesce(min(length({D.part('line', _INDENT, 1)})) filter (where fence is null and {D.like('line', _SOLID)}), 0) as shared from coded where code group by doc_id, block),
codes as (select b.doc_id, b.line_no, b.language, {D.sub("string_agg(substring(c.line, shared + 1), chr(10) order by c.line_no)", _EDGES, '')} as text from bodies b join coded c on b.doc_id = c.doc_id and b.block = c.block and c.code and c.fence is null group by b.doc_id, b.line_no, b.language),
pipes as (select *, not code and {D.like('line', _SOLID)} and contains(line, '|') as pipe from coded),
starting as (select *, pipe and coalesce(lead(pipe) over w and {D.like('lead(line) over w', X.TABLE_DELIMITER)}, false) and len({CELLS}) >= 2 as starts, sum(case when pipe then 0 else 1 end) over w as island from pipes window w as (partition by doc_id order by line_no)),
firsts as (select *, min(case when starts then line_no end) over (partition by doc_id, island) as first from starting),
placed as (select *, case when code then 'K' when pipe and coalesce(line_no >= first, false) then 'T' when not {D.like('line', _SOLID)} then 'B' when {D.like('line', X.LIST_ITEM)} then 'L' when {D.like('line', _LEADS)} and not {D.like('line', X.ATX_HEADING)} then 'C' else 'O' end as kind from firsts),
grids as (select doc_id, first as line_no, list({CELLS} order by line_no) as grid from placed where kind = 'T' and line_no <> first + 1 group by doc_id, first),
squares as (select doc_id, line_no, len(grid) > 1 and not list_contains(grid[1], '') as good, list_transform(grid, lambda r: list_transform(range(1, len(grid[1]) + 1), lambda i: coalesce(r[i], ''))) as grid from grids),
tabled as (select doc_id, line_no, case when good then 'table' else 'rows' end as kind, case when good then array_to_string(list_transform(grid, lambda r: array_to_string(r, chr(9))), chr(10))
  else array_to_string(list_filter(list_transform(grid, lambda r: array_to_string(list_filter(r, lambda c: c <> ''), ' — ')), lambda x: x <> ''), chr(10)) end as text from squares),
more as (select *, kind = 'C' and coalesce(last_value(case when kind <> 'C' then kind end ignore nulls) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding) = 'L', false) as more from placed),
runs as (select *, sum(case when kind in ('L', 'B') or more then 0 else 1 end) over (partition by doc_id order by line_no) as run from more),
begun as (select *, max(case when kind = 'L' and not {D.like('line', X.THEMATIC_BREAK)} then 1 else 0 end) over (partition by doc_id, run order by line_no) as begun from runs),
items as (select *, sum(case when kind = 'L' then 1 else 0 end) over (partition by doc_id, run order by line_no) as item, {_ITEM} as raw from begun where (kind = 'L' or more) and begun = 1),
cleaned as (select *, {D.sub('raw', _BOX, '')} as boxless from items), paired as (select *, {term_pair('boxless')} as pair from cleaned), said as (select *, {without_marks('pair')} as text from paired),
joined as (select doc_id, run, item, min(line_no) as line_no, coalesce(string_agg(text, ' ' order by line_no) filter (where text <> ''), '') as text from said group by doc_id, run, item),
listed as (select doc_id, min(line_no) as line_no, string_agg(text, chr(10) order by item) filter (where text <> '') as text from joined group by doc_id, run)
select doc_id, line_no, 'code' as kind, left(language, {X.LANGUAGE_CHARS}) as language, {_TRUNCATED} as text from codes where text <> ''
union all select doc_id, line_no, kind, null, text from tabled where text <> '' union all select doc_id, line_no, 'list', null, text from listed where text is not null"""


@query("str_35_markdown_readers", SQL)
def str_35(spark, sf):
    lines = A.lines(spark, sf).select("doc_id", "line_no", _dressed(F.col("line")).alias("line"))
    return W.readers(lines.union(LINES.frame(spark)))
