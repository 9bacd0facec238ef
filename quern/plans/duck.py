"""DuckDB SQL fragments with the meaning of the Column functions."""

from __future__ import annotations

from quern.functions import fixed as X
from quern.sources import fixtures
from quern.sources.fixtures import literal  # noqa: F401
from quern.sources.adapters import GRADES, NOW_MS


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sub(x: str, pattern: str, by: str) -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(by)}, 'g')"


def like(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def part(x: str, pattern: str, group: int) -> str:
    return f"regexp_extract({x}, {q(pattern)}, {group})"


def slug(x: str) -> str:
    return f"trim({sub(f'lower({x})', '[^a-z0-9]+', ' ')})"


def trim(x: str) -> str:
    return f"trim({x}, ' ')"


def tidy(x: str) -> str:
    return sub(trim(sub(x, r"\s+", " ")), "[;,]$", "")


def n_words(x: str) -> str:
    return f"len(string_split_regex({x}, '\\s+'))"


def content_words(x: str) -> str:
    pieces = f"string_split_regex({sub(f'lower({x})', r'[^a-z0-9\s]', ' ')}, '\\s+')"
    stop = "[" + ", ".join(map(q, X.STOPWORDS)) + "]"
    kept = f"list_filter({pieces}, lambda w: (length(w) >= 4 or {like('w', '[0-9]')}) and not list_contains({stop}, w))"
    return f"list_distinct(list_transform({kept}, lambda w: case when {like('w', '[0-9]')} then w else {sub('w', X.STEM, chr(92) + '1')} end))"


def overlap(a: str, b: str) -> str:
    return f"case when least(len({a}), len({b})) > 0 then len(list_intersect({a}, {b})) / least(len({a}), len({b})) else 0.0 end"


def numbers(x: str) -> str:
    return f"list_distinct(regexp_extract_all({x}, {q(X.NUMBER)}))"


def conflicting(a: str, b: str) -> str:
    return f"(len({a}) > 0 and len({b}) > 0 and (len(list_intersect({a}, {b})) < len({a}) or len(list_intersect({a}, {b})) < len({b})))"


def said(x: str) -> str:
    """Without an introductory clause. RE2 has no look-ahead: the clause that goes is matched with the letter after it, which stays."""
    return f"regexp_replace({x}, '^[A-Z][^,]{{0,40}},\\s+([a-z])', '\\1')"


def label(x: str) -> str:
    la = sub(trim(x), "[:?.]+$", "")
    return (
        f"(length({la}) between {X.LABEL_CHARS[0]} and {X.LABEL_CHARS[1]} and not {like(la, X.DISCOURSE)} and not {like(la, X.CHROME)} and {n_words(la)} <= {X.LABEL_WORDS} "
        f"and not {like(la, X.PRONOUN)} and not contains({sub(la, r'\([^)]*\)', '')}, ',') and {like(la, '[A-Za-z]{3,}')} and not {like(la, X.IMPERATIVE)} "
        f"and not {like(la, X.DEICTIC)} and not {like(la, X.FINITE_VERB)})"
    )


def usable(front: str, back: str) -> str:
    """Of columns that are already trimmed."""
    stem = sub(sub(front, r"\.\.\.\?$", ""), r"\?$", "")
    core = front
    for p in (r"(?i)^what (is|are) important about\s+", r"(?i)^what characterizes\s+", r"(?i)^what (is|are)\s+", "[?.]+$"):
        core = sub(core, p, "")
    core, bare = trim(core), sub(front, r"[?:.\s]+$", "")
    bad = [
        f"{front} = ''", f"length({back}) < {X.MIN_BACK_CHARS}", like(stem, r"[:;,/]$|(^|\s)[=+\-–—]$"), like(back, r"(^|\s)[=+]$"),
        f"{n_words(front)} > {X.MAX_FRONT_WORDS}", f"{n_words(back)} > {X.MAX_BACK_WORDS}", like(front, X.BOILERPLATE), like(core, X.DISCOURSE), like(core, X.CHROME),
        like(core, X.BOILERPLATE), like(bare, r"^[\d\s.)+-]+$"), f"length({bare}) < 3", f"{slug(front)} = {slug(back)}", f"length({slug(back)}) < 4",
    ]
    return "not (" + " or ".join(bad) + ")"


CARDS = """cards as (select conv_id as deck_id, turn as ord, text as front, back, false as has_code, false as has_image from (
  select conv_id, turn, role, text, lead(role) over w as next_role, lead(text) over w as back from conversations window w as (partition by conv_id order by turn, role, text))
  where role = 'user' and next_role = 'assistant' and text is not null and back is not null union all select * from """ + fixtures.CARDS.sql + ")"
DOCS = f"docs as (select doc_id, source, text from documents where text is not null union all select * from {fixtures.DOCUMENTS.sql})"
LINES = DOCS + ", lines as (select doc_id, source, unnest(range(len(l))) as line_no, unnest(l) as line from (select doc_id, source, string_split(text, chr(10)) as l from docs))"
SENTENCES = DOCS + (
    ", sentences as (select doc_id, unnest(range(len(s))) as pos, unnest(s) as sentence from (select doc_id, list_filter(list_transform(string_split("
    + sub(sub("text", r"\s+", " "), "([.!?])\\s+([A-Z“\"'(])", "\\1\x01\\2")
    + ", chr(1)), lambda x: trim(x, ' ')), lambda x: x <> '') as s from docs))"
)

TIDY_SENTENCES = SENTENCES.replace("from docs))", "from (select doc_id, " + tidy("text") + " as text from docs)))")


def millis(ts: str) -> str:
    return f"(epoch_us({ts}) // 1000)"


DECKS = "decks as (select c_custkey as deck_id, c_name as name, c_nationkey::bigint as folder_id, c_acctbal as created_at from customer)"
FOLDERS = "folders as (select n_nationkey::bigint as folder_id, n_name as name from nation where n_regionkey < 4)"
STUDY = f"study as (select o_custkey as deck_id, o_orderkey as card_id, case when o_orderstatus <> 'O' then {millis('o_orderdate')} end as due_ms from orders)"
ANSWERS = f"answers as (select l_partkey as question_id, {{'ms': {millis('l_shipdate')}, 'o': l_orderkey, 'n': l_linenumber}} as seq, l_returnflag = 'N' as correct from lineitem)"
_GRADE = "case event_type " + " ".join(f"when {q(k)} then {q(v)}" for k, v in GRADES.items()) + " end"
REVIEWS = f"reviews as (select user_id as card_id, event_id as seq, {millis('ts')} as at_ms, {_GRADE} as grade from events where {_GRADE} is not null)"
NOW = str(NOW_MS)
DUE = f"due_ms < ({NOW} // {X.DAY_MS} + 1) * {X.DAY_MS}"


def url_key(x: str) -> str:
    """Only plain addresses: what stands before the path has no port but the scheme's own, and paths no dot segments."""
    host = f"regexp_replace(lower(regexp_extract({x}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)', 1)), case when lower({x}) like 'https:%' then ':443$' else ':80$' end, '')"
    path = f"regexp_replace(regexp_extract({x}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/$', '')"
    return f"(case when regexp_matches({x}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?[^/?#]') then lower({host} || {path} || nullif(regexp_extract({x}, '(\\?[^#]*)', 1), '?')) else lower(trim({x})) end)".replace("nullif(regexp_extract", "coalesce(nullif(regexp_extract").replace(", '?'))", ", '?'), ''))")


def fetchable(x: str) -> str:
    """By a list of what is refused: hosts are looked at as they are written."""
    host = f"lower(regexp_extract(trim({x}), '(?i)^https?://(?:[^/?#@]*@)?(\\[[^]/?#]*\\]|[^/?#:]*)', 1))"
    number = "(0x[0-9a-f]+|[0-9]+)"
    value = lambda p: f"(case when {p} like '0x%' then try_cast('0x' || coalesce(nullif(ltrim(substr({p}, 3), '0'), ''), '0') as bigint) when {p} like '0_%' then list_sum(list_transform(range(length({p})), lambda i: (try_cast(substr({p}, i + 1, 1) as bigint) * pow(8, length({p}) - 1 - i)::bigint)))::bigint else try_cast({p} as bigint) end)"
    parts = f"string_split(regexp_replace(h, '\\.$', ''), '.')"
    numeric = f"regexp_full_match(h, '{number}(\\.{number}){{0,3}}\\.?')"
    address = f"(case when {numeric} then (select case when len(v) = 1 then v[1] when len(v) = 2 then v[1] * 16777216 + v[2] when len(v) = 3 then v[1] * 16777216 + v[2] * 65536 + v[3] else v[1] * 16777216 + v[2] * 65536 + v[3] * 256 + v[4] end from (select list_transform({parts}, lambda p: {value('p')}) as v)) end)"
    private = lambda a: f"({a} >= 3758096384 or {a} // 16777216 in (0, 10, 127) or {a} // 65536 in (43518, 49320) or {a} // 1048576 = 2753 or {a} // 4194304 = 401)"
    six = "regexp_extract(h, '^\\[(.*)\\]$', 1)"
    mapped = f"regexp_extract({six}, ':ffff:([0-9.]+)$', 1)"
    hexed = f"(('0x' || lpad(regexp_extract({six}, ':ffff:([0-9a-f]{{1,4}}):[0-9a-f]{{1,4}}$', 1), 4, '0'))::bigint * 65536 + ('0x' || lpad(regexp_extract({six}, ':ffff:[0-9a-f]{{1,4}}:([0-9a-f]{{1,4}})$', 1), 4, '0'))::bigint)"
    quad = f"list_reduce(list_transform(string_split({mapped}, '.'), lambda p: try_cast(p as bigint)), lambda a, b: a * 256 + b)"
    bad6 = f"({six} in ('::1', '::') or regexp_matches({six}, '^f[cd]|^fe[89ab]') or ({mapped} like '%.%.%.%' and {private(quad)}) or (regexp_matches({six}, ':ffff:[0-9a-f]{{1,4}}:[0-9a-f]{{1,4}}$') and {private(hexed)}))"
    return f"(select h <> '' and not {like('h', X.BLOCKED_HOST)} and case when h like '[%' then {six} <> '' and not coalesce({bad6}, false) when {address} is not null then {address} < 4294967296 and not {private(address)} else true end from (select {host} as h))"


def card_hash(front: str, back: str) -> str:
    """Over UTF-16 units; characters beyond the first plane have two."""
    codes = f"list_transform(string_split({front} || chr(0) || {back}, ''), lambda c: unicode(c)::bigint)"
    units = f"flatten(list_transform({codes}, lambda u: case when u > 65535 then [55296 + (u - 65536) // 1024, 56320 + (u - 65536) % 1024] else [u] end))"
    return f"lower(to_hex(list_reduce(list_prepend(2166136261::bigint, {units}), lambda h, u: ((xor(h, u)::hugeint * 16777619) % 4294967296)::bigint)))"


def schedules(more: str | None = None) -> str:
    """The fold of a review log and of ``more`` reviews; a review has the fields of a state, with its own time and grade."""
    day = f"{X.DAY_MS}::bigint"
    learn, before = "(s.reps = 0)", "greatest(1::bigint, s.ivl)"
    ease = f"(case when {learn} then s.ease when e.grade = 'hard' then greatest({X.MIN_EASE}::double, s.ease - 0.15::double) when e.grade = 'easy' then s.ease + 0.15::double else s.ease end)"
    grown = f"(case when e.grade = 'hard' then {before} * 1.2::double when e.grade = 'good' then {before} * {ease} else {before} * {ease} * 1.3::double end)"
    days = f"least({X.MAX_INTERVAL}::bigint, case when {learn} then (case when e.grade = 'easy' then 4 else 1 end)::bigint else greatest({before} + 1, floor({grown} + 0.5::double)::bigint) end)"
    counts = f"(e.grade = 'again' or not s.seen or s.due < (e.last // {day} + 1) * {day})"
    miss = "e.grade = 'again'"
    new = {
        "seen": "true", "due": f"case when {miss} then e.last else e.last + {days} * {day} end", "ivl": f"case when {miss} then 0::bigint else {days} end",
        "ease": f"case when {miss} and not {learn} then greatest({X.MIN_EASE}::double, s.ease - 0.2::double) when {miss} then s.ease else {ease} end",
        "reps": f"case when {miss} then 0::bigint else s.reps + 1 end", "lapses": f"s.lapses + (case when {miss} and not {learn} then 1 else 0 end)::bigint", "last": "e.last",
    }
    fold = ", ".join(f"'{k}': case when {counts} then {v} else s.{k} end" for k, v in new.items()) + ", 'grade': ''"
    zero = "'seen': false, 'due': 0::bigint, 'ivl': 0::bigint, 'ease': 2.5::double, 'reps': 0::bigint, 'lapses': 0::bigint"
    events = f"list({{{zero}, 'last': at_ms, 'grade': grade}} order by at_ms, seq)"
    log = f", log as (select * from reviews union all {more})" if more else ", log as (select * from reviews)"
    return f"""with {REVIEWS}{log}, folded as (select card_id, list_reduce(list_prepend({{{zero}, 'last': 0::bigint, 'grade': ''}}, {events}), lambda s, e: {{{fold}}}) as s from log group by card_id)
select card_id, s.due as due, s.ivl as "interval", s.ease as ease, s.reps as reps, s.lapses as lapses, s.last as last from folded"""
