"""The queries over the reference's operators and their SQL, keyed by operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import fixed as X
from quern.functions import java as J
from quern.functions import phrasing as P
from quern.functions import text as T
from quern.operators import library as L
from quern.operators import schedule as S
from quern.operators import structure as R
from quern.plans import duck as D
from quern.runtime import table
from quern.sources import adapters as A
from quern.sources import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and its SQL."""

    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


# Similarity and de-duplication


@query("dup_01_slug", f"with {D.LINES} select doc_id, line_no, {D.slug('line')} as slug from lines")
def dup_01(spark, sf):
    return A.lines(spark, sf).select("doc_id", "line_no", T.slug(F.col("line")).alias("slug"))


@query("dup_02_content_words", f"select doc_id, len(w) as n_words, md5(array_to_string(list_sort(w), ' ')) as words_md5 from (select doc_id, {D.content_words('text')} as w from documents where text is not null)")
def dup_02(spark, sf):
    w = table(spark, sf, "documents").where("text is not null").select("doc_id", T.content_words(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").cast("long").alias("n_words"), F.md5(F.array_join(F.array_sort("w"), " ")).alias("words_md5"))


_TURNS = f"turns as (select conv_id, turn, role, w, lag(w) over o as v from (select conv_id, turn, role, text, {D.content_words('text')} as w from conversations where text is not null) window o as (partition by conv_id order by turn, role, text))"


def _turns(spark, sf):
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = table(spark, sf, "conversations").where("text is not null").withColumn("w", T.content_words(F.col("text")))
    return rows.withColumn("v", F.lag("w").over(order)).where("v is not null")


@query("dup_03_overlap", f"with {_TURNS} select conv_id, turn, role, {D.overlap('v', 'w')} as overlap from turns where v is not null")
def dup_03(spark, sf):
    return _turns(spark, sf).select("conv_id", "turn", "role", T.overlap(F.col("v"), F.col("w")).alias("overlap"))


_PAIRS = f"w as (select deck_id, ord, front, back, {D.content_words('front')} as fw, {D.content_words('back')} as bw, {D.numbers('front')} as fn, {D.numbers('back')} as bn, has_code, has_image from cards), pairs as (select a.deck_id, a.ord as kept, b.ord as later, a.fw as afw, b.fw as bfw, a.bw as abw, b.bw as bbw, a.fn as afn, b.fn as bfn, a.bn as abn, b.bn as bbn, b.has_code and not a.has_code as code, b.has_image and not a.has_image as image from w a join w b on a.deck_id = b.deck_id and a.ord < b.ord)"


@query("dup_04_conflicting_numbers", f"with {D.CARDS}, {_PAIRS} select deck_id, kept, later, {D.conflicting('abn', 'bbn')} as conflict from pairs where later = kept + 1 or deck_id < 0")
def dup_04(spark, sf):
    n = A.cards(spark, sf).select("deck_id", "ord", T.numbers(F.col("back")).alias("n"))
    a, b = n.toDF("deck_id", "kept", "m"), n.toDF("deck_id", "later", "n")
    near = (F.col("later") == F.col("kept") + 1) | ((F.col("deck_id") < 0) & (F.col("later") > F.col("kept")))
    return a.join(b, "deck_id").where(near).select("deck_id", "kept", "later", T.conflicting(F.col("m"), F.col("n")).alias("conflict"))


@query("dup_07_url_key", f"select page_id, key, row_number() over (partition by key order by page_id) = 1 as kept from (select page_id, {D.url_key('url')} as key from pages union all select page_id, {D.url_key('url')} from {fixtures.URLS.sql})")
def dup_07(spark, sf):
    return L.first_of_key(table(spark, sf, "pages").select("page_id", "url").union(fixtures.URLS.frame(spark)), T.url_key(F.col("url")), "page_id").select("page_id", "key", "kept")


# Cards


@query("crd_04_term_definition", f"with {D.LINES}, parts as (select doc_id, line_no, {D.tidy('line')} as t from lines), terms as (select *, {D.trim(D.part('t', X.TERM_DEFINITION, 1))} as term, {D.trim(D.part('t', X.TERM_DEFINITION, 2))} as def from parts where {D.like('t', X.TERM_DEFINITION)}) select doc_id, line_no, term, def from terms where {D.n_words('term')} <= 9 and {D.label('term')}")
def crd_04(spark, sf):
    return A.lines(spark, sf).select("doc_id", "line_no", T.term_definition(F.col("line")).alias("t")).where("t is not null").select("doc_id", "line_no", "t.term", "t.def")


def _sentences(spark, sf):
    found = A.documents(spark, sf).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))
    return found.withColumn("pos", F.col("pos").cast("long"))


@query("crd_05_sentences", f"with {D.SENTENCES} select doc_id, pos, sentence from sentences")
def crd_05(spark, sf):
    return _sentences(spark, sf)


def _definitions_sql() -> str:
    # RE2 has no look-ahead: the clause that goes is matched with the letter after it, which stays.
    said = D.said("sentence")
    cases = []
    for p in X.DEFINITIONS:
        term, rest = D.trim(D.part("said", p, 1)), D.sub(D.trim(D.part("said", p, 2)), "[.]$", "")
        good = f"not {D.like(term, X.PRONOUN_SUBJECT)} and not {D.like(term, X.CONJUNCTION)} and {D.n_words(term)} <= 7 and {D.label(term)}"
        cases.append(f"when {D.like('said', p)} then case when {good} then {{'term': {term}, 'def': {rest}}} end")
    last, before = D.trim(D.part("said", X.TRAILING, 2)), D.trim(D.part("said", X.TRAILING, 1))
    trailing = f"case when {D.like('said', X.TRAILING)} and {D.label(last)} and {D.n_words(before)} <= 40 then {{'term': {last}, 'def': {before}}} end"
    both = f"[case {' '.join(cases)} end, {trailing}]"
    return f"with {D.SENTENCES}, said as (select doc_id, pos, {said} as said from sentences), found as (select doc_id, pos, unnest(list_filter({both}, lambda x: x is not null)) as d from said where {D.n_words('said')} <= 42) select doc_id, pos, d.term as term, d.def as def from found"


@query("crd_06_definitions", _definitions_sql())
def crd_06(spark, sf):
    found = _sentences(spark, sf).select("doc_id", "pos", F.explode(T.definitions(F.col("sentence"))).alias("d"))
    return found.select("doc_id", "pos", "d.term", "d.def")


_KEYS = f"list_filter(string_split_regex(lower(title), '[^a-z0-9]+'), lambda w: length(w) > 3 and not list_contains({D.literal(X.SUMMARY_FILLER)}, w))"


@query(
    "crd_07_summary",
    f"""with {D.TIDY_SENTENCES}, titled as (select doc_id, {D.trim("split_part(text, chr(10), 1)")} as title from docs), keys as (select doc_id, title, {_KEYS} as k from titled where {D.label('title')} and not {D.like('title', '[:;]')}),
scored as (select doc_id, title, pos, sentence, len(list_filter(k, lambda w: contains(lower(sentence), w))) as hits, {D.n_words('sentence')} as n from sentences join keys using (doc_id)),
good as (select *, hits * 10 + (case when {D.like('lower(sentence)', X.STATEMENT)} then 5 else 0 end) - (case when {D.like('sentence', X.PRONOUN_SUBJECT)} then 6 else 0 end) - n / 10 as score from scored where hits > 0 and n between 8 and 45 and not {D.like('sentence', X.CONJUNCTION)}),
best as (select doc_id, arg_max(sentence, {{'a': score, 'b': -pos}}) as s, max(score) as score from good group by doc_id)
select doc_id, {D.said('s')} as back, score from best""",
)
def crd_07(spark, sf):
    title = F.substring_index("text", "\n", 1)
    # Most documents' first line names no concept; only the others' sentences are looked at.
    docs = A.documents(spark, sf).where(T.meaningful_label(title))
    return docs.select("doc_id", T.summary(title, F.col("text")).alias("s")).where("s is not null").select("doc_id", "s.back", "s.score")


@query("crd_10_labels", f"with {D.LINES} select doc_id, line_no, {D.label('line')} as meaningful from lines")
def crd_10(spark, sf):
    return A.lines(spark, sf).select("doc_id", "line_no", T.meaningful_label(F.col("line")).alias("meaningful"))


@query("crd_11_usable_cards", f"with {D.CARDS}, t as (select deck_id, ord, trim(front, ' ') as f, trim(back, ' ') as b from cards) select deck_id, ord, {D.usable('f', 'b')} as usable from t")
def crd_11(spark, sf):
    return A.cards(spark, sf).select("deck_id", "ord", T.usable_card(F.col("front"), F.col("back")).alias("usable"))


@query("crd_12_dangling", f"with {D.SENTENCES}, d as (select doc_id, pos, {D.sub(D.part('sentence', X.DANGLING, 0), r'\s*[?:,.]?$', '')} as phrase from sentences) select doc_id, pos, phrase from d where phrase <> ''")
def crd_12(spark, sf):
    return _sentences(spark, sf).select("doc_id", "pos", T.dangling_reference(F.col("sentence")).alias("phrase")).where("phrase is not null")


_CELLS = "cells as (select trim(p_name) as row_key, unnest([0, 1, 2]) as col, unnest(['p_brand', 'p_type', 'p_size']) as header, unnest([p_brand, p_type, p_size::varchar]) as value from part)"


def _cells(spark, sf):
    return R.unpivoted(table(spark, sf, "part"), "p_name", ["p_brand", "p_type", "p_size"])


@query("crd_03_unpivot", f"with {_CELLS} select row_key, col::bigint as col, header, value from cells where row_key <> '' and trim(value) <> ''")
def crd_03(spark, sf):
    return _cells(spark, sf)


@query("crd_13_table_question", f"with {_CELLS} select row_key, col::bigint as col, 'What is the ' || lower(header) || ' of the ' || row_key || ' part?' as front from cells where row_key <> '' and trim(value) <> '' union all select row_key, col, expected from {fixtures.TABLE_CELLS.sql}")
def crd_13(spark, sf):
    front = P.table_question(F.lit("Parts"), F.col("row_key"), F.col("header"), F.lit(None).cast("string"))
    cells = _cells(spark, sf).select("row_key", "col", front.alias("front"))
    branches = fixtures.TABLE_CELLS.frame(spark).select("row_key", "col", P.table_question(F.col("row_header"), F.col("row_key"), F.col("header"), F.col("context")).alias("front"))
    return cells.union(branches)


_STEM = D.sub("case when regexp_replace(trim(line, ' '), '^\\(?\\d{1,2}[.)]\\s+', '') = '' then trim(line, ' ') else trim(regexp_replace(trim(line, ' '), '^\\(?\\d{1,2}[.)]\\s+', ''), ' ') end", "[:?]+$", "")
_ASKED = f"case when {D.like('s', X.QUESTION_WORD)} then s || '?' when {D.like('s', X.PREPOSITION_END)} then s || '...?'"


@query("crd_14_heading_questions", f"with {D.LINES}, s as (select doc_id, line_no, {_STEM} as s from lines where {D.label('line')}) select doc_id, line_no, {_ASKED} else 'What characterizes ' || s || '?' end as heading, {_ASKED} else 'What is important about ' || s || '?' end as label from s")
def crd_14(spark, sf):
    line = F.col("line")
    return A.lines(spark, sf).where(T.meaningful_label(line)).select("doc_id", "line_no", P.heading_question(line).alias("heading"), P.label_question(line).alias("label"))


_PLURAL = f"case when {D.like('n', X.PLURAL_HINT)} then regexp_matches(n, '(?i)s\\b') or regexp_matches(n, '(?i)criteria') else regexp_matches(n, '(?i)[^s]s$') end"
_SINGULAR = "case when m like '%ies' then left(m, length(m) - 3) || 'y' when m like '%ses' then left(m, length(m) - 2) when m like '%s' and m not like '%ss' then left(m, length(m) - 1) else m end"


@query("crd_15_words", f"select distinct n, case when {_PLURAL} then 'are' else 'is' end as be, {_SINGULAR} as singular from (select unnest(string_split(p_name || ' ' || p_type, ' ')) as n, lower(n) as m from part)")
def crd_15(spark, sf):
    n = table(spark, sf, "part").select(F.explode(F.split(F.concat_ws(" ", "p_name", "p_type"), " ")).alias("n")).distinct()
    return n.select("n", P.be(F.col("n")).alias("be"), P.singular(F.col("n")).alias("singular"))


# Structure


@query("str_03_spacing", f"with {D.LINES} select doc_id, line_no, " + D.trim(D.sub(D.sub(D.sub(D.sub(D.sub(D.sub("line", r"\(\s+", "("), r"\s+\)", ")"), r"(\d)\s*([–—-])\s*(\d)", r"\1\2\3"), r"(?i)(\d)\s*y\s+r\b", r"\1 yr"), r"(?i)(\d)\s*m\s+o\b", r"\1 mo"), r"\s{2,}", " ")) + " as line from lines")
def str_03(spark, sf):
    return A.lines(spark, sf).select("doc_id", "line_no", T.normal_spacing(F.col("line")).alias("line"))


@query("str_05_clusters", "with g as (select l_orderkey, l_quantity, case when l_quantity - lag(l_quantity) over w > 12 then 1 else 0 end as opened from lineitem window w as (partition by l_orderkey order by l_quantity)), c as (select l_orderkey, l_quantity, sum(opened) over (partition by l_orderkey order by l_quantity rows unbounded preceding)::bigint as cluster from g) select l_orderkey, cluster, avg(l_quantity) as anchor, count(*) as n from c group by all")
def str_05(spark, sf):
    return R.clusters(table(spark, sf, "lineitem").select("l_orderkey", "l_quantity"), ["l_orderkey"], "l_quantity", 12)


@query("str_12_print_artifacts", f"with {D.LINES} select doc_id, count(*) as n_lines, count(*) filter ({D.like(D.trim('line'), X.PRINT_ARTIFACT)}) as n_artifacts from lines group by doc_id")
def str_12(spark, sf):
    return A.lines(spark, sf).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(T.print_artifact(F.col("line"))).alias("n_artifacts"))


_BLOCKS = f"""with {D.LINES}, b as (select coalesce(source, '') as document, doc_id as section, line_no as block, line as text, lower(left(line, {X.SIGNATURE_CHARS})) as s from lines), n as (select document, count(distinct section) as n from b group by document),
often as (select document, s from b join n using (document) where s <> '' and n >= 4 group by document, s, n having count(distinct section) >= greatest(3, ceil(n * 0.3))),
owner as (select document, {D.slug('text')} as slug, max(section) as owner from b where block = 0 group by all having slug <> ''),
kept as (select b.* from b anti join often using (document, s)), shown as (select k.* from kept k left join owner o on k.document = o.document and o.slug = {D.slug('k.text')} left join n on n.document = k.document where o.owner is null or length(k.text) > {X.NAVIGATION_CHARS} or o.owner = k.section or n.n < 4)"""


@query("str_16_furniture", _BLOCKS + " select document, section, count(*) as n_kept from shown group by document, section")
def str_16(spark, sf):
    lines = A.lines(spark, sf).withColumn("document", F.coalesce("source", F.lit("")))
    blocks = lines.select("document", F.col("doc_id").alias("section"), F.col("line_no").alias("block"), F.col("line").alias("text"))
    titles = blocks.where("block = 0").select("document", "section", F.col("text").alias("title"))
    kept = R.without_navigation(R.without_furniture(blocks), titles)
    return kept.groupBy("document", "section").agg(F.count("*").alias("n_kept"))


@query("str_17_context", f"with {D.LINES} select doc_id, line_no, last_value(case when {D.label('line')} then line end ignore nulls) over (partition by doc_id order by line_no rows unbounded preceding) as context from lines")
def str_17(spark, sf):
    return R.headings_down(A.lines(spark, sf), T.meaningful_label(F.col("line"))).select("doc_id", "line_no", "context")


@query("str_33_page_title", f"with {D.LINES}, t as (select doc_id, {D.trim(D.sub('line', r'\s+', ' '))} as t from lines where line_no = 0) select doc_id, case when {D.like('t', X.PAGE_TITLE)} then {D.trim(D.part('t', X.PAGE_TITLE, 1))} else t end as title from t")
def str_33(spark, sf):
    return A.documents(spark, sf).select("doc_id", T.page_title(F.substring_index("text", "\n", 1)).alias("title"))


# Joins, aggregates and library


@query("jon_02_folder_of", f"with {D.DECKS}, {D.FOLDERS} select deck_id, coalesce(f.folder_id::varchar, 'unfiled') as folder from decks d left join folders f using (folder_id)")
def jon_02(spark, sf):
    return L.folder_of(A.decks(spark, sf), A.folders(spark, sf)).select("deck_id", "folder")


@query("jon_04_orphans", "select o_orderkey as question_id, o_custkey as card_id from orders anti join (select c_custkey as o_custkey from customer where c_mktsegment <> 'BUILDING') using (o_custkey)")
def jon_04(spark, sf):
    live = table(spark, sf, "customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("card_id"))
    return L.orphans(table(spark, sf, "orders").select(F.col("o_orderkey").alias("question_id"), F.col("o_custkey").alias("card_id")), live)


@query("agg_01_decks_by_folder", f"with {D.DECKS}, {D.FOLDERS} select f.folder, count(d.deck_id) as n_decks from (select folder_id::varchar as folder from folders union all select 'unfiled') f left join (select deck_id, coalesce(f.folder_id::varchar, 'unfiled') as folder from decks left join folders f using (folder_id)) d using (folder) group by f.folder")
def agg_01(spark, sf):
    return L.decks_by_folder(A.decks(spark, sf), A.folders(spark, sf))


@query("agg_05_session_preview", f"with {D.STUDY}, c as (select deck_id, count(*) as n_cards, count(*) filter ({D.DUE}) as due, count(*) filter (due_ms is null) as new, min(due_ms) filter (not ({D.DUE})) as nd from study group by deck_id) select deck_id, n_cards, due, new, least(new, 20) as session_new, case when due + least(new, 20) = 0 then nd end as next_due from c")
def agg_05(spark, sf):
    return L.study_counts(A.study_cards(spark, sf), A.NOW_MS)


@query("agg_06_answer_tally", f'with {D.ANSWERS} select question_id, count(*) as asked, count(*) filter (correct) as "right", arg_max(correct, seq) as last_correct from answers group by question_id')
def agg_06(spark, sf):
    return L.answer_tally(A.answers(spark, sf))


@query("agg_08_mode_first_seen", "select l_orderkey, arg_max(l_shipmonth, {'n': n, 'f': -f, 'v': l_shipmonth}) as l_shipmonth, max(n) as n from (select l_orderkey, month(l_shipdate)::bigint as l_shipmonth, count(*) as n, min(l_linenumber) as f from lineitem group by all) group by l_orderkey")
def agg_08(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.month("l_shipdate").cast("long").alias("l_shipmonth"))
    return R.most_frequent(rows, "l_orderkey", "l_shipmonth", "l_linenumber")


@query("agg_10_scores", 'select l_suppkey, count(*) filter (l_returnflag = \'N\') as "right", count(*) filter (l_returnflag <> \'N\') as missed, floor(100 * count(*) filter (l_returnflag = \'N\') / count(*) + 0.5)::bigint as percent from lineitem group by l_suppkey')
def agg_10(spark, sf):
    return L.scores(table(spark, sf, "lineitem").select("l_suppkey", (F.col("l_returnflag") == "N").alias("correct")), "l_suppkey")


# Selection


@query(
    "sel_04_session_queue",
    f"""with {D.STUDY}, k as (select deck_id, card_id, case when {D.DUE} then 0 when due_ms is null then 1 end as kind, case when {D.DUE} then md5('queue:' || card_id) else '' end as key from study),
r as (select *, row_number() over (partition by deck_id, kind order by key, card_id) as rank from k where kind is not null)
select deck_id, card_id, row_number() over (partition by deck_id order by kind, rank) as position from r where kind = 0 or rank <= 20""",
)
def sel_04(spark, sf):
    return L.session_queue(A.study_cards(spark, sf), A.NOW_MS)


_SORT = "array_to_string(list_transform(regexp_extract_all(lower(name), '\\d+|\\D+'), lambda p: case when regexp_matches(p, '^\\d') then lpad(length(coalesce(nullif(ltrim(p, '0'), ''), '0'))::varchar, 5, '0') || coalesce(nullif(ltrim(p, '0'), ''), '0') else p end), '')"


@query("sel_08_library_order", f"with {D.DECKS} select deck_id, row_number() over (partition by folder_id order by {_SORT}, created_at desc, deck_id) as position from decks")
def sel_08(spark, sf):
    return L.library_order(A.decks(spark, sf)).select("deck_id", "position")


@query("sel_13_rate_limit", "with r as (select user_id as address, event_id as seq, epoch_us(ts) // 1000 as at_ms from events), h as (select *, count(*) over (partition by address order by at_ms range between 3599999 preceding and current row) - (row_number() over (partition by address, at_ms order by seq desc) - 1) as hits from r) select address, seq, hits, hits > 3 as limited from h")
def sel_13(spark, sf):
    requests = table(spark, sf, "events").select(F.col("user_id").alias("address"), F.col("event_id").alias("seq"), A.millis(F.col("ts")).alias("at_ms"))
    return L.rate_limited(requests, 3, 3_600_000).select("address", "seq", "hits", "limited")


# Schedules


@query("srs_01_schedules", D.schedules())
def srs_01(spark, sf):
    return S.schedules(A.reviews(spark, sf))


_DAYS = f"((due_ms // {X.DAY_MS}) - ({D.NOW} // {X.DAY_MS}))"
_MONTHS = f"floor({_DAYS} / 30 + 0.5)::bigint"


@query("srs_04_labels", f"with {D.STUDY} select card_id, case when due_ms is null then 'New' when {D.DUE} then 'Due' else 'Due ' || case when {_DAYS} <= 0 then 'today' when {_DAYS} = 1 then 'tomorrow' when {_DAYS} < 31 then 'in ' || {_DAYS} || ' days' when {_MONTHS} <= 1 then 'in a month' else 'in ' || {_MONTHS} || ' months' end end as label from study")
def srs_04(spark, sf):
    return A.study_cards(spark, sf).select("card_id", S.state_label(F.col("due_ms"), F.lit(A.NOW_MS).cast("long")).alias("label"))


# Sinks and mutations


@query("snk_04_update", "select c_custkey, case when o is not null then o else c_name end as c_name from customer left join (select o_custkey as c_custkey, max(o_orderpriority) as o from orders group by o_custkey) using (c_custkey)")
def snk_04(spark, sf):
    changes = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderpriority").alias("c_name"))
    return L.updated(table(spark, sf, "customer").select("c_custkey", "c_name"), changes, "c_custkey", ["c_name"])


@query("snk_10_delete_folder", f"with {D.DECKS} select deck_id, case when folder_id not in (select n_nationkey from nation where n_regionkey = 4) then folder_id end as folder_id from decks")
def snk_10(spark, sf):
    gone = table(spark, sf, "nation").where("n_regionkey = 4").select(F.col("n_nationkey").cast("long").alias("folder_id"))
    return L.unfiled(A.decks(spark, sf), gone).select("deck_id", "folder_id")


@query("snk_15_export", f"with {D.CARDS}, d as (select distinct deck_id from cards union select conv_id from conversations union select -99), t as (select deck_id, string_agg(replace(replace(front, '&', 'and'), ';', ',') || '&' || replace(replace(back, '&', 'and'), ';', ','), ';' order by ord) || ';' as export from cards group by deck_id) select deck_id, coalesce(export, '') as export from d left join t using (deck_id)")
def snk_15(spark, sf):
    cards = A.cards(spark, sf)
    decks = cards.select("deck_id").union(table(spark, sf, "conversations").select("conv_id")).union(spark.range(-99, -98).toDF("deck_id")).distinct()
    return L.export(cards, decks)


@query("snk_16_file_name", f"select c_custkey, case when {D.slug('c_name')} = '' then 'deck' else replace({D.slug('c_name')}, ' ', '-') end || '.txt' as file_name from customer")
def snk_16(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", T.export_file_name(F.col("c_name")).alias("file_name"))


@query("scl_32_fetchable", f"select page_id, {D.fetchable('url')} as fetchable from (select page_id, url from pages union all select * from {fixtures.URLS.sql})")
def scl_32(spark, sf):
    return table(spark, sf, "pages").select("page_id", "url").union(fixtures.URLS.frame(spark)).select("page_id", T.fetchable(F.col("url")).alias("fetchable"))


@query("str_01_letter_spacing", f"with {D.LINES}, t as (select doc_id, line_no, line, {D.trim('line')} as t, {D.sub(D.trim('line'), r'\s+', '')} as j from lines) select doc_id, line_no, case when length(t) >= 3 and {D.like('t', r'^(\S\s)+\S$')} and length({D.sub('j', '[^A-Za-z0-9]', '')}) >= 2 then j else line end as line from t")
def str_01(spark, sf):
    return A.lines(spark, sf).select("doc_id", "line_no", T.letter_spaced(F.col("line")).alias("line"))


@query("str_18_truncated_code", f"with c as (select doc_id, text, left(text, {X.CODE_CHARS}) as c from documents where text is not null), p as (select *, length(c) - strpos(reverse(c), chr(10)) as cut from c) select doc_id, md5(case when length(text) <= {X.CODE_CHARS} then text else (case when strpos(c, chr(10)) > 0 and cut > 0 then left(c, cut) else c end) || chr(10) || '…' end) as code_md5 from p")
def str_18(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.md5(T.truncated_code(F.col("text"))).alias("code_md5"))


@query("jsn_08_clamp", f"with {D.LINES}, t as (select doc_id, line_no, {D.trim('line')} as t, left({D.trim('line')}, 40) as c from lines), l as (select *, case when contains(c, ' ') then length(c) - strpos(reverse(c), ' ') else -1 end as last from t) select doc_id, line_no, case when t = '' then null when length(t) <= 40 then t else rtrim(case when last > 24 then left(c, last) else c end, ' ') || '…' end as clamped from l")
def jsn_08(spark, sf):
    return A.lines(spark, sf).select("doc_id", "line_no", T.clamped(F.col("line"), 40).alias("clamped"))


@query("snk_02_cards_kept", f"with {D.CARDS}, t as (select deck_id, ord, trim(front, ' ') as front, trim(back, ' ') as back from cards) select deck_id, front, back, row_number() over (partition by deck_id order by ord) - 1 as position from t where front <> '' and back <> '' and {D.usable('front', 'back')}")
def snk_02(spark, sf):
    kept = A.cards(spark, sf).select("deck_id", "ord", F.trim("front").alias("front"), F.trim("back").alias("back"))
    kept = kept.where((F.col("front") != "") & (F.col("back") != "") & T.usable_card(F.col("front"), F.col("back")))
    return kept.select("deck_id", "front", "back", (F.row_number().over(Window.partitionBy("deck_id").orderBy("ord")) - 1).cast("long").alias("position"))


@query("set_03_missing", "select p_partkey from part anti join (select l_partkey as p_partkey from lineitem where l_quantity > 45) using (p_partkey)")
def set_03(spark, sf):
    covered = table(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return L.without(table(spark, sf, "part").select("p_partkey"), covered, "p_partkey")


@query("sel_02_options", "with o as (select p_partkey, list_transform(list_sort(list_transform([p_name, p_brand, p_type, p_name || '?'], lambda x: {'k': md5('quiz:' || p_partkey || ':' || x), 'x': x})), lambda s: s.x) as o, p_name from part) select p_partkey, array_to_string(o, '|') as options, list_position(o, p_name) - 1 as answer from o")
def sel_02(spark, sf):
    options = F.array("p_name", "p_brand", "p_type", F.concat("p_name", F.lit("?")))
    keyed = F.transform(options, lambda x: F.struct(F.md5(F.concat_ws(":", F.lit("quiz"), F.col("p_partkey").cast("string"), x)).alias("k"), x.alias("x")))
    rows = table(spark, sf, "part").select("p_partkey", "p_name", F.transform(F.array_sort(keyed), lambda s: s["x"]).alias("o"))
    return rows.select("p_partkey", F.array_join("o", "|").alias("options"), (F.array_position("o", F.col("p_name")) - 1).cast("long").alias("answer"))


@query("scl_33_folder_key", f"select c_custkey, lower({D.trim(D.sub('c_name', r'\s+', ' '))}) as key from customer")
def scl_33(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.lower(T.folder_name(F.col("c_name"))).alias("key"))
