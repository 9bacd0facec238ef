"""Queries over keyed changes and selections, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import fixed as X
from quern.functions import phrasing as P
from quern.functions import text as T
from quern.operators import changes as C
from quern.operators import library as L
from quern.operators import schedule as S
from quern.operators import selection as E
from quern.plans import duck as D
from quern.plans.queries import query
from quern.runtime import table, work_path
from quern.sources import adapters as A
from quern.sources.fixtures import Fixture, literal

_CARDS = "cards as (select l_orderkey as deck_id, l_partkey as card_id, (l_linenumber - 1)::bigint as ord from lineitem), decks as (select o_orderkey as deck_id, o_custkey % 9 as card_count from orders)"


def _cards(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("deck_id"), F.col("l_partkey").alias("card_id"), (F.col("l_linenumber") - 1).cast("long").alias("ord"))


def _decks(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("deck_id"), (F.col("o_custkey") % 9).alias("card_count"))


@query("agg_09_next_position", f"with {_CARDS} select deck_id, coalesce(max(ord), -1) + 1 as next from cards group by deck_id")
def agg_09(spark, sf):
    return C.next_positions(_cards(spark, sf))


_NEW = "new as (select o_orderkey + (case when o_custkey % 5 = 0 then 100000000 else 0 end) as deck_id, o_custkey as card_id from orders where o_orderpriority = '1-URGENT')"


def _new(spark, sf):
    urgent = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'")
    return urgent.select((F.col("o_orderkey") + F.when(F.col("o_custkey") % 5 == 0, 100000000).otherwise(0)).alias("deck_id"), F.col("o_custkey").alias("card_id"))


@query(
    "snk_03_add_cards",
    f"with {_CARDS}, {_NEW}, after as (select * from cards union all select deck_id, card_id, coalesce((select max(ord) from cards c where c.deck_id = n.deck_id), -1) + row_number() over (partition by deck_id order by card_id) from new n) select deck_id, count(*) as n, max(ord) as last, sum(card_id * (ord + 1))::bigint as mark, max(card_count + added) as card_count from after left join (select d.deck_id, card_count, count(n.card_id) as added from decks d left join new n using (deck_id) group by all) using (deck_id) group by deck_id",
)
def snk_03(spark, sf):
    cards, decks = C.added(_cards(spark, sf), _decks(spark, sf), _new(spark, sf))
    found = cards.groupBy("deck_id").agg(F.count("*").alias("n"), F.max("ord").alias("last"), F.sum(F.col("card_id") * (F.col("ord") + 1)).alias("mark"))
    return found.join(decks, "deck_id", "left").select("deck_id", "n", "last", "mark", "card_count")


@query(
    "snk_05_delete_cards",
    f"with {_CARDS}, gone as (select p_partkey as card_id from part where p_size < 10), q as (select l_orderkey as deck_id, l_partkey as card_id, l_linenumber from lineitem) select deck_id, greatest(0, card_count - (select count(*) from cards c where c.deck_id = d.deck_id and card_id in (select card_id from gone))) as card_count, (select count(*) from cards c where c.deck_id = d.deck_id and card_id not in (select card_id from gone)) as cards, (select count(*) from q where q.deck_id = d.deck_id and card_id not in (select card_id from gone)) as questions from decks d",
)
def snk_05(spark, sf):
    gone = table(spark, sf, "part").where("p_size < 10").select(F.col("p_partkey").alias("card_id"))
    questions = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("deck_id"), F.col("l_partkey").alias("card_id"), "l_linenumber")
    cards, decks, questions = C.cards_deleted(_cards(spark, sf), _decks(spark, sf), questions, gone)
    n = lambda df, name: df.groupBy("deck_id").agg(F.count("*").alias(name))
    joined = decks.join(n(cards, "cards"), "deck_id", "left").join(n(questions, "questions"), "deck_id", "left")
    return joined.select("deck_id", "card_count", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("cards", "questions")))


@query(
    "snk_06_delete_decks",
    "with gone as (select c_custkey as deck_id from customer where c_acctbal < 0), t as (select 'decks' as name, c_custkey as deck_id, c_custkey as id from customer union all select 'cards', o_custkey, o_orderkey from orders union all select 'questions', o_custkey, l_orderkey * 10 + l_linenumber from lineitem join orders on l_orderkey = o_orderkey union all select 'infographics', page_id, page_id from pages) select name, deck_id, count(*) as n, sum(id)::bigint as ids from t anti join gone using (deck_id) group by name, deck_id",
)
def snk_06(spark, sf):
    orders = table(spark, sf, "orders")
    owned = table(spark, sf, "lineitem").join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    tables = {
        "decks": table(spark, sf, "customer").select(F.col("c_custkey").alias("deck_id"), F.col("c_custkey").alias("id")),
        "cards": orders.select(F.col("o_custkey").alias("deck_id"), F.col("o_orderkey").alias("id")),
        "questions": owned.select(F.col("o_custkey").alias("deck_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")),
        "infographics": table(spark, sf, "pages").select(F.col("page_id").alias("deck_id"), F.col("page_id").alias("id")),
    }
    gone = table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("deck_id"))
    left = [df.withColumn("name", F.lit(name)) for name, df in C.decks_deleted(tables, gone).items()]
    return reduce(DataFrame.union, left).groupBy("name", "deck_id").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query("snk_07_prune", "with q as (select l_orderkey as deck_id, l_partkey as card_id from lineitem), live as (select p_partkey as card_id from part where p_size <= 40) select deck_id, count(*) as removed from q anti join live using (card_id) group by deck_id")
def snk_07(spark, sf):
    live = table(spark, sf, "part").where("p_size <= 40").select(F.col("p_partkey").alias("card_id"))
    return C.pruned(_cards(spark, sf), live)[1]


@query("snk_08_rename", f"with {D.DECKS} select deck_id, coalesce(n_name || ' deck', name) as name from decks left join nation on deck_id = n_nationkey")
def snk_08(spark, sf):
    names = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("deck_id"), F.concat("n_name", F.lit(" deck")).alias("name"))
    return L.updated(A.decks(spark, sf), names, "deck_id", ["name"]).select("deck_id", "name")


REQUESTS = Fixture(
    "request_id long, folder_id long, name string",
    [(1, None, "Biology"), (2, None, "  "), (3, None, " algeria"), (4, 0, "ALGERIA"), (5, 1, "Algeria"), (6, 2, ""), (7, None, "United   States"), (8, None, "united kingdom "), (9, 3, "New  Name "), (10, 999, "Kenya"), (11, None, None)],
)


@query(
    "snk_09_folder_names",
    f"with {D.FOLDERS}, r as (select request_id, folder_id, {D.trim(D.sub('name', r'\s+', ' '))} as name from {REQUESTS.sql}), taken as (select *, exists (select 1 from folders f where lower({D.trim(D.sub('f.name', r'\s+', ' '))}) = lower(r.name) and f.folder_id is distinct from r.folder_id) as t from r) select request_id, folder_id, name, case when name = '' then 'empty' when t then 'duplicate' else 'ok' end as outcome from taken",
)
def snk_09(spark, sf):
    return C.folder_requests(REQUESTS.frame(spark), A.folders(spark, sf))


@query("snk_11_move", f"with {D.DECKS}, {D.FOLDERS}, m as (select o_custkey as deck_id, max(nullif(o_orderkey % 30, 7)) as f from orders where o_orderpriority = '2-HIGH' group by all) select deck_id, case when m.deck_id is null then d.folder_id when m.f is null then null when m.f in (select folder_id from folders) then m.f else d.folder_id end as folder_id from decks d left join m using (deck_id)")
def snk_11(spark, sf):
    moves = table(spark, sf, "orders").where("o_orderpriority = '2-HIGH'").groupBy(F.col("o_custkey").alias("deck_id")).agg(F.max(F.nullif(F.col("o_orderkey") % 30, F.lit(7))).alias("folder_id"))
    return C.moved(A.decks(spark, sf), moves, A.folders(spark, sf)).select("deck_id", "folder_id")


@query("snk_12_save_questions", "with n as (select l_partkey + (l_linenumber % 2) * 1000000 as question_id, max(l_comment) as stem from (select *, l_shipmode as l_comment from (select *, l_returnflag || l_linestatus as l_shipmode from lineitem)) where l_quantity = 50 group by all) select question_id, stem from n union all select p_partkey, p_name from part where p_partkey not in (select question_id from n)")
def snk_12(spark, sf):
    new = table(spark, sf, "lineitem").where("l_quantity = 50").groupBy((F.col("l_partkey") + (F.col("l_linenumber") % 2) * 1000000).alias("question_id")).agg(F.max(F.concat("l_returnflag", "l_linestatus")).alias("stem"))
    return C.upserted(table(spark, sf, "part").select(F.col("p_partkey").alias("question_id"), F.col("p_name").alias("stem")), new, "question_id")


@query("snk_13_application_skip", "with s as (select l_partkey + 100 as card_id, max(l_returnflag) as hash from lineitem where l_linenumber = 7 group by all) select p_partkey as card_id, coalesce(hash, case when p_size > 25 then p_brand end) as skip_hash from part left join s on p_partkey = card_id")
def snk_13(spark, sf):
    cards = table(spark, sf, "part").select(F.col("p_partkey").alias("card_id"), F.when(F.col("p_size") > 25, F.col("p_brand")).alias("skip_hash"))
    skips = table(spark, sf, "lineitem").where("l_linenumber = 7").groupBy((F.col("l_partkey") + 100).alias("card_id")).agg(F.max("l_returnflag").alias("skip_hash"))
    return L.updated(cards, skips, "card_id", ["skip_hash"])


_INFOGRAPHICS = "i as (select page_id as infographic_id, page_id % 7 as deck_id, page_id // 3 as created_at, case page_id % 5 when 0 then '' when 1 then null else html end as html from pages)"


@query("snk_14_infographics", f"with {_INFOGRAPHICS} select deck_id, infographic_id, row_number() over (partition by deck_id order by created_at desc, infographic_id) as position from i where length(html) > 0")
def snk_14(spark, sf):
    html = F.when(F.col("page_id") % 5 == 0, "").when(F.col("page_id") % 5 != 1, F.col("html"))
    rows = table(spark, sf, "pages").select(F.col("page_id").alias("infographic_id"), (F.col("page_id") % 7).alias("deck_id"), F.floor(F.col("page_id") / 3).alias("created_at"), html.alias("html"))
    return C.infographics_read(rows).select("deck_id", "infographic_id", "position")


@query("agg_06_counters", f'with {D.ANSWERS}, t as (select question_id, count(*) as a, count(*) filter (correct) as r, arg_max(correct, seq) as l from answers group by question_id) select p_partkey as question_id, p_size % 3 + coalesce(a, 0) as times_asked, coalesce(r, 0) as times_correct, case when a is not null then l else p_size > 25 end as last_correct from part left join t on p_partkey = question_id')
def agg_06_counters(spark, sf):
    questions = table(spark, sf, "part").select(F.col("p_partkey").alias("question_id"), (F.col("p_size") % 3).cast("long").alias("times_asked"), F.lit(0).cast("long").alias("times_correct"), (F.col("p_size") > 25).alias("last_correct"))
    return C.counters_upserted(questions, L.answer_tally(A.answers(spark, sf)))


def _states(spark, sf):
    return S.schedules(A.reviews(spark, sf)).select("card_id", F.struct(F.lit(True).alias("seen"), "due", "interval", "ease", "reps", "lapses", "last").cast(S.STATE).alias("s"))


def _flat(states):
    return states.select("card_id", "s.due", "s.interval", "s.ease", "s.reps", "s.lapses", "s.last")


_GRADED = "card_id, case card_id % 4 when 0 then 'again' when 1 then 'hard' when 2 then 'good' else 'easy' end"


@query("srs_05_review", D.schedules(f"select card_id, 9000000000000, {D.NOW} + 86400000 * 12000::bigint, grade from (select distinct {_GRADED} as grade from reviews where card_id % 3 <> 0)"))
def srs_05(spark, sf):
    grade = F.element_at(F.array(*map(F.lit, ("again", "hard", "good", "easy"))), (F.col("card_id") % 4 + 1).cast("int"))
    states = _states(spark, sf)
    # Some of the graded cards are gone.
    grades = states.where("card_id % 3 <> 0").select("card_id").union(spark.range(-3, 0).toDF("card_id")).withColumn("grade", F.when(F.col("card_id") < 0, "good").otherwise(grade))
    return _flat(C.reviewed(states, grades, F.lit(A.NOW_MS + 86400000 * 12000).cast("long")))


@query("srs_06_relearn", D.schedules(f"select distinct user_id, 9000000000000, {D.NOW} + 86400000 * 12000::bigint, 'again' from events where value < 20 and user_id in (select card_id from reviews)"))
def srs_06(spark, sf):
    answers = table(spark, sf, "events").select(F.col("user_id").alias("card_id"), (~(F.col("value") < 20)).alias("correct"))
    return _flat(C.relearned(_states(spark, sf), answers, F.lit(A.NOW_MS + 86400000 * 12000).cast("long")))


@query("agg_02_sparse_counts", f"with {D.STUDY}, s as (select deck_id, count(*) as n, count(*) filter ({D.DUE}) as due from study where due_ms is not null group by deck_id) select c_custkey as deck_id, coalesce(due, 0) as due, greatest(0, c_nationkey - coalesce(n, 0)) as new from customer left join s on c_custkey = deck_id")
def agg_02(spark, sf):
    decks = table(spark, sf, "customer").select(F.col("c_custkey").alias("deck_id"), F.col("c_nationkey").alias("card_count"))
    return E.sparse_counts(decks, A.study_cards(spark, sf).where("due_ms is not null"), A.NOW_MS)


@query("agg_11_rejections", "with v as (select case event_type when 'click' then true when 'view' then null else false end as ok, string_split(event_type || ',' || (case when value > 50 then 'NEW' else 'APPLIED' end), ',') as failed from events) select name, count(*) as n from (select unnest(failed) as name from v where not coalesce(ok, false)) group by name")
def agg_11(spark, sf):
    ok = F.when(F.col("event_type") == "click", True).when(F.col("event_type") != "view", False)
    failed = F.array("event_type", F.when(F.col("value") > 50, "NEW").otherwise("APPLIED"))
    return E.rejections(table(spark, sf, "events").select(F.col("event_id").alias("question_id"), ok.alias("ok"), failed.alias("failed")))


@query("agg_12_media", f"with {D.CARDS} select deck_id, count(*) filter (length(back) > 20) as included, bool_or(has_code or has_image) as any_media from cards group by deck_id")
def agg_12(spark, sf):
    return E.media(A.cards(spark, sf).withColumn("include", F.length("back") > 20))


@query("agg_13_session_tally", f"with {D.REVIEWS} select at_ms // 3600000 as session_id, count(*) filter (grade <> 'again') as known, count(*) filter (grade = 'again') as unknown, count(distinct card_id) as cards from reviews group by 1")
def agg_13(spark, sf):
    return E.session_tally(A.reviews(spark, sf).withColumn("session_id", F.floor(F.col("at_ms") / 3600000)))


_DECK = "c as (select p_brand as deck_id, p_partkey as ord, p_partkey as card_id, p_name as front, p_type || (case when p_size % 3 = 0 then '  ' || repeat('x', 200) else '' end) as back, case when p_size % 4 = 0 then '' when p_size % 4 = 1 then null else p_type end as topic, 'page ' || p_size as source from part)"


def _near(limit: int, chars: int, one: bool) -> str:
    cut = lambda x: f"case when length({x}) <= {chars} then {x} else left({x}, {chars}) || chr(10) || '…' end"
    clean = lambda x: D.trim(D.sub(x, r"\s+", " "))
    key = "lower(back)" if one else "ord::varchar"
    return f"""with {_DECK}, t as (select deck_id, ord, card_id, {cut(clean('front'))} as front, {cut(clean('back'))} as back, topic, source, (row_number() over (partition by deck_id order by ord) - 1) // 8 as batch from c),
r as (select b.deck_id, b.batch, n.ord, n.card_id, n.front, n.back, {key.replace('back', 'n.back').replace('ord', 'n.ord')} as key, min(case when n.topic <> '' and n.topic = b.topic then 0 when n.source <> '' and n.source = b.source then 1 else 2 end) as rank from t b join t n on b.deck_id = n.deck_id and b.batch <> n.batch where n.front <> '' and n.back <> '' group by all),
o as (select *, row_number() over (partition by deck_id, batch, key order by rank, ord) as turn from r), p as (select *, row_number() over (partition by deck_id, batch order by rank, ord) as position from o where turn = 1)
select deck_id, batch, position, card_id, md5(front || '|' || back) as text from p where position <= {limit}"""


def _deck(spark, sf):
    back = F.concat("p_type", F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("  "), F.repeat(F.lit("x"), 200))).otherwise(""))
    topic = F.when(F.col("p_size") % 4 == 0, "").when(F.col("p_size") % 4 != 1, F.col("p_type"))
    return table(spark, sf, "part").select(F.col("p_brand").alias("deck_id"), F.col("p_partkey").alias("ord"), F.col("p_partkey").alias("card_id"), F.col("p_name").alias("front"), back.alias("back"), topic.alias("topic"), F.concat(F.lit("page "), F.col("p_size").cast("string")).alias("source"))


@query("sel_06_neighbours", _near(X.NEIGHBOURS, X.NEIGHBOUR_CHARS, True))
def sel_06(spark, sf):
    return E.neighbours(_deck(spark, sf), 8).select("deck_id", "batch", "position", "card_id", F.md5(F.concat_ws("|", "front", "back")).alias("text"))


@query("jon_07_context_cards", _near(X.CONTEXTS, X.CONTEXT_CHARS, False))
def jon_07(spark, sf):
    found = E.neighbours(_deck(spark, sf), 8, X.CONTEXTS, X.CONTEXT_CHARS, one_of_back=False)
    return found.select("deck_id", "batch", "position", "card_id", F.md5(F.concat_ws("|", "front", "back")).alias("text"))


_ORDERED = f"c as (select l_orderkey as deck_id, l_linenumber as card_id, case when l_orderkey % 3 = 0 and l_linenumber = 2 then null else 10 - l_linenumber end as ord, {D.millis('l_shipdate')} as created_at from lineitem)"


@query("sel_07_card_order", f"with {_ORDERED}, k as (select *, case when bool_and(ord is not null) over (partition by deck_id) then ord else created_at end as key from c) select deck_id, card_id, row_number() over (partition by deck_id order by key nulls first, card_id) as position from k")
def sel_07(spark, sf):
    ord_ = F.when(~((F.col("l_orderkey") % 3 == 0) & (F.col("l_linenumber") == 2)), 10 - F.col("l_linenumber"))
    cards = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("deck_id"), F.col("l_linenumber").alias("card_id"), ord_.alias("ord"), A.millis(F.col("l_shipdate")).alias("created_at"))
    return E.card_order(cards).select("deck_id", "card_id", "position")


@query("sel_09_folder_filter", f"with {D.DECKS}, {D.FOLDERS}, p as (select deck_id, coalesce(f.folder_id::varchar, 'unfiled') as folder from decks d left join folders f using (folder_id)) select choice, deck_id from p join (values ('all'), ('unfiled'), ('3'), ('999')) v(choice) on choice in ('all', '999') or choice = folder")
def sel_09(spark, sf):
    decks, folders = A.decks(spark, sf), A.folders(spark, sf)
    return reduce(DataFrame.union, (E.in_folder(decks, folders, c).select(F.lit(c).alias("choice"), "deck_id") for c in ("all", "unfiled", "3", "999")))


@query("sel_10_style", "select l_orderkey, l_linenumber from lineitem where coalesce(case l_returnflag when 'A' then 'vignette' when 'N' then 'recall' end, 'recall') = 'recall'")
def sel_10(spark, sf):
    style = F.when(F.col("l_returnflag") == "A", "vignette").when(F.col("l_returnflag") == "N", "recall")
    return E.of_style(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", style.alias("style")), "recall").select("l_orderkey", "l_linenumber")


@query("sel_11_retest", "select o_orderkey from orders where (case when o_orderstatus <> 'P' then o_orderkey % 4 end) is distinct from o_custkey % 4")
def sel_11(spark, sf):
    answers = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey") % 4).alias("chosen"), (F.col("o_custkey") % 4).alias("correct_index"))
    return E.to_retest(answers).select("o_orderkey")


@query("sel_12_first_few", "select p_brand, p_partkey, place from (select *, row_number() over (partition by p_brand order by p_size, p_partkey) as place from part) where place <= 30")
def sel_12(spark, sf):
    return E.first_few(table(spark, sf, "part"), "p_brand", ["p_size", "p_partkey"], 30).select("p_brand", "p_partkey", "place")


@query("sel_14_scope", f"with {D.CARDS}, k as (select *, row_number() over (partition by deck_id order by ord) as card_id from cards) select deck_id, ord, md5(case when length(front) > 400 then left(front, 400) || '…' else front end) as front, md5(case when length(back) > 400 then left(back, 400) || '…' else back end) as back from k where card_id % 2 = 1")
def sel_14(spark, sf):
    numbered = A.cards(spark, sf).withColumn("place", F.row_number().over(Window.partitionBy("deck_id").orderBy("ord")))
    cards = numbered.withColumn("card_id", F.struct("deck_id", "place"))
    return E.in_scope(cards, numbered.where("place % 2 = 1").select(F.struct("deck_id", "place").alias("card_id"))).select("deck_id", "ord", F.md5("front").alias("front"), F.md5("back").alias("back"))


@query("set_01_union", f"with {D.DOCS} select 'section' as kind, doc_id as id, md5(text) as text from docs union all select 'page', page_id, md5(url) from pages")
def set_01(spark, sf):
    sections = A.documents(spark, sf).select(F.lit("section").alias("kind"), F.col("doc_id").alias("id"), F.md5("text").alias("text"))
    pages = table(spark, sf, "pages").select(F.lit("page").alias("kind"), F.md5("url").alias("text"), F.col("page_id").alias("id"))
    return sections.unionByName(pages)


@query("jon_01_card_of_place", f"with {D.STUDY}, q as (select deck_id, card_id, row_number() over (partition by deck_id order by card_id) as position from study where card_id % 2 = 0) select q.deck_id, position, q.card_id, due_ms from q join study using (card_id)")
def jon_01(spark, sf):
    cards = A.study_cards(spark, sf)
    queue = cards.where("card_id % 2 = 0").select("deck_id", "card_id", F.row_number().over(Window.partitionBy("deck_id").orderBy("card_id")).cast("long").alias("position"))
    return queue.join(cards.select("card_id", "due_ms"), "card_id").select("deck_id", "position", "card_id", "due_ms")


@query("jon_08_by_label", "with s as (select l_orderkey as batch_id, 'S' || l_linenumber as label, l_linenumber as place, l_orderkey * 10 + l_linenumber as section_id from lineitem), r as (select l_orderkey * 10 + l_linenumber as reply_id, l_orderkey as batch_id, case when l_linenumber % 4 = 3 then null else 'S' || (l_quantity::bigint % 9) end as label from lineitem), f as (select batch_id, arg_min(section_id, place) as first from s group by batch_id) select reply_id, coalesce(section_id, first) as section_id from r left join s using (batch_id, label) join f using (batch_id)")
def jon_08(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    sections = lines.select(F.col("l_orderkey").alias("batch_id"), F.concat(F.lit("S"), F.col("l_linenumber").cast("string")).alias("label"), F.col("l_linenumber").alias("place"), F.col("id").alias("section_id"))
    label = F.when(F.col("l_linenumber") % 4 != 3, F.concat(F.lit("S"), (F.col("l_quantity").cast("long") % 9).cast("string")))
    return E.by_label(lines.select(F.col("id").alias("reply_id"), F.col("l_orderkey").alias("batch_id"), label.alias("label")), sections)


LINKS = Fixture(
    "page_id long, url string, final_url string",
    [(-1, "https://ex.org/a", "https://ex.org/b"), (-2, "https://ex.org/b/", "https://ex.org/b"), (-3, "http://ex.org/c?x=1", "https://ex.org/c?x=1#top"), (-4, "https://ex.org/d", "https://other.org/"), (-5, "ex.org/a", "https://ex.org/a/")],
)


@query("jon_09_redirects", f"with p as (select page_id % 10 as list_id, page_id, url, case when page_id % 6 = 0 then lead(url) over (partition by page_id % 10 order by page_id) else url end as final_url from pages union all select 0, * from {LINKS.sql}), k as (select *, {D.url_key('url')} as key, {D.url_key('final_url')} as final_key from p) select page_id, coalesce(final_key <> key and exists (select 1 from k l where l.list_id = k.list_id and l.key = k.final_key), false) as collides from k")
def jon_09(spark, sf):
    order = Window.partitionBy(F.col("page_id") % 10).orderBy("page_id")
    pages = table(spark, sf, "pages").select((F.col("page_id") % 10).alias("list_id"), "page_id", "url", F.when(F.col("page_id") % 6 == 0, F.lead("url").over(order)).otherwise(F.col("url")).alias("final_url"))
    links = LINKS.frame(spark).select(F.lit(0).cast("long").alias("list_id"), "page_id", "url", "final_url")
    return E.redirect_collisions(pages.union(links)).select("page_id", F.coalesce("collides", F.lit(False)).alias("collides"))


@query("jsn_10_card_hash", f"with {D.CARDS} select deck_id, ord, {D.card_hash('front', 'back')} as hash from cards")
def jsn_10(spark, sf):
    return A.cards(spark, sf).select("deck_id", "ord", T.card_hash(F.col("front"), F.col("back")).alias("hash"))


_STYLED = "q as (select l_partkey as card_id, case l_linestatus when 'O' then 'application' when 'F' then case when l_linenumber = 1 then null else 'recall' end end as style, 'Brand#' || (l_linenumber + 10) as hash, {'a': l_orderkey, 'b': l_linenumber} as seq from lineitem)"


@query("jon_03_needing_questions", f"with {_STYLED}, last as (select card_id, coalesce(style, 'recall') as style, arg_max(hash, seq) as hash from q group by all) select p_partkey as card_id, s.style, case when s.style = 'application' and p_size % 5 = 0 then 'skipped' else 'unwritten' end as state from part join (values ('recall'), ('application')) s(style) on true left join last l on l.card_id = p_partkey and l.style = s.style where l.hash is distinct from p_brand")
def jon_03(spark, sf):
    cards = table(spark, sf, "part").select(F.col("p_partkey").alias("card_id"), F.col("p_brand").alias("hash"), F.when(F.col("p_size") % 5 == 0, F.col("p_brand")).alias("skip_hash"))
    style = F.when(F.col("l_linestatus") == "O", "application").when(F.col("l_linenumber") != 1, "recall")
    questions = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("card_id"), style.alias("style"), F.struct("l_orderkey", "l_linenumber").alias("seq"), F.concat(F.lit("Brand#"), (F.col("l_linenumber") + 10).cast("string")).alias("hash"))
    found = [L.needing_questions(cards, questions, s).select("card_id", F.lit(s).alias("style"), F.when(F.col("skipped"), "skipped").otherwise("unwritten").alias("state")) for s in ("recall", "application")]
    return reduce(DataFrame.union, found)


@query("crd_16_language_names", "select p_partkey, name from part left join (values " + ", ".join(f"({literal(k)}, {literal(v)})" for k, v in X.LANGUAGES.items()) + ") v(tag, name) on tag = lower(case p_size % 5 when 0 then 'CPP' when 1 then 'Sh' when 2 then 'none' when 3 then 'tsx' else p_brand end)")
def crd_16(spark, sf):
    tag = F.when(F.col("p_size") % 5 == 4, F.col("p_brand")).otherwise(F.element_at(F.array(*map(F.lit, ("CPP", "Sh", "none", "tsx", ""))), (F.col("p_size") % 5 + 1).cast("int")))
    return table(spark, sf, "part").select("p_partkey", P.language_name(tag).alias("name"))


_QUEUES = "q as (select o_custkey as deck_id, list(o_orderkey order by o_orderkey) as queue from orders group by o_custkey)"


@query("sel_05_requeue", f"with {_QUEUES}, p as (select deck_id, queue, deck_id % len(queue) as position from q), a as (select *, least(position + 4, len(queue)) as upto from p) select deck_id, array_to_string(list_concat(list_concat(queue[1:upto], [queue[position + 1]]), queue[upto + 1:len(queue)]), ',') as queue from a")
def sel_05(spark, sf):
    q = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("deck_id")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("queue"))
    q = q.withColumn("position", (F.col("deck_id") % F.size("queue")).cast("int"))
    return q.select("deck_id", F.array_join(L.requeued(F.col("queue"), F.col("position"), F.get("queue", F.col("position"))), ",").alias("queue"))


@query("srs_03_due", f"with {D.STUDY} select card_id, {D.DUE} as due from study where due_ms is not null")
def srs_03(spark, sf):
    return A.study_cards(spark, sf).where("due_ms is not null").select("card_id", S.is_due(F.col("due_ms"), F.lit(A.NOW_MS).cast("long")).alias("due"))


@query("snk_01_saved_together", "select 'cards' as name, o_orderkey as id from orders where o_orderkey % 3 = 0 union all select 'decks', c_custkey from customer where c_custkey % 2 = 0")
def snk_01(spark, sf):
    root = work_path(spark, "decks")
    decks, cards = table(spark, sf, "customer").select(F.col("c_custkey").alias("id")), table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    C.saved_together({"decks": decks.limit(0), "cards": cards.limit(0)}, root)
    C.saved_together({"decks": decks.where("id % 2 = 0"), "cards": cards.where("id % 3 = 0")}, root)
    found = C.read_together(spark, root, ["decks", "cards"])
    return reduce(DataFrame.union, (df.select(F.lit(name).alias("name"), "id") for name, df in found.items()))
