"""Column functions by table: texts and what is expected of them."""

import pytest
from pyspark.sql import functions as F

from quern.functions import phrasing as P
from quern.functions import replies as J
from quern.functions import text as T
from quern.operators import library as L
from quern.operators import schedule as S
from quern.operators import structure as R

DAY = 86_400_000


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "f, given, expected",
    [
        (T.slug, "  Für Elise — No. 1 ", "f r elise no 1"),
        (T.slug, "日本", ""),
        (T.tidy, " a \n b; ", "a b"),
        (T.content_words, "Synchronizing the variables, synchronized 4 days", ["synchroniz", "variabl", "4", "days"]),
        (T.content_words, None, None),
        (T.numbers, "7 or 7.0 or 7", ["7", "7.0"]),
        (T.sentences, "One. Two! three? (Four) e.g. five", ["One.", "Two! three?", "(Four) e.g. five"]),
        (T.meaningful_label, "Limbic system (reward, emotion)", True),
        (T.meaningful_label, "For example:", False),
        (T.meaningful_label, "Functions are the primary", False),
        (T.meaningful_label, "Anyway, we can fix it", False),
        (T.dangling_reference, "What does this code print?", "this code"),
        (T.dangling_reference, "What is shown above?", "shown above"),
        (T.dangling_reference, "What is a closure?", None),
        (T.letter_spaced, "S P R I N G", "SPRING"),
        (T.letter_spaced, "( )", "( )"),
        (T.normal_spacing, "( 0 - 2 y r )", "(0-2 yr)"),
        (T.print_artifact, "Page 3 of 9", True),
        (T.page_title, "Tides: How the Moon Pulls – Ocean Notes", "Tides: How the Moon Pulls"),
        (T.url_key, "https://Ex.com/a/?q=1#x", "ex.com/a?q=1"),
        (T.url_key, "no address", "no address"),
        (T.fetchable, "http://10.0.0.1/x", False),
        (T.fetchable, "https://example.com/", True),
        (T.fetchable, "http://localhost:80/", False),
        (T.fetchable, "ftp://example.com/", False),
        (T.fetchable, "http://999.1.1.1/", False),
        (T.export_file_name, "Biology Ch. 3", "biology-ch-3.txt"),
        (T.export_file_name, "…", "deck.txt"),
        (J.fence_stripped, "```json\n[1]\n```", "[1]"),
        (P.be, "Features", "are"),
        (P.be, "Class", "is"),
        (P.singular, "Categories", "category"),
        (P.softened, "LARVAL STAGE", "Larval Stage"),
        (P.softened, "Mixed CASE", "Mixed CASE"),
        (P.language_name, "CPP", "C++"),
        (P.heading_question, "2. Attachment:", "What characterizes Attachment?"),
        (P.heading_question, "Characterized by", "Characterized by...?"),
        (P.label_question, "Why it matters", "Why it matters?"),
        (P.list_question, "Milestones", "What are the milestones?"),
        (P.term_question, "On exam", "On exam — what was found?"),
        (P.diagram_question, "Call stack", "Call stack — what does it look like?"),
    ],
)
def test_text(spark, f, given, expected):
    assert one(spark, f(F.lit(given).cast("string"))) == expected


def test_two_texts(spark):
    a, b = (T.content_words(F.lit(x)) for x in ("hand over control", "control handed over quickly"))
    assert one(spark, T.overlap(a, b)) == 1.0
    assert one(spark, T.overlap(a, T.content_words(F.lit("")))) == 0.0
    assert one(spark, T.conflicting(T.numbers(F.lit("4 days")), T.numbers(F.lit("7 days")))) is True
    assert one(spark, T.conflicting(T.numbers(F.lit("4 days")), T.numbers(F.lit("days")))) is False
    assert one(spark, T.card_hash(F.lit("a"), F.lit("b"))) == fnv("a\0b")
    assert one(spark, T.card_hash(F.lit("🙂"), F.lit(""))) == fnv("🙂\0")
    assert one(spark, T.usable_card(F.lit("What is a closure?"), F.lit("A function with its scope"))) is True
    assert one(spark, T.usable_card(F.lit("What is important about note?"), F.lit("It is short"))) is False
    assert one(spark, T.usable_card(F.lit("How is this written in C++?"), F.lit("int x;"))) is True
    assert one(spark, T.term_definition(F.lit("Closure: a function with its scope"))).asDict() == {"term": "Closure", "def": "a function with its scope"}
    assert one(spark, T.clamped(F.lit("one two three"), 9)) == "one two…"
    assert one(spark, T.truncated_code(F.lit("x" * 1000 + "\n" + "y" * 1000))) == "x" * 1000 + "\n…"
    said = one(spark, T.definitions(F.lit("A closure is a function with its scope.")))
    assert [d.asDict() for d in said] == [{"term": "closure", "def": "a function with its scope"}]


def fnv(text):
    h = 2166136261
    raw = text.encode("utf-16-be")
    for i in range(0, len(raw), 2):
        h = (h ^ int.from_bytes(raw[i : i + 2], "big")) * 16777619 & 0xFFFFFFFF
    return f"{h:x}"


def test_table_questions(spark):
    say = lambda *x: one(spark, P.table_question(*(F.lit(v).cast("string") for v in x)))
    assert say("Age", "2 mo", "Motor", "Motor milestones") == "At 2 mo, what are the motor milestones?"
    assert say("Domain", "Memory", "Normal aging", None) == "In normal aging, what is expected for memory?"
    assert say("Pattern", "Avoidant (~20%)", "Caregiver Pattern", "Attachment styles") == "What is the caregiver pattern in Avoidant attachment?"
    assert say(None, "Row", "Values", None) == "What are the values of Row?"


def test_schedule_ladder(spark):
    rows = [("a", i, t * DAY, g) for i, (t, g) in enumerate([(0, "good"), (1, "good"), (4, "good"), (12, "good"), (12, "easy"), (20, "again"), (20, "again"), (20, "easy")])]
    got = S.schedules(spark.createDataFrame(rows + [("b", 9, 5, "hard")], "card_id string, seq long, at_ms long, grade string")).collect()
    by = {r["card_id"]: r for r in got}
    # Intervals 1, 3, 8; the next good comes due on day 12 and gives 20; the easy on the same day does not count; only the first miss is a lapse.
    assert (by["a"]["interval"], by["a"]["reps"], by["a"]["lapses"], round(by["a"]["ease"], 9)) == (4, 1, 1, 2.3)
    assert (by["b"]["interval"], by["b"]["due"]) == (1, DAY + 5)


def test_library(spark):
    decks = spark.createDataFrame([(1, "Chapter 10", 1, 1.0), (2, "chapter 2", 1, 2.0), (3, "x", 9, 3.0), (4, "y", None, 4.0)], "deck_id long, name string, folder_id long, created_at double")
    folders = spark.createDataFrame([(1, "a"), (2, "b")], "folder_id long, name string")
    assert sorted(map(tuple, L.decks_by_folder(decks, folders).collect())) == [("1", 2), ("2", 0), ("unfiled", 2)]
    order = {r["deck_id"]: r["position"] for r in L.library_order(decks).collect()}
    assert order[2] < order[1]
    assert one(spark, L.requeued(F.array(*map(F.lit, "abcdef")), F.lit(0), F.lit("a"))) == list("abcdaef")
    assert one(spark, L.requeued(F.array(F.lit("a")), F.lit(0), F.lit("a"))) == ["a", "a"]


def test_rate_limit_counts_equal_times_in_order(spark):
    rows = spark.createDataFrame([("x", i, t) for i, t in enumerate([0, 0, 0, 59_999, 60_000])], "address string, seq long, at_ms long")
    got = {r["seq"]: (r["hits"], r["limited"]) for r in L.rate_limited(rows, 2).collect()}
    assert got == {0: (1, False), 1: (2, False), 2: (3, True), 3: (4, True), 4: (2, False)}


def test_furniture_and_navigation(spark):
    rows = [("d", s, b, t) for s in range(5) for b, t in enumerate(["Menu", f"own {s}", "Title 3"])]
    blocks = spark.createDataFrame(rows, "document string, section long, block long, text string")
    assert {r["text"] for r in R.without_furniture(blocks).collect()} == {f"own {s}" for s in range(5)}
    titles = spark.createDataFrame([("d", 3, "title 3")], "document string, section long, title string")
    assert {r["section"] for r in R.without_navigation(blocks, titles).where("text = 'Title 3'").collect()} == {3}


def test_names_sort_by_numbers_without_accents(spark):
    names = ["Chapter 10", "chapter 2", "Élan 3", "elan 03", "Zeta", "a" + "1" * 21 + "5", "a" + "1" * 21 + "9", "a2"]
    rows = spark.createDataFrame([(n,) for n in reversed(names)], "name string")
    got = [r.name for r in rows.orderBy(T.sort_key(F.col("name")), "name").collect()]
    assert got == ["a2", "a" + "1" * 21 + "5", "a" + "1" * 21 + "9", "chapter 2", "Chapter 10", "elan 03", "Élan 3", "Zeta"]


def test_addresses_in_any_spelling(spark):
    refused = ["http://[::1]/x", "http://[fe80::1]/", "http://[::ffff:10.0.0.1]/", "http://2130706433/", "http://0177.0.0.1/", "http://127.1/", "http://0x7f.0.0.1/", "http://[::ffff:7f00:1]/", "http://user@10.0.0.1/", "http://a.internal/"]
    allowed = ["http://8.8.8.8/", "http://[2001:db8::1]/", "https://example.org:8443/x", "http://172.32.0.1/"]
    rows = spark.createDataFrame([(u,) for u in refused + allowed], "u string")
    assert {r.u for r in rows.where(T.fetchable(F.col("u"))).collect()} == set(allowed)


def test_sentences_keep_digits_at_their_ends(spark):
    text = "0 one 0. Two 1 is 11"
    found = spark.range(1).select(T.sentences(F.lit(text)).alias("s")).first()["s"]
    assert found == ["0 one 0.", "Two 1 is 11"]


def test_clusters_hold_equal_values_together_in_any_order(spark):
    values = [5.0, 15.0, 23.0, 25.0, 27.0, 45.0, 45.0]
    for rows in (values, values[::-1], values[3:] + values[:3]):
        found = R.clusters(spark.createDataFrame([(1, v) for v in rows], "page int, x double").repartition(3), ["page"], "x", 12).collect()
        assert sorted((r["anchor"], r["n"]) for r in found) == [(19.0, 5), (45.0, 2)]


def test_card_hash_of_long_texts_is_linear(spark):
    import time

    front, back = "größer 😀 " * 20_000, "b"
    h = 2166136261
    raw = f"{front}\x00{back}".encode("utf-16-be")
    for i in range(0, len(raw), 2):
        h = (h ^ int.from_bytes(raw[i : i + 2], "big")) * 16777619 & 0xFFFFFFFF
    began = time.time()
    found = spark.createDataFrame([(front, back)], "f string, b string").select(T.card_hash(F.col("f"), F.col("b")).alias("h")).first()["h"]
    assert found == f"{h:x}"
    assert time.time() - began < 20
