"""Cards by rule, section division, outputs and payloads, on small documents with results worked out by hand."""

import json

from pyspark.sql import functions as F

from quern.operators import drafting as G

SECTIONS = "section_id long, doc_id long, place long, label string, title string"


def block(section, place, kind, **k):
    names = [c.split()[0] for c in G.BLOCKS.replace("array<array<string>>", "x").split(", ")]
    return tuple({"section_id": section, "place": place, "kind": kind, **k}.get(n) for n in names)


def sections(spark):
    return spark.createDataFrame([(1, 1, 0, "Page 1", "Insect growth"), (2, 1, 1, "Page 2", "Tides on coasts"), (3, 1, 2, "Page 3", None), (4, 2, 0, "Page 1", "Memory systems")], SECTIONS)


def blocks(spark):
    rows = [
        block(1, 0, "heading", level=1, text="Insect growth"),
        block(1, 1, "paragraph", text="0-2 yr"),
        block(1, 2, "heading", level=2, text="Larval stage"),
        block(1, 3, "paragraph", text="The larva feeds and sheds its skin several times."),
        block(1, 4, "paragraph", text="Moulting is the process in which an insect sheds its skin."),
        block(1, 5, "paragraph", heading="Key milestones", text="Wings and first flights appear;"),
        block(1, 6, "list", heading="PUPAL STAGE (2-7 yr)", items=["Resting", " Spinning "]),
        block(1, 7, "list", items=["Assimilation: fitting new things into old schemas", "Accommodation: changing schemas to fit new things", "other"]),
        block(1, 8, "table", headers=["Age", "Ability", ""], rows=[["12 mo", "Flies short distances", "x"], ["", "none", "y"], ["24 mo", "", "z"]]),
        block(2, 0, "paragraph", text="A tide returns about twice a day."),
        block(2, 1, "code", text="const [n, setN] = useState(0)", language="jsx", output="0"),
        block(2, 2, "image", heading="Lunar cycle", src="a.png"),
        block(2, 3, "image", src="b.png", caption="Each day has its own tides."),
        block(3, 0, "paragraph", text="No title and no structure."),
        block(4, 0, "paragraph", text="However, memory systems are the parts of the mind that keep what was learned for later."),
    ]
    return spark.createDataFrame(rows, G.BLOCKS)


def test_cards_of_sections(spark):
    got = {}
    for r in G.section_cards(blocks(spark), sections(spark)).orderBy("section_id", "card").collect():
        got.setdefault(r.section_id, []).append((r.front, r.back, r.front_code or r.back_code or r.image))
    assert got[1] == [
        ("What characterizes Larval stage?", "The larva feeds and sheds its skin several times.", None),
        ("Larval stage — what age range?", "0-2 yr", None),
        ("What is Moulting?", "the process in which an insect sheds its skin", None),
        ("What is important about Key milestones?", "Wings and first flights appear", None),
        ("What characterizes Pupal Stage?", "• Resting\n• Spinning", None),
        ("Pupal Stage — what age range?", "2-7 yr", None),
        ("What is Assimilation?", "fitting new things into old schemas", None),
        ("What is Accommodation?", "changing schemas to fit new things", None),
        ("At 12 mo, what is the ability?", "Flies short distances", None),
        ("Which age is associated with: Flies short distances?", "12 mo", None),
    ]
    code = "const [n, setN] = useState(0)"
    assert got[2] == [
        ("Tides on coasts — what does this JSX program print?", "0", code),
        ("Tides on coasts — how is this written in JSX?", "A tide returns about twice a day.", code),
        ("Lunar cycle — what does it look like?", "A tide returns about twice a day.", "a.png"),
        ("Tides on coasts — what does it look like?", "Each day has its own tides.", "b.png"),
    ]
    assert 3 not in got
    assert got[4][0] == ("What are Memory systems?", "memory systems are the parts of the mind that keep what was learned for later.", None)


def test_drafted_cards_are_usable_and_flagged(spark):
    got = G.drafted(blocks(spark), sections(spark)).orderBy("doc_id", "ord").collect()
    assert {r.include for r in got if "program print" in r.front} <= {True} and len(got) > 8
    assert all(r.front and r.back for r in got)


def test_outputs_are_attached(spark):
    rows = [
        (1, 0, "code", "print(1)", None), (1, 1, "paragraph", "It prints.", None), (1, 2, "heading", "Output:", None), (1, 3, "code", "1", None),
        (1, 4, "paragraph", "output", None), (1, 5, "code", "2", None),  # the program has an output by now
        (2, 0, "code", "a", None), (2, 1, "list", "x", None), (2, 2, "paragraph", "Output", None), (2, 3, "code", "b", None),
        (3, 0, "code", "far", None), (3, 1, "paragraph", "1", None), (3, 2, "paragraph", "2", None), (3, 3, "paragraph", "3", None), (3, 4, "paragraph", "Output", None), (3, 5, "code", "c", None),
    ]
    got = G.attached_outputs(spark.createDataFrame(rows, "doc_id long, place long, kind string, text string, output string")).collect()
    assert sorted((r.doc_id, r.place, r.output) for r in got if r.doc_id == 1) == [(1, 0, "1"), (1, 1, None), (1, 4, None), (1, 5, None)]
    assert [r.output for r in got if r.doc_id != 1] == [None] * 10


def test_runs(spark):
    rows = [(1, 0, "heading", 1, "Doc", 3), (1, 1, "paragraph", None, "lead", 10), (1, 2, "heading", 2, "A", 1), (1, 3, "paragraph", None, "a", 2000), (1, 4, "heading", 3, "A1", 2), (1, 5, "paragraph", None, "a1", 10), (1, 6, "heading", 2, "B", 1), (1, 7, "paragraph", None, "b", 10), (1, 8, "heading", 5, "deep", 4)]
    rows += [(2, 0, "paragraph", None, "no heading", 9000)]
    got = G.runs(spark.createDataFrame(rows, "doc_id long, place long, kind string, level int, text string, size int")).collect()
    assert {(r.doc_id, r.text): r.titles for r in got} == {
        (1, "lead"): ["Doc"], (1, "a"): ["Doc", "A"], (1, "a1"): ["Doc", "A", "A1"], (1, "b"): ["Doc", "B"], (1, "deep"): ["Doc", "B"], (2, "no heading"): [],
    }
    assert len({str(r.run) for r in got if r.doc_id == 1}) == 4


def test_payload_and_halves(spark):
    rows = [(1, i, k, f"t{i}", "c" if k == "code" else None, "alt" if k == "image" else None) for i, k in enumerate(["code", "image", "paragraph", "code"])]
    said = json.loads(G.payload(spark.createDataFrame(rows, "batch_id long, place long, kind string, text string, language string, alt string")).first().payload)
    assert [x.get("id") for x in said] == ["c1", "i1", None, "c2"] and "text" not in said[1]
    sized = spark.createDataFrame([(b, p, s) for b, s, n in ((1, 60_000, 3), (2, 10, 5), (3, 200_000, 1)) for p in range(n)], "batch_id long, place long, size long")
    got = {(r.batch_id, r.place): r.half for r in G.with_halved(sized).collect()}
    assert {k: v for k, v in got.items() if v} == {(1, 2): 1}


def test_days_of_a_zone(spark):
    from quern.operators import schedule as S

    ms = lambda s: F.unix_millis(F.to_timestamp(F.lit(s)))
    # 8 March 2026: clocks in New York go from 2 to 3; the day has 23 hours.
    row = spark.range(1).select(S.next_day(ms("2026-03-08T05:30:00Z"), "America/New_York").alias("a"), S.next_day(ms("2026-03-09T04:30:00Z"), "America/New_York").alias("b"), S.next_day(ms("2026-03-08T05:30:00Z")).alias("c")).first()
    assert (row.b - row.a) == 24 * 3_600_000 and row.a == 1_773_028_800_000 and row.c == 1_773_014_400_000


def test_written_out_fixtures(spark):
    """The fixtures beside the queries' tables give what was worked out by hand."""
    from quern.plans import cards as P

    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(G.attached_outputs(P.PROGRAMS.frame(spark)).select("doc_id", "place", "output")) == sorted(P.ATTACHED.rows, key=repr)
    assert rows(G.payload(P.PARTS.frame(spark))) == sorted(P.SAID.rows, key=repr)
    divided = G.runs(P.DIVIDED.frame(spark).drop("titles")).select("doc_id", "place", F.array_join("titles", " > "))
    assert rows(divided) == sorted(((d, p, t) for d, p, _, _, _, _, t in P.DIVIDED.rows if t is not None), key=repr)


def test_long_chains_of_neighbours(spark):
    """A walk over chains longer than there are rounds, with keys beside them, against one in Python."""
    import random

    from quern.operators import duplicates as N

    rng = random.Random(3)
    nodes, edges = [], []
    for deck in range(4):
        n = (300, 40, 40, 5)[deck]
        nodes += [(deck, i, i, None if rng.random() < 0.7 else f"k{rng.randrange(n // 3 + 1)}") for i in range(n)]
        edges += [(deck, i, i + 1) for i in range(n - 1)] if deck != 2 else [(deck, *rng.sample(range(n), 2)) for _ in range(60)]
    kept = []
    for deck, item, _, key in nodes:
        near = {b if a == item else a for d, a, b in edges if d == deck and item in (a, b)}
        if not any(d == deck and (i in near or (key is not None and k == key)) for d, i, k in kept):
            kept.append((deck, item, key))
    found = N.greedy(spark.createDataFrame(nodes, "deck long, item long, place long, key string"), spark.createDataFrame(edges, "deck long, a long, b long"), "deck").select("deck", "item", "key")
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(kept, key=repr)
