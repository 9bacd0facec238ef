"""Cards of all documents of the smallest tables against a walk from block to block, and the drafted ones against a walk from card to card.

What is asked about a text has queries with SQL of its own; here those columns are leaves, and the walks decide what is asked, in which order, and what goes.
"""

from pyspark.sql import functions as F

from quern.functions import fixed as X
from quern.functions import phrasing as P
from quern.functions import text as T
from quern.operators import drafting as G
from quern.plans import cards as C

SF = "/root/testdata/sf0.001"
ASK = {
    "label": lambda a, b: P.label_question(a), "heading": lambda a, b: P.heading_question(a), "term": lambda a, b: P.term_question(a), "age": lambda a, b: F.concat(a, F.lit(" — what age range?")), "which": lambda a, b: F.concat(a, F.lit(" — which item?")),
    "list": lambda a, b: P.list_question(a), "prints": lambda a, b: P.output_question(a, b), "written": lambda a, b: P.code_question(a, b), "looks": lambda a, b: P.diagram_question(a), "said": lambda a, b: a,
}


def leaves(blocks):
    c, clean = F.col, T.tidy(F.col("text"))
    age = lambda x: F.struct(P.softened(F.coalesce(G.heading_age(x)["name"], x)).alias("name"), G.heading_age(x)["age"].alias("age"))
    items = F.filter(F.transform("items", lambda i: T.tidy(i)), lambda i: i != "")
    return blocks.select(
        "*", clean.alias("clean"), F.size(T.words(clean)).alias("n_words"), F.coalesce(T.meaningful_label(c("text")), F.lit(False)).alias("text_ok"), F.coalesce(T.meaningful_label(c("heading")), F.lit(False)).alias("heading_ok"), age(c("text")).alias("text_age"), age(c("heading")).alias("heading_age"),
        T.term_definition(clean).alias("pair"), F.flatten(F.transform(T.sentences(clean), T.definitions)).alias("mined"), F.transform(items, lambda i: F.struct(i.alias("text"), T.term_definition(i).alias("pair"))).alias("said"),
    )


def walk(section, blocks, tables, summary):
    """``(question, a, b, back)`` of each card; ``question`` names a column function."""
    structured = any(b.kind in ("table", "list", "code", "image") for b in blocks)
    if not section.title and not structured:
        return []
    out, head, chip, prose = [], None, None, None
    for b in blocks:
        if b.kind == "heading":
            if b.level == 1:
                head = chip = None
            elif b.text_ok:
                head = b
        elif b.kind == "table":
            out += [("said", f, None, k) for f, k in tables.get((b.section_id, b.place), [])]
            head = None
        elif b.kind == "paragraph":
            prose = b.clean if b.n_words <= X.PROSE_WORDS else prose
            if b.clean[:1].isdigit() and len(b.clean) <= 24 and b.clean[-1:] not in ".!?":
                chip = b.clean
            elif b.heading and b.heading_ok:
                out.append(("label", b.heading, None, b.clean))
                head = None
            elif head:
                out.append(("heading", head.text, None, b.clean))
                if chip:
                    out.append(("age", head.text, None, chip))
                head = chip = None
            elif b.pair:
                out.append(("term", b.pair.term, None, b.pair["def"]))
            else:
                out += [("term", d.term, None, d["def"]) for d in b.mined]
        else:
            topic, good, split = (b.heading, b.heading_ok, b.heading_age) if b.heading is not None else (head.text, True, head.text_age) if head else (None, False, None)
            if topic is None and b.kind != "list":
                topic, good = section.title, section.title_ok
            if b.kind == "code":
                out += [("prints", topic, b.language, b.output)] * bool(b.output) + [("written", topic, b.language, prose)] * bool(good and prose)
            elif b.kind == "image":
                out += [("looks", topic, None, b.caption or prose)] * bool(good and (b.caption or prose))
            else:
                if not b.said:
                    continue
                if 2 * sum(i.pair is not None for i in b.said) >= len(b.said):
                    for i in b.said:
                        if i.pair:
                            out.append(("term", i.pair.term, None, i.pair["def"]))
                        elif good:
                            out.append(("which", topic, None, i.text))
                elif good:
                    out.append(("heading" if split.age else "list", split.name, None, "\n".join(f"• {i.text}" for i in b.said)))
                    if split.age or chip:
                        out.append(("age", split.name, None, split.age or chip))
                        chip = chip if split.age is None and not chip else None
            head = None
    if not structured and summary:
        out.insert(0, ("term", section.title.strip(), None, summary))
    return out[: X.SECTION_CARDS]


def asked(spark, rows):
    """Fronts in order, by the column functions."""
    frame = spark.createDataFrame([(i, q, a, b) for i, (q, a, b) in enumerate(rows)], "i long, q string, a string, b string")
    front = F.coalesce(*(F.when(F.col("q") == q, f(F.col("a"), F.col("b"))) for q, f in ASK.items()))
    return [r.front for r in frame.select("i", front.alias("front")).orderBy("i").collect()]


def walked(spark):
    blocks, sections = (df.cache() for df in C.with_fixture(spark, SF))
    rows, tables = {}, {}
    for b in leaves(blocks).orderBy("section_id", "place").collect():
        rows.setdefault(b.section_id, []).append(b)
    table = blocks.where("kind = 'table'").join(sections.select("section_id", "title"), "section_id")
    for t in table.select("section_id", "place", F.posexplode(G.table_cards(F.col("headers"), F.col("rows"), F.col("title")))).orderBy("section_id", "place", "pos").collect():
        tables.setdefault((t.section_id, t.place), []).append((t.col.front, t.col.back))
    texts = {s: "\n".join(b.text for b in r if b.kind == "paragraph" and b.text) for s, r in rows.items()}
    told = spark.createDataFrame([(s, texts[s]) for s in rows], "section_id long, said string").join(sections, "section_id").select("section_id", T.summary(F.col("title"), F.col("said")).alias("s")).where("s is not null")
    summaries = {r.section_id: r.s.back for r in told.collect()}
    found = []
    for s in sections.withColumn("title_ok", F.coalesce(T.meaningful_label(F.col("title")), F.lit(False))).collect():
        found += [(s, i, *x) for i, x in enumerate(walk(s, rows.get(s.section_id, []), tables, summaries.get(s.section_id)))]
    return [(s, i, q, front, back) for (s, i, q, _, _, back), front in zip(found, asked(spark, [x[2:5] for x in found]))]


def test_section_cards(spark):
    want = sorted((s.section_id, i, front, back) for s, i, _, front, back in walked(spark))
    got = sorted(tuple(r) for r in C.crd_02(spark, SF).select("section_id", "card", "front", "back").collect())
    assert len(want) > 100 and got == want


def test_drafted(spark):
    """Usable cards of a document in order; one goes if one that stayed has its front or says the same."""
    rows = sorted(((s.doc_id, s.place, i, s.section_id, q, front, back) for s, i, q, front, back in walked(spark)), key=lambda r: r[:3])
    cards = spark.createDataFrame([(i, r[0], r[3], *r[5:], r[4] in ("prints", "written"), r[4] == "looks", r[4] == "prints") for i, r in enumerate(rows)], "n long, doc_id string, section_id long, front string, back string, has_code boolean, has_image boolean, code_in_front boolean")
    usable = cards.where(T.usable_card(F.col("front"), F.col("back"))).withColumn("slug", T.slug(F.col("front"))).withColumn("include", T.dangling_reference(F.col("front"), F.col("code_in_front")).isNull()).cache()
    side = usable.select("doc_id", "n", "has_code", "has_image", *(T.content_words(F.col(x)).alias(f"{x}_w") for x in ("front", "back")), *(T.numbers(F.col(x)).alias(f"{x}_n") for x in ("front", "back")))
    a, b = (side.select("doc_id", *(F.col(c).alias(f"{k}_{c}") for c in side.columns if c != "doc_id")) for k in "ab")
    both = a.join(b, "doc_id").where("a_n < b_n and (a_has_code or not b_has_code) and (a_has_image or not b_has_image)")
    for x, share in (("front", X.DUPLICATE_FRONT), ("back", X.DUPLICATE_BACK)):
        both = both.where(~T.conflicting(F.col(f"a_{x}_n"), F.col(f"b_{x}_n")) & (F.least(F.size(f"a_{x}_w"), F.size(f"b_{x}_w")) >= X.MIN_WORDS) & (T.overlap(F.col(f"a_{x}_w"), F.col(f"b_{x}_w")) >= share))
    near = {(r.a_n, r.b_n) for r in both.collect()}
    kept, places, want = [], {}, []
    for c in usable.orderBy("n").collect():
        place = places[c.doc_id] = places.get(c.doc_id, -1) + 1
        if not any(k.doc_id == c.doc_id and (k.slug == c.slug or (k.n, c.n) in near) for k in kept):
            kept.append(c)
            want.append((c.doc_id, place, c.section_id, c.front, c.back, c.include))
    found = G.drafted(*C.with_fixture(spark, SF)).select("doc_id", "ord", "section_id", "front", "back", "include").collect()
    assert len(want) > 50 and sorted(map(tuple, found)) == sorted(want)
