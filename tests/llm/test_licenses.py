"""Licence scan: its SQL, base places by definition, changed notices, the plan, and odd rows."""

import random
import re

import duckdb

from quern.llm import licenses as L
from quern.llm import oracle

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def base_of(text):
    found = WORD.findall((text or "").translate(LOWER))
    places = [(i, label) for label, phrase in L.BASE for i in range(len(found)) if found[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(found), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def against(spark, folder, files):
    got = L.op13_licenses(spark, folder)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{files}')")
    found = con.execute(oracle.LICENSES)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(got.columns)
    rows = sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in got.select(*names).collect()), key=repr)
    assert rows == sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in found.fetchall()), key=repr)
    return got


def test_given_table(spark):
    got = against(spark, SF, f"{SF}/documents.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = sorted(((d.doc_id, *base_of(d.text)) for d in docs), key=repr)
    assert sorted(map(tuple, got.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()), key=repr) == want
    assert any(x[2] for x in want)


def notice(label, at=0):
    return [t for x, t in L.NOTICES if x == label][at].split()


def test_changed_notices(spark):
    rng = random.Random(8)
    junk = lambda n: [f"j{rng.randint(0, 999)}" for _ in range(n)]
    apache, mit = notice("apache", 1), notice("mit", 1)
    put_in = apache[:9] + ["really", "truly"] + apache[9:]
    left_out = mit[:12] + mit[13:]
    half = mit[: len(mit) // 2]
    scattered = [w for i, x in enumerate(apache) for w in (x, f"s{i}")]
    texts = [junk(30) + put_in + junk(9), junk(3) + left_out, half + junk(4), scattered, apache + junk(50) + apache]
    found = L.scan(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.labels for r in found] == ["apache", "mit", "", "", "apache"]
    assert [(s.start, s.end) for s in found[0].spans] == [(30, 30 + len(put_in))]
    assert found[0].score == 1 and 0.8 <= found[1].score < 1 and found[2].score == 0
    assert [(s.start, s.end) for s in found[4].spans] == [(0, len(apache)), (len(apache) + 50, 2 * len(apache) + 50)]


def test_odd_rows(spark, tmp_path):
    rng = random.Random(6)
    bits = ["cc", "by", "CC-BY", "General", "public license", "All Rights", "reserved.", "K", "İ", "ALL", "é", "x" * 50, *(t for _, t in L.NOTICES)]
    docs = [(rng.choice([None, *range(30)]), rng.choice([" ", "\n", ", "]).join(rng.choice(bits) for _ in range(rng.choice([0, 1, 2, 9, 60]))), "x", 3) for _ in range(120)]
    docs += [(1, None, "x", 3), (None, None, "x", 3), (2, "", "x", 3), (3, "...", "x", 3), (4, "cc by", "x", 3), (5, "cc", "x", 3)] + docs[:6]
    docs += [(6, "all rights reserved " * 20_000 + "cc by", "x", 3)]
    made = spark.createDataFrame(docs, "doc_id long, text string, label string, size int")
    made.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = against(spark, str(tmp_path), f"{tmp_path}/documents.parquet/*.parquet")
    want = sorted(((k, *base_of(t)) for k, t, *_ in docs), key=repr)
    assert sorted(map(tuple, got.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()), key=repr) == want
    assert L.scan(made.limit(0)).collect() == []


def test_plan_is_native_with_one_shuffle(spark):
    plan = L.op13_licenses(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "BroadcastHashJoin" in plan and "Python" not in plan
