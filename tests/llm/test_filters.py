"""Filter audit: its SQL, measures by plain Python, hash collisions, and odd rows."""

import random
from itertools import permutations

import duckdb
import numpy as np
import pyarrow as pa

from quern.llm import filters, oracle

SF = "/root/testdata/sf0.001"
WORDS = ["a", "B", "été", "I#", "x|y", "long" * 9, "🙂", "NASA", "\xa0", "\x1c", "z"]
GAPS = [" ", "\n", "\t", "\x0b", "\x0c\r", "  "]


def texts(seed, n=60):
    rng = random.Random(seed)
    made = ["".join(rng.choice(WORDS) + rng.choice(GAPS) for _ in range(rng.choice([0, 1, 3, 40, 260]))) for _ in range(n)]
    return made + [None, "", " ", "\n\n", "é", "A", " lead", "trail ", "\x00 \x7f"]


def measured(text):
    data = (text or "").encode()
    words = data.split()
    return len(text or ""), len(words), len(set(words)), sum(65 <= b <= 90 for b in data), sum(b in b"#$%&*|" for b in data)


NAMES = ("n_chars", "n_words", "n_distinct", "n_capitals", "n_symbols")


def test_scan_and_collisions():
    made = texts(1)
    for array in (pa.array(made), pa.array(["pad", *made])[1:], pa.array(made, pa.large_string())):
        for base in (filters.BASE, 1, 0):  # with 1 anagrams share a hash, with 0 all words of one first byte
            got = filters.scan(array, base)
            assert list(zip(*(got[c].tolist() for c in NAMES))) == [measured(t) for t in made]
    assert filters.scan(pa.array([], pa.string()))["n_words"].tolist() == []
    assert filters.scan(pa.array([None, ""], pa.string()))["n_distinct"].tolist() == [0, 0]


def test_long_text():
    text = "Ab cd " * 200_000 + "é" * 1_000_000
    assert [filters.scan(pa.array([text]))[c][0] for c in NAMES] == list(measured(text))


def test_orders_of_masks():
    rng = np.random.default_rng(3)
    n, good, toxic = rng.integers(0, 9, (3, 32))
    got = filters.orders_of(n, good, toxic)
    removed_by = dict.fromkeys("ABCDE", 0)
    for o, order in enumerate(permutations("ABCDE")):
        left = set(range(32))
        for k, x in enumerate(order):
            fails = {m for m in range(32) if m >> "ABCDE".index(x) & 1}
            assert got["removed"][o, k] == sum(n[m] for m in left & fails)
            assert got["redundant"][o, k] == sum(n[m] for m in fails - left)
            assert got["good_lost"][o, k] == sum(good[m] for m in left & fails)
            assert got["toxic_lost"][o, k] == sum(toxic[m] for m in left & fails)
            assert got["unique_fails"][o, k] == n[1 << "ABCDE".index(x)]
            removed_by[x] += got["removed"][o, k]
            left -= fails
            assert got["kept"][o, k] == sum(n[m] for m in left)
    assert all(got["shapley"][o, k] == removed_by[x] for o, order in enumerate(permutations("ABCDE")) for k, x in enumerate(order))


def against_sql(got, con):
    found = con.execute(oracle.FILTERS)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(got.columns)
    rows = sorted(map(tuple, got.select(*names).collect()))
    assert rows == sorted(found.fetchall())
    return rows


def test_against_sql_on_given_tables(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    rows = against_sql(filters.op11_filter_audit(spark, SF), con)
    assert len(rows) % 600 == 0 and rows


def test_odd_rows(spark, tmp_path):
    rng = random.Random(5)
    made = texts(2, 30) * 2
    docs = [(rng.choice([None, *range(40)]), t, rng.choice([None, "", "s", "t"]), "x") for t in made] + [(7, "same", "s", "x")] * 3
    labels = [(rng.randint(0, 40), rng.choice([0, 1, None]), rng.choice([0, 1, None]), 0) for _ in range(40)] + [(None, 1, 1, 0)]
    spark.createDataFrame(docs, "doc_id long, text string, source string, part string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int, fails int").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    against_sql(filters.op11_filter_audit(spark, str(tmp_path)), con)
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert filters.audit(none, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []
