"""Mixing against brute force and its SQL."""

import math

import duckdb
import pytest

from quern.llm import mixing, oracle

HOT = [(i, "w " * (i % 37 + (900 if i % 50 == 0 else 0)), "hot") for i in range(400)]
ROWS = HOT + [
    (1000, "a b c", "a"), (1001, "d " * 50, "a"), (1002, None, "b"), (1003, "", "b"), (1004, "x\ty\n z q", None),
    (1005, "k " * 20, None), (None, "n n", "a"), (1006, "e e", "É"), (1006, "e e", "É"), (1007, "t", "z"),
]
LABELS = [(1, 1, 0), (2, 0, 0), (2, 1, 0), (3, None, 1), (1001, 0, 1)]


def tables(spark):
    docs = spark.createDataFrame([(*r, 5) for r in ROWS], "doc_id long, text string, source string, size int").repartition(3)
    return docs, spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, capped = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        share = {s: (left - sum(capped.values())) * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 2.0 * sizes[s] for s in over}


def test_targets_and_amounts(spark):
    got = mixing.mix(*tables(spark)).collect()
    assert len(got) == len(ROWS)
    sizes, taken, largest = {}, {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
        largest[r.source] = max(largest.get(r.source, 0), r["size"])
        assert r.taken <= 2 * r["size"]
    want = brute_targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-9)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1
    again = mixing.mix(*tables(spark)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_against_sql(spark):
    docs, labels = tables(spark)
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
    con.register("labels", labels.toPandas().astype({"quality": "Int64"}))
    want = con.sql(oracle.MIXING).fetchall()
    got = mixing.mix(docs, labels).select("doc_id", "size", "source_size", "target", "taken").collect()
    key = lambda r: (str(r[0]), r[1], r[4])
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert a[:3] == b[:3] and a[4] == b[4] and math.isclose(a[3], b[3], rel_tol=1e-12, abs_tol=1e-12)


def test_each_row_is_given_as_often_as_it_is_taken(spark):
    # One id on unlike rows, null ids, a repeated row, and columns named as those used inside.
    rows = [(i, "w " * n, s, 7, f"c{i}", n) for i, n, s in ((1, 5, "a"), (1, 900, "a"), (None, 3, "b"), (None, 40, "a"), (2, 8, "b"), (2, 8, "b"), (3, 0, None))]
    rows += [(100 + i, "v " * (i % 9 + 1), "a", 7, "x", i) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _id int, _copy string, row int").repartition(3)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    found = mixing.mix(docs, carry=docs.columns).collect()
    assert len(found) == len(rows)
    want = sorted(str(tuple(r.row)) for r in found if r["size"] for _ in range(r.taken // r["size"]))
    assert sorted(str(tuple(r)) for r in out.collect()) == want and len(want) > len(rows)


@pytest.mark.parametrize("rows", [[], [(1, None, None)]])
def test_small(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert [(r.size if False else r["size"], r.target, r.taken) for r in mixing.mix(docs).collect()] == [(0, 0.0, 0)] * len(rows)
