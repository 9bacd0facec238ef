"""Periodic runs against a search by definition, the states' seeds, planted repeats, and odd rows."""

import hashlib
import random
import re
from fractions import Fraction
from zlib import crc32

import numpy as np
import pytest

from quern.llm import periodic as P

SF = "/root/testdata/sf0.001"


def by_definition(ids):
    """All runs: for each period, maximal stretches that have it, and of those only where it is the smallest."""
    n, out = len(ids), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if ids[i] != ids[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and ids[i] == ids[i + q]:
                i += 1
            length = i + q - s
            if length >= max(24, 3 * q):
                part = ids[s : s + length]
                if not any(part[k:] == part[:-k] for k in range(1, q)):
                    out.append((s, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def strings(seed):
    rng = random.Random(seed)
    for _ in range(150):
        ids = []
        for _ in range(rng.randint(1, 6)):
            kind = rng.random()
            if kind < 0.6:
                unit = [rng.randint(0, rng.choice([1, 2, 9])) for _ in range(rng.randint(1, 12))]
                if rng.random() < 0.3:
                    unit = unit * rng.randint(2, 3) + [rng.randint(0, 9)]
                ids += (unit * rng.randint(1, 14))[: rng.randint(1, 120)]
            else:
                ids += [rng.randint(0, 50) for _ in range(rng.randint(1, 40))]
            if ids and rng.random() < 0.2:
                ids[rng.randrange(len(ids))] = 99
        yield ids
    yield [0] * 300
    yield [0, 1] * 12
    yield [0] * 23
    yield [0] * 24
    yield list(range(8)) * 3
    yield list(range(8)) * 3 + [0]
    yield list(range(9)) * 2 + list(range(8))
    a, b = [0], [0, 1]  # Fibonacci words have as many runs as there can be
    while len(b) < 400:
        a, b = b, b + a
    yield b


@pytest.mark.parametrize("seed", range(8))
def test_runs_by_definition(seed):
    for ids in strings(seed):
        assert P.runs_of(np.array(ids)) == by_definition(ids), ids


def test_shared_hashes_lose_no_run(monkeypatch):
    monkeypatch.setattr(P, "_BASE", np.uint64(0))  # a sixteen's hash is its last word
    for ids in strings(99):
        assert P.runs_of(np.array(ids)) == by_definition(ids)


def test_primitive():
    for d in range(1, 40):
        for r in range(1, d + 1):
            unit = np.arange(d) % r
            assert P._primitive(unit, d) == (not any(d % k == 0 and (unit[k:] == unit[:-k]).all() for k in range(1, d)))


def plain(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if n and doc_id is not None and (h := crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = by_definition(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    tail = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *tail, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)), n)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_query_on_given_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert any(crc32(str(d.doc_id).encode()) % 10 == 0 for d in docs)
    assert rows(P.op12_periodic_runs(spark, SF)) == sorted((plain(d.doc_id, d.text) for d in docs), key=repr)


def test_odd_rows(spark, tmp_path):
    rng = random.Random(4)
    tell = lambda ids: rng.choice([" ", "\n", " \t"]).join(f"w{i}é" for i in ids)
    docs = [(rng.choice([None, *range(200)]), tell(ids), "x", 0) for ids in strings(50)]
    docs += [(k, t, "x", 0) for k, t in ((None, None), (3, None), (27, ""), (27, " \n"), (10, "one"), (27, "\xa0 \x1c " * 30), (-5, "a b " * 20))]
    docs += docs[:5]
    made = spark.createDataFrame(docs, "doc_id long, text string, runs string, start int")
    made.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    assert rows(P.op12_periodic_runs(spark, str(tmp_path))) == sorted((plain(k, t) for k, t, *_ in docs), key=repr)
    assert P.periodic_runs(made.limit(0)).collect() == []


def test_long_text(spark):
    text = "x " * 100_000 + "y z " * 100_000 + " ".join(map(str, range(100_000)))
    (row,) = P.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [tuple(r) for r in row.runs] == [(0, 100_000, 1), (100_000, 200_000, 2)]
    assert row.collapsed == "x y z " + " ".join(map(str, range(100_000)))
