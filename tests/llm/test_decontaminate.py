"""Decontamination against brute force."""

import random
import re

from pyspark.sql import functions as F

from quern.llm import decontaminate as D


def brute_words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    windows = {}
    for name, text in items:
        w = brute_words(text)
        m = min(13, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            windows.setdefault(tuple(w[i : i + m]), set()).add("" if name is None else str(name))
    out = []
    for doc, text in docs:
        w, hit, found = brute_words(text), set(), set()
        for m in {len(k) for k in windows}:
            for i in range(len(w) - m + 1):
                if tuple(w[i : i + m]) in windows:
                    found |= windows[tuple(w[i : i + m])]
                    hit |= set(range(i, i + m))
        out.append((str(doc), len(w), len(hit), ",".join(sorted(found))))
    return sorted(out)


def tables(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["É", "ß-x", "A1"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, say(rng.choice([14, 20, 40, 13, 12]))) for i in range(12)]
    items += [(99, "Rare pair"), (100, None), (101, "..."), (102, items[0][1]), (None, say(15)), (103, "w1 w2 w3")][: 6 if seed % 2 else 5]
    docs = []
    for i in range(60):
        t = say(rng.randint(0, 80))
        if i % 3 == 0:
            other = brute_words(rng.choice(items)[1])
            a = rng.randint(0, 5)
            t = t + ", " + " / ".join(other[a : a + rng.randint(5, 40)]).upper() + " " + say(3)
        docs.append((i, t))
    docs += [(70, None), (71, ""), (None, "rare PAIR"), (3, items[1][1]), (3, items[1][1])]
    return docs, items


def check(spark, seed, **options):
    docs, items = tables(seed)
    a = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, spans string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = D.contamination(a, b, **options).select("doc_id", "n_words", D.n_hit(F.col("spans")).alias("h"), F.array_join("items", ",").alias("i")).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == brute(docs, items)


def test_against_brute_force(spark):
    check(spark, 1)
    check(spark, 2)


def test_in_blocks(spark):
    check(spark, 3, block_bytes=300)


def test_removal_and_matches(spark):
    docs, items = tables(2)
    a = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, items string")
    b = spark.createDataFrame(items, "item_id long, text string")
    kept = D.decontaminate(a, b)
    assert kept.columns == a.columns
    want = [d for d, n, h, _ in brute(docs, items) if not (h and 20 * h >= n)]
    assert sorted(str(r.doc_id) for r in kept.collect()) == want
    for r in D.longest_matches(a.where("doc_id < 60 and doc_id <> 3"), b).collect():
        d, t = brute_words(docs[r.doc_id][1]), brute_words(next(x for n, x in items if ("" if n is None else str(n)) == r.item_id))
        assert d[r.doc_word : r.doc_word + r.n_words] == t[r.item_word : r.item_word + r.n_words]
        e, f = r.doc_word + r.n_words, r.item_word + r.n_words
        assert e == len(d) or f == len(t) or d[e] != t[f]


def test_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [tuple(r)[:4] for r in D.contamination(docs, none).collect()] == [(1, 2, [], [])]
    assert D.contamination(docs.limit(0), none).collect() == []


def test_longest_match_of_each_document(spark):
    docs, items = tables(4)
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    best = {}
    for r in D.longest_matches(a, b).collect():
        best[r.doc_id] = max(best.get(r.doc_id, 0), r.n_words)
    for options in ({}, {"block_bytes": 200}):
        got = [(r.doc_id, r.longest.words if r.longest else 0) for r in D.contamination(a, b, **options).collect()]
        one = [d for d, _ in got]
        assert {d: n for d, n in got if one.count(d) == 1} == {d: best.get(d, 0) for d in one if one.count(d) == 1} and best
