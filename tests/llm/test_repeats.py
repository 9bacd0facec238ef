"""Removal of repeats against brute force."""

import hashlib
import random

import numpy as np

from quern.llm import repeats, repeats_text


def brute(rows):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, rows[i][1] is not None, (rows[i][1] or "").encode()))
    seen, out = set(), []
    for i in order:
        doc, text = rows[i]
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - 99):
            w = raw[s : s + 100]
            if w in seen:
                gone[s : s + 100] = True
            seen.add(w)
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        runs = int(np.sum(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        out.append((doc, len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows(seed, n=160):
    rng = random.Random(seed)
    words = ["the", "of", "and", "été", "to", "in", "a", "that", "it", "was", "🙂"]
    say = lambda k: " ".join(rng.choice(words) + rng.choice(["", "s", "ing", ","]) for _ in range(k))
    shared = [say(rng.randint(18, 120)) for _ in range(8)]
    line = say(60)
    out = []
    for i in range(n):
        parts = [say(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(shared)
            a = rng.randint(0, 40)
            parts += [p[a : len(p) - rng.randint(0, 40)], say(rng.randint(0, 5))]
        if i % 3 == 0:
            parts.append(line)
        if i % 17 == 0:
            parts.append("ab" * rng.randint(40, 200))
        out.append((i * 37 % 1009, " ".join(parts)))
    out += [(2000 + i, out[i % 5][1]) for i in range(30)]
    out += [(3000, None), (3001, ""), (3002, "x" * 99), (3003, "x" * 100), (3004, "x" * 101), (3005, "y" * 40_000), (None, out[3][1]), (None, out[4][1]), (5, out[6][1]), (5, out[6][1]), (5, None)]
    rng.shuffle(out)
    return out


def check(spark, data, parts=3):
    docs = spark.createDataFrame([(*r, "x") for r in data], "doc_id long, text string, copy string").repartition(parts)
    got = sorted(map(tuple, repeats.without_repeats(docs).collect()), key=str)
    assert got == brute(data)


def test_against_brute_force(spark):
    check(spark, rows(1))
    check(spark, [r for r in rows(2) if r[0] is not None and r[0] != 5], 5)


def test_small(spark):
    check(spark, [(1, "z" * 250)], 1)
    assert repeats.without_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_family_finds_what_is_earlier():
    rng = np.random.default_rng(3)
    family, seen = repeats_text.IndexFamily(), {}
    for b in range(40):
        n = int(rng.integers(1, 200))
        whole = rng.integers(0, 60, n).astype(np.uint64)
        key = whole % np.uint64(2)
        doc, copy, place = np.sort(rng.integers(b * 5, b * 5 + 8, n)), np.zeros(n, np.int32), rng.permutation(n).astype(np.int64) + 1000 * b
        got = family.add([whole, key, doc, copy, place])
        rows = sorted(range(n), key=lambda i: (doc[i], place[i]))
        for i in rows:
            k, at = (whole[i], key[i]), (doc[i], place[i])
            assert not got[i] or any(x < at for x in seen.get(k, [])), "told without cause"
            if any(x < at for x in seen.get(k, [])):
                assert got[i]
            seen.setdefault(k, []).append(at)
        sizes = [len(x[0]) for x in family.levels]
        assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:]))
