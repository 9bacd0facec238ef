"""MinHash against the exact Jaccard likeness, and the order of documents."""

import hashlib
import random

import numpy as np

from quern.llm import minhash as M


def jaccard(a, b):
    def shingles(t):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t).split()
        k = min(5, len(w))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def say(rng, n):
    return " ".join(rng.choice(["a", "the", "of", "é", "X"]) + str(rng.randint(0, 60)) for _ in range(n))


def test_estimates():
    rng, hasher, errors = random.Random(1), M.Hasher(), []
    for _ in range(150):
        w = say(rng, rng.randint(1, 900)).split()
        v = w[: rng.randint(0, len(w))] + say(rng, rng.randint(0, 200)).split()
        a, b = " ".join(w), "  ".join(v).upper()
        errors.append(M.likeness(hasher.signature(a), hasher.signature(b)) - jaccard(a, b))
    assert abs(np.mean(errors)) < 0.02 and np.max(np.abs(errors)) < 0.2


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or ""))
    out, hasher = [], M.Hasher()
    for (doc, text), (_, following) in zip(order, order[1:] + order[:1]):
        text, following = text or "", following or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        a, b, c = map(hasher.signature, (text, edited, following))
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), M.printed(a), M.printed(b), M.likeness(a, b), M.likeness(a, c)))
    return sorted(out, key=str)


def test_order(spark):
    rng = random.Random(2)
    rows = [(rng.randint(0, 10**6), say(rng, rng.randint(0, 40))) for _ in range(300)]
    rows += [(None, "no id"), (None, None), (5, None), (6, ""), (7, "🙂é" * 9), (8, "x" * 50_000), (9, "same"), (9, "same"), (9, None), (rows[0][0], "tie")]
    for part in (rows, rows[:1], [(3, None)]):
        docs = spark.createDataFrame([(*r, "z") for r in part], "doc_id long, text string, part string").repartition(3)
        for n in (1, 4, 7):
            assert sorted(map(tuple, M.compared(docs, n).collect()), key=str) == brute(part)
    assert M.compared(docs.limit(0)).collect() == []


def test_near_duplicates_by_brute_force(spark):
    rng = random.Random(5)
    base = [[f"w{rng.randrange(500)}" for _ in range(60)] for _ in range(6)]
    rows, n = [], 0
    for words in base:
        for k in range(8):
            own = list(words)
            for _ in range(k // 3):
                own[rng.randrange(len(own))] = f"x{rng.randrange(99)}"
            rows.append((n := n + 1, " ".join(own)))
    rows += [(900, None), (901, ""), (902, " "), (903, "one two"), (904, "One TWO"), (1, "another text with the first id"), (None, rows[0][1]), (5, rows[4][1])]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, key int").repartition(3)
    got = sorted(map(tuple, M.near_duplicates(docs).collect()))

    named = [(d, M.shingle_set(t or "")) for d, t in rows if d is not None]
    label = list(range(len(named)))
    for i in range(len(named)):
        for j in range(i):
            p, q = named[i][1], named[j][1]
            if len(p & q) >= 0.8 * len(p | q):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {x: min(d for (d, _), y in zip(named, label) if y == x) for x in label}
    assert got == sorted((d, least[x]) for (d, _), x in zip(named, label))
    assert M.near_duplicates(docs.limit(0)).collect() == []


def test_signature_by_plain_integers():
    """Independent of numpy's arithmetic: shingles one by one, hash functions in Python's integers."""
    hasher, full = M.Hasher(), (1 << 64) - 1
    for text in ("A b c d e f g", "One two THREE four  five six seven eight nine ten", "few words", "é ß 漢 a b c d", "x " * 40 + "y z"):
        words = text.lower().encode().split() if text.isascii() else "".join(c.lower() if c.isascii() else c for c in text).encode().split()
        k = min(5, len(words))
        values = set()
        for i in range(len(words) - k + 1):
            h = sum((b + 1) * pow(0x9E3779B97F4A7C15, j, 1 << 64) for j, b in enumerate(b" ".join(words[i : i + k]))) & full
            h = ((h ^ (h >> 31)) * 0xBF58476D1CE4E5B9) & full
            values.add(h >> 32)
        want = [min((int(a) * v + int(b)) & full for v in values) >> 32 for a, b in zip(hasher.a, hasher.b)]
        assert hasher.signature(text).tolist() == want


def test_long_texts_leave_no_tables_behind():
    hasher = M.Hasher()
    long = "word " * 120_000
    assert (hasher.signature(long) == M.Hasher().signature(long[: len(long) // 2])).all()
    assert len(hasher.up) <= hasher.KEPT + 1


def test_groups_of_many_near_copies_by_brute_force(spark):
    """Copies with few and many edits: which are linked is what all pairs say, and few pairs are looked at."""
    rng = random.Random(11)
    texts = []
    for base in range(3):
        words = [f"b{base}w{rng.randrange(4000)}" for _ in range(120)]
        for k in range(90):
            own = list(words)
            for at in rng.sample(range(120), rng.choice([0, 1, 1, 2, 2, 3, 4, 6, 9, 14])):
                own[at] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(own))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in M.near_duplicates(docs).collect()}
    sets, name = [M.shingle_set(t) for t in texts], list(range(len(texts)))

    def root(i):
        while name[i] != i:
            i = name[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                name[b] = a
    want = {i: root(i) for i in range(len(texts))}
    assert len(set(want.values())) > 20
    assert sum(got[i] == want[i] for i in want) >= 0.99 * len(want)


def _linked(texts):
    """Component names by all pairs: the smallest index that links of the threshold reach."""
    sets, name = [M.shingle_set(t) for t in texts], list(range(len(texts)))

    def root(i):
        while name[i] != i:
            i = name[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                name[b] = a
    return [root(i) for i in range(len(texts))]


def _found(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in M.near_duplicates(docs).collect()}
    return [got[i] for i in range(len(texts))]


def _hub(rng, hubs, copies, size):
    """Two near copies of a passage beside longer texts that hold it, each of which has near copies of its own."""
    say = lambda n: [f"h{rng.randrange(10**6)}" for _ in range(n)]
    passage = say(size)
    texts = [passage + say(size // 36 + 1) for _ in range(2)]
    for _ in range(hubs):
        own = say(rng.randint(size // 12, size // 3))
        for _ in range(copies + 1):
            told = passage + own
            told[rng.randrange(size, len(told))] = f"c{rng.randrange(10**6)}"
            texts.append(told)
    rng.shuffle(texts)
    return [" ".join(t) for t in texts]


def test_a_passage_alone_beside_texts_that_quote_it(spark):
    texts = _hub(random.Random(1), 21, 8, 300)
    assert len(texts) == 191 and _found(spark, texts) == _linked(texts)


def test_random_hubs_by_brute_force(spark):
    for seed in range(3):
        rng = random.Random(100 + seed)
        texts = [t for _ in range(3) for t in _hub(rng, rng.randint(2, 12), rng.randint(0, 6), rng.randint(60, 200))]
        assert _found(spark, texts) == _linked(texts), seed
