"""SimHash against brute force."""

import random

import xxhash

from quern.llm import simhash


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_groups(rows):
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 2:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            r = find(i)
            least[r] = min(least.get(r, doc), doc)
    return sorted((str(doc), fp, least.get(find(i))) for i, (doc, fp) in enumerate(rows))


def test_fingerprints_and_groups(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)] + ["Über", "É", "ÀB", "x y"]
    texts = [None, "", "  \n", "One", "one two", "one two\tthree", "A b c d"]
    for _ in range(40):
        t = [rng.choice(words) for _ in range(rng.randint(1, 60))]
        texts += [" ".join(t), "\n".join(t).upper()]
        t[rng.randrange(len(t))] = "zz"
        texts.append(" ".join(t))
    rows = [(i * 3 % 127, t, "x") for i, t in enumerate(texts)] + [(None, "one two", "y"), (5, texts[-1], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(3)
    got = sorted((str(r.doc_id), r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(df).collect())
    want = brute_groups([(d, brute_fingerprint(t)) for d, t, _ in rows])
    assert got == want


def test_links_through_a_crowded_key(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(3)]
    fps = {b ^ sum(1 << x for x in rng.sample(range(64), rng.randint(0, 4))) for b in base for _ in range(150)}
    fps |= {base[0] ^ rng.getrandbits(13) for _ in range(200)}
    rows = [(i, f) for i, f in enumerate(sorted(fps))]
    signed = [(f - 2**64 if f >> 63 else f,) for _, f in rows]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"))
    from quern.llm.components import components

    label = {r.node % 2**64: r.component for r in components(edges).collect()}
    want = brute_groups(rows)
    groups = {}
    for doc, fp, name in want:
        groups.setdefault(name, set()).add(fp)
    for g in groups.values():
        assert len({label.get(f, f) for f in g}) == 1
    assert len({label.get(f, ("own", f)) for f in fps}) == len(groups)


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
