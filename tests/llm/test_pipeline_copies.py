"""The pipeline's near-duplicate stage on planted near copies."""

import random

import corpus_pipeline


def test_near_copies_go_and_others_stay(spark):
    rng = random.Random(8)
    rows, copies = [], []
    for i in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        rows.append((i, " ".join(words), "x"))
        for k in range(1, 4):  # words replaced; five-word likeness of about 0.95, 0.91 and 0.86
            own = list(words)
            for at in rng.sample(range(200), k):
                own[at] = f"z{rng.randrange(5000)}"
            copies.append((1000 + len(copies) if k < 3 else None, " ".join(own), "x"))
    other = " ".join(f"v{rng.randrange(5000)}" for _ in range(50))
    rows += [(5000, other, "x"), (5000, other + " " + other[::-1], "x"), (None, "an unlike text without an id", None), (None, "another such text", None), (5001, None, "x")]
    docs = spark.createDataFrame(rows + copies + rows[:3] + [(None, "another such text", None)], "doc_id long, text string, source string").repartition(3)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(rows, key=str)
