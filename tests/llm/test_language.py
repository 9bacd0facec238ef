"""Language identification: accuracy on the held-out fold, and edge cases."""

import numpy as np

import os

import pytest
from pyspark.sql import functions as F

from quern.llm import language as L

DATA = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_held_out_accuracy(spark):
    out = L.op10_language(spark, DATA)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang", "text")
    rows = out.join(docs, "doc_id").where("held_out").select("lang", "lang_pred", "score", "rejected").collect()
    assert len(rows) > 250
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.rejected for r in rows) / len(rows) < 0.02
    folds = {r.doc_id: r.held_out for r in out.select("doc_id", "held_out").collect()}
    import zlib

    assert all(v == (zlib.crc32(str(k).encode()) % 3 == 1) for k, v in folds.items())


def test_edges(spark):
    texts = ["the cat and the dog", "der Hund und die Katze", "the end of the day", "das Ende und der Tag"] * 5
    rows = [(i, t, "de" if " und " in t else "en", "x") for i, t in enumerate(texts)]
    rows += [(100, None, "en", ""), (101, "", None, ""), (102, "12 34 !!", "de", ""), (None, "the cat", None, ""), (103, "é", None, None), (104, "und " * 200_000, "de", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string").repartition(3)
    model = L.fit(docs.where(~L.held_out(F.col("doc_id"))))
    got = {r.row.doc_id: r for r in L.identify(docs, model, carry=["doc_id"]).collect()}
    assert len(got) == len(rows)
    assert got[0].lang_pred == "en" and got[1].lang_pred == "de" and got[104].lang_pred == "de"
    for k in (100, 101, 102):
        assert (got[k].lang_pred, got[k].score, got[k].rejected) == ("und", 0.0, True)
    assert L.identified(docs, model).columns == docs.columns
    assert L.identify(docs.limit(0), model).collect() == []
    empty = L.fit(docs.limit(0))
    assert {r.lang_pred for r in L.identify(docs, empty).collect()} == {"und"}


def test_pieces_of_a_long_text(spark):
    text = "ab cd " * 400_000
    raw = b" " + b" ".join(text.encode().split()) + b" "
    assert L.features([text]).sum() == sum(len(raw) - n + 1 for n in L.GRAMS)


def test_prediction_by_plain_counts():
    """Counts of n-grams, weights and cosines one by one, against the model's."""
    import math
    from collections import Counter

    rng = np.random.default_rng(5)
    texts = ["Ein kurzer Text, mit Wörtern.", "a b", "ünï çødé 12 x", "The quick brown fox"]
    counts = L.features(texts)
    idf = rng.uniform(1, 3, L.SIZE).astype(np.float32)
    centroids = rng.uniform(0, 1, (5, L.SIZE)).astype(np.float32)
    centroids /= np.linalg.norm(centroids, axis=1, keepdims=True)
    model = L.Model(["p", "q"], idf, centroids, np.array([0, 0, 1, 1, 1]), np.full((2, L.CLASSES), -1.0))
    names, scores, _ = model.predict(texts)
    for i, text in enumerate(texts):
        raw = text.lower().encode()
        raw = b" " + b" ".join(bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in raw).split()) + b" "
        seen = Counter()
        for n, prime in zip(L.GRAMS, L._PRIMES):
            for at in range(len(raw) - n + 1):
                code = int.from_bytes(raw[at : at + n], "big")
                seen[((code * prime) & 0xFFFFFFFF) >> 20] += 1
        assert {k: int(v) for k, v in enumerate(counts[i]) if v} == dict(seen)
        v = {k: math.sqrt(n) * float(idf[k]) for k, n in seen.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        cos = [sum(x * float(c[k]) for k, x in v.items()) / norm for c in centroids]
        best = max(range(5), key=cos.__getitem__)
        assert names[i] == ["p", "p", "q", "q", "q"][best] and math.isclose(scores[i], cos[best], rel_tol=1e-4)
