"""Rejection of long texts in scripts that were never learned."""

import os
import random

import pytest

from quern.llm import language as L

DATA = "/root/testdata/sf0.01"
SCRIPTS = {"Cyrillic": (0x430, 0x450), "Greek": (0x3B1, 0x3CA), "Arabic": (0x621, 0x64B), "CJK": (0x4E00, 0x9000), "Latin letters by chance": (97, 123)}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_unknown_scripts_go_at_any_length(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model, rng = L.fit(docs), random.Random(6)
    for name, (low, high) in SCRIPTS.items():
        for words in (5, 50) if name.startswith("Latin") else (5, 50, 300, 2000):
            texts = [" ".join("".join(chr(rng.randrange(low, high)) for _ in range(rng.randint(2, 9))) for _ in range(words)) for _ in range(20)]
            assert sum(model.predict(texts)[2]) >= 19, (name, words)
    learned = [r.text for r in docs.where("lang is not null and text is not null").select("text").collect() if L.has_letter(r.text)]
    assert sum(model.predict(learned)[2]) <= 0.012 * len(learned)
