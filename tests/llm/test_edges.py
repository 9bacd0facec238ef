"""Edges of two operators' ways: keys that just so many fingerprints share, and what an index family forgets."""

import random

import numpy as np
import pytest

from quern.llm import simhash
from quern.llm.components import components
from quern.llm.repeats_text import IndexFamily


def _groups(fps):
    name = list(range(len(fps)))

    def root(i):
        while name[i] != i:
            i = name[i]
        return i

    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= 2:
                name[max(root(i), root(j))] = min(root(i), root(j))
    groups = {}
    for i, f in enumerate(fps):
        groups.setdefault(root(i), set()).add(f)
    return sorted(sorted(g) for g in groups.values())


@pytest.mark.parametrize("n", [simhash.PAIRS_UP_TO - 1, simhash.PAIRS_UP_TO, simhash.PAIRS_UP_TO + 1])
def test_keys_at_the_limit_of_pairs(spark, n):
    """The fingerprints differ in one block alone, so that they share every key without it; which are linked is what all pairs say."""
    rng = random.Random(n)
    at, width = simhash.BLOCKS[0]
    base = rng.getrandbits(64) & ~(((1 << width) - 1) << at)
    fps = [base | low << at for low in rng.sample(range(1 << width), n)]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    label = {r.node: r.component for r in components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))).collect()}
    groups = {}
    for f, s in zip(fps, signed):
        groups.setdefault(label.get(s, ("alone", s)), set()).add(f)
    assert sorted(sorted(g) for g in groups.values()) == _groups(fps)


@pytest.mark.parametrize("most", [7, 60, 10**6])
def test_an_index_family_tells_no_first_one(most):
    """What it tells does occur earlier, however much it forgets; what comes in order it tells in full, if it forgets nothing."""
    rng = np.random.default_rng(most)
    family, seen, missed = IndexFamily(most), set(), 0
    for doc in range(120):
        n = int(rng.integers(0, 25))
        whole = rng.integers(0, 150, n).astype(np.uint64)
        batch = [whole, whole * np.uint64(3), np.full(n, doc), np.zeros(n, np.int64), np.arange(n)]
        told = family.add(batch)
        for w, late in zip(whole.tolist(), told.tolist()):
            assert not late or w in seen
            missed += w in seen and not late
            seen.add(w)
    assert (missed == 0) == (most == 10**6)
