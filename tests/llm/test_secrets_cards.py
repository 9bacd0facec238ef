"""Card numbers: the prefilter's spans are those of a search of the whole text."""

import random

from quern.llm import secrets as S


def searched(text):
    return [("card", m.start(), m.end()) for m in S._DIGITS.finditer(text) if S.luhn_ok(m)]


def test_cards_behind_other_digits():
    rng, scanner = random.Random(9), S.Scanner()
    texts = ["12345678 4111111111111111", "é 12345678 4111 1111 1111 1111.", "4111111111111111 12345678", "x12 34 4111111111111111"]
    parts = ["4111111111111111", "4111 1111 1111 1111", "12345678", "1", "00", " ", " ", "-", "x", "é", "--", "5500005555555559"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    assert searched(texts[0]) == [("card", 9, 25)]
    for text in texts:
        assert [s for s in scanner.spans(text) if s[0] == "card"] == searched(text), text
