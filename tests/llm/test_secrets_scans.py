"""The added kinds against a search of the whole text, and hostile texts."""

import base64
import random
import re
import time

import pytest

pytest.importorskip("ahocorasick")

from quern.llm import secrets as S  # noqa: E402

KEY_BLOCK = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----[A-Za-z0-9+/=\s:,-]*?-----END \1-----")
WHOLE = {
    "prefixed": (re.compile(r"(?:gh[pousr]|npm)_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])"), S.prefixed_ok),
    "jwt": (re.compile(r"(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"), S.jwt_ok),
    "key_block": (KEY_BLOCK, lambda m: True),
    "account": (re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[0-9A-Z]){11,30}(?![0-9A-Za-z])"), S.account_ok),
    "card": (re.compile(r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])", re.ASCII), S.luhn_ok),
}


def pieces(rng):
    body = "".join(rng.choice("abcXYZ0189") for _ in range(30))
    import zlib

    token = f"ghp_{body}{S.base62(zlib.crc32(body.encode()), 6)}"
    header = base64.urlsafe_b64encode(b'{"alg":"HS256"}').decode().rstrip("=")
    return [
        token, token[:-1] + "!", f"{header}.e30.x_-", header, header + ".", "eyJ", f"{header}.{header}.{header}.q", "4111111111111111", "4111 1111 1111 1111", "4111111111111112", "12345678 ",
        "GB82WEST12345698765432", "DE89ABCDEFGHIJKLMNOP", "GB82 WEST 1234 5698 7654 32", "GB83WEST12345698765432", "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----", "-----END PRIVATE KEY-----",
        "AAAA+/=\n", "é", " ", "\n", ".", "_", "word", "7", "{", "-----",
    ]


def test_added_kinds_equal_a_search_of_the_whole_text():
    rng, scanner, seen = random.Random(3), S.Scanner(), set()
    parts = pieces(rng)
    for _ in range(6000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        got = scanner.spans(text)
        for kind, (pattern, ok) in WHOLE.items():
            want = [(m.start(), m.end()) for m in pattern.finditer(text) if ok(m)]
            assert [(a, b) for k, a, b in got if k == kind] == want, (kind, text)
            seen |= {kind} if want else set()
    assert seen == set(WHOLE)


@pytest.mark.parametrize(
    "text",
    [
        "eyJ" * 1_700_000,
        "-----BEGIN PRIVATE KEY-----" * 190_000,
        "".join(f"-----BEGIN A{i} PRIVATE KEY-----" for i in range(150_000)),
        "token" * 1_000_000,
        "AKIA" * 1_250_000,
        "1 " * 2_500_000,
        "eyJa.eyJa." * 500_000,
    ],
    ids=["jwt", "headers", "kinds of headers", "keywords", "access", "digits", "dots"],
)
def test_long_hostile_texts_take_linear_time(text):
    began = time.monotonic()
    S.Scanner().spans(text)
    assert time.monotonic() - began < 30


def test_deeply_nested_header_is_no_token():
    deep = base64.urlsafe_b64encode(b'{"alg":' + b"[" * 200_000).decode().rstrip("=")
    assert [s for s in S.Scanner().spans(f"{deep}.e30.x") if s[0] == "jwt"] == []


def test_account_of_letters_alone():
    assert S.Scanner().spans("pay DE89ABCDEFGHIJKLMNOP now") == [("account", 4, 24)]


def test_header_that_is_a_string_is_no_token():
    told = base64.urlsafe_b64encode(b'"alg and more text"').decode().rstrip("=")
    assert not S.jwt_ok(re.match(r"(.+)", told))
