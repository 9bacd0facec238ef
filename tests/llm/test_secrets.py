"""Secret scans against whole-text searches."""

import hashlib
import random
import re
import zlib

from quern.llm import secrets as S

PATTERNS = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 32),
}


def brute(text):
    out = []
    for i, (kind, (p, g, least)) in enumerate(PATTERNS.items()):
        out += [(m.start(), i, kind, m.end()) for m in p.finditer(text or "") if len(m[g]) >= least]
    return [(k, a, b) for a, _, k, b in sorted(out)]


def texts():
    rng = random.Random(5)
    parts = ["password", "PASSWD", "Secret", "token", "api_key", "ApiKey", '"', "'", " ", "  ", ":", "=", "==", "abcdefgh", "AKIA", "AKIA0123456789AB", "deadbeef" * 4, "0" * 31, "é", "ſecret", "toKen", "K", "\n", "x.y-z/w+v_u=", "12", "🙂"]
    yield from (None, "", "token=" + "a" * 200_000, "AKIA" * 5, "f" * 100_000)
    for _ in range(3000):
        yield "".join(rng.choice(parts) for _ in range(rng.randint(1, 25)))


def test_base_spans():
    scanner = S.Scanner()
    for t in texts():
        assert [s for s in scanner.spans(t) if s[0] in PATTERNS] == brute(t), t


def test_checksums():
    body = "abcDEF0123456789abcDEF01234567"
    good = "ghp_" + body + S.base62(zlib.crc32(body.encode()), 6)
    text = f"é {good} and ghp_{body}AAAAAA, card 4111 1111 1111 1111 not 4111 1111 1111 1112, GB82WEST12345698765432 not GB83WEST12345698765432"
    got = [(k, text[a:b]) for k, a, b in S.Scanner().spans(text)]
    assert got == [("prefixed", good), ("card", "4111 1111 1111 1111"), ("account", "GB82WEST12345698765432")]
    jwt = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxIn0.c2ln"
    key = "-----BEGIN RSA PRIVATE KEY-----\nMIIB\n-----END RSA PRIVATE KEY-----"
    assert [k for k, _, _ in S.Scanner().spans(f"{jwt} eyJxxxx.a.b {key} -----BEGIN PRIVATE KEY-----\nno")] == ["jwt", "key_block"]


def test_frame(spark):
    rows = [(i, t, "s") for i, t in enumerate(list(texts())[:200])] + [(None, "token=12345678", None), (7, "x", "y"), (7, "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string").repartition(3)
    got = S.scan(docs, carry=["doc_id"]).collect()
    key = lambda d, t: (str(d), S.joined(brute(t)))
    have = sorted((str(r.row.doc_id), r.base_sha256, r.n_assign + r.n_access + r.n_hex) for r in got)
    assert have == sorted((str(d), hashlib.sha256(key(d, t)[1].encode()).hexdigest(), len(brute(t))) for d, t, _ in rows)
    assert S.scan(docs.limit(0)).collect() == []
