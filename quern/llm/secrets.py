"""Secret scans: a keyword prefilter, anchored expressions near its hits, and embedded checksums.

One pass of an Aho-Corasick automaton over a text finds all keywords. An expression is tried
only where a keyword of its kind begins, anchored there, so the spans of a kind are those
that a search of the whole text would find, leftmost first and without overlap. Runs of
hexadecimal digits have no keyword; their prefilter is a search for 32 such characters in a
row in a copy of the text where they all look the same.

Base kinds are ``assign``, ``access`` and ``hex``. The method adds kinds whose secrets hold
their own proof, and drops candidates that fail it: tokens that end in the CRC-32 of the rest
in base 62, payment card numbers under the Luhn rule, bank account numbers under ISO 7064,
web tokens whose header decodes to JSON, and private key blocks with a footer of their kind.

Very long texts: every scan is linear in the text's length, however keywords repeat. Where an
expression fails, hits that must fail for the same reason are passed over: those in the same
run of token characters, and headers of key blocks whose footer does not follow.

Nulls: a null text is an empty one and has no spans. A null ``doc_id`` is kept. Repeated rows
each get a row, an empty table gives none. Spans that begin at one place are ordered by kind. Other columns are kept under ``row`` if asked for, whatever their names.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.rows import carried
from quern.runtime import bounded_batches

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "prefixed", "jwt", "key_block", "card", "account")
#: Keywords by kind; those of `assign` are found in either case.
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("AKIA",),
    "prefixed": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"),
    "jwt": ("eyJ",),
    "key_block": ("-----BEGIN ",),
}
_PREFIXED = re.compile(r"(?:gh[pousr]|npm)_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
_JWT = re.compile(r"(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
_TOKEN_RUN = re.compile(r"[A-Za-z0-9_-]+")
_KEY_HEADER = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----")
_KEY_FOOTER = re.compile(r"(?=-----END ((?:[A-Z0-9]+ )*PRIVATE KEY)-----)")
_KEY_BODY = re.compile(r"[A-Za-z0-9+/=\s:,-]*")
_DIGITS = re.compile(r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])", re.ASCII)
_ACCOUNT = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[0-9A-Z]){11,30}(?![0-9A-Za-z])")
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_HEX_RUN = bytes(120 if 48 <= b <= 57 or 97 <= b <= 102 else 32 for b in range(256))
#: Shapes of a long number and of an account's first characters.
_DIGIT_RUN = bytes(48 if 48 <= b <= 57 else 45 if b in (32, 45) else 46 for b in range(256))


def base62(n: int, width: int) -> str:
    """``n`` in base 62, digits first, then capitals."""
    out = ""
    for _ in range(width):
        n, d = divmod(n, 62)
        out = _BASE62[d] + out
    return out


def prefixed_ok(m: re.Match) -> bool:
    """The last six characters are the CRC-32 of the thirty before."""
    return base62(zlib.crc32(m[1].encode()), 6) == m[2]


def jwt_ok(m: re.Match) -> bool:
    """The header is a JSON object with an algorithm."""
    try:
        header = json.loads(base64.urlsafe_b64decode(m[1] + "=" * (-len(m[1]) % 4)))
        return isinstance(header, dict) and "alg" in header
    except (ValueError, TypeError, RecursionError):
        return False


def luhn_ok(m: re.Match) -> bool:
    """Every second digit from the right doubled, the digits' sum is a multiple of ten."""
    d = [int(c) for c in m[0] if c.isdigit()][::-1]
    return any(d) and sum(d[::2] + [x * 2 - 9 * (x > 4) for x in d[1::2]]) % 10 == 0


def account_ok(m: re.Match) -> bool:
    """The number that letters and digits spell, with the first four at the end, leaves 1 when divided by 97."""
    s = m[0].replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _anchored(pattern: re.Pattern, ok: Callable[[re.Match], bool], run: re.Pattern | None = None) -> Callable[[str, list[int]], Iterator[tuple[int, int]]]:
    """Spans where the pattern matches at a hit, leftmost first, none inside another. Where it fails, it fails for all hits in the same ``run``."""

    def scan(text: str, hits: list[int]) -> Iterator[tuple[int, int]]:
        done = 0
        for at in hits:
            if at < done:
                continue
            if m := pattern.match(text, at):
                done = m.end()
                if ok(m):
                    yield m.start(), done
            elif run:
                done = run.match(text, at).end()

    return scan


def _key_blocks(text: str, hits: list[int]) -> Iterator[tuple[int, int]]:
    """Headers, a body and the first footer of the header's kind behind it. Footers are found once, and a run of body characters is measured once."""
    footers: dict[str, list[int]] = {}
    for m in _KEY_FOOTER.finditer(text):
        footers.setdefault(m[1], []).append(m.start())
    done = body_end = 0
    for at in hits:
        m = _KEY_HEADER.match(text, at) if at >= done else None
        places = footers.get(m[1], []) if m else []
        i = bisect.bisect_left(places, m.end()) if m else 0
        if i == len(places):
            continue
        if m.end() >= body_end:
            body_end = _KEY_BODY.match(text, m.end()).end()
        if places[i] <= body_end:
            done = places[i] + len("-----END -----") + len(m[1])
            yield at, done


SCANS = {
    "assign": _anchored(ASSIGN, lambda m: len(m[2]) >= 8),
    "access": _anchored(ACCESS, lambda m: len(m[0]) >= 16),
    "hex": _anchored(HEX, lambda m: len(m[0]) >= 32),
    "prefixed": _anchored(_PREFIXED, prefixed_ok),
    "jwt": _anchored(_JWT, jwt_ok, _TOKEN_RUN),
    "key_block": _key_blocks,
    "card": _anchored(_DIGITS, luhn_ok),
    "account": _anchored(_ACCOUNT, account_ok),
}


class Scanner:
    """Finds all spans of a text."""

    def __init__(self):
        import ahocorasick

        self.auto = ahocorasick.Automaton()
        for kind, words in KEYWORDS.items():
            for w in words:
                self.auto.add_word(w.lower(), (kind, w))
        self.auto.make_automaton()
        self.longest = max(len(w) for words in KEYWORDS.values() for w in words)

    def spans(self, text: str | None) -> list[tuple[str, int, int]]:
        """``(kind, start, end)`` in code points, by start and then kind."""
        if not text:
            return []
        raw = text.encode("utf-8", "surrogatepass")
        ascii_only = len(raw) == len(text)
        # One character for each byte, so that the automaton sees bytes and letters in either case are alike.
        hits: dict[str, list[int]] = {}
        for end, (kind, word) in self.auto.iter(raw.translate(_LOWER).decode("latin-1")):
            start = end + 1 - len(word)
            if kind == "assign" or raw[start : end + 1] == word.encode():
                hits.setdefault(kind, []).append(start)
        hits["hex"] = _runs(raw.translate(_HEX_RUN), b"x" * 32)
        shape = raw.translate(_DIGIT_RUN)
        if shape.count(b"0") >= 13:
            hits["card"] = [m.start() for m in re.finditer(rb"(?<!0)(?=0(?:-?0){12})", shape)]
        hits["account"] = [m.start() for m in re.finditer(rb"[A-Z]{2}[0-9]{2}", raw)]
        found = []
        for kind, at in hits.items():
            if at:
                points = sorted(set(at)) if ascii_only else _code_points(raw, sorted(set(at)))
                found += [(kind, a, b) for a, b in SCANS[kind](text, points)]
        return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _runs(shape: bytes, of: bytes) -> list[int]:
    """Where runs of one byte, at least as long as ``of``, begin."""
    out, at = [], shape.find(of)
    while at >= 0:
        out.append(at)
        end = shape.find(b" ", at)
        at = -1 if end < 0 else shape.find(of, end)
    return out


def _code_points(raw: bytes, at: list[int]) -> list[int]:
    """Places in bytes as places in code points."""
    out, done, points = [], 0, 0
    for x in at:
        points += len(raw[done:x].decode("utf-8", "surrogatepass"))
        done = x
        out.append(points)
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    """Spans as text."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Columns in ``carry`` under ``row``, then ``n_assign, n_access, n_hex, base_sha256, spans``."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{text_col}`").alias("text"), carried(carry))
    names = ["row", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text in batch.column(0).to_pylist():
                spans = scanner.spans(text)
                base = [s for s in spans if s[0] in KINDS[:3]]
                for i, kind in enumerate(KINDS[:3]):
                    out[i].append(sum(s[0] == kind for s in base))
                out[3].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out[4].append(joined(spans))
            types = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(1), *map(pa.array, out, types)], names=names)

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: secrets in every text of ``documents``."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), carry=["doc_id"])
    return found.select("row.doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
