"""Markdown readers: documents worked out by hand, and random lines against a walk from line to line."""

import random
import re

import pytest

from quern.functions import fixed as X
from quern.operators import markdown as W
from quern.plans.markdown import LINES


def found(spark, lines):
    frame = spark.createDataFrame(lines, "doc_id long, line_no long, line string").repartition(3)
    return sorted(((r.doc_id, r.line_no, r.kind, r.language, r.text) for r in W.readers(frame).collect()), key=repr)


def test_by_hand(spark):
    got = {(d, n): (k, lang, t) for d, n, k, lang, t in found(spark, LINES.rows)}
    cut = got.pop((-105, 0))
    assert cut[:2] == ("code", "l" * 20) and cut[2].startswith("line 0 of") and cut[2].endswith("line's end\n…") and len(cut[2]) <= 1202
    assert got == {
        (-101, 0): ("list", None, "one\nTwo: second item goes on and on\nthree\nnested"),
        (-101, 12): ("list", None, "a\n- -\nb"),
        (-102, 1): ("table", None, "A\tB x\tC\n1\t2\t\na\tb|c\td\n---\t---\t"),
        (-102, 7): ("rows", None, "h\nv\nonly — header"),
        (-103, 0): ("code", "py", "x = 1\n\n  y = 2"),
        (-103, 5): ("code", "", "```\n~~~\n- no item"),
        (-103, 13): ("code", "sql", "- no item\n```\n   last"),
        (-104, 0): ("rows", None, "X — Y"),
        (-104, 6): ("list", None, "item"),
        (-104, 9): ("list", None, "twelve"),
        (-104, 11): ("list", None, "a | b"),
        (-104, 12): ("table", None, "- c\td\ne\tf"),
    }


def walk(lines):
    """Lists, tables and code of one document, from line to line."""
    out, i, n = [], 0, len(lines)
    fence = lambda s: re.match(X.FENCE, s)

    def code_from(i):
        m = fence(lines[i])
        body, j = [], i + 1
        while j < n and not ((c := fence(lines[j])) and c[1][0] == m[1][0] and len(c[1]) >= len(m[1])):
            body.append(lines[j])
            j += 1
        solid = [len(re.match(r"\s*", x)[0]) for x in body if x.strip()]
        text = "\n".join(x[min(solid, default=0) :] for x in body).strip()
        if text:
            out.append((i, "code", m[2][:20], text))
        return j + 1

    # What is code is settled first; then tables; then lists.
    kind = [None] * n
    while i < n:
        if fence(lines[i]):
            j = code_from(i)
            kind[i:j] = ["code"] * (min(j, n) - i)
            i = j
        else:
            i += 1
    pipe = [kind[k] is None and "|" in lines[k] for k in range(n)]
    i = 0
    while i < n:
        if pipe[i] and i + 1 < n and pipe[i + 1] and re.match(X.TABLE_DELIMITER, lines[i + 1]) and len(cells(lines[i])) >= 2:
            j = i
            while j < n and pipe[j]:
                kind[j] = "table"
                j += 1
            head = cells(lines[i])
            grid = [(cells(x) + [""] * len(head))[: len(head)] for x in [lines[i], *lines[i + 2 : j]]]
            if all(head) and len(grid) > 1:
                out.append((i, "table", None, "\n".join("\t".join(r) for r in grid)))
            elif text := "\n".join(t for r in grid if (t := " — ".join(filter(None, r)))):
                out.append((i, "rows", None, text))
            i = j
        else:
            i += 1
    item = lambda k: kind[k] is None and re.match(X.LIST_ITEM, lines[k])
    i = 0
    while i < n:
        if not item(i) or re.match(X.THEMATIC_BREAK, lines[i]):
            i += 1
            continue
        items, j = [], i
        while j < n:
            if m := item(j):
                items.append([clean(m[2])])
                j += 1
                while j < n and kind[j] is None and re.match(r"\s+\S", lines[j]) and not item(j) and not re.match(X.ATX_HEADING, lines[j]):
                    items[-1].append(clean(lines[j].strip()))
                    j += 1
            elif kind[j] is None and not lines[j].strip():
                j += 1
            else:
                break
        if text := "\n".join(t for x in items if (t := " ".join(filter(None, x)))):
            out.append((i, "list", None, text))
        i = max(j, i + 1)
    return out


def clean(text):
    return re.sub(r"\*\*([^*]+)\*\*", r"\1", re.sub(r"^\[[ xX]\]\s*", "", text)).strip()


def cells(line):
    line = re.sub(r"\|$", "", re.sub(r"^\|", "", line.strip()))
    return [clean(c.replace("\\|", "|")) for c in re.split(r"(?<!\\)\|", line)]


PIECES = ["- a", "  - b", "3) c", "  more", "\tmore", "", " ", "text", "# h", "  # h", "---", "- - -", "***", "```", "````", "~~~", "```py", "    x", "| a | b |", "|---|---|", "a | b\\|c", "| | x |", "|-|-|", "- p | q", "* [ ] **t** u", "|"]


@pytest.mark.parametrize("seed", range(3))
def test_random_lines(spark, seed):
    rng = random.Random(seed)
    docs = [[rng.choice(PIECES) for _ in range(rng.randint(0, 30))] for _ in range(150)]
    want = sorted(((d, *x) for d, lines in enumerate(docs) for x in walk(lines)), key=repr)
    assert found(spark, [(d, i, x) for d, lines in enumerate(docs) for i, x in enumerate(lines)]) == want


def test_no_lines(spark):
    assert W.readers(spark.createDataFrame([], "doc_id long, line_no long, line string")).collect() == []
