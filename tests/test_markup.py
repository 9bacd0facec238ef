"""Pages as tables: pages worked out by hand, and random trees of which everything is known."""

import random
import re

import pytest

from quern.functions import fixed as X
from quern.operators import markup as K
from quern.plans.markup import PAGES

BLOCKS = {
    -1: [("heading", 1, "Stores2"), ("paragraph", None, None), ("list", None, "One tail\nInner bold item\nSecond inner\nTwo words.\nPara Next")],
    -2: [
        ("heading", 2, "Title in header"), ("paragraph", None, None), ("table", None, "Age\tWords\n1\tten\n2\t"), ("paragraph", None, "layout cell — and other"), ("table", None, "k\tv\nxinner\ty\nin\tner"),
    ],
    -3: [
        ("paragraph", None, "First para"), ("paragraph", None, "Loose words in a wrapper that are long enough to stay as they are."), ("paragraph", None, "Second Word and bold (a)."), ("paragraph", None, "Quoted one"), ("paragraph", None, "Quoted two"),
        ("paragraph", None, "One line quote"), ("heading", 5, "Note"), ("code", None, "  x = 1\n    y = 2"), ("list", None, "Span: items held\nSpan: again"), ("heading", 5, "More of it"), ("paragraph", None, "Hidden text"), ("paragraph", None, "No picture"),
    ],
    -4: [("paragraph", None, "Stays here"), ("paragraph", None, "Short text"), ("paragraph", None, "Kept <as> it is &amp; more")],
    -5: [("paragraph", None, "Never closed Bold"), ("paragraph", None, "New one italic"), ("paragraph", None, "Ending")],
    -7: [("paragraph", None, None), ("paragraph", None, "One page | Two page"), ("paragraph", None, "A sentence with one link and another in it."), ("paragraph", None, "Deep Dive How it works")],
}


def test_blocks_by_hand(spark):
    found = {}
    for r in K.blocks(PAGES.frame(spark)).orderBy("page_id", "place").collect():
        found.setdefault(r.page_id, []).append((r.kind, r.level, None if r.text.startswith("A paragraph of the article") else r.text))
    assert found == BLOCKS


def test_roots_and_noise_by_hand(spark):
    rows = K.without_noise(K.elements(PAGES.frame(spark)))
    roots = {r.page_id: r.name for r in K.content_roots(K.texts(rows)).collect()}
    assert roots == {-1: "main", -2: "article", -3: None, -4: None, -5: None, -7: "div"}
    left = {r.token for r in rows.where("page_id = -4 and kind = 'text'").collect()}
    assert left == {"Stays here", "Short text", "Kept &lt;as&gt; it&nbsp;is &amp;amp; more", "stray ", "<", " sign"}


NAMES = ["div", "section", "article", "span", "b", "i", "a", "em", "nav", "aside", "header", "footer", "main", "h2"]
WORDS = ["word", "Two", " three", "four. ", "(", ") ", "Five", "six,", "é", " ", "\n", "7", "#", "¶"]


def tree(rng, depth=0):
    """A text, or an element: name, whether it is hidden, children."""
    if depth > 5 or rng.random() < 0.35:
        return "".join(rng.choice(WORDS) for _ in range(rng.randint(1, 3)))
    return (rng.choice(NAMES), rng.random() < 0.05, [tree(rng, depth + 1) for _ in range(rng.randint(0, 4))])


def rendered(node):
    if isinstance(node, str):
        return node
    return f"<{node[0]}{' hidden' if node[1] else ''}>{''.join(map(rendered, node[2]))}</{node[0]}>"


def merged(children):
    """Texts side by side are one text."""
    out = []
    for c in children:
        if isinstance(c, str) and out and isinstance(out[-1], str):
            out[-1] += c
        else:
            out.append(c)
    return out


def joined(node):
    if isinstance(node, str):
        return node
    text = ""
    for c in merged(node[2]):
        more = joined(c)
        if text and more and re.search(r"""[a-z0-9,.:;?!)"']$""", text) and re.search("^[A-Z(]", more):
            text += " "
        text += more
    return text


def tidied(text):
    text = re.sub(r"([(\[{])\s+", r"\1", re.sub(r"\s+([,.;:!?%)\]}])", r"\1", re.sub(r"\s+", " ", text)))
    return re.sub(r"\s*[#¶]\s*$", "", text.strip())


def kept(node, within=False):
    """The tree without noise."""
    if isinstance(node, str):
        return node
    name, hidden, children = node
    noise = name in X.NOISE_ELEMENTS and not (within and name in ("header", "footer"))
    if hidden or noise:
        return None
    inside = within or name in ("article", "main")
    return (name, hidden, [k for c in merged(children) if (k := kept(c, inside)) is not None])


def listed(node, out):
    """Every element in order: name, text, how many elements that are not inline it holds, and links."""
    if not isinstance(node, str):
        place = len(out)
        out.append(None)
        for c in node[2]:
            listed(c, out)
        inside = out[place + 1 :]
        out[place] = (node[0], tidied(joined(node)), sum(x[0] not in X.INLINE_ELEMENTS for x in inside), sum(x[0] == "a" for x in inside))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_random_trees(spark, seed):
    rng = random.Random(seed)
    trees = [("div", False, [tree(rng) for _ in range(5)]) for _ in range(40)]
    pages = spark.createDataFrame([(i, rendered(t)) for i, t in enumerate(trees)], "page_id long, html string")
    for strip in (False, True):
        rows = K.without_noise(K.elements(pages)) if strip else K.elements(pages)
        found = {}
        for r in K.texts(rows).orderBy("page_id", "n").collect():
            found.setdefault(r.page_id, []).append((r.name, r.text, r.n_blocks, r.n_links))
        # Noise that goes leaves two texts where there was one element between them: they stay two.
        want = {i: listed(kept(t) if strip else t, []) for i, t in enumerate(trees)}
        if not strip:
            assert found == want
        else:
            assert {k: [(x[0], x[2], x[3]) for x in v] for k, v in found.items()} == {k: [(x[0], x[2], x[3]) for x in v] for k, v in want.items()}


def test_holders_by_a_stack(spark):
    rng = random.Random(9)
    trees = [("div", False, [tree(rng) for _ in range(5)]) for _ in range(40)]
    pages = spark.createDataFrame([(i, rendered(t)) for i, t in enumerate(trees)], "page_id long, html string")
    want = {}

    def walk(page, node, at, stack):
        want[page, at[0]] = next((n for n, name in reversed(stack) if name in ("b", "div")), None)
        here = at[0]
        at[0] += 1
        if not isinstance(node, str):
            for c in merged(node[2]):
                walk(page, c, at, [*stack, (here, node[0])])
            at[0] += 1

    from pyspark.sql import functions as F

    for i, t in enumerate(trees):
        walk(i, t, [0], [])
    found = {(r.page_id, r.n): r.holder for r in K.holders(K.elements(pages), F.col("name").isin("b", "div"), "holder").collect()}
    assert found == want


def test_no_pages(spark):
    none = spark.createDataFrame([(1, None), (2, "")], "page_id long, html string")
    assert K.blocks(none).collect() == [] and K.list_items(K.elements(none)).collect() == []
