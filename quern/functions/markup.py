"""Columns over pieces of markup: tokens of a page, attributes of a tag, and text as it is read.

Patterns are written so that Java's engine and RE2 find the same; those for Java take runs at once, so that long tags need no deep stack.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements whose content is text up to their end tag; all are noise or stand outside the page's text.
RAW = ("script", "style", "textarea", "title", "iframe", "noscript")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
#: Elements that end where the next of their group begins, and the groups' names in the order of `quern.operators.markup`.
SECTIONS = ("thead", "tbody", "tfoot")
ENTITIES = (
    ("&nbsp;", " "), ("&#160;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#34;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"),
    ("&ndash;", "–"), ("&mdash;", "—"), ("&hellip;", "…"), ("&lsquo;", "‘"), ("&rsquo;", "’"), ("&ldquo;", "“"), ("&rdquo;", "”"), ("&laquo;", "«"), ("&raquo;", "»"), ("&para;", "¶"), ("&amp;", "&"),
)
_BLOCKS = "|".join(rf"<{name}(?:\s[^>]*)?>.*?(?:</{name}\s*>|\z)" for name in RAW)
TOKEN = rf"""(?is)<!--.*?(?:-->|\z)|{_BLOCKS}|<[!?][^>]*>|</?[a-z](?:[^>"']|"[^"]*"|'[^']*')*>|[^<]+|<"""
TOKEN_JAVA = TOKEN.replace("""(?:[^>"']|"[^"]*"|'[^']*')*>""", """(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
NAME = r"^</?([A-Za-z][^\s/>]*)"


def attribute(name: str) -> str:
    """A pattern whose three groups hold the value, in either kind of quotes or none."""
    return rf"""(?i)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def tokens(html: Column) -> Column:
    """Comments, elements of raw text as a whole, tags and texts, in order."""
    return F.regexp_extract_all(html, F.lit(TOKEN_JAVA), F.lit(0))


def value(tag: Column, name: str) -> Column:
    """An attribute's value; empty if there is none."""
    return F.concat(*(F.regexp_extract(tag, attribute(name), i) for i in (1, 2, 3)))


def has_class(tag: Column, names: tuple[str, ...]) -> Column:
    """Whether one of the tag's classes is among the names."""
    return value(tag, "class").rlike(r"(?:^|\s)(?:" + "|".join(names) + r")(?:\s|$)")


def decoded(text: Column) -> Column:
    """Text with the common entities replaced; others stay."""
    for entity, by in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(by))
    return text


def tidy_inline(text: Column) -> Column:
    """White space in single spaces, none before closing and behind opening marks."""
    text = F.regexp_replace(F.replace(text, F.lit(" "), F.lit(" ")), r"\s+", " ")
    text = F.regexp_replace(text, r"\s+([,.;:!?%)\]}])", "$1")
    return F.trim(F.regexp_replace(text, r"([(\[{])\s+", "$1"))


def text_of(text: Column) -> Column:
    """`tidy_inline`, and without the sign of a link to the heading at the end."""
    return F.regexp_replace(tidy_inline(text), r"\s*[#¶]\s*$", "")


def parted(before: Column, after: Column) -> Column:
    """Whether a space must stand between texts of two elements: the first ends and the second begins as words do."""
    return before.rlike(r"""[a-z0-9,.:;?!)"']$""") & after.rlike("^[A-Z(]")
