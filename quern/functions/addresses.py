"""Addresses, file names and Markdown marks as Column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions import fixed as X
from quern.functions import text as T


def url_list(text: Column) -> Column:
    """Addresses in pasted text, each once, in order: split at white space and between addresses, without Markdown or brackets around them."""
    pieces = F.split(text, r"\s+|[,;](?=https?://)|[,;](?=www\.)|(?<=\))(?=\[)")
    bare = lambda p: reduce(lambda x, pattern: F.regexp_replace(x, pattern, ""), (r"^[<(\[]+", r"^.*?\]\(", r"[>)\]]+$", "[.,;]+$"), p)
    pieces = F.transform(pieces, lambda p: bare(p))
    found = F.filter(pieces, lambda p: p.rlike("(?i)^https?://") | p.rlike(X.HOST_LIKE))
    full = F.transform(found, lambda p: F.when(p.rlike("(?i)^https?://"), p).otherwise(F.concat(F.lit("https://"), p)))
    keys = F.transform(full, T.url_key)
    return F.filter(full, lambda p, i: F.array_position(keys, T.url_key(p)) == i + 1)


def deck_name(url: Column) -> Column:
    """Host and path of an address, without a last slash; other text as it is."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(host == "", url).otherwise(F.regexp_replace(F.concat(host, path), "/$", ""))


def shortened(name: Column, most: int = 34) -> Column:
    """A name that is never longer than ``most``."""
    return F.when(F.length(name) > most, F.concat(F.rtrim(F.substring(name, 1, most - 1)), F.lit("…"))).otherwise(name)


def failures(failed: Column, read: Column) -> Column:
    """One line on pages that were not read: ``failed`` is an array of ``url, error``; the first three are named."""
    shown = F.transform(F.slice(failed, 1, 3), lambda f: F.concat(deck_name(f["url"]), F.lit(" — "), f["error"]))
    rest = F.size(failed) - 3
    tail = F.when(rest > 0, F.concat(F.lit("; and "), rest.cast("string"), F.lit(" more"))).otherwise("")
    return F.concat(F.lit("Read "), read.cast("string"), F.lit(" of "), (read + F.size(failed)).cast("string"), F.lit(" pages. Skipped: "), F.array_join(shown, "; "), tail)


def reader_of(path: Column) -> Column:
    """The reader for a file by its extension; null if there is none."""
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(extension == "pdf", "pdf").when(extension == "pptx", "pptx").when(extension.isin(*X.MARKDOWN_EXTENSIONS), "markdown").when(extension.isin("html", "htm"), "html")


def serves_markdown(url: Column, content_type: Column) -> Column:
    """Whether an address serves Markdown: by its type, or as plain text with a Markdown extension."""
    return content_type.rlike("(?i)text/markdown") | (content_type.rlike("(?i)text/plain") & url.rlike(r"(?i)\.(" + "|".join(X.MARKDOWN_EXTENSIONS) + r")(\?|#|$)"))


def file_title(name: Column) -> Column:
    """A title from a Markdown file's name."""
    bare = F.regexp_replace(name, r"(?i)\.(" + "|".join(X.MARKDOWN_EXTENSIONS) + ")$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "[_-]+", " "), r"\s+", " "))


def term_pair(line: Column) -> Column:
    """An emphasised term and a dash or colon as ``Term: definition``; other lines as they are."""
    clean = F.trim(line)
    term = F.trim(F.regexp_replace(F.trim(F.regexp_extract(clean, X.TERM_PAIR, 2)), "[:—–-]+$", ""))
    rest = F.trim(F.regexp_extract(clean, X.TERM_PAIR, 3))
    return F.when((term != "") & (rest != ""), F.concat(term, F.lit(": "), rest)).otherwise(line)


def without_marks(text: Column) -> Column:
    """Text without Markdown's inline marks: images, links, footnotes, tags, code, emphasis and escapes, in that order."""
    bare = text
    for pattern, by in X.INLINE_MARKS:
        bare = F.regexp_replace(bare, pattern, by.replace("\\", "$"))
    # A cheap test first: every pattern has one of these signs.
    bare = F.when(text.rlike(r"[\[<`*_~\\]"), bare).otherwise(text)
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def chrome(text: Column) -> Column:
    """Whether a block is a control of the page rather than content."""
    return (F.length(F.trim(text)) < 3) | F.trim(text).rlike(X.CHROME_TEXT)
