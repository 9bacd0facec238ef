"""Small tables that reach every rule, put beside the driver's rows in a query and in its SQL."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

_TYPES = {"long": "bigint", "int": "integer", "string": "varchar", "double": "double", "boolean": "boolean", "array<string>": "varchar[]"}


def literal(value: Any) -> str:
    """A value as SQL."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(literal, value)) + "]"
    return repr(value)


class Fixture:
    """Rows with a schema, as a DataFrame and as SQL."""

    def __init__(self, schema: str, rows: list[tuple]):
        self.schema, self.rows = schema, rows

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema)

    @property
    def sql(self) -> str:
        """A parenthesised select."""
        columns = [c.split() for c in self.schema.split(", ")]
        rows = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in self.rows)
        return f"(select {', '.join(f'{n}::{_TYPES[t]} as {n}' for n, t in columns)} from (values {rows}) as v({', '.join(n for n, _ in columns)}))"


_HEAD = "Course reader, spring term\nPrint this page"
DOCUMENTS = Fixture(
    "doc_id long, source string, text string",
    [
        (-1, "reader", f"Working memory – Course reader\n{_HEAD}\nS P R I N G\nPage 3 of 9\nWorking memory is a store that holds a few items for some seconds. It decays fast. Older accounts say that working memory was a single box.\nSpan: the number of items that can be repeated at once.\n( 0 - 2 y r ) and ( 9 m o )\nIn this example: the span is four. As shown above the store is small."),
        (-2, "reader", f"Long-term memory\n{_HEAD}\nA trace that lasts for years is called engram.\nHowever, long-term memory is the store that keeps facts and events for years without effort.\nWorking memory\nRehearsal: saying items again so that they stay.\nhttps://example.org/reader\nThe table below shows spans.\n1/2/2024, 10:15 AM"),
        (-3, "reader", f"Forgetting curves\n{_HEAD}\n© 2024 Some Press\nForgetting curves are known as records of how much is kept after hours or days. The following: a list.\nA decay refers to the loss of a trace over time.\nSleep means a state in which traces are replayed and kept.\nWhat does this diagram show?"),
        (-4, "reader", f"Recall, and recognition\n{_HEAD}\nRecall is the concept of finding an item without help.\nCue is defined as a hint that brings an item back.\nNote: cues help.\n-"),
        (-5, None, "For example:\nno source here\nS P R I N G"),
        (-6, None, "For example:\nstill none"),
    ],
)

CARDS = Fixture(
    "deck_id long, ord long, front string, back string, has_code boolean, has_image boolean",
    [
        (-1, 0, "How many items can working memory hold at once?", "Working memory holds about four separate items at once", False, False),
        (-1, 1, "How many items can working memory really hold?", "About four separate items held in working memory at once", False, False),  # near the first
        (-1, 2, "How many items can working memory hold at once?", "Another answer with quite different content words inside", False, False),  # same front
        (-1, 3, "How many items can working memory hold at once today?", "Working memory holds about 4 separate items at once", True, False),  # carries code
        (-1, 4, "Which 7 items can working memory hold at once?", "Working memory holds about 7 separate items at once", False, False),
        (-1, 5, "Which 9 items can working memory hold at once?", "Working memory holds about 9 separate items at once", False, False),  # conflicting numbers
        (-1, 6, "Which 7 items could working memory hold at once?", "Working memory holds about 7 separate items at once", False, False),  # near the fourth
        (-1, 7, "Short one", "Too few", False, False),
        (-1, 8, "Short one!", "Other", False, False),  # same slug
        (-1, 9, "How many items can working memory really hold at once?", "Separate items held at once in working memory: about four", False, True),  # carries an image
        (-2, 0, "alpha beta gamma delta words", "epsilon zeta theta kappa words", False, False),
        (-2, 1, "alpha beta gamma delta words omega", "epsilon zeta theta kappa words omega", False, False),
        (-2, 2, "beta gamma delta words omega sigma", "zeta theta kappa words omega sigma", False, False),  # near the second, which went
        (-3, 0, "What is important about references", "See the list", False, False),
        (-3, 1, "What does this code print?", "It prints four items", True, False),
        (-3, 2, "What does this diagram show?", "It shows four boxes", False, True),
        (-3, 3, "Name; the two stores", "Working and long-term", False, False),
        (-3, 4, "", "no front", False, False),
        (-3, 5, "Same text", "same text!", False, False),
    ],
)

URLS = Fixture(
    "page_id long, url string",
    [(-i, u) for i, u in enumerate((
        "http://[::1]/x", "http://[fe80::1]/", "http://[fd00::2]/a", "http://[::ffff:10.0.0.1]/", "http://[::ffff:7f00:1]/", "http://[2001:db8::1]/", "http://[::ffff:8.8.8.8]/", "http://2130706433/", "http://0177.0.0.1/",
        "http://127.1/", "http://0x7f.0.0.1/", "http://10.1.2.3:8080/", "http://172.16.0.1/", "http://172.32.0.1/", "http://192.168.1.1", "http://169.254.169.254/latest", "http://100.64.0.1/", "http://224.0.0.1/",
        "http://8.8.8.8/dns", "http://134744072/", "http://localhost/", "http://a.localhost/", "http://printer.local/", "http://metadata.google.internal/x", "http://me@127.0.0.1/", "http://me@example.org/", "ftp://example.org/",
        "example.org/no-scheme", "https://example.org", "https://example.org:443/", "http://example.org:80/?q=1#x", "https://EXAMPLE.org/Path/?Q=1", "https://example.org/Path?Q=1", "http://999.1.1.1/", "http://", "https://example.org:8443/",
    ), 1)],
)

# One cell for each way to ask, and the question that it must give.
TABLE_CELLS = Fixture(
    "row_key string, col long, row_header string, header string, context string, expected string",
    [
        ("12 mo", -1, None, "Language", None, "At 12 mo, what is the language?"),
        ("12 mo", -2, None, "Language", "Developmental milestones", "At 12 mo, what are the language milestones?"),
        ("Toddler", -3, "Age group", "Motor skills", None, "At Toddler, what are the motor skills?"),
        ("Social skills", -4, "Domain", "12 months", None, "In 12 months, what are expected for social skills?"),
        ("Aspirin", -5, "Drug", "Drug class", None, "What is the drug class for Aspirin?"),
        ("Aspirin", -6, "Drug", "Drug class", "Emergency drugs", "What is the drug class in Aspirin emergency?"),
        ("Aspirin (oral)", -7, "Drugs", "Dose", None, "What is the dose of the Aspirin drug?"),
        ("Aspirin", -8, None, "MRI", None, "What is the MRI of Aspirin?"),
        ("Aspirin", -9, None, "Side effects", "Emergency drugs", "What are the side effects of the Aspirin emergency?"),
    ],
)
