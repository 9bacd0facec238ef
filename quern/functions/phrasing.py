"""Questions from labels, headings and tables, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions import java as X


def is_plural(label: Column) -> Column:
    clean = F.trim(label)
    return F.when(clean.rlike(X.PLURAL_HINT), clean.rlike(X.java(r"(?i)s\b")) | clean.rlike("(?i)criteria")).otherwise(clean.rlike("(?i)[^s]s$"))


def be(label: Column) -> Column:
    return F.when(is_plural(label), "are").otherwise("is")


def without_parenthetical(label: Column) -> Column:
    clean = F.trim(F.regexp_replace(label, r"\s*\([^)]*\)\s*$", ""))
    return F.when(clean == "", F.trim(label)).otherwise(clean)


def lower(label: Column) -> Column:
    """Lower case, but for short acronyms and identifiers."""
    return F.when(label.rlike(r"^[A-Z0-9/\s.-]+$") & (F.length(label) <= 6), label).otherwise(F.lower(label))


def singular(noun: Column) -> Column:
    n = F.lower(F.trim(noun))
    short = lambda k: F.substring(n, F.lit(1), F.length(n) - k)
    return F.when(n.endswith("ies"), F.concat(short(3), F.lit("y"))).when(n.endswith("ses"), short(2)).when(n.endswith("s") & ~n.endswith("ss"), short(1)).otherwise(n)


def without_ordinal(label: Column) -> Column:
    clean = F.trim(F.regexp_replace(F.trim(label), r"^\(?\d{1,2}[.)]\s+", ""))
    return F.when(clean == "", F.trim(label)).otherwise(clean)


def softened(text: Column) -> Column:
    """ALL CAPS with capitals at the beginnings of words only."""
    low = F.lower(text)
    # Capitals follow the beginning, white space, brackets, slashes and dashes.
    parts = F.regexp_extract_all(low, F.lit(r"[\s(/-]*[^\s(/-]*"), F.lit(0))
    cap = F.transform(parts, lambda p: F.concat(F.regexp_extract(p, r"^[\s(/-]*", 0), F.upper(F.substring(F.regexp_replace(p, r"^[\s(/-]*", ""), 1, 1)), F.substring(F.regexp_replace(p, r"^[\s(/-]*", ""), F.lit(2), F.length(p))))
    return F.when(~text.rlike("[a-z]") & text.rlike("[A-Z]{3,}"), F.array_join(cap, "")).otherwise(text)


def language_name(tag: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in X.LANGUAGES.items() for x in pair))
    return F.try_element_at(table, F.lower(tag))


def _topic(label: Column) -> Column:
    return F.regexp_replace(without_ordinal(label), "[:?]+$", "")


def _asked(stem: Column, otherwise: Column, prepositions: bool = True) -> Column:
    ready = F.when(stem.rlike(X.QUESTION_WORD), F.concat(stem, F.lit("?")))
    return (ready.when(stem.rlike(X.PREPOSITION_END), F.concat(stem, F.lit("...?"))) if prepositions else ready).otherwise(otherwise)


def heading_question(heading: Column) -> Column:
    stem = _topic(heading)
    return _asked(stem, F.concat(F.lit("What characterizes "), stem, F.lit("?")))


def label_question(label: Column) -> Column:
    stem = _topic(label)
    return _asked(stem, F.concat(F.lit("What is important about "), stem, F.lit("?")))


def list_question(heading: Column) -> Column:
    stem = _topic(heading)
    return _asked(stem, F.concat(F.lit("What "), be(stem), F.lit(" the "), lower(stem), F.lit("?")))


def term_question(term: Column) -> Column:
    stem = F.trim(term)
    plain = F.when(stem.rlike(X.ADVERBIAL), F.concat(stem, F.lit(" — what was found?"))).otherwise(F.concat(F.lit("What "), be(stem), F.lit(" "), stem, F.lit("?")))
    return _asked(stem, plain, prepositions=False)


def code_question(label: Column, language: Column) -> Column:
    topic, name = _topic(label), language_name(language)
    suffix = F.when(name.isNotNull(), F.concat(F.lit(" in "), name)).otherwise("")
    return _asked(topic, F.concat(topic, F.lit(" — how is this written"), suffix, F.lit("?")), prepositions=False)


def output_question(label: Column, language: Column) -> Column:
    name = language_name(language)
    rest = F.concat(F.lit("hat does this "), F.coalesce(F.concat(name, F.lit(" ")), F.lit("")), F.lit("program print?"))
    topic = F.coalesce(_topic(label), F.lit(""))
    return F.when(topic == "", F.concat(F.lit("W"), rest)).otherwise(F.concat(topic, F.lit(" — w"), rest))


def diagram_question(label: Column) -> Column:
    topic = _topic(label)
    return _asked(topic, F.concat(topic, F.lit(" — what does it look like?")), prepositions=False)


def reverse_question(row_header: Column, value: Column) -> Column:
    noun = singular(row_header)
    return (
        F.when(row_header.isNull(), F.concat(F.lit("What is characterized by: "), value, F.lit("?")))
        .when(noun.startswith("age"), F.concat(F.lit("Which age is associated with: "), value, F.lit("?")))
        .otherwise(F.concat(F.lit("Which "), noun, F.lit(" is characterized by: "), value, F.lit("?")))
    )


def table_question(row_header: Column, row_key: Column, col_header: Column, context: Column) -> Column:
    """Question for one cell of a table; ``row_header`` and ``context`` may be null."""
    row, col, verb = without_parenthetical(row_key), lower(F.trim(col_header)), be(col_header)
    say = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    known = F.try_element_at(F.filter(F.split(F.lower(context), r"\s+"), lambda w: w.rlike(X.DOMAIN_NOUN)), F.lit(1))
    domain = F.when(known.endswith("s"), known).otherwise(F.concat(known, F.lit("s")))
    age = row.rlike(X.AGE) | F.coalesce(F.trim(row_header).rlike("(?i)^age"), F.lit(False))
    at = F.when(domain.isNotNull(), say("At ", row, ", what ", be(domain), " the ", col, " ", domain, "?")).otherwise(say("At ", row, ", what ", verb, " the ", col, "?"))
    first = F.element_at(F.split(F.trim(context), r"\s+"), 1)
    noun = F.when(F.trim(row_header) != "", singular(row_header)).when(F.length(first) > 3, F.lower(first))
    scope = singular(first)
    stutter = F.when((scope != noun) & (F.length(scope) > 3), say("What ", verb, " the ", col, " in ", row, " ", scope, "?")).otherwise(say("What ", verb, " the ", col, " for ", row, "?"))
    return (
        F.when(age, at)
        .when(F.trim(row_header).rlike(X.DIMENSION), say("In ", col, ", what ", be(row_key), " expected for ", lower(row), "?"))
        .when(F.contains(col, noun), stutter)
        .when(noun.isNotNull(), say("What ", verb, " the ", col, " of the ", row, " ", noun, "?"))
        .otherwise(say("What ", verb, " the ", col, " of ", row, "?"))
    )
