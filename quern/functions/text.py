"""Text measures and predicates as Column functions; none leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions import java as X


def slug(text: Column) -> Column:
    """Comparable form: lower case, runs of other characters as one space. Text without ASCII letters or digits has an empty one."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def tidy(text: Column) -> Column:
    """White space collapsed, without a last semicolon or comma."""
    return F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), "[;,]$", "")


def words(text: Column) -> Column:
    """Pieces between runs of white space."""
    return F.split(text, r"\s+")


def content_words(text: Column) -> Column:
    """Distinct stemmed words that carry meaning, in order of appearance."""
    pieces = F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", " "), r"\s+")
    # Each word is looked at once; most end in no letter that a suffix ends in.
    words_ = F.filter(F.array_except(pieces, F.array(*map(F.lit, X.STOPWORDS))), lambda w: (F.length(w) >= 4) | w.rlike(r"\d"))
    stemmed = F.transform(words_, lambda w: F.when(F.substring(w, -1, 1).isin("g", "d", "s", "e") & ~w.rlike(r"\d"), F.regexp_replace(w, X.STEM, "$1")).otherwise(w))
    return F.array_distinct(stemmed)


def overlap(a: Column, b: Column) -> Column:
    """Shared elements of two sets as a share of the smaller one; 0 if one is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def numbers(text: Column) -> Column:
    """Distinct numbers as they are written."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(X.NUMBER), F.lit(0)))


def conflicting(a: Column, b: Column) -> Column:
    """Whether two sets of numbers, neither empty, differ."""
    return (F.size(a) > 0) & (F.size(b) > 0) & ((F.size(F.array_except(a, b)) > 0) | (F.size(F.array_except(b, a)) > 0))


def sentences(text: Column) -> Column:
    """Sentences: a stop, white space, then a capital or an opening mark."""
    # Not `F.trim` itself: it takes a second argument, and `transform` would give it the sentence's number as the characters to trim.
    return F.filter(F.transform(F.split(F.regexp_replace(text, r"\s+", " "), r"(?<=[.!?])\s+(?=[A-Z“\"'(])"), lambda s: F.trim(s)), lambda s: s != "")


def meaningful_label(text: Column) -> Column:
    """Whether a label names a concept."""
    label = F.regexp_replace(F.trim(text), "[:?.]+$", "")
    return (
        F.length(label).between(*X.LABEL_CHARS)
        & ~label.rlike(X.DISCOURSE)
        & ~label.rlike(X.CHROME)
        & (F.size(words(label)) <= X.LABEL_WORDS)
        & ~label.rlike(X.PRONOUN)
        & ~F.regexp_replace(label, r"\([^)]*\)", "").contains(",")
        & label.rlike("[A-Za-z]{3,}")
        & ~label.rlike(X.IMPERATIVE)
        & ~label.rlike(X.DEICTIC)
        & ~label.rlike(X.FINITE_VERB)
    )


def term_definition(line: Column) -> Column:
    """``(term, def)`` of a line "term: definition", or null."""
    clean = tidy(line)
    term, rest = (F.trim(F.regexp_extract(clean, X.TERM_DEFINITION, i)) for i in (1, 2))
    good = clean.rlike(X.TERM_DEFINITION) & (F.size(words(term)) <= 9) & meaningful_label(term)
    return F.when(good, F.struct(term.alias("term"), rest.alias("def")))


def definitions(sentence: Column) -> Column:
    """Up to two ``(term, def)`` of a sentence: the first pattern that fits, and a term at its end."""
    said = F.regexp_replace(sentence, r"^[A-Z][^,]{0,40},\s+(?=[a-z])", "")
    none = F.lit(None).cast("struct<term:string,def:string>")
    found = none
    for pattern in reversed(X.DEFINITIONS):
        term = F.trim(F.regexp_extract(said, pattern, 1))
        rest = F.regexp_replace(F.trim(F.regexp_extract(said, pattern, 2)), "[.]$", "")
        good = ~term.rlike(X.PRONOUN_SUBJECT) & ~term.rlike(X.CONJUNCTION) & (F.size(words(term)) <= 7) & meaningful_label(term)
        found = F.when(said.rlike(pattern), F.when(good, F.struct(term.alias("term"), rest.alias("def")))).otherwise(found)
    last, before = (F.trim(F.regexp_extract(said, X.TRAILING, i)) for i in (2, 1))
    trailing = F.when(said.rlike(X.TRAILING) & meaningful_label(last) & (F.size(words(before)) <= 40), F.struct(last.alias("term"), before.alias("def")))
    # A cheap test first: every pattern has one of these words.
    possible = F.lower(sentence).rlike(r"\s(is|are|refers|means)\s")
    return F.when(possible & (F.size(words(said)) <= 42), F.array_compact(F.array(found, trailing))).otherwise(F.array().cast("array<struct<term:string,def:string>>"))


def summary(title: Column, text: Column) -> Column:
    """``(back, score)``: the sentence that best explains a title, the first of equals; null where the title names no concept or no sentence will do."""
    title = F.trim(title)
    keys = F.filter(F.split(F.lower(title), "[^a-z0-9]+"), lambda w: (F.length(w) > 3) & ~w.isin(*X.SUMMARY_FILLER))
    said = F.transform(sentences(tidy(text)), lambda s, i: F.struct(s.alias("s"), F.lower(s).alias("low"), F.size(words(s)).alias("n"), (-i).alias("place")))
    fit = F.filter(said, lambda x: x["n"].between(8, 45) & F.exists(keys, lambda w: F.contains(x["low"], w)) & ~x["s"].rlike(X.CONJUNCTION))
    score = lambda x: F.size(F.filter(keys, lambda w: F.contains(x["low"], w))) * 10 + F.when(x["low"].rlike(X.STATEMENT), 5).otherwise(0) - F.when(x["s"].rlike(X.PRONOUN_SUBJECT), 6).otherwise(0) - x["n"] / 10
    best = F.array_max(F.transform(fit, lambda x: F.struct(score(x).alias("score"), x["place"].alias("place"), x["s"].alias("s"))))
    back = F.regexp_replace(best["s"], r"^[A-Z][^,]{0,40},\s+(?=[a-z])", "")
    return F.when(meaningful_label(title) & ~title.rlike("[:;]") & best.isNotNull(), F.struct(back.alias("back"), best["score"].alias("score")))


def usable_card(front: Column, back: Column) -> Column:
    """Whether a card is worth keeping."""
    front, back = F.trim(front), F.trim(back)
    stem = F.regexp_replace(F.regexp_replace(front, r"\.\.\.\?$", ""), r"\?$", "")
    core = front
    for pattern in (r"(?i)^what (is|are) important about\s+", r"(?i)^what characterizes\s+", r"(?i)^what (is|are)\s+", "[?.]+$"):
        core = F.regexp_replace(core, pattern, "")
    core = F.trim(core)
    bare = F.regexp_replace(front, r"[?:.\s]+$", "")
    bad = (
        (front == "")
        | (F.length(back) < X.MIN_BACK_CHARS)
        | stem.rlike(r"[:;,/]$|(^|\s)[=+\-–—]$")
        | back.rlike(r"(^|\s)[=+]$")
        | (F.size(words(front)) > X.MAX_FRONT_WORDS)
        | (F.size(words(back)) > X.MAX_BACK_WORDS)
        | front.rlike(X.BOILERPLATE)
        | core.rlike(X.DISCOURSE)
        | core.rlike(X.CHROME)
        | core.rlike(X.BOILERPLATE)
        | bare.rlike(r"^[\d\s.)+-]+$")
        | (F.length(bare) < 3)
        | (slug(front) == slug(back))
        | (F.length(slug(back)) < 4)
    )
    return ~bad


def dangling_reference(front: Column, has_code: Column | None = None) -> Column:
    """The words that point at something the card lacks, or null; code on the front excuses nouns of code."""
    found = F.regexp_replace(F.regexp_extract(front, X.DANGLING, 0), r"\s*[?:,.]?$", "")
    excused = F.lit(False) if has_code is None else has_code & found.rlike(X.ATTACHED_CODE)
    return F.when((found != "") & ~excused, found)


def card_hash(front: Column, back: Column) -> Column:
    """FNV-1a of 32 bits over the UTF-16 units of front, NUL and back, as lower-case hex without padding."""
    # Each unit is cut from the bytes, where a place is found at once; in a string it is counted from the beginning.
    raw = F.concat(front, F.lit("\x00"), back)
    cut = lambda x: F.transform(F.sequence(F.lit(0), (F.length(x) / 2).cast("int") - 1), lambda i: F.conv(F.hex(F.substring(x, i * 2 + 1, F.lit(2))), 16, 10).cast("long"))
    # Bound to a name by an array of one, so that a text is encoded once and not for each of its units.
    units = F.flatten(F.transform(F.array(F.encode(raw, "UTF-16BE")), cut))
    mask = F.lit(0xFFFFFFFF)
    return F.lower(F.hex(F.aggregate(units, F.lit(2166136261).cast("long"), lambda h, u: (h.bitwiseXOR(u) * F.lit(16777619)).bitwiseAND(mask))))


def letter_spaced(text: Column) -> Column:
    """``S P R I N G`` as ``SPRING``; other text as it is."""
    clean = F.trim(text)
    joined = F.regexp_replace(clean, r"\s+", "")
    enough = F.length(F.regexp_replace(joined, "[^A-Za-z0-9]", "")) >= 2
    return F.when((F.length(clean) >= 3) & clean.rlike(r"^(\S\s)+\S$") & enough, joined).otherwise(text)


def normal_spacing(text: Column) -> Column:
    """Spaces inside brackets, ranges and units taken out. Text without brackets, digits and double spaces is only trimmed."""
    plain = text
    for pattern, by in ((r"\(\s+", "("), (r"\s+\)", ")"), (r"(\d)\s*([–—-])\s*(\d)", "$1$2$3"), (X.java(r"(?i)(\d)\s*y\s+r\b"), "$1 yr"), (X.java(r"(?i)(\d)\s*m\s+o\b"), "$1 mo"), (r"\s{2,}", " ")):
        text = F.regexp_replace(text, pattern, by)
    return F.trim(F.when(plain.rlike(r"[()\d]|\s\s"), text).otherwise(plain))


def print_artifact(text: Column) -> Column:
    """Whether a line was printed by the browser."""
    return F.trim(text).rlike(X.PRINT_ARTIFACT)


def page_title(text: Column) -> Column:
    """A title without the site's name behind it."""
    clean = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(clean.rlike(X.PAGE_TITLE), F.trim(F.regexp_extract(clean, X.PAGE_TITLE, 1))).otherwise(clean)


def truncated_code(text: Column) -> Column:
    """Long code up to its last line that fits, and a mark."""
    cut = F.substring(text, 1, X.CODE_CHARS)
    at = F.length(cut) - F.instr(F.reverse(cut), "\n")
    return F.when(F.length(text) <= X.CODE_CHARS, text).otherwise(F.concat(F.when((F.instr(cut, "\n") > 0) & (at > 0), F.substring(cut, F.lit(1), at)).otherwise(cut), F.lit("\n…")))


def clamped(text: Column, most: int) -> Column:
    """Text of at most so many characters, cut between words where one ends late enough."""
    clean = F.trim(text)
    cut = F.substring(clean, 1, most)
    last = F.when(F.instr(cut, " ") > 0, F.length(cut) - F.instr(F.reverse(cut), " ")).otherwise(-1)
    kept = F.when(last > most * 0.6, F.substring(cut, F.lit(1), last)).otherwise(cut)
    return F.when(clean == "", None).when(F.length(clean) <= most, clean).otherwise(F.concat(F.rtrim(kept), F.lit("…")))


def url_key(url: Column) -> Column:
    """Comparable address: host, path without one last slash, and query."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))
    own_port = F.when(F.lower(url).startswith("https:"), F.regexp_replace(host, ":443$", "")).otherwise(F.regexp_replace(host, ":80$", ""))
    path = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/$", "")
    query = F.regexp_extract(url, r"(\?[^#]+)", 1)
    return F.when(host != "", F.concat(own_port, F.lower(path), F.lower(F.when(query == "?", "").otherwise(query)))).otherwise(F.lower(F.trim(url)))


def _ipv4(host: Column) -> Column:
    """The number of an IPv4 address in any spelling: one to four parts, decimal, octal or hexadecimal, the last one filling what is left; null for other hosts."""
    parts = F.split(F.regexp_replace(host, r"\.$", ""), r"\.")
    value = lambda p: F.when(p.startswith("0x"), F.conv(F.concat(F.lit("0"), F.substring(p, 3, 20)), 16, 10)).when(p.rlike("^0[0-9]"), F.conv(p, 8, 10)).otherwise(p).cast("long")
    v = F.transform(parts, value)
    n = F.size(v)
    last = F.element_at(v, -1)
    before = F.aggregate(F.sequence(F.lit(1), F.lit(3)), F.lit(0).cast("long"), lambda s, i: s + F.when(i < n, F.get(v, i - 1) * F.element_at(F.array(*(F.lit(1 << k).cast("long") for k in (24, 16, 8))), i)).otherwise(F.lit(0)))
    return F.when(host.rlike(r"^(0x[0-9a-f]+|[0-9]+)(\.(0x[0-9a-f]+|[0-9]+)){0,3}\.?$"), before + last)


def _private(address: Column) -> Column:
    """Whether an IPv4 number is the machine itself, in a private or shared network, link-local, multicast or no address."""
    top = F.shiftright(address, 24)
    return top.isin(0, 10, 127) | (top >= 224) | F.shiftright(address, 16).isin((169 << 8) + 254, (192 << 8) + 168) | (F.shiftright(address, 20) == (172 << 4) + 1) | (F.shiftright(address, 22) == (100 << 2) + 1)


def fetchable(url: Column) -> Column:
    """Whether a reader may fetch an address: http or https, and neither the machine itself nor a private network, as the address is written."""
    host = F.lower(F.regexp_extract(F.trim(url), r"(?i)^https?://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)", 1))
    six = F.regexp_extract(host, r"^\[(.*)\]$", 1)
    dotted = F.regexp_extract(six, r":ffff:(\d{1,3}(?:\.\d{1,3}){3})$", 1)
    pair = [F.conv(F.regexp_extract(six, r":ffff:([0-9a-f]{1,4}):([0-9a-f]{1,4})$", i), 16, 10).cast("long") for i in (1, 2)]
    inner = F.coalesce(_ipv4(F.when(dotted != "", dotted)), pair[0] * 65536 + pair[1])
    bad_six = (six == "") | six.isin("::1", "::") | six.rlike("^f[cd]|^fe[89ab]") | F.coalesce(_private(inner), F.lit(False))
    four = _ipv4(host)
    bad_four = F.coalesce((four >= 1 << 32) | _private(four), F.lit(False))
    return (host != "") & ~host.rlike(X.BLOCKED_HOST) & F.when(host.startswith("["), ~bad_six).otherwise(~bad_four)


def export_field(text: Column) -> Column:
    """A field without the separators of the export."""
    return F.replace(F.replace(text, F.lit("&"), F.lit("and")), F.lit(";"), F.lit(","))


def export_file_name(name: Column) -> Column:
    """File name of a deck's export."""
    s = F.replace(slug(name), F.lit(" "), F.lit("-"))
    return F.concat(F.when(s == "", F.lit("deck")).otherwise(s), F.lit(".txt"))


def folder_name(name: Column) -> Column:
    """White space collapsed."""
    return F.trim(F.regexp_replace(name, r"\s+", " "))


def sort_key(name: Column) -> Column:
    """Names in numeric order of their digits, without regard to case and accents: a run of digits stands behind its length, however long it is."""
    pieces = F.regexp_extract_all(F.lower(name), F.lit(r"\d+|\D+"), F.lit(0))
    bare = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    return F.collate(F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(r"^\d"), F.concat(F.lpad(F.length(bare(p)).cast("string"), 5, "0"), bare(p))).otherwise(p)), ""), "UNICODE_CI_AI")
