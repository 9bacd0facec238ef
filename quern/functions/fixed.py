"""Word lists, patterns and limits on which results depend.

Patterns are written for both Java and RE2. Those with a look-around, which RE2 lacks,
say so.
"""

# Words too common to carry meaning.
STOPWORDS = (
    "what when where which that this those these with from your you the and for not but its into "
    "does doing done should would could about according them they their instead rather than inside within "
    "without like such also have has are was were"
).split()
# Suffixes taken off while four characters stay, in this order, again and again; one greedy match does the same.
STEM = r"^(.{4,}?)(?:ing|ed|es|s|e)+$"
NUMBER = r"\d+(?:\.\d+)?"

# Near-duplicate cards: overlap of fronts, of backs, least words on either side.
DUPLICATE_FRONT, DUPLICATE_BACK, MIN_WORDS = 0.9, 0.9, 4
# Near-duplicate questions: overlap of stems, of answers, least answer words.
SAME_STEM, SAME_ANSWER, MIN_ANSWER_WORDS = 0.5, 0.8, 2
MISSED_SHARE = 0.3

# Labels that are no names of concepts.
DISCOURSE = (
    r"(?i)^(for example|for instance|e\.?g|i\.?e|note|notes|remember|tip|warning|caution|important|anyway|however|therefore|thus|so|and|but|or|also|"
    r"in short|in summary|in other words|in this case|in contrast|for reference|see also|as follows|the following|example|examples|result|results|"
    r"conclusion|summary|question|answer|hint|reminder|aside|caveat|disclaimer|update|edit|source|sources|via|from|to|by|with|about|explanation|"
    r"explanations|working|output|code|program|definition)$"
)
CHROME = r"(?i)^(docs|community|tools|search|menu|home|blog|download|playground|get started|get help|sign in|log in|share|print|copy|yes|no|skip to|back to top|table of contents)$"
PRONOUN = r"(?i)\b(we|you|i|they|it|he|she|us|our|your|my|their)\b"
IMPERATIVE = r"(?i)^(notice|note|see|consider|look|observe|recall|imagine|try|check|compare|suppose|assume|let|say)\b"
DEICTIC = r"(?i)\b(here|below|above|following|previous|next)\b"
FINITE_VERB = r"(?i)\b(is|are|was|were|has|have|had|can|could|will|would|should|do|does|did|says?|means|allows?|makes?|takes?|gets?|comes?|goes)\b"
LABEL_CHARS, LABEL_WORDS = (3, 70), 7

# Cards that are not worth keeping.
BOILERPLATE = (
    r"(?i)^(what characterizes\s+)?(learning objectives?|objectives?|references?( & further reading)?|further reading|agenda|outline|overview|"
    r"key takeaways?|takeaways?|questions?|thank you|acknowledg|disclosures?|class discussion|on this page|is this page helpful|search docs|"
    r"popular documentation pages|using \w+|community|contributors to this page|site colours?|site colors?|code font|previous|next|customize|made with)"
)
MAX_BACK_WORDS, MAX_FRONT_WORDS, MIN_BACK_CHARS = 60, 32, 3

# Fronts that point at something the card does not have.
REFERENCE_NOUNS = "examples?|code|snippets?|programs?|listings?|output|diagrams?|figures?|images?|pictures?|illustrations?|tables?|charts?|graphs?|slides?|sections?|passages?|excerpts?|text|scenario|case"
DANGLING = (
    rf"(?i)\b(?:this|these|the above|the following|the preceding|the previous|the given)\s+(?:{REFERENCE_NOUNS})\b"
    r"|\b(?:the above|the following)(?:\s*[?:,.]|\s*$)"
    r"|\b(?:shown|given|listed) (?:above|below)\b"
)
ATTACHED_CODE = r"(?i)\b(?:examples?|code|snippets?|programs?|listings?|output)\b"

# Definitions in prose.
PRONOUN_SUBJECT = r"(?i)^(it|this|that|these|those|there|they|we|you|he|she|i|one|some|most|many|both|all|each|another|others?)\b"
CONJUNCTION = r"(?i)^(but|and|or|so|yet|because|although|though|while|if|when|whereas|since|unless|until|after|before)\b"
_TERM = r"(?i)^(?:(?:a|an|the)\s+)?([A-Za-z][\w\s./'-]{2,45}?)\s+"
DEFINITIONS = (
    _TERM + r"is\s+the\s+concept\s+of\s+(.{10,})$",
    _TERM + r"(?:is|are)\s+(?:defined\s+as|referred\s+to\s+as|known\s+as|called)\s+(.{8,})$",
    _TERM + r"(?:refers\s+to|means)\s+(.{8,})$",
    _TERM + r"(?:is|are)\s+((?:a|an|the)\s+.{8,})$",
)
TRAILING = r"(?i)^(.{15,}?)\s+is\s+(?:sometimes\s+)?(?:called|known\s+as|termed)\s+([A-Za-z][\w-]{2,30})[.]?$"
TERM_DEFINITION = r"^([A-Za-z0-9][^:]{2,60}?):\s+(.{8,})$"
SUMMARY_FILLER = ("with", "from", "this", "that", "page", "the", "and", "for", "your")
STATEMENT = r"\b(is|are|describes?|means|lets?|allows?|makes?)\b"

# Phrasing.
QUESTION_WORD = r"(?i)^(what|which|who|when|where|why|how)\b"
PREPOSITION_END = r"(?i)\b(by|of|for|with|in|to|from|on|at|as|into|about|between|through)$"
PLURAL_HINT = r"(?i)\b(implications?|features?|milestones?|findings?|criteria|behaviou?rs?|points?|categories)\b"
ADVERBIAL = r"(?i)^(on|in|at|by|for|with|during|after|before)\b"
AGE = r"(?i)^\s*\d+\s*(?:[–—-]\s*\d+\s*)?(?:mo|yr|months?|years?|weeks?|days?)\b|^\s*\d+\s*\+"
DIMENSION = r"(?i)^(domain|area|aspect|category|dimension|feature|characteristic)s?$"
DOMAIN_NOUN = r"^(milestones?|findings?|criteria|features?|red flags?)$"
# Display names of languages.
LANGUAGES = {
    "bash": "Bash", "c": "C", "cpp": "C++", "csharp": "C#", "css": "CSS", "dart": "Dart", "go": "Go", "graphql": "GraphQL", "html": "HTML", "java": "Java",
    "javascript": "JavaScript", "json": "JSON", "jsx": "JSX", "kotlin": "Kotlin", "markdown": "Markdown", "php": "PHP", "python": "Python", "ruby": "Ruby",
    "rust": "Rust", "scala": "Scala", "scss": "Sass", "sh": "Shell", "shell": "Shell", "sql": "SQL", "swift": "Swift", "tsx": "TSX", "typescript": "TypeScript",
    "xml": "XML", "yaml": "YAML",
}

# Lines that a browser prints on every page.
PRINT_ARTIFACT = r"(?i)^\d+\s+of\s+\d+$|^page\s+\d+(\s+of\s+\d+)?$|^https?://|^\d{1,2}/\d{1,2}/\d{2,4},?\s+\d{1,2}:\d{2}(\s*[AP]M)?$|^©\s*\d{4}"
PAGE_TITLE = r"^(.{8,}?)\s+[–—|·»-]\s+(.{2,40})$"
SIGNATURE_CHARS, NAVIGATION_CHARS = 80, 60
CODE_CHARS = 1200

# Hosts that no reader may fetch.
BLOCKED_HOST = r"(?i)^(localhost|ip6-localhost|instance-data|metadata|metadata\.google\.internal|.*\.localhost|.*\.local|.*\.internal|.*\.home\.arpa)$"
IPV4 = r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$"

# Schedules.
DAY_MS, DEFAULT_EASE, MIN_EASE, MAX_INTERVAL = 86_400_000, 2.5, 1.3, 365
FIRST_INTERVAL = {"hard": 1, "good": 1, "easy": 4}
NEW_PER_SESSION, REQUEUE_GAP = 20, 3
# Neighbours of a batch, their characters, context cards, their characters, characters of a field of an infographic.
NEIGHBOURS, NEIGHBOUR_CHARS, CONTEXTS, CONTEXT_CHARS, FIELD_CHARS = 20, 160, 12, 200, 400
RATE_WINDOW_MS = 60_000

# Layout: gap below which fragments are one word, as a share of the font; tolerance of column anchors; rows of a table at least.
NO_SPACE_GAP, ANCHOR_TOLERANCE, MIN_ROWS = 0.3, 12, 3
# Batches of sections: sections, cards; pages of a batch.
BATCH_SECTIONS, BATCH_CARDS, BATCH_PAGES = 4, 40, 3
# Options that are no answers.
BANNED_OPTIONS = ("all of the above", "none of the above")
# Application code: characters, lines.
APPLICATION_CHARS, APPLICATION_LINES = 1500, 25
# Headings of appendices.
APPENDIX = (
    r"(?i)^(references?|citations?|notes( and references)?|footnotes?|bibliography|sources|further reading|external links?|see also|"
    r"related( (articles?|topics?|pages?|links?|content|posts?|stories))?|more in .+|learn more|links and books|you (might|may) also like|"
    r"you may be interested in|recommended( (for you|articles?|reading|posts?))?|popular( (articles?|posts?|resources?))?|trending( now)?|"
    r"navigation menu|contents|comments?|share this|about the author|licen[cs]e|acknowledgements?)$"
)
# Controls of a page.
CHROME_TEXT = (
    r"(?i)^(is this page useful\??|was this (page )?helpful\??|edit (this )?page|previous|next|on this page|table of contents|in this article|"
    r"share (this)?|copy( link| code)?|skip to (main )?content|back to top|menu|search|subscribe|sign (in|up)|log in|accept( all)?( cookies)?|"
    r"cookie (policy|settings)|advertisement|loading…?|show more|read more)$"
)
OUTPUT_LABEL = r"(?i)^output\s*:?$"
OUTPUT_LOOKBACK = 3
# Markdown.
MARKDOWN_EXTENSIONS = ("md", "markdown", "mdown", "mkd")
# With a back-reference, which RE2 lacks.
TERM_PAIR = r"^(\*\*|__|\*|_)(.{2,60}?)\1\s*[—–:-]\s+(.+)$"
# Inline marks and what stays of them, in this order; three have a look-ahead.
INLINE_MARKS = (
    (r"!\[[^\]]*\]\([^)]*\)", ""), (r"!\[[^\]]*\]\[[^\]]*\]", ""), (r"\[([^\]]*)\]\([^)]*\)", r"\1"), (r"\[\^[^\]]+\]", ""), (r"\[([^\]]*)\]\[[^\]]*\]", r"\1"),
    (r"<((?:https?|mailto):[^>\s]+)>", r"\1"), (r"</?[A-Za-z][^>]*>", ""), (r"``([^`]+)``", r"\1"), (r"`([^`]+)`", r"\1"), (r"\*\*\*([^*]+)\*\*\*", r"\1"),
    (r"\*\*([^*]+)\*\*", r"\1"), (r"\*([^*\n]+)\*", r"\1"), (r"(^|[^A-Za-z0-9_])___([^_]+)___(?![A-Za-z0-9_])", r"\1\2"), (r"(^|[^A-Za-z0-9_])__([^_]+)__(?![A-Za-z0-9_])", r"\1\2"),
    (r"(^|[^A-Za-z0-9_])_([^_\n]+)_(?![A-Za-z0-9_])", r"\1\2"), (r"~~([^~]+)~~", r"\1"), (r"\\([\\`*_{}\[\]()#+\-.!|>~])", r"\1"),
)
# A word that can be a host.
HOST_LIKE = r"(?i)^[a-z0-9-]+(\.[a-z0-9-]+)*\.[a-z]{2,}(:\d+)?([/?#]|$)"
# An age or a duration. Cards of a section, words of a sentence that answers, characters of a section and of a payload, deepest heading that divides.
DURATION = r"(?i)\b(mo|yr|months?|years?|weeks?|days?)\b"
SECTION_CARDS, PROSE_WORDS, SECTION_CHARS, PAYLOAD_CHARS, SPLIT_LEVEL = 30, 45, 1200, 100_000, 4
# An infographic's parts: characters of each; items by level of detail, pairs of the core concept, comparisons at most.
INFOGRAPHIC_CHARS = {
    "title": 80, "lede": 240, "keyTakeaway": 240, "label": 80, "detail": 240, "meta": 40, "name": 80, "value": 240, "concept": 60, "meaning": 160,
}
INFOGRAPHIC_ITEMS, CORE_PAIRS, COMPARISONS = {"basic": 6, "standard": 9, "detailed": 12}, 4, 6

# Fixed values of web pages.
NOISE_ELEMENTS = ("script", "style", "noscript", "nav", "header", "footer", "aside", "form", "svg", "iframe", "canvas", "template", "dialog", "button", "select", "textarea", "input", "video", "audio")
NOISE_ROLES = ("navigation", "banner", "contentinfo", "complementary", "search", "dialog")
NOISE_CLASSES = ("sidebar", "toc", "breadcrumb", "breadcrumbs", "cookie-banner", "advertisement")
#: The article, most specific first: elements as they are, .classes, #ids and [roles].
CONTENT = ("article", ".mw-parser-output", "[main]", "main", "#content", "#main", "#main-content", ".markdown-body", ".post-content", ".entry-content", ".article-body", ".content")
CONTENT_CHARS = 400
INLINE_ELEMENTS = (
    "a", "abbr", "b", "bdi", "bdo", "br", "cite", "code", "data", "del", "dfn", "em", "i", "img", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "u", "var", "wbr",
)
CALLOUT = r"(?i)^(note|notes|pitfall|caution|warning|tip|hint|deep dive|illustrated by|under the hood|remember|example|examples|try it out)$"
LINK_SHARE = 0.9
LOOSE_CHARS = 40

# Fixed patterns of Markdown lines.
ATX_HEADING = r"^ {0,3}(#{1,6})\s+(.*)$"
LIST_ITEM = r"^(\s*)(?:[-*+]|\d{1,9}[.)])\s+(.*)$"
THEMATIC_BREAK = r"^ {0,3}(?:-\s*(?:-\s*){2,}|\*\s*(?:\*\s*){2,}|_\s*(?:_\s*){2,})$"
TABLE_DELIMITER = r"^\s*\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)+\|?\s*$"
FENCE = r"^ {0,3}(`{3,}|~{3,})\s*(\S*)"
LANGUAGE_CHARS = 20

# Fixed values of page layout: multiples of the font size, points, and the signs of lists.
SAME_LINE_GAP, BASELINE, BLOCK_BREAK, SENTENCE_BREAK, WRAP, BULLET_WIDTH = 1.6, 0.4, 1.75, 1.4, 1.6, 1.2
BULLET = r"^[•◦▪‣∙▶►·]\s*$"
LEADING_BULLET = r"^\s*[•◦▪‣∙▶►·]+\s*"
HEADER_CHARS, FILLED = 60, 0.85
INLINE_LABEL = r"^[^.!?]{3,60}:$"
