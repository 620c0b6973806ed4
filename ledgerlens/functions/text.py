"""Text column functions: normalisation, section detection, quality
predicates, query terms, keyword overlap and sentence splitting.

All are built-in expressions (regexp_*, higher-order array functions).  The
regular expressions avoid engine-specific classes: Python's Unicode ``\\s``
is spelled out, and word boundaries are written as explicit letter/digit
classes, so Java (Spark) and RE2 (the SQL oracle) agree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's Unicode whitespace (``str.isspace``), valid in Java and RE2 classes.
WS = r"[\t\n\x0B\f\r\x1C-\x1F \x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"

# Section headings, tried in order; first hit wins.
SECTION_PATTERNS = [
    (r"Introduction", "Introduction"),
    (r"Motivation", "Motivation"),
    (r"Cognitive\s+Bias", "Cognitive Bias"),
    (r"Aim\s+and\s+Objectives", "Aim and Objectives"),
    (r"Research\s+Aim", "Research Aim"),
    (r"Research\s+Objectives", "Research Objectives"),
    (r"Justification", "Justification"),
    (r"Research\s+Questions?", "Research Questions"),
    (r"Hypotheses", "Hypotheses"),
    (r"Research\s+Methodology", "Research Methodology"),
    (r"Literature\s+Review", "Literature Review"),
    (r"Descriptive\s+analytics", "Descriptive Analytics"),
    (r"Diagnostic\s+Analysis", "Diagnostic Analysis"),
    (r"Predictive\s+Analytics", "Predictive Analytics"),
    (r"Prescriptive\s+Analytics", "Prescriptive Analytics"),
    (r"Case\s+Study", "Case Studies"),
    (r"Integration\s+of\s+Tools", "Tools and Technologies"),
    (r"Data\s+Pipeline", "Data Pipeline"),
    (r"Conclusion", "Conclusion"),
    (r"References", "References"),
]
# Patterns whose trailing word boundary is absent in the heading list above.
_NO_TRAILING_BOUNDARY = {"Cognitive Bias"}

# Keywords that mark a question as about the audit data.
AUDIT_KEYWORDS = ["sales", "profit", "loss", "margin", "cash", "flow", "creditor", "debtor", "stock",
                  "inventory", "wastage", "waste", "purchase", "revenue", "audit", "emilio",
                  "restaurant", "april", "may", "pokhara", "foodmandu"]
# Words dropped from question keywords in extractive answers.
STOP_WORDS = ["what", "which", "where", "when", "does", "this", "that", "with", "from", "about"]
# Noise phrases that disqualify an answer sentence.
NOISE_TERMS = ["table of contents", "list of figures", "accessed:"]

DOT_RUN = r"\.{5,}"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def section_regex(pattern: str, name: str) -> str:
    """Case-insensitive whole-word pattern with explicit boundaries."""
    body = pattern.replace(r"\s", WS)
    tail = "" if name in _NO_TRAILING_BOUNDARY else f"($|{NOT_WORD})"
    return f"(?i)(^|{NOT_WORD}){body}{tail}"


# Whitespace other than the plain space.
WS_NOT_SPACE = WS.replace(" ", "")


def normalize_text(col) -> Column:
    """NUL -> space, whitespace runs -> one space, trim.  Only runs that
    change are matched (two or more characters, or one that is not a plain
    space); the output equals replacing every run."""
    t = F.regexp_replace(_c(col), r"\x00", " ")
    return F.trim(F.regexp_replace(t, f"{WS}{{2,}}|{WS_NOT_SPACE}", " "))


def strip_ws(col) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace."""
    return F.regexp_replace(_c(col), f"^{WS}+|{WS}+$", "")


def _first_word(pattern: str) -> str:
    return pattern.split("\\")[0].rstrip("?").lower()


def detect_section(col, default: str = "General") -> Column:
    """First matching heading pattern, else ``default``.  A plain
    substring test on the pattern's first word guards each regex, so most
    texts never run a regex at all."""
    c = _c(col)
    low = F.lower(c)
    expr = None
    for pattern, name in SECTION_PATTERNS:
        cond = low.contains(_first_word(pattern)) & c.rlike(section_regex(pattern, name))
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr.otherwise(F.lit(default))


def dot_runs(col) -> Column:
    return F.regexp_count(_c(col), F.lit(DOT_RUN))


def low_quality_page(col) -> Column:
    """P5: table-of-contents / figure-list page, or >= 3 dot leaders in a
    short (< 2500 chars) page."""
    c = _c(col)
    low = F.lower(c)
    return (low.contains("table of contents") | low.contains("list of figures")
            | ((dot_runs(c) >= 3) & (F.length(c) < 2500)))


def low_quality_chunk(col) -> Column:
    """Shorter than 80, >= 2 dot leaders, or starts with a TOC heading."""
    c = _c(col)
    return (F.length(c) < 80) | (dot_runs(c) >= 2) | F.lower(c).startswith("table of contents")


def useful_sentence(col) -> Column:
    """At least 40 chars, no dot leader, not only digits/dots/space, not a
    bare markdown heading, no noise phrase."""
    c = _c(col)
    low = F.lower(c)
    noise = None
    for t in NOISE_TERMS:
        noise = low.contains(t) if noise is None else (noise | low.contains(t))
    heading = strip_ws(c).rlike(f"^#+{WS}*(?:{WORD}|{WS})+$")
    return ((F.length(c) >= 40) & ~c.rlike(DOT_RUN) & ~c.rlike(rf"^(?:\p{{Nd}}|\.|{WS})+$")
            & ~heading & ~noise)


def audit_query(col) -> Column:
    """Any audit keyword is a substring of the lower-cased question."""
    low = F.lower(_c(col))
    kws = F.array(*[F.lit(k) for k in AUDIT_KEYWORDS])
    return F.exists(kws, lambda k: F.contains(low, k))


def query_terms(col) -> Column:
    """Distinct lower-cased runs of 4+ ASCII letters."""
    words = F.regexp_extract_all(_c(col), F.lit("([A-Za-z]{4,})"), 1)
    return F.array_distinct(F.transform(words, lambda w: F.lower(w)))


def keyword_terms(col) -> Column:
    """X10 (extractive variant): query terms minus the stop words."""
    return F.array_except(query_terms(col), F.array(*[F.lit(w) for w in STOP_WORDS]))


def keyword_overlap(terms, text) -> Column:
    """X11: how many terms occur as substrings of the lower-cased text."""
    low = F.lower(_c(text))
    return F.size(F.filter(_c(terms), lambda t: F.contains(low, t)))


def split_sentences(col) -> Column:
    """Split after . ! or ? followed by whitespace."""
    return F.split(_c(col), f"(?<=[.!?]){WS}+")
