"""Scalar column functions: lenient parsing, cell cleaning, number formats,
report-period detection and calendar helpers.  All are built-in expressions,
so they stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month abbreviations in calendar order.
MONTH_ORDER = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def lenient_number(col) -> Column:
    """string/number -> DOUBLE; parse errors and NaN become NULL."""
    out = F.trim(_c(col).cast("string")).try_cast("double")
    return F.when(F.isnan(out), F.lit(None).cast("double")).otherwise(out)


def clean_cell(col) -> Column:
    """Trim; empty string or the text 'nan' (any case) -> NULL."""
    t = F.trim(_c(col).cast("string"))
    # only letters of ASCII become those of 'nan', so texts of other lengths need not be lowered
    return F.when((t == "") | ((F.octet_length(t) == 3) & (F.lower(t) == "nan")), F.lit(None).cast("string")).otherwise(t)


def plain_number(col) -> Column:
    """A number as a cell shows it, with all its digits: '12', '1234567.89' (up to six decimals)."""
    x = _c(col).cast("double")
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    return (F.when(x.isNull() | F.isnan(x), F.lit(None).cast("string"))
            .when(whole, x.cast("bigint").cast("string"))
            # without an exponent, and with six decimals at most, the number's own text is the same
            .when((F.abs(x) >= 1e-3) & (F.abs(x) < 1e7) & (F.length(x.cast("string")) - F.instr(x.cast("string"), ".") <= 6), x.cast("string"))
            .otherwise(F.rtrim(x.cast("decimal(38,6)").cast("string"), F.lit("0"))))


def format_long(col) -> Column:
    """X3 long form: |x|>=1000 -> '1,234.00'; integral -> '12'; else 2 decimals."""
    x = _c(col).cast("double")
    return (F.when(x.isNull() | F.isnan(x), F.lit(None).cast("string"))
            .when(F.abs(x) >= 1000, F.format_number(x, 2))
            .when(x == F.floor(x), F.floor(x).cast("bigint").cast("string"))
            .otherwise(F.format_string("%.2f", x)))


def format_short(col) -> Column:
    """X3 short form: >=1e6 -> '1.23M'; >=1000 -> '1,234'; integral; else 3 decimals."""
    x = _c(col).cast("double")
    return (F.when(x.isNull() | F.isnan(x), F.lit(None).cast("string"))
            .when(F.abs(x) >= 1_000_000, F.concat(F.format_string("%.2f", x / F.lit(1_000_000.0)), F.lit("M")))
            .when(F.abs(x) >= 1000, F.format_number(x, 0))
            .when(x == F.floor(x), F.floor(x).cast("bigint").cast("string"))
            .otherwise(F.format_string("%.3f", x)))


# Ordered name rules for report-period detection.  Each entry
# is (tokens that must all occur in the lower-cased name, month name); the
# token "{year}" stands for the report year.  'march', 'april' and 'may'
# need no year; the abbreviations need it.
PERIOD_RULES = [
    (["jan", "{year}"], "January"),
    (["feb", "{year}"], "February"),
    (["march"], "March"),
    (["mar", "{year}"], "March"),
    (["april"], "April"),
    (["may"], "May"),
    (["jun", "{year}"], "June"),
    (["jul", "{year}"], "July"),
    (["aug", "{year}"], "August"),
    (["sep", "{year}"], "September"),
    (["oct", "{year}"], "October"),
    (["nov", "{year}"], "November"),
    (["dec", "{year}"], "December"),
]

# Full month names scanned in the fallback text search.
FALLBACK_MONTHS = ["january", "february", "march", "april", "may", "june",
                   "july", "august", "september", "october", "november", "december"]


def detect_period(name_col, text_col=None, year="2026") -> Column:
    """First matching rule on the file name; else month+year in the text
    (fallback scan); else 'Unknown Period'.  ``year`` is a string or a
    column (for sources whose year varies)."""
    name = F.lower(_c(name_col))
    y = F.lit(year) if isinstance(year, str) else year
    expr = None
    for tokens, month in PERIOD_RULES:
        cond = None
        for t in tokens:
            c = name.contains(y) if t == "{year}" else name.contains(t)
            cond = c if cond is None else (cond & c)
        label = F.concat(F.lit(month + " "), y)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    if text_col is not None:
        flat = F.lower(_c(text_col))
        for m in FALLBACK_MONTHS:
            expr = expr.when(flat.contains(m) & flat.contains(y), F.concat(F.lit(m.capitalize() + " "), y))
    return expr.otherwise(F.lit("Unknown Period"))


def month_abbrev(date_col) -> Column:
    """'Jan'..'Dec' from a date/timestamp (locale independent)."""
    arr = F.array(*[F.lit(m) for m in MONTH_ORDER])
    return F.element_at(arr, F.month(_c(date_col)))


def period_of(date_col) -> Column:
    """'YYYY-MM' period key; sorts lexically."""
    return F.date_format(_c(date_col), "yyyy-MM")


def day_name(date_col) -> Column:
    """English day name."""
    return F.date_format(_c(date_col), "EEEE")


def monday0(date_col) -> Column:
    """Day of week with Monday = 0 (``weekday``, not ``dayofweek``)."""
    return F.weekday(_c(date_col))


def lenient_date(col) -> Column:
    """A date written by hand -> DATE, NULL if it is none of these or no day of the calendar:
    '2024-1-31' or '2024/01/31' (a time may follow), '01/31/2024' (day first where the first number
    is above 12), '31 January 2024', '31-Jan-24' with a four-digit year, 'Jan 31, 2024'."""
    t = F.trim(_c(col).cast("string"))
    lows = [F.lit(m.lower()) for m in MONTH_ORDER]

    def part(pattern: str, i: int) -> Column:
        return F.regexp_extract(t, pattern, i)

    def number(pattern: str, i: int) -> Column:
        return part(pattern, i).try_cast("int")

    def month(pattern: str, i: int) -> Column:
        name = F.lower(part(pattern, i))
        at = F.array_position(F.array(*lows), F.substring(name, 1, 3)).cast("int")
        full = F.element_at(F.array(*[F.lit(m) for m in FALLBACK_MONTHS]), F.greatest(at, F.lit(1)))
        return F.when((at > 0) & full.startswith(name), at)

    def day(y: Column, m: Column, d: Column) -> Column:
        return F.to_date(F.try_make_timestamp(y, m, d, F.lit(0), F.lit(0), F.lit(0)))

    iso, slash = r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})(?:[T ]\d{1,2}:\d{2}.*)?$", r"^(\d{1,2})/(\d{1,2})/(\d{4})$"
    day_first, month_first = r"^(\d{1,2})[- ]([A-Za-z]{3,9})[-, ]+(\d{4})$", r"^([A-Za-z]{3,9})\.? (\d{1,2}),? (\d{4})$"
    a, b = number(slash, 1), number(slash, 2)
    return (F.when(t.rlike(iso), day(number(iso, 1), number(iso, 2), number(iso, 3)))
            .when(t.rlike(slash), day(number(slash, 3), F.when(a > 12, b).otherwise(a), F.when(a > 12, a).otherwise(b)))
            .when(t.rlike(day_first), day(number(day_first, 3), month(day_first, 2), number(day_first, 1)))
            .when(t.rlike(month_first), day(number(month_first, 3), month(month_first, 1), number(month_first, 2))))
