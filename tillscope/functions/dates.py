"""Date columns: tolerant parsing and periods."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tried in this order; the first pattern that parses wins. A time of
# day may follow where the brackets allow it.
DATE_PATTERNS = (
    "yyyy-M-d['T'H:m[:s]][ H:m[:s]]",
    "M/d/yyyy[ H:m[:s]]",
    "d/M/yyyy[ H:m[:s]]",
    "yyyy/M/d[ H:m[:s]]",
    "d-M-yyyy[ H:m[:s]]",
    "M-d-yyyy[ H:m[:s]]",
)

# Tried after the fixed patterns, for free-form dates.
FALLBACK_PATTERNS = (
    "yyyy-M-d h:m[:s] a", "M/d/yyyy h:m[:s] a", "d/M/yyyy h:m[:s] a", "yyyy/M/d h:m[:s] a",
    "MMM d, yyyy", "MMMM d, yyyy", "MMM d yyyy", "MMMM d yyyy", "d MMM yyyy", "d MMMM yyyy", "d-MMM-yyyy",
    "yyyy.M.d", "d.M.yyyy[ H:m[:s]]", "yyyyMMdd",
)
# A full ISO time with a fraction or a zone, which Spark's own cast reads.
ISO_TIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]{1,9})?(Z|[+-][0-9]{2}:[0-9]{2})?$"

# What each pattern letter run looks like as a regular expression.
_SHAPES = {
    "yyyy": "[0-9]{4}",
    "MMMM": "[A-Za-z]{3,9}",
    "MMM": "[A-Za-z]{3}",
    "MM": "(?:0[1-9]|1[0-2])",
    "M": "(?:0?[1-9]|1[0-2])",
    "dd": "(?:0[1-9]|[12][0-9]|3[01])",
    "d": "(?:0?[1-9]|[12][0-9]|3[01])",
    "H": "(?:[01]?[0-9]|2[0-3])",
    "h": "(?:0?[1-9]|1[0-2])",
    "a": "[AaPp][Mm]",
    ".": "[.]",
    "m": "[0-5]?[0-9]",
    "s": "[0-5]?[0-9]",
}

# Candidates for one format that fits a whole column, in order.
COLUMN_FORMATS = (
    ("%Y-%m-%d", "yyyy-M-d"),
    ("%d/%m/%Y", "d/M/yyyy"),
    ("%m/%d/%Y", "M/d/yyyy"),
    ("%Y/%m/%d", "yyyy/M/d"),
    ("%d-%m-%Y", "d-M-yyyy"),
    ("%m-%d-%Y", "M-d-yyyy"),
    ("%Y%m%d", "yyyyMMdd"),
    ("%d%m%Y", "ddMMyyyy"),
    ("%m%d%Y", "MMddyyyy"),
)


def _shape(pattern: str) -> str:
    optional = {"[": "(?:", "]": ")?", "'T'": "T"}
    parts = re.sub(r"'T'|y+|M+|d+|H|h|m|s|a|[.]|\[|\]", lambda run: (_SHAPES | optional)[run.group()], pattern)
    return f"^{parts}$"


def parse_with(text: Column, pattern: str) -> Column:
    """The text as a timestamp if it has the pattern, else NULL.

    Text of another shape never reaches the parser: a failed parse raises and
    catches an exception inside Spark, which costs far more than the regular
    expression.
    """
    return F.when(F.rlike(text, F.lit(_shape(pattern))), F.try_to_timestamp(text, F.lit(pattern)))


def parse_timestamp(text: Column, patterns: Sequence[str] = DATE_PATTERNS + FALLBACK_PATTERNS) -> Column:
    """First pattern that parses the trimmed text, else an ISO time with fraction or zone; NULL if none does.

    The time of day is kept; a time with a zone becomes the session's.
    """
    trimmed = F.trim(text.cast("string"))
    iso = F.when(F.rlike(trimmed, F.lit(ISO_TIME)), trimmed.try_cast("timestamp"))
    return F.coalesce(*[parse_with(trimmed, p) for p in patterns], iso)


def parse_date(text: Column, patterns: Sequence[str] = DATE_PATTERNS + FALLBACK_PATTERNS) -> Column:
    return parse_timestamp(text, patterns).cast("date")


def ordered_patterns(order: str | None) -> tuple[str, ...]:
    """All patterns where numbers come in the given order: ``dmy`` or ``mdy`` leaves out those of the other; None tries both."""
    if order not in (None, "dmy", "mdy"):
        raise ValueError(f"no such order of a date: {order}")
    other = {"dmy": ("M/d/", "M-d-"), "mdy": ("d/M/", "d-M-", "d.M.")}.get(order, ())
    return tuple(p for p in DATE_PATTERNS + FALLBACK_PATTERNS if not p.startswith(other)) if other else DATE_PATTERNS + FALLBACK_PATTERNS


# Two numbers of one or two digits and a year of four, the same sign between them.
NUMBERS = r"^([0-9]{1,2})([-/.])([0-9]{1,2})\2[0-9]{4}(?![0-9])"


def period_start(when: Column, unit: str) -> Column:
    """First day of the Monday week ("week") or calendar month ("month")."""
    return F.date_trunc(unit, when).cast("date")
