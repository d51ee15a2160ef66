"""Column expressions for text: blank test, length, money, dates, account numbers.

Everything here is a native Catalyst expression (no Python per row).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters Python's ``str.strip()`` removes: ASCII whitespace, the four file
# separators, NEL, and every Unicode space/line/paragraph separator.
PY_SPACE = r"\t\n\x0b\x0c\r \x1c-\x1f\x85\p{Z}"
BLANK_RE = rf"^[{PY_SPACE}]*$"
PAGE_BREAK_RE = r"(?m)^---[ \t]*$"
MONEY_RE = r"^\s*-?\$?[ \t]?(?:[0-9]+|[0-9]{1,3}(?:,[0-9]{3})++)(?:\.[0-9]+)?\s*$"
DATE_FORMATS = LONG_FORMAT, SHORT_FORMAT, ISO_FORMAT = ("MMMM d, yyyy", "MMM d, yyyy", "yyyy-MM-dd")


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_blank(c) -> Column:
    """True for NULL, empty or whitespace-only text (Python ``not s.strip()``)."""
    c = col_of(c)
    return c.isNull() | c.rlike(BLANK_RE)


def py_strip(c) -> Column:
    """Python ``str.strip()`` on a string column."""
    return F.regexp_replace(col_of(c), rf"^[{PY_SPACE}]+|[{PY_SPACE}]+$", "")


def char_length(c) -> Column:
    """Length in code points, what Python ``len(str)`` returns."""
    return F.char_length(col_of(c))


def parse_money(c, scale: int = 2) -> Column:
    """``$1,234.56`` / ``-$198.92`` / ``1234.5`` -> decimal; anything else (``1 2 3``, ``1,2,3``) -> NULL."""
    c = col_of(c)
    return F.when(c.rlike(MONEY_RE), F.translate(c, "$, \t\n\x0b\f\r", "").try_cast(f"decimal(18,{scale})"))


def format_money(c) -> Column:
    """Inverse of ``parse_money`` for two-decimal amounts."""
    c = col_of(c)
    return F.concat(F.when(c < 0, F.lit("-")).otherwise(F.lit("")), F.lit("$"),
                    F.format_number(F.abs(c), 2))


def normalize_date(c) -> Column:
    """``March 7, 2018`` / ``Mar. 7, 2018`` / ``Sept 7, 2018`` / ``2018-03-07`` -> DATE, else NULL."""
    c = F.regexp_replace(F.trim(col_of(c)), r"[ \t]+", " ")
    c = F.regexp_replace(F.regexp_replace(c, r"^([A-Za-z]{3,4})\.", "$1"), r"(?i)^sept ", "Sep ")
    # Only the one format that can read it is tried: a failed one costs an exception.
    return F.get(F.transform(F.array(c), lambda x: (
        F.when(x.rlike("^[0-9+-]"), F.try_to_date(x, ISO_FORMAT)).when(F.substring(x, 4, 1) == " ", F.try_to_date(x, SHORT_FORMAT))
        .when(x != "", F.try_to_date(x, LONG_FORMAT)))), 0)


def normalize_account(c) -> Column:
    """``10 101 010 10`` -> ``1010101010`` (kept as text)."""
    return F.regexp_replace(col_of(c), r"\s", "")


def group_account(c) -> Column:
    """Ten digits grouped 2-3-5 by spaces, the layout printed on statements."""
    c = col_of(c)
    return F.concat_ws(" ", F.substring(c, 1, 2), F.substring(c, 3, 3), F.substring(c, 6, 5))
