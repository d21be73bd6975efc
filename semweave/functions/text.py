"""Text expressions that follow Python ``str`` semantics on the JVM.

Python's ``str.split()`` / ``str.strip()`` treat every Unicode white-space
character *and* the four ASCII separators U+001C..U+001F as blanks. Java's
``(?U)\\s`` covers the former only, so the separators are added explicitly.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# character class of Python white space, as a Java regex fragment
WS_CLASS = r"(?U)[\s\x1c-\x1f]"
_NON_WS = r"(?U)[^\s\x1c-\x1f]+"

# The 29 characters for which Python's str.isspace() is true,
# in code-point order (U+0009-000D, U+001C-001F, U+0020, U+0085, U+00A0,
# U+1680, U+2000-200A, U+2028, U+2029, U+202F, U+205F, U+3000).
PY_WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
                 "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
                 "\u2028\u2029\u202f\u205f\u3000")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def year_from_date(date_text, null_date: str = "zero") -> Column:
    """Year = integer before the first '-' of the date text.

    ``null_date="zero"``: null or empty date text counts as year 0 (the
    exploratory scan); ``"drop"``: it yields null so a later
    ``isNotNull`` filter drops the row (the embedding scan). Text whose
    prefix is not an integer yields null either way.
    """
    d = _c(date_text)
    if null_date == "zero":
        d = F.coalesce(F.nullif(d, F.lit("")), F.lit("0-0-0"))
    elif null_date != "drop":
        raise ValueError("null_date must be 'zero' or 'drop'")
    return F.split_part(d, F.lit("-"), F.lit(1)).try_cast("int")


def strip_text(text) -> Column:
    """Null-safe Unicode strip: ``(x or '').strip()`` — a character-set
    trim on both ends (no regular expression)."""
    return F.btrim(F.coalesce(_c(text), F.lit("")), F.lit(PY_WHITESPACE))


def word_count(text) -> Column:
    """``len(x.split())``: the number of maximal runs of non-blank characters.

    Counting matches avoids materialising the token array; '' gives 0.
    """
    return F.coalesce(F.regexp_count(_c(text), F.lit(_NON_WS)), F.lit(0)).cast("int")


def first_line(text) -> Column:
    """Text before the first newline (the whole text if there is none)."""
    return F.split_part(F.coalesce(_c(text), F.lit("")), F.lit("\n"), F.lit(1))


def clean_title(title) -> Column:
    """Tabs/newlines to spaces, then strip; null becomes ''."""
    return strip_text(F.translate(F.coalesce(_c(title), F.lit("")), "\t\n", "  "))


# Placeholder title of an id without metadata, "<unknown {id}>".
UNKNOWN_PREFIX, UNKNOWN_SUFFIX = "<unknown ", ">"


def unknown_title(id_col) -> Column:
    """Placeholder title for an id without metadata: ``<unknown {id}>``."""
    return F.concat(F.lit(UNKNOWN_PREFIX), _c(id_col).cast("string"), F.lit(UNKNOWN_SUFFIX))


def tau_tag(tau) -> Column:
    """Stable string key for a threshold: 0.19 -> 'tau_0p190'."""
    return F.concat(F.lit("tau_"), F.replace(F.format_string("%.3f", _c(tau)), F.lit("."), F.lit("p")))


def date_text(ts, zone_free: bool) -> Column:
    """``yyyy-MM-dd`` of a timestamp independent of the session time zone.

    A zone-free timestamp (``TIMESTAMP_NTZ``) is cast to a DATE directly; a
    zoned one is reduced to whole UTC days since the epoch first.
    """
    if zone_free:
        return _c(ts).cast("date").cast("string")
    days = F.floor(F.unix_seconds(_c(ts)) / F.lit(86400)).cast("int")
    return F.date_from_unix_date(days).cast("string")
