"""Text expressions shared by the operators. White space is the ECMAScript class, which Java's \\s is not."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that count as white space (fixed value: ECMAScript WhiteSpace and LineTerminator).
WS = r"[\t-\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
_WS_RUN = WS + "+"


def js_trim(c: Column) -> Column:
    """White space of every kind removed at both ends."""
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def clean_text(c: Column) -> Column:
    """White space runs become one space, none at the ends."""
    return F.trim(F.regexp_replace(c, _WS_RUN, " "))


def non_blank(c: Column) -> Column:
    """Null where the value is null or only white space, else the trimmed value."""
    return F.nullif(js_trim(c), F.lit(""))


def first_non_blank(*cs: Column) -> Column:
    return F.coalesce(*[non_blank(c) for c in cs])


def normalize_markdown(c: Column) -> Column:
    """Line ends to LF, NBSP to space, no blanks at line ends, at most one blank line, trimmed."""
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.replace(c, F.lit("\u00a0"), F.lit(" "))
    c = F.regexp_replace(c, r"[ \t]+(?=\n|\z)", "")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return js_trim(c)


def normalize_fingerprint_content(c: Column) -> Column:
    """As ``normalize_markdown``, but only line breaks go at the ends, so indentation of the first line stays."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n?", "\n")
    c = F.regexp_replace(c, r"[ \t]+(?=\n|\z)", "")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return F.regexp_replace(c, r"\A\n+|\n+\z", "")


def visible_length(html: Column) -> Column:
    """Length of the text of an HTML string without its tags."""
    return F.length(clean_text(F.regexp_replace(html, "<[^>]+>", " ")))


def parse_moment(c: Column) -> Column:
    """A moment in any of the usual ISO spellings; without a zone it is UTC; null where it can't be read."""
    s = js_trim(c)
    zoned = F.when(s.rlike(r"(?i)(z|utc|[+-]\d{2}:?\d{2})$") & s.rlike(r"^\d{4}-\d{2}-\d{2}.*:"), s)
    return F.coalesce(zoned, F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d"), F.concat(s, F.lit("+00:00"))), F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(s, F.lit("T00:00:00+00:00")))).try_cast("timestamp")
