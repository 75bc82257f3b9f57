"""String expressions with the exact semantics that samples and metrics rely on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(x: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def str_or_none(x: Column) -> Column:
    """Null for null and blank, else the string as it is."""
    return F.when(strip(x) != "", x)


def json_string(x: Column) -> Column:
    """JSON form of a string, non-ASCII raw, hexadecimal escapes in lower case; null becomes null."""
    quoted = F.to_json(F.array(x))
    body = quoted.substr(F.lit(2), F.length(quoted) - 2)
    for c in (0x0B, 0x0E, 0x0F, *range(0x1A, 0x20)):
        up, low = f"\\u{c:04X}", f"\\u{c:04x}"
        if up != low:
            body = F.replace(body, F.lit(up), F.lit(low))
    return F.when(x.isNull(), F.lit("null")).otherwise(body)


def unquoted(x: Column) -> Column:
    """Without one matching pair of quotes around it, then stripped."""
    s = strip(x)
    pair = s.rlike(r'(?s)^".*"$') | s.rlike(r"(?s)^'.*'$")
    return strip(F.when(s.isin('"', "'"), "").when(pair, s.substr(F.lit(2), F.length(s) - 2)).otherwise(s))


def tokens(length: Column) -> Column:
    """Additive token count: a quarter of the characters, rounded up."""
    return F.ceil(length / 4).cast("long")
