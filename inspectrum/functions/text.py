"""Text and number coercion as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INT_PATTERN = r"^\s*[+-]?[0-9]+\s*$"
NUMBER_PATTERN = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
# Every character that counts as white space.
ASCII_SPACE = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f"
WHITE_SPACE = ASCII_SPACE + (
    "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def is_ascii(c: Column) -> Column:
    """As many bytes as characters."""
    return F.octet_length(c) == F.length(c)


def strip(c: Column) -> Column:
    """Drop leading and trailing white space of any kind; ASCII text takes the short list."""
    return F.when(is_ascii(c), F.btrim(c, F.lit(ASCII_SPACE))).otherwise(F.btrim(c, F.lit(WHITE_SPACE)))


def repair_mojibake(c: Column) -> Column:
    """Undo UTF-8 text that was read as Latin-1; keep text that does not decode."""
    latin = c.rlike(r"^[\x{0}-\x{FF}]*$")
    decoded = F.encode(c, "ISO-8859-1").cast("string")
    return F.when(~is_ascii(c) & latin & F.is_valid_utf8(decoded), decoded).otherwise(c)


def to_int(c: Column, kind: str = "int") -> Column:
    """Plain integer text to a number, anything else to NULL."""
    return F.when(c.rlike(INT_PATTERN), c.try_cast(kind))


def to_whole_number(c: Column) -> Column:
    """Numeric text to bigint; decimals are accepted when they are whole."""
    as_double = F.when(c.rlike(NUMBER_PATTERN), c.try_cast("double"))
    whole = F.when((as_double == F.rint(as_double)) & (F.abs(as_double) < F.lit(2.0**63)), as_double)
    return F.coalesce(to_int(c, "bigint"), whole.cast("bigint"))


def is_present(c: Column) -> Column:
    """Not NULL and not the empty string."""
    return c.isNotNull() & (c != "")


def has_text(c: Column) -> Column:
    """Not NULL and not only spaces."""
    return c.isNotNull() & (F.trim(c) != "")


def year_of(c: Column) -> Column:
    return to_int(F.substring(c, 1, 4))


def month_of(c: Column) -> Column:
    return to_int(F.substring(c, 6, 2))


def same_name(c: Column, wanted: str) -> Column:
    """Case-insensitive equality with a trimmed search term."""
    return F.upper(c) == F.lit(wanted.strip().upper())
