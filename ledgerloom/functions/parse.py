"""Typed readings of text cells.

Blank, null and blanks-only cells are the same thing and give null everywhere in this module. Nothing raises on
bad text: an unreadable cell gives null, and the ``*_key`` functions keep its text so that two unreadable cells can
still be compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Accepted range of invoice dates.
FIRST_DATE = "2017-07-01"
LAST_DATE = "2030-12-31"

# Unicode white space at either end, and the separators U+001C to U+001F.
_EDGE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
# Plain text with nothing at its ends, which most cells are: a cheaper test than the search for edges.
_PLAIN = r"^[!-~](?:[ -~]*[!-~])?\z"
_YEAR_FIRST = r"^[0-9]{4}([-/])[0-9]{1,2}\1[0-9]{1,2}$"
_DAY_FIRST = r"^[0-9]{1,2}([-/.])[0-9]{1,2}\1[0-9]{4}$"
_DIGITS = r"[0-9]+(?:_[0-9]+)*"
_NUMBER = rf"^[+-]?(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?[0-9]{{1,2}})?$"
AMOUNT_TYPE = "decimal(24,6)"


def staged(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with columns added that later expressions read instead of computing again.

    Adjacent projections are merged by the optimizer, which copies an expression into each place that reads a field of
    it. A generator over one row stands between them and yields the same rows.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Text without white space of any kind at its ends; null stays null."""
    return F.when(col(c).rlike(_PLAIN), col(c)).otherwise(F.regexp_replace(col(c), _EDGE, ""))


def filled(c: Column | str) -> Column:
    """Stripped text, or null if nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def is_blank(c: Column | str) -> Column:
    """True for null, empty and white-space-only text; never null."""
    return filled(c).isNull()


def date_of(text: Column) -> Column:
    """DATE of stripped text in the layouts Y-m-d, Y/m/d, d/m/Y, d-m-Y or d.m.Y, day and month of one or two digits."""
    plain = F.translate(text, "/.", "--")
    day, month = F.substring_index(plain, "-", 1), F.substring_index(F.substring_index(plain, "-", 2), "-", -1)
    turned = F.concat(F.right(plain, F.lit(4)), F.lit("-"), month, F.lit("-"), day)
    return F.when(text.rlike(_YEAR_FIRST), plain.try_cast("date")).when(text.rlike(_DAY_FIRST), turned.try_cast("date"))


def parse_date(c: Column | str) -> Column:
    """DATE of a cell; null if no layout fits or the day doesn't exist."""
    return date_of(strip(c))


def amount_of(text: Column) -> Column:
    """Decimal of stripped text; commas, blanks and the rupee sign are dropped. Null if no finite number is left."""
    bare = F.translate(text, ",₹ ", "")
    return F.when(bare.rlike(_NUMBER), F.translate(bare, "_", "").try_cast(AMOUNT_TYPE))


def parse_amount(c: Column | str) -> Column:
    """Decimal of an amount cell; null if blank or unreadable."""
    return amount_of(strip(c))


def standard_gstin(c: Column | str) -> Column:
    """GSTIN in upper case without white space and hyphens; null if nothing is left."""
    return F.nullif(F.upper(F.regexp_replace(col(c), r"(?U)[\s\-]", "")), F.lit(""))


def pan(gstin: Column | str) -> Column:
    """The ten-character holder number inside a standard GSTIN."""
    return F.substring(col(gstin), 3, 10)


def record_key(c: Column | str) -> Column:
    """Identifier for joining snapshots and copies: stripped, upper case; null if blank."""
    return F.upper(filled(c))


def amount_key(c: Column | str) -> Column:
    """Comparable text of an amount: the number without trailing zeros, else ``?`` and the stripped text.

    ``7.5`` and ``7.50`` give the same key; blank gives null and so differs from ``0.00``.
    """
    return F.coalesce(parse_amount(c).cast("string"), F.concat(F.lit("?"), filled(c)))


def date_key(c: Column | str) -> Column:
    """Comparable text of a date: ISO if it can be read, else ``?`` and the stripped text."""
    return F.coalesce(parse_date(c).cast("string"), F.concat(F.lit("?"), filled(c)))
