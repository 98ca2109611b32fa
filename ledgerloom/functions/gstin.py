"""GSTIN structure and checksum as native expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .parse import col

# The code alphabet, and the state codes 01 to 38, 97 and 99.
ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SHAPE = r"^(?:0[1-9]|[12][0-9]|3[0-8]|97|99)[A-Z]{5}[0-9]{4}[A-Z][0-9A-Z]Z[0-9A-Z]$"
_STATE = r"^(?:0[1-9]|[12][0-9]|3[0-8]|97|99)"
_PAN = r"^..[A-Z]{5}[0-9]{4}[A-Z]"


def check_digit(first14: Column | str) -> Column:
    """Base-36 check character over the first 14 characters, weights 1, 2, 1, 2 and so on.

    Null if a character lies outside the alphabet.
    """
    g = col(first14)

    def term(i: int) -> Column:
        value = F.nullif(F.instr(F.lit(ALPHABET), F.substring(g, i, 1)), F.lit(0)) - 1
        product = value * (2 if i % 2 == 0 else 1)
        return F.floor(product / 36) + product % 36

    total = reduce(lambda a, b: a + b, [term(i) for i in range(1, 15)])
    return F.substring(F.lit(ALPHABET), (F.pmod(36 - total % 36, F.lit(36)) + 1).cast("int"), F.lit(1))


def is_valid(gstin: Column | str) -> Column:
    """True for 15 characters of the right shape with the right check digit; false otherwise, also for null."""
    g = col(gstin)
    return F.coalesce(F.when(g.rlike(_SHAPE), F.substring(g, 15, 1) == check_digit(g)), F.lit(False))


def problem(gstin: Column | str) -> Column:
    """What is wrong with a GSTIN that is not valid: length, state, shape, fixed letter, or check digit, in this order."""
    g = col(gstin)
    return (
        F.when(F.length(g) != 15, F.format_string("length is %s, not 15", F.length(g)))
        .when(~g.rlike(_STATE), F.lit("unknown state code"))
        .when(~g.rlike(_PAN), F.lit("characters 3 to 12 are no PAN"))
        .when(F.substring(g, 14, 1) != "Z", F.lit("character 14 is not Z"))
        .otherwise(F.lit("wrong check digit or character"))
    )
