"""Cleaning and comparing of typed text."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from . import parse

# A form of address that is dropped, edge characters that are dropped, and what makes a text look damaged.
_ADDRESS = r"^(?:M/[sS]|Messrs)\.?\s+"
_EDGES = " .,;:-"
_ODD = r"[^A-Za-z0-9 &.,'()\-/]"
_WELDED = r"[0-9][A-Za-z]|[A-Za-z][0-9]"
_SPLIT = r"[A-Za-z][,;][A-Za-z]"


def standard_text(c: Column | str) -> Column:
    """Text with single blanks, without a leading form of address and without punctuation at its ends; null gives empty text."""
    plain = F.regexp_replace(F.coalesce(parse.strip(c), F.lit("")), r"(?U)\s+", " ")
    bare = F.btrim(F.regexp_replace(plain, _ADDRESS, ""), F.lit(_EDGES))
    return F.regexp_replace(bare, r"(?U)\s+", " ")


def looks_messy(c: Column | str) -> Column:
    """Whether text has odd characters, a digit welded to a letter, or a comma or semicolon inside a word; false for blanks."""
    text = F.coalesce(parse.filled(c), F.lit(""))
    return (text != "") & (text.rlike(_ODD) | text.rlike(_WELDED) | text.rlike(_SPLIT))


def sorted_words(c: Column | str) -> Column:
    """Words of a text in upper case and in order, so that their order doesn't count."""
    return F.array_join(F.array_sort(F.filter(F.split(F.upper(parse.col(c)), r"(?U)\s+"), lambda w: w != "")), " ")


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of the table held in the bits of one number."""
    if len(a) < len(b):
        a, b = b, a
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    ones = row
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return (ones & ~row).bit_count()


def ratio(a: str | None, b: str | None) -> float | None:
    """Similarity by insertions and deletions: twice the common subsequence over both lengths; 1 for two empty texts."""
    if a is None or b is None:
        return None
    return 2 * common_subsequence(a, b) / (len(a) + len(b)) if a or b else 1.0


def with_ratio(pairs: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """pairs with the ratio of two text columns. Different pairs of texts are compared once per batch."""
    ship(pairs.sparkSession)

    @F.pandas_udf("double")
    def compare(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in batches:
            known: dict[tuple, float | None] = {}
            values = []
            for k in zip(x, y, strict=True):
                if k not in known:
                    known[k] = ratio(*k)
                values.append(known[k])
            yield pd.Series(values, dtype="float64")

    # A filter on the ratio would otherwise be moved before it and compute it once more.
    return pairs.withColumn(out, compare.asNondeterministic()(a, b))
