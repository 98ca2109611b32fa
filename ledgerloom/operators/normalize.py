"""Normalisation of valid ledger records, with a log of what it changed."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parse, text
from ..session import ship, store
from .validate import NUMERIC

DATES = ("invoice_date", "itc_claimed_date", "rule88d_intimation_date", "supplier_filing_date", "simulated_current_date")
_CHANGE = "array<struct<field:string,raw:string,normalized:string,rule:string>>"


def _blank(c: Column | str) -> Column:
    return F.coalesce(parse.strip(c), F.lit(""))


def standard_date(c: Column | str) -> Column:
    """ISO text of a date; what can't be read stays as stripped text, blank as empty text."""
    return F.coalesce(parse.parse_date(c).cast("string"), _blank(c))


def standard_amount(c: Column | str) -> Column:
    """Amount with two decimals, half rounded up; what can't be read stays as stripped text, blank as empty text."""
    return F.coalesce(parse.parse_amount(c).cast("decimal(24,2)").cast("string"), _blank(c))


def rules(columns: list[str]) -> dict[str, tuple[str, Column]]:
    """Rule and normalised column of each field that has one; invoice_id is never touched."""
    out: dict[str, tuple[str, Column]] = {}
    for c in columns:
        if c == "vendor_gstin":
            out[c] = ("gstin", F.coalesce(parse.standard_gstin(c), F.lit("")))
        elif c in DATES:
            out[c] = ("date", standard_date(c))
        elif c in NUMERIC:
            out[c] = ("amount", standard_amount(c))
        elif c == "vendor_name":
            out[c] = ("text", text.standard_text(c))
    return out


def normalize(records: DataFrame) -> DataFrame:
    """records with normalised fields in place, the raw ones in the struct ``raw``, and ``changes``, one entry for each field
    that moved. Fields that a source lacks are skipped; null and empty text are the same and no change."""
    todo = rules(records.columns)
    staged = parse.staged(records, {f"_n_{c}": v for c, (_, v) in todo.items()})
    change = [
        F.when(F.coalesce(F.col(c), F.lit("")) != F.col(f"_n_{c}"), F.struct(F.lit(c).alias("field"), F.col(c).alias("raw"), F.col(f"_n_{c}").alias("normalized"), F.lit(rule).alias("rule")))
        for c, (rule, _) in todo.items()
    ]
    keep = [F.col(f"_n_{c}").alias(c) if c in todo else F.col(c) for c in records.columns]
    return staged.select(*keep, F.struct(*todo).alias("raw"), F.array_compact(F.array(*change)).cast(_CHANGE).alias("changes"))


def change_log(normalized: DataFrame, *keep: str) -> DataFrame:
    """One row per changed field of normalised records."""
    return normalized.select(*keep, F.explode("changes").alias("c")).select(*keep, "c.*")


def accept_reply(reply: str, original: str) -> str:
    """The text of a cleaner's reply: a JSON object with the one key cleaned_text, not empty and at most twice as long as the
    original plus 24. Anything else raises ValueError."""
    data = json.loads(reply)
    if not isinstance(data, dict) or list(data) != ["cleaned_text"] or not isinstance(data["cleaned_text"], str):
        raise ValueError("reply isn't an object with the one text cleaned_text")
    out = data["cleaned_text"].strip()
    if not out or len(out) > 2 * len(original) + 24:
        raise ValueError("cleaned text is empty or runs away")
    return out


def clean_names(normalized: DataFrame, cleaner: Callable[[str], str], column: str = "vendor_name") -> tuple[DataFrame, DataFrame]:
    """(records with repaired names and ``name_status``, numbers of names by status).

    Only different messy names are sent, each once. A reply that breaks the contract, or a cleaner that raises, leaves the
    name as it is. Status: not_needed, applied, unchanged, rejected (contract) or failed (raised).
    """
    ship(normalized.sparkSession)
    messy = normalized.where(text.looks_messy(column)).select(F.col(column).alias("_name")).distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for name in b["_name"]:
                try:
                    reply = cleaner(name)
                except Exception:  # whatever a cleaner raises, the name stays
                    rows.append((name, name, "failed"))
                    continue
                try:
                    new = accept_reply(reply, name)
                    rows.append((name, new, "applied" if new != name else "unchanged"))
                except ValueError:
                    rows.append((name, name, "rejected"))
            yield pd.DataFrame(rows, columns=["_name", "_new", "name_status"])

    # Written before it is used twice: a second call of the cleaner might answer otherwise.
    repaired = store(messy.mapInPandas(run, "_name string, _new string, name_status string"))
    joined = normalized.join(repaired, F.col(column) == F.col("_name"), "left")
    out = joined.withColumn(column, F.coalesce("_new", column)).withColumn("name_status", F.coalesce("name_status", F.lit("not_needed"))).drop("_name", "_new")
    return out, repaired.groupBy("name_status").agg(F.count("*").alias("n"))
