"""Registered queries of the core: name to a function of (spark, data folder)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import copydiff, snapshots, validate
from ..sources.tables import FILING_COLUMNS, SOURCES, table
from . import ledger_queries

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Added, removed and changed invoices of each delivered snapshot after the first."""
    return snapshots.filing_changes(table(spark, folder, "gstr2b_prior_period"))


def p1_by_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers of added, removed and changed invoices by snapshot."""
    return snapshots.changes_by_snapshot(p1_found(spark, folder))


def _judged(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, folder, "raw_filing_lines").where("line_no <> 1")
    return (
        validate.load_lines(lines, FILING_COLUMNS),
        validate.load_snapshots(table(spark, folder, "quarantine_log"), SOURCES),
    )


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Lines and logged snapshots that hold no valid record, with the reason."""
    lines, log = _judged(spark, folder)
    a = validate.failing(lines, F.lit("raw_filing_lines").alias("origin"), F.col("line_id").alias("row_id"))
    return a.unionByName(validate.failing(log, F.lit("quarantine_log").alias("origin"), F.col("id").alias("row_id")))


def p2_loaded(spark: SparkSession, folder: str) -> DataFrame:
    """The valid records of both, typed; columns a source lacks are null."""
    lines, log = _judged(spark, folder)
    a = validate.loaded(lines, F.lit("raw_filing_lines").alias("origin"), F.col("line_id").alias("row_id"))
    b = validate.loaded(log, F.lit("quarantine_log").alias("origin"), F.col("id").alias("row_id"))
    return a.unionByName(b, allowMissingColumns=True)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Invoices missing on either side, and differing amounts, of the newest snapshot and its copy."""
    return copydiff.filing_copy_differences(table(spark, folder, "gstr2b_prior_period"), table(spark, folder, "gstr2b_prior_copy"))


QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_by_snapshot": p1_by_snapshot,
    "p2_found": p2_found,
    "p2_loaded": p2_loaded,
    "p5_found": p5_found,
} | ledger_queries.QUERIES
