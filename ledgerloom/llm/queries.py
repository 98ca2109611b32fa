"""Registered queries of this subpackage, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table
from . import linkage, mixing, names, pii, tokens


# A deployment passes its own.
SECRET = b"registered query"


def p3_links(spark: SparkSession, folder: str) -> DataFrame:
    """The invoice that each register row books, with the confidence."""
    return linkage.link(table(spark, folder, "purchase_register"), table(spark, folder, "gstr2b_prior_period"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return p3_links(spark, folder).select("invoice_id", "pr_record_id")


def p4_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Every vendor spelling with the organisation it belongs to."""
    return names.resolve(table(spark, folder, "gstr2b_prior_period"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of spellings of one organisation."""
    return names.spelling_pairs(p4_clusters(spark, folder))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document."""
    return tokens.encode_corpus(table(spark, folder, "documents"))


def _mix(spark: SparkSession, folder: str) -> mixing.Mix:
    return mixing.Mix(table(spark, folder, "documents"), table(spark, folder, "mix_plans"))


def p7_drawn(spark: SparkSession, folder: str) -> DataFrame:
    """Documents drawn for each plan, with their repeats."""
    return _mix(spark, folder).drawn()


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual shares of each plan and source."""
    return _mix(spark, folder).shares()


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Personal details of every document."""
    return pii.find_details(table(spark, folder, "documents"), SECRET).select("doc_id", "kind", "found_text")


def p8_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with placeholders instead of personal details."""
    return pii.replace_details(table(spark, folder, "documents"), SECRET)


QUERIES = {"p3_found": p3_found, "p3_links": p3_links, "p4_found": p4_found, "p4_clusters": p4_clusters, "p6_ids": p6_ids, "p7_drawn": p7_drawn, "p7_shares": p7_shares, "p8_found": p8_found, "p8_texts": p8_texts}
SQL: dict[str, str] = {}
