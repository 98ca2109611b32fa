"""Readers of the driver's Parquet tables and of delimited ledger files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Column order of the delivered files.
FILING_COLUMNS = [
    "record_id", "invoice_id", "vendor_name", "vendor_gstin", "invoice_date", "place_of_supply", "tax_rate",
    "taxable_value", "cgst", "sgst", "igst", "total_tax", "invoice_value", "supplier_filing_date",
    "gstr2b_period", "simulated_current_date",
]
REGISTER_COLUMNS = [
    "record_id", "invoice_id", "vendor_id", "vendor_name", "vendor_gstin", "invoice_date", "place_of_supply",
    "tax_rate", "taxable_value", "cgst", "sgst", "igst", "total_tax", "invoice_value", "itc_claimed_date",
    "rule88d_intimation_date", "simulated_current_date",
]

SOURCES = {
    "purchase_register": REGISTER_COLUMNS,
    "gstr2b": FILING_COLUMNS,
    "gstr2b_prior_period": FILING_COLUMNS,
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def columns_of(source: str) -> list[str]:
    """Columns of a known source; any other name raises ValueError before anything is read."""
    if source not in SOURCES:
        raise ValueError(f"unknown source {source!r}; known: {', '.join(sorted(SOURCES))}")
    return SOURCES[source]


def read_csv(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Rows of a delimited file with a header, all columns text, absent cells empty, with ``source``, ``row_number``
    (position in the file from 1) and ``source_id``.

    Columns are taken by name: those the header lacks come out empty. An empty file gives no rows.
    """
    names = columns_of(source)
    raw = spark.read.option("header", True).option("inferSchema", False).option("mode", "PERMISSIVE").csv(path)
    have = set(raw.columns)
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at")]
    cells = [(F.coalesce(F.col(n).cast("string"), F.lit("")) if n in have else F.lit("")).alias(n) for n in names]
    rows = raw.select(*cells, *place)
    # A block of a file is read by one task in its order; the rows of the blocks before it are counted, a row for each block.
    blocks = rows.groupBy("_file", "_block").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("_file", "_block", (before - F.col("_first")).alias("_offset"))
    return (
        rows.join(blocks, ["_file", "_block"])
        .select(*names, (F.col("_at") + F.col("_offset") + 1).alias("row_number"))
        .withColumn("source", F.lit(source))
        .withColumn("source_id", F.concat_ws(":", "source", "record_id"))
    )


def read_all(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Union by name of several sources; a column that one lacks is empty there."""
    parts = [read_csv(spark, p, s) for s, p in paths.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.na.fill("")


def as_source(df: DataFrame, source: str, order: str = "record_id") -> DataFrame:
    """A Parquet ledger in the form that read_csv gives: cells filled with empty text, ``source`` and ``source_id``."""
    names = columns_of(source)
    return df.select(
        *[(F.coalesce(F.col(n).cast("string"), F.lit("")) if n in df.columns else F.lit("")).alias(n) for n in names]
    ).withColumns({"source": F.lit(source), "source_id": F.concat_ws(":", F.lit(source), F.coalesce(order, F.lit("")))})
