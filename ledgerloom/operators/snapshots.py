"""What changed between consecutive full snapshots of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import parse

ADDED, REMOVED, CHANGED = "added", "removed", "changed"


def snapshot_changes(
    rows: DataFrame, key: Column, snapshot: Column, values: Sequence[Column], key_name: str, snapshot_name: str
) -> DataFrame:
    """Added, removed and changed keys between each snapshot and the one delivered before it.

    rows: all snapshots; key, snapshot: text columns over rows; values: the compared values.
    Result: (snapshot_name, key_name, change), one row per difference, snapshot being the later of the two.

    Each key's presences are ordered by the index of the snapshot among those delivered. In that window a first
    presence after the first snapshot, or one after a gap, is an addition; a gap or an early end is a removal in the
    snapshot after the last presence; a hash unlike the one before is a change. Keys that come back are added again.

    Rows without key or snapshot give nothing, but a snapshot counts as delivered if any row carries its name. Rows
    delivered twice count once; should they disagree, the greatest hash stands. Null values equal each other and
    differ from all else. An empty table, or a single snapshot, gives no rows. Other columns are never looked at.

    Rows are first reduced to one hash per key and snapshot on the map side, so a key that repeats without end weighs
    no more than any other; a window then holds at most one row per delivered snapshot.
    """
    # The hash skips nulls, so which values are null goes into it too.
    nulls = [v.isNull() for v in values]
    named = rows.select(key.alias("k"), snapshot.alias("s"), F.xxhash64(*values, *nulls).alias("h")).where("s is not null")
    # One row per delivered snapshot, however large the table is.
    order = (
        named.select("s").distinct().select("s", F.row_number().over(Window.orderBy("s")).alias("i"), F.lead("s").over(Window.orderBy("s")).alias("next_s"))
    )
    present = named.where("k is not null").groupBy("k", "s").agg(F.max("h").alias("h")).join(order, "s")
    w = Window.partitionBy("k").orderBy("i")
    seen = present.select(
        "k", "s", "i", "next_s", "h",
        F.lag("i").over(w).alias("before"), F.lag("h").over(w).alias("hash_before"), F.lead("i").over(w).alias("after"),
    )
    came = F.when(
        (F.col("before").isNull() & (F.col("i") > 1)) | (F.col("before") < F.col("i") - 1), F.lit(ADDED)
    ).when((F.col("before") == F.col("i") - 1) & (F.col("hash_before") != F.col("h")), F.lit(CHANGED))
    gone = F.when(
        F.col("next_s").isNotNull() & (F.col("after").isNull() | (F.col("after") > F.col("i") + 1)), F.lit(REMOVED)
    )
    events = F.array(F.struct(F.col("s").alias("at"), came.alias("change")), F.struct(F.col("next_s").alias("at"), gone.alias("change")))
    return (
        seen.select("k", F.explode(events).alias("e"))
        .where("e.change is not null")
        .select(F.col("e.at").alias(snapshot_name), F.col("k").alias(key_name), "e.change")
    )


def filing_values() -> list[Column]:
    """The compared values of a filed invoice, typed, unreadable cells as their text."""
    return [
        parse.standard_gstin("vendor_gstin"),
        parse.date_key("invoice_date"),
        F.regexp_replace(parse.filled("place_of_supply"), r"(?U)\s+", " "),
        *[parse.amount_key(c) for c in ("tax_rate", "taxable_value", "cgst", "sgst", "igst", "total_tax", "invoice_value")],
    ]


def filing_changes(filings: DataFrame) -> DataFrame:
    """snapshot_changes of a filing extract: (gstr2b_period, invoice_id, change)."""
    return snapshot_changes(
        filings, parse.record_key("invoice_id"), parse.filled("gstr2b_period"), filing_values(), "invoice_id", "gstr2b_period"
    )


def changes_by_snapshot(changes: DataFrame, snapshot_name: str = "gstr2b_period") -> DataFrame:
    """Numbers of added, removed and changed keys of each snapshot."""
    count = lambda kind: F.count_if(F.col("change") == kind).alias(kind)
    return changes.groupBy(snapshot_name).agg(count(ADDED), count(REMOVED), count(CHANGED))


SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("gstr2b_period", "invoice_id", "change")])
