"""Typed field-by-field evidence of each matched pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parse

FIELDS = ("amount", "date", "gstin", "invoice_number", "tax_heads", "vendor_name")
TOLERANCE = 1.00
_MONEY = "decimal(24,2)"


def head_profile(igst: Column, cgst: Column, sgst: Column) -> Column:
    """Which tax heads hold money: igst, cgst_sgst, mixed or none; blank counts as zero."""
    has_i = F.coalesce(igst, F.lit(0)) > 0
    has_cs = (F.coalesce(cgst, F.lit(0)) > 0) | (F.coalesce(sgst, F.lit(0)) > 0)
    return F.when(has_i & has_cs, "mixed").when(has_i, "igst").when(has_cs, "cgst_sgst").otherwise("none")


def _text(a: Column, b: Column, found: Column, any_case: bool = False) -> Column:
    x, y = (F.upper(a), F.upper(b)) if any_case else (a, b)
    return F.struct(a.alias("left_value"), b.alias("right_value"), F.coalesce(found & (x == y), F.lit(False)).alias("match"))


def compare(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Evidence of each row of pairs (left_id, right_id): (left_id, right_id, found, evidence, matched_fields, mismatched_fields).

    evidence is a struct of six structs in alphabetical order, each with the value of either side and whether they match;
    amounts and dates with their signed difference, left less right. Amounts match within TOLERANCE after rounding to two
    decimals. Names match whatever their case. A left row without partner keeps its values and matches in nothing. Ids are those of
    record_id. Normalised ledgers are expected; a null cell is the same as an empty one.
    """
    need = ["record_id", "invoice_id", "vendor_gstin", "vendor_name", "taxable_value", "invoice_date", "igst", "cgst", "sgst"]

    def typed(df: DataFrame, p: str) -> DataFrame:
        amount = lambda n: parse.parse_amount(n).cast(_MONEY)
        cells = {f"{p}{n}": F.coalesce(F.col(n), F.lit("")) for n in need[1:]}
        cells |= {f"{p}amount": amount("taxable_value"), f"{p}date": parse.parse_date("invoice_date")}
        cells |= {f"{p}{h}_n": amount(h) for h in ("igst", "cgst", "sgst")}
        return parse.staged(df.select(*need), cells).select(F.col("record_id").alias(f"{p}id"), *cells)

    l, r = typed(left, "l_"), typed(right, "r_")  # noqa: E741
    both = pairs.select("left_id", "right_id").join(l, F.col("left_id") == F.col("l_id")).join(r, F.col("right_id") == F.col("r_id"), "left")
    c, found = F.col, F.col("r_id").isNotNull()
    zero = lambda x: F.coalesce(c(x), F.lit(0).cast(_MONEY))
    total = lambda p: (zero(f"{p}igst_n") + zero(f"{p}cgst_n") + zero(f"{p}sgst_n")).cast(_MONEY)
    profile = lambda p: head_profile(c(f"{p}igst_n"), c(f"{p}cgst_n"), c(f"{p}sgst_n"))
    gap = (c("l_amount") - c("r_amount")).cast(_MONEY)
    days = F.datediff(c("l_date"), c("r_date"))
    shown = lambda v, x: F.coalesce(v.cast("string"), x)
    tax_gap = (total("l_") - total("r_")).cast(_MONEY)
    same_heads = F.coalesce(found & (profile("l_") == profile("r_")), F.lit(False))
    right_only = lambda v: F.when(found, v)
    parts = {
        "amount": F.struct(shown(c("l_amount"), c("l_taxable_value")).alias("left_value"), shown(c("r_amount"), c("r_taxable_value")).alias("right_value"), gap.alias("delta"), F.coalesce(F.abs(gap) <= TOLERANCE, F.lit(False)).alias("match")),
        "date": F.struct(shown(c("l_date"), c("l_invoice_date")).alias("left_value"), shown(c("r_date"), c("r_invoice_date")).alias("right_value"), days.alias("delta_days"), F.coalesce(days == 0, F.lit(False)).alias("match")),
        "gstin": _text(c("l_vendor_gstin"), c("r_vendor_gstin"), found),
        "invoice_number": _text(c("l_invoice_id"), c("r_invoice_id"), found),
        "tax_heads": F.struct(profile("l_").alias("left_value"), right_only(profile("r_")).alias("right_value"), right_only(tax_gap).alias("delta"), total("l_").alias("left_total"), right_only(total("r_")).alias("right_total"), same_heads.alias("match")),
        "vendor_name": _text(c("l_vendor_name"), c("r_vendor_name"), found, any_case=True),
    }
    out = parse.staged(both.select("left_id", "right_id", found.alias("found"), F.struct(*[v.alias(n) for n, v in parts.items()]).alias("e")), {"evidence": F.col("e")}).drop("e")
    listed = lambda yes: F.array_compact(F.array(*[F.when(F.col(f"evidence.{n}.match") == yes, F.lit(n)) for n in FIELDS]))
    return out.withColumns({"matched_fields": listed(True), "mismatched_fields": listed(False)})


def long_form(evidence: DataFrame) -> DataFrame:
    """One row per pair and field: (left_id, right_id, field, left_value, right_value, match), values as text."""
    rows = [F.struct(F.lit(n).alias("field"), *[F.col(f"evidence.{n}.{k}").cast("string").alias(k) for k in ("left_value", "right_value")], F.col(f"evidence.{n}.match").alias("match")) for n in FIELDS]
    return evidence.select("left_id", "right_id", F.explode(F.array(*rows)).alias("f")).select("left_id", "right_id", "f.*")
