"""Constraint rules over text cells, as arrays of errors, and the split into loaded and failing rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import gstin, parse

# The reasons, in the order in which they are checked.
BROKEN_QUOTING, BROKEN_JSON, COLUMN_COUNT = "broken_quoting", "broken_json", "column_count"
MISSING, GSTIN, DATE, AMOUNT = (
    "missing_required_field",
    "invalid_gstin_format",
    "unparseable_or_implausible_date",
    "non_numeric_or_negative_amount",
)
REQUIRED = ("invoice_id", "vendor_gstin", "invoice_date", "taxable_value")
TAX_HEADS = ("cgst", "sgst", "igst")
NUMERIC = ("taxable_value", "cgst", "sgst", "igst", "total_tax", "invoice_value")


def _error(when: Column, kind: str, field: str, message: Column) -> Column:
    return F.when(when, F.struct(F.lit(kind).alias("error_type"), message.alias("message"), F.lit(field).alias("field")))


def prepare(records: DataFrame, cell=F.col) -> DataFrame:
    """records with the stripped text (``_t_``), amounts (``_a_``), date (``_d``) and GSTIN check (``_g``) that the rules
    read. cell: gives the text column of a field name."""
    texts = {f"_t_{n}": F.coalesce(parse.strip(cell(n)), F.lit("")) for n in dict.fromkeys((*REQUIRED, *NUMERIC))}
    typed = {f"_a_{n}": parse.amount_of(F.col(f"_t_{n}")) for n in NUMERIC}
    typed |= {"_d": parse.date_of(F.col("_t_invoice_date")), "_g": gstin.is_valid("_t_vendor_gstin")}
    return parse.staged(parse.staged(records, texts), typed)


def _unprepared(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(("_t_", "_a_")) or c in ("_d", "_g")])


def record_errors() -> list[Column]:
    """Nullable error structs (error_type, message, field) over prepared records, in the order in which they count.

    Blank, null and absent cells are the same thing. Required fields come first, one tax head at least, then the GSTIN
    as written (lower case is wrong), the date with its accepted range, and the six amounts, which may be blank but
    neither unreadable nor negative. Not-a-number and infinity are unreadable.
    """
    text = lambda n: F.col(f"_t_{n}")
    out = [_error(text(n) == "", MISSING, n, F.lit(f"{n} is blank")) for n in REQUIRED]
    no_head = (text("cgst") == "") & (text("sgst") == "") & (text("igst") == "")
    out.append(_error(no_head, MISSING, "cgst|sgst|igst", F.lit("cgst, sgst and igst are all blank")))
    g = text("vendor_gstin")
    out.append(_error(~F.col("_g"), GSTIN, "vendor_gstin", F.concat(F.lit("GSTIN "), g, F.lit(": "), gstin.problem(g))))
    d = F.col("_d")
    out.append(_error(d.isNull(), DATE, "invoice_date", F.concat(F.lit("no date in an accepted layout: "), text("invoice_date"))))
    between = d.between(F.lit(parse.FIRST_DATE).cast("date"), F.lit(parse.LAST_DATE).cast("date"))
    out.append(_error(~between, DATE, "invoice_date", F.concat(F.lit("date out of range: "), d.cast("string"))))
    for n in NUMERIC:
        amount = F.col(f"_a_{n}")
        out.append(_error((text(n) != "") & amount.isNull(), AMOUNT, n, F.concat(F.lit(f"{n} is no number: "), text(n))))
        out.append(_error(amount < 0, AMOUNT, n, F.concat(F.lit(f"{n} is negative: "), text(n))))
    return out


def first_error() -> Column:
    """The first error of a prepared record as a nullable struct; rules after it aren't evaluated."""
    return F.coalesce(*record_errors())


def error_array() -> Column:
    """All errors of a prepared record in order; empty if it is valid. A blank required cell may bring further ones."""
    return F.array_compact(F.array(*record_errors()))


def with_errors(records: DataFrame) -> DataFrame:
    """records with ``errors``, all that is wrong with each row."""
    return _unprepared(prepare(records).withColumn("errors", error_array()))


def partition(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, invalid) rows; invalid ones carry ``error``, their first failing check. Both share one plan over the input;
    persist records if both are used."""
    checked = _unprepared(parse.staged(prepare(records), {"error": first_error()}))
    return checked.where("error is null").drop("error"), checked.where("error is not null")


def counts_by_error(invalid: DataFrame) -> DataFrame:
    """Failing rows by source and reason."""
    return invalid.groupBy("source", F.col("error.error_type").alias("error_type")).agg(F.count("*").alias("n"))


# --- raw input ------------------------------------------------------------------------------------------------------

_MARK = "\u0001"
_FIELD = r'(?s)((?:"[^"]*+")++|[^,"]*+)(?:,|\z)'


def csv_outline(line: Column) -> Column:
    """The line with each quoted stretch replaced by a mark: what is left tells structure apart from content.

    A doubled quote splits a quoted value into two stretches side by side, so it gives two marks.
    """
    return F.regexp_replace(F.translate(line, _MARK, "\u0002"), r'(?s)"[^"]*+"', _MARK)


def csv_is_well_quoted(outline: Column) -> Column:
    """RFC 4180: quotes are closed, enclose whole fields, and line breaks stand inside quotes only."""
    return ~outline.rlike(rf'(?s)[^,{_MARK}]{_MARK}|{_MARK}[^,{_MARK}]|"|[\r\n]')


def csv_field_count(outline: Column) -> Column:
    return F.length(outline) - F.length(F.translate(outline, ",", "")) + 1


def csv_fields(line: Column, n: int) -> Column:
    """The n fields of a well-quoted line of n fields, unquoted."""
    parts = F.slice(F.regexp_extract_all(line, F.lit(_FIELD), F.lit(1)), 1, n)
    return F.transform(
        parts,
        lambda x: F.when(x.startswith('"'), F.regexp_replace(F.substring(x, F.lit(2), F.length(x) - 2), '""', '"')).otherwise(x),
    )


def load_lines(lines: DataFrame, columns: Sequence[str], line: str = "raw_line") -> DataFrame:
    """lines with ``errors`` and ``cells``, the text cells of each line by name.

    errors has one struct (error_type, message, field) for each thing wrong: broken quoting ends the list, then a count
    of fields other than the columns, then the record rules. cells is null where the line has no such fields. One line
    end (CR, LF or both) at the end of the text belongs to no field. A null line has no fields.
    """
    n = len(columns)
    text = F.regexp_replace(F.coalesce(F.col(line), F.lit("")), r"(?:\r\n|\n|\r)\z", "")
    out = parse.staged(lines, {"_text": text})
    out = parse.staged(out, {"_outline": csv_outline(F.col("_text"))})
    quoted, count = csv_is_well_quoted(F.col("_outline")), csv_field_count(F.col("_outline"))
    shape = F.when(~quoted, F.lit(BROKEN_QUOTING)).when(count != n, F.lit(COLUMN_COUNT))
    out = parse.staged(out, {"_shape": shape})
    out = parse.staged(out, {"_fields": F.when(F.col("_shape").isNull(), csv_fields(F.col("_text"), n))})
    cells = F.when(F.col("_shape").isNull(), F.struct(*[F.get("_fields", F.lit(i)).alias(c) for i, c in enumerate(columns)]))
    return _judge(parse.staged(out, {"cells": cells}), columns).drop("_text", "_outline", "_fields")


_JSON_STRICT = {
    "allowSingleQuotes": "false", "allowNonNumericNumbers": "false", "allowUnquotedFieldNames": "false",
    "allowComments": "false", "allowNumericLeadingZeros": "false", "allowBackslashEscapingAnyCharacter": "false",
    "allowUnquotedControlChars": "false", "mode": "PERMISSIVE",
}


def load_snapshots(rows: DataFrame, columns_of: dict[str, Sequence[str]], source: str = "source", text: str = "raw_record_snapshot") -> DataFrame:
    """rows with ``errors`` and ``cells`` of a JSON snapshot, judged against the columns of the row's source.

    Text that is no standard JSON object is broken; keys other than the source's columns, more or fewer, are a wrong
    column count, and so is a source that isn't known; then the record rules. JSON nulls are blank cells. A null
    snapshot is broken.
    """
    parsed = F.from_json(F.trim(F.col(text)), "map<string,string>", _JSON_STRICT)
    names = sorted({c for cs in columns_of.values() for c in cs})
    expected = None
    for s, cs in columns_of.items():
        keys = F.lit("\u0001".join(sorted(cs)))
        expected = F.when(F.col(source) == s, keys) if expected is None else expected.when(F.col(source) == s, keys)
    # One value must make up the whole text: what follows a complete object is as broken as what is cut off.
    whole = F.col(text).rlike(r"(?s)^[ \t\r\n]*\{.*\}[ \t\r\n]*\z") & F.coalesce(F.json_object_keys(F.col(text)).isNotNull(), F.lit(False))
    out = parse.staged(rows, {"_map": F.when(whole, parsed)})
    keys = F.array_join(F.array_sort(F.array_distinct(F.map_keys("_map"))), "\u0001")
    shape = F.when(F.col("_map").isNull(), F.lit(BROKEN_JSON)).when(~F.coalesce(keys == expected, F.lit(False)), F.lit(COLUMN_COUNT))
    cells = F.struct(*[F.try_element_at("_map", F.lit(c)).alias(c) for c in names])
    out = parse.staged(out, {"_shape": shape})
    return _judge(parse.staged(out, {"cells": F.when(F.col("_shape").isNull(), cells)}), names).drop("_map")


def _judge(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    shape = F.struct(F.col("_shape").alias("error_type"), F.lit("row isn't laid out as a record").alias("message"), F.lit(None).cast("string").alias("field"))
    # A field that the columns lack is blank in every row.
    ready = prepare(rows, lambda n: F.col("cells")[n] if n in columns else F.lit(None).cast("string"))
    errors = F.when(F.col("_shape").isNotNull(), F.array(shape)).otherwise(error_array())
    return _unprepared(parse.staged(ready, {"errors": errors})).drop("_shape")


def failing(judged: DataFrame, *keep: str) -> DataFrame:
    """Rows with errors: the kept columns and ``reason``, the first that applies."""
    return judged.where(F.size("errors") > 0).select(*keep, F.get("errors", F.lit(0))["error_type"].alias("reason"))


def loaded(judged: DataFrame, *keep: str) -> DataFrame:
    """Rows without errors: the kept columns, the text cells, and typed date and amounts."""
    typed = [parse.parse_date(F.col("cells.invoice_date")).alias("invoice_date_typed")]
    typed += [parse.parse_amount(F.col("cells")[n]).alias(f"{n}_typed") for n in NUMERIC]
    return judged.where(F.size("errors") == 0).select(*keep, "cells.*", *typed)
