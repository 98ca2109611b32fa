import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import normalize, validate
from ledgerloom.sources.tables import FILING_COLUMNS, REGISTER_COLUMNS, SOURCES

from .conftest import frame, ledger


def reasons(spark, *rows):
    df = frame(spark, rows, [*FILING_COLUMNS, "error_type"] if any("error_type" in r for r in rows) else FILING_COLUMNS)
    valid, invalid = validate.partition(df.withColumn("source", F.lit("gstr2b")))
    return {r["record_id"]: r["error"]["error_type"] for r in invalid.collect()}, {r["record_id"] for r in valid.collect()}


@pytest.mark.parametrize(
    "cells, reason",
    [
        ({"invoice_id": " "}, "missing_required_field"), ({"vendor_gstin": None}, "missing_required_field"), ({"taxable_value": " "}, "missing_required_field"),
        ({"cgst": "", "sgst": None, "igst": " "}, "missing_required_field"), ({"vendor_gstin": "27aapfu0939f1zv"}, "invalid_gstin_format"),
        ({"invoice_date": "2017-06-30"}, "unparseable_or_implausible_date"), ({"invoice_date": "2199-06-30"}, "unparseable_or_implausible_date"), ({"invoice_date": "tbd"}, "unparseable_or_implausible_date"),
        ({"igst": "N/A"}, "non_numeric_or_negative_amount"), ({"invoice_value": "-1.00"}, "non_numeric_or_negative_amount"), ({"total_tax": "nan"}, "non_numeric_or_negative_amount"),
        ({"invoice_id": "", "vendor_gstin": "x", "invoice_date": "x", "cgst": "x"}, "missing_required_field"), ({"vendor_gstin": "x", "invoice_date": "x"}, "invalid_gstin_format"),
        ({"invoice_date": "x", "cgst": "x"}, "unparseable_or_implausible_date"),
    ],
)
def test_first_failure_wins(spark, cells, reason):
    assert reasons(spark, ledger(**cells)) == ({"R1": reason}, set())


def test_valid_and_boundaries(spark):
    rows = [ledger(), ledger(record_id="R2", invoice_date="2017-07-01"), ledger(record_id="R3", invoice_date="31/12/2030"), ledger(record_id="R4", taxable_value="1,00,000.00", total_tax="", invoice_value=None)]
    assert reasons(spark, *rows) == ({}, {"R1", "R2", "R3", "R4"})


def test_all_errors_and_clashing_columns(spark):
    df = frame(spark, [ledger(invoice_id="", vendor_gstin="x", igst="-2") | {"message": "m", "field": "f"}], [*FILING_COLUMNS, "message", "field"])
    got = validate.with_errors(df).collect()[0]
    assert [(e["error_type"], e["field"]) for e in got["errors"]] == [("missing_required_field", "invoice_id"), ("invalid_gstin_format", "vendor_gstin"), ("non_numeric_or_negative_amount", "igst")]
    assert got["message"] == "m" and got["field"] == "f"


def by_state(line):
    """Fields of an RFC 4180 line, read sign by sign; None if it is none."""
    state, cell, out = "start", [], []
    for c in line:
        if state in ("start", "plain") and c in '"\r\n' and not (state == "start" and c == '"'):
            return None
        if state == "start" and c == '"':
            state = "quoted"
        elif state in ("start", "plain", "closed") and c == ",":
            out.append("".join(cell))
            cell, state = [], "start"
        elif state == "start":
            cell.append(c)
            state = "plain"
        elif state == "plain":
            cell.append(c)
        elif state == "quoted" and c == '"':
            state = "closed"
        elif state == "quoted":
            cell.append(c)
        elif state == "closed" and c == '"':
            cell.append(c)
            state = "quoted"
        else:
            return None
    return None if state == "quoted" else [*out, "".join(cell)]


def test_lines_against_state_machine(spark):
    rng = random.Random(8)
    lines = ["".join(rng.choice('a,"\n\r b\u0001') for _ in range(rng.randint(0, 9))) for _ in range(3000)]
    lines += ['"a ""b""",c', '"",""', ",", "", '"line\nbreak",x', 'a"b,c', '"a"b,c', " \"a\",b", "x" * 200_000 + ",b", '"' + "y,\n" * 50_000 + '",b']
    df = spark.createDataFrame(list(enumerate(lines)), "i int, raw_line string")
    got = {r["i"]: r for r in validate.load_lines(df.withColumn("cells", F.lit("clash")).drop("cells"), ["p", "q"]).select("i", "errors", "cells").collect()}
    for i, line in enumerate(lines):
        bare = line[:-2] if line.endswith("\r\n") else line[:-1] if line.endswith(("\n", "\r")) else line
        want = by_state(bare)
        first = got[i]["errors"][0]["error_type"] if got[i]["errors"] else None
        if want is None:
            assert first == "broken_quoting", repr(line[:50])
        elif len(want) != 2:
            assert first == "column_count", repr(line[:50])
        else:
            assert list(got[i]["cells"]) == want, repr(line[:50])


def test_lines_null_and_empty_table(spark):
    df = spark.createDataFrame([(1, None)], "i int, raw_line string")
    assert [r["reason"] for r in validate.failing(validate.load_lines(df, FILING_COLUMNS), "i").collect()] == ["column_count"]
    assert validate.load_lines(df.limit(0), FILING_COLUMNS).count() == 0


def test_snapshots(spark):
    register = {c: ledger().get(c, "") for c in REGISTER_COLUMNS}
    good = json.dumps(register)
    cases = {
        good: None, json.dumps(register | {"invoice_id": None}): "missing_required_field", json.dumps(register | {"more": ""}): "column_count",
        json.dumps({k: v for k, v in register.items() if k != "cgst"}): "column_count", good[:-1]: "broken_json", good + " x": "broken_json", good.replace('"', "'"): "broken_json",
        json.dumps([register]): "broken_json", '"text"': "broken_json", "": "broken_json", "null": "broken_json", good.replace('"18"', "NaN"): "broken_json", good.replace('"18"', "18"): None,
        json.dumps(register | {"vendor_name": 'a "b" \\ \n ₹'}): None, "  " + good + "\n": None,
    }
    df = spark.createDataFrame([(i, "purchase_register", s) for i, s in enumerate(cases)] + [(98, "purchase_register", None), (99, "unknown", good)], "id int, source string, raw_record_snapshot string")
    got = {r["id"]: r["reason"] for r in validate.failing(validate.load_snapshots(df, SOURCES), "id").collect()}
    assert [got.get(i) for i in range(len(cases))] == list(cases.values())
    assert got[98] == "broken_json" and got[99] == "column_count"


def test_loaded_is_typed(spark):
    line = ",".join(ledger()[c] for c in FILING_COLUMNS)
    df = spark.createDataFrame([(1, line)], "line_id int, raw_line string")
    r = validate.loaded(validate.load_lines(df, FILING_COLUMNS), "line_id").collect()[0]
    assert (str(r["invoice_date_typed"]), float(r["taxable_value_typed"]), r["vendor_name"]) == ("2026-04-15", 100000.0, "Acme Industries Private Limited")


def test_normalize_logs_changes(spark):
    df = frame(spark, [ledger(vendor_gstin=" 27AAPFU0939F1ZV", taxable_value="1,00,000", vendor_name="M/s Acme "), ledger(record_id="R2")])
    got = {r["record_id"]: r for r in normalize.normalize(df).collect()}
    assert {(c["field"], c["raw"], c["normalized"], c["rule"]) for c in got["R1"]["changes"]} == {("vendor_gstin", " 27AAPFU0939F1ZV", "27AAPFU0939F1ZV", "gstin"), ("taxable_value", "1,00,000", "100000.00", "amount"), ("vendor_name", "M/s Acme ", "Acme", "text")}
    assert got["R2"]["changes"] == [] and got["R1"]["raw"]["vendor_name"] == "M/s Acme "


@pytest.mark.parametrize("reply", ["", "[]", "{}", "no json", '{"cleaned_text": null}', '{"cleaned_text": ""}', '{"cleaned_text": 1}', '{"cleaned_text": "a", "more": 1}', json.dumps({"cleaned_text": "x" * 100})])
def test_cleaner_contract(reply):
    with pytest.raises(ValueError):
        normalize.accept_reply(reply, "C0mpany")


def test_clean_names(spark):
    def cleaner(name):
        if "fail" in name:
            raise RuntimeError("down")
        return json.dumps({"cleaned_text": name.replace("0", "o")} if "bad" not in name else {"x": 1})

    df = frame(spark, [ledger(record_id=i, vendor_name=n) for i, n in enumerate(["C0mpany", "C0mpany", "bad C0", "fail C0", "Clean", None])])
    out, counts = normalize.clean_names(df, cleaner)
    assert sorted((r["vendor_name"] or "", r["name_status"]) for r in out.collect()) == [("", "not_needed"), ("Clean", "not_needed"), ("Company", "applied"), ("Company", "applied"), ("bad C0", "rejected"), ("fail C0", "failed")]
    assert {r["name_status"]: r["n"] for r in counts.collect()} == {"applied": 1, "rejected": 1, "failed": 1}
