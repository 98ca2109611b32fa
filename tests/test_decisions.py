import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import confidence, evidence, normalize, rules
from ledgerloom.plans import report

from .conftest import frame, ledger


def compared(spark, left, right):
    l, r = (normalize.normalize(frame(spark, [x])) for x in (left, right or ledger(record_id="none")))  # noqa: E741
    pairs = spark.createDataFrame([(left["record_id"], right["record_id"] if right else None)], "left_id string, right_id string")
    return evidence.compare(pairs, l, r)


def test_evidence_amounts_and_heads(spark):
    e = compared(spark, ledger(taxable_value="11800"), ledger(taxable_value="11800.99")).collect()[0]
    assert e["evidence"]["amount"]["match"] and float(e["evidence"]["amount"]["delta"]) == -0.99
    e = compared(spark, ledger(taxable_value="11800"), ledger(taxable_value="11801.01")).collect()[0]
    assert not e["evidence"]["amount"]["match"] and e["mismatched_fields"] == ["amount"]
    e = compared(spark, ledger(cgst="1062", sgst="1062", igst="0"), ledger(cgst="0", sgst="", igst="2124")).collect()[0]["evidence"]["tax_heads"]
    assert (e["left_value"], e["right_value"], float(e["left_total"]), float(e["right_total"]), float(e["delta"]), e["match"]) == ("cgst_sgst", "igst", 2124.0, 2124.0, 0.0, False)


def test_evidence_without_partner(spark):
    e = compared(spark, ledger(), None).collect()[0]
    assert not e["found"] and e["matched_fields"] == [] and e["mismatched_fields"] == list(evidence.FIELDS) and e["evidence"]["amount"]["left_value"] == "100000.00"


@pytest.mark.parametrize("cells, value", [({}, 100), ({"invoice_date": "2026-04-16"}, 90), ({"vendor_name": "Other"}, 95), ({"taxable_value": "5"}, 70), ({"vendor_gstin": "07AAPFU0939F1ZH"}, 70), ({"invoice_id": "X"}, 80), ({"vendor_name": "ACME industries private limited"}, 100)])
def test_confidence(spark, cells, value):
    s = confidence.score(compared(spark, ledger(), ledger(**cells))).select("*", confidence.explain().alias("why")).collect()[0]
    assert s["confidence"] == value and s["clean_match"] == (not {"taxable_value", "vendor_gstin", "invoice_id"} & set(cells)) and s["why"].endswith("of 100")


def test_gate_and_rules(spark):
    rs = rules.load({"version": "t", "rules": [{"rule_id": "A", "category": "a", "when": "abs(evidence.amount.delta) > 1", "reason": "'amount'"}, {"rule_id": "B", "category": "b", "when": "true"}], "checks": [{"kind": "deadline", "check_id": "due", "since": "date'2026-06-01'", "until": "date'2026-06-08'", "days": 7}, {"kind": "group_sum", "check_id": "sum", "key": "right_id", "amount": "75000.00", "limit": 75000}]})
    d = confidence.decide(confidence.score(rules.with_checks(rules.classify(compared(spark, ledger(), ledger(taxable_value="5")), rs), rs)), 80.25)
    r = d.select("*", rules.flag("due").alias("due")).collect()[0]
    assert (r["outcome"], r["classification"]["rule_id"], r["due"]["status"], r["flags"][1]["status"]) == ("classified_exception", "A", "within_window", "within_threshold")
    clean = confidence.decide(confidence.score(rules.classify(compared(spark, ledger(), ledger()), rs)), 80.25)
    assert clean.collect()[0]["outcome"] == "auto_reconcile"
    assert {x["outcome"]: x["n"] for x in confidence.outcome_counts(clean).collect()} == {"auto_reconcile": 1, "classified_exception": 0, "indeterminate": 0}
    assert report.match_rates(clean).collect()[0]["exact"] == 1
    with pytest.raises(ValueError):
        rules.load({"checks": [{"kind": "none"}]})
    with pytest.raises(ValueError):
        rules.load({"rules": [{"rule_id": "x"}]})


def test_no_rules_and_null_group(spark):
    df = spark.createDataFrame([(None, 3.0), (None, 4.0), ("a", 1.0)], "k string, v double")
    rs = rules.RuleSet("x", (), (rules.GroupCheck("s", "k", "v", 6.5),))
    assert sorted((r["k"] or "", r["flags"][0]["status"]) for r in rules.with_checks(df, rs).collect()) == [("", "breached"), ("", "breached"), ("a", "within_threshold")]


def labels(spark, rows):
    return spark.createDataFrame(rows, "confidence double, label boolean")


def test_sweep(spark):
    d = labels(spark, [(90.0, True)] * 5 + [(50.0, False)] * 5)
    c = confidence.calibrate(d)
    assert (c.low, c.high, c.threshold, c.best["youden_j"]) == (50.5, 90.0, 70.25, 1.0)
    assert confidence.confusion(labels(spark, [(90.0, True), (85.0, True), (40.0, False), (95.0, False)]), 80) == {"tp": 2, "fp": 1, "tn": 1, "fn": 0}
    with pytest.raises(ValueError):
        confidence.calibrate(labels(spark, []))


def test_sweep_against_counting(spark):
    rng = random.Random(2)
    rows = [(rng.choice([0.0, 12.25, 50.0, 79.9999, 80.0, 100.0]), rng.random() < 0.5) for _ in range(200)] + [(None, True), (10.0, None)]
    for r in confidence.sweep(labels(spark, rows)).collect():
        known = [(s, y) for s, y in rows if s is not None and y is not None]
        t = r["threshold"]
        assert (r["tp"], r["fp"], r["tn"], r["fn"]) == tuple(sum((s >= t) == p and y == z for s, y in known) for p, z in ((True, True), (True, False), (False, False), (False, True)))


def test_split_is_exact(spark):
    df = spark.range(1001).select(F.col("id").cast("string").alias("k"), F.when(F.col("id") < 700, "big").when(F.col("id") < 1000, "mid").alias("s"))
    got = {(r["s"], r["split"]): r["count"] for r in confidence.stratified_split(df, "s", "k").groupBy("s", "split").count().collect()}
    assert got == {("big", "calibration"): 490, ("big", "frozen_test"): 210, ("mid", "calibration"): 210, ("mid", "frozen_test"): 90, (None, "calibration"): 1}
