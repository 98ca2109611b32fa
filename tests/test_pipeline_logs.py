import json

import pytest

from ledgerloom.__main__ import main
from ledgerloom.operators import confidence, rules
from ledgerloom.plans import pipeline, report
from ledgerloom.sources import logs
from ledgerloom.sources.tables import FILING_COLUMNS, as_source, columns_of, read_all, read_csv
from ledgerloom.streaming import microbatch

from .conftest import frame, ledger


@pytest.fixture(scope="module")
def sides(spark):
    left = [ledger(record_id=f"P{i}", invoice_id=f"INV-2604-{i:05d}", taxable_value=f"{1000 + 37 * i}") for i in range(12)] + [ledger(record_id="PX", vendor_gstin="bad"), ledger(record_id="PN", invoice_id="INV-9", taxable_value="7", vendor_gstin="29AAGCB7383J1Z4", invoice_date="2026-01-01", vendor_name="Zed")]
    right = [ledger(record_id=f"B{i}", invoice_id=f"INV-2604-{i:05d}", taxable_value=f"{1000 + 37 * i + (500 if i == 3 else 0)}") for i in range(11)]
    return as_source(frame(spark, left), "purchase_register"), as_source(frame(spark, right), "gstr2b")


def test_run_and_logs(spark, sides, tmp_path):
    rs = rules.load({"version": "v1", "rules": [{"rule_id": "A", "category": "amount", "when": "found and abs(evidence.amount.delta) > 1", "reason": "'amount'"}]})
    run = pipeline.run(*sides, rule_set=rs, log_folder=str(tmp_path), now="2026-06-10T00:00:00Z", timed=True)
    got = {r["left_id"]: r["outcome"] for r in run.decisions.collect()}
    assert got.pop("P3") == "classified_exception" and got.pop("PN") == "indeterminate" and got.pop("P11") in ("indeterminate", "auto_reconcile", "classified_exception")
    assert set(got.values()) == {"auto_reconcile"} and len(got) == 10
    m = run.metrics()
    assert (m["scored"], m["quarantined"], m["read"]) == (13, 1, 25) and set(run.seconds) == {"validate_normalize", "match", "evidence", "rules", "gate", "logs"}

    audit, quarantine, reviews = logs.audit_log(spark, str(tmp_path)), logs.quarantine_log(spark, str(tmp_path)), logs.review_log(spark, str(tmp_path))
    assert audit.count() == 13 and quarantine.count() == 1 and run.run_id == "run-1"
    entry = quarantine.read().collect()[0]
    assert entry["validation_error"] == "invalid_gstin_format" and json.loads(entry["raw_record_snapshot"])["vendor_gstin"] == "bad"
    assert list(json.loads(audit.read().collect()[0]["evidence_snapshot"])) == ["amount", "date", "gstin", "invoice_number", "tax_heads", "vendor_name"]

    again = pipeline.run(*sides, rule_set=rs, log_folder=str(tmp_path), now="later")
    assert again.run_id == "run-2" and audit.count() == 13 and audit.count(logs.ALL_RUNS) == 26 and audit.runs().count() == 2
    assert pipeline.fingerprint(run) == pipeline.fingerprint(again)
    with pytest.raises(logs.ImmutableLogError):
        audit.append(audit.read("run-1"))

    waiting = {r["record_id"] for r in logs.pending_review(audit.read(), reviews.read(logs.ALL_RUNS)).collect()}
    assert "PN" in waiting
    logs.record_review(audit, reviews, "PN", "accepted", "someone")
    logs.record_review(audit, reviews, "PN", "rejected", "someone")
    assert {r["record_id"] for r in logs.pending_review(audit.read(), reviews.read(logs.ALL_RUNS)).collect()} == waiting - {"PN"}
    shown = {r["record_id"]: r["reviewer_decision"] for r in logs.with_reviews(audit.read(), reviews.read(logs.ALL_RUNS)).collect()}
    assert shown["PN"] == "rejected" and shown["P0"] is None
    with pytest.raises(KeyError):
        logs.record_review(audit, reviews, "none", "x", "y")
    assert {r["rule_id_fired"] for r in audit.counts_by("rule_id_fired").collect()} == {"A", "(none)"}
    assert audit.history("P0").count() == 2

    bad = audit.read().limit(1).withColumn("record_id", logs.F.lit("PX"))
    with pytest.raises(logs.QuarantinedRecordError):
        logs.record_audit(audit, quarantine, bad, "purchase_register:")

    data = report.report(run.decisions, run.invalid)
    assert data["outcomes"]["auto_reconcile"] >= 10 and "Outcomes" in report.render(data) and json.loads(report.export_json(data))
    report.export_csv(report.EXPORTS["decisions"](run.decisions), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 13
    audit.purge()
    assert audit.count() == 0


def test_differences(spark, sides):
    one, two = pipeline.run(*sides), pipeline.run(*sides, threshold=101.0)
    changed, fields = pipeline.differences(one, two)
    assert changed.count() >= 10 and fields.count() == 0
    assert pipeline.fingerprint(one) != pipeline.fingerprint(two)


def test_empty_ledgers(spark, sides):
    run = pipeline.run(sides[0].limit(0), sides[1])
    assert run.decisions.count() == 0 and run.matching.unmatched.count() == 11 and run.metrics()["scored"] == 0


def test_migrate(spark, tmp_path):
    audit, reviews = logs.audit_log(spark, str(tmp_path)), logs.review_log(spark, str(tmp_path))
    old = spark.createDataFrame([("a", "accepted"), ("b", None)], "record_id string, reviewer_decision string")
    logs.migrate_legacy(audit, old, reviews)
    assert {(r["run_id"], r["run_sequence"], r["reviewer_decision"]) for r in audit.read(logs.ALL_RUNS).collect()} == {("run-legacy", 0, None)}
    assert reviews.read(logs.ALL_RUNS).collect()[0]["reviewer_decision"] == "accepted"
    with pytest.raises(logs.ImmutableLogError):
        logs.migrate_legacy(audit, old)


def test_csv_sources(spark, tmp_path):
    p = tmp_path / "f.csv"
    p.write_text(",".join(FILING_COLUMNS[:3]) + '\nR1,INV-1,"A, B"\nR2,,\n')
    rows = read_csv(spark, str(p), "gstr2b").orderBy("row_number").collect()
    assert [(r["row_number"], r["record_id"], r["invoice_id"], r["vendor_name"], r["cgst"], r["source_id"]) for r in rows] == [(1, "R1", "INV-1", "A, B", "", "gstr2b:R1"), (2, "R2", "", "", "", "gstr2b:R2")]
    assert read_all(spark, {"gstr2b": str(p), "purchase_register": str(p)}).count() == 4
    with pytest.raises(ValueError):
        columns_of("other")


def test_stream(spark, tmp_path):
    frame(spark, [ledger(), ledger(record_id="R2", vendor_gstin="x")], FILING_COLUMNS).write.parquet(str(tmp_path / "in"))
    q = microbatch.ingest(microbatch.ledger_stream(spark, str(tmp_path / "in"), "gstr2b"), str(tmp_path / "ok"), str(tmp_path / "bad"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert [r["record_id"] for r in spark.read.parquet(str(tmp_path / "ok")).collect()] == ["R1"] and spark.read.parquet(str(tmp_path / "bad")).count() == 1


def test_rules_see_an_earlier_snapshot(spark, sides):
    """Presence goes by the number as written, for records with and without a partner."""
    rs = rules.load({"version": "v", "rules": [{"rule_id": "S", "category": "gone", "when": "not found and in_snapshot", "reason": "'was there'"}, {"rule_id": "T", "category": "seen", "when": "in_snapshot"}]})
    snapshot = frame(spark, [ledger(invoice_id="INV-9"), ledger(invoice_id="INV-2604-00002"), ledger(invoice_id="inv-2604-00004"), ledger(invoice_id="INV-9")])
    run = pipeline.run(*sides, rule_set=rs, snapshot=snapshot)
    got = {r["left_id"]: (r["in_snapshot"], r["classification"]["rule_id"]) for r in run.decisions.collect()}
    assert got["PN"] == (True, "S") and got["P2"] == (True, "T") and got["P4"] == (False, None) and len(got) == 13
    assert not any(r["in_snapshot"] for r in pipeline.run(*sides, snapshot=snapshot.limit(0)).decisions.collect())


def test_row_numbers_over_blocks(spark, tmp_path):
    for name, n in (("a", 3000), ("b", 500)):
        (tmp_path / f"{name}.csv").write_text("record_id,invoice_id\n" + "".join(f"{name}{i},x\n" for i in range(1, n + 1)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = read_csv(spark, str(tmp_path), "gstr2b").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 3500 and all(int(r["record_id"][1:]) == r["row_number"] for r in rows)


def test_guard_over_all_runs_and_purge(spark, tmp_path):
    quarantine, audit = logs.quarantine_log(spark, str(tmp_path)), logs.audit_log(spark, str(tmp_path))
    audit.purge()
    row = spark.createDataFrame([("run-1", 1, "P1")], "run_id string, run_sequence int, record_id string")
    quarantine.append(row)
    later = row.withColumn("run_id", logs.F.lit("run-2"))
    logs.record_audit(audit, quarantine, later)
    with pytest.raises(logs.QuarantinedRecordError):
        logs.record_audit(audit, quarantine, later.withColumn("run_id", logs.F.lit("run-3")), any_run=True)
    assert audit.count(logs.ALL_RUNS) == 1
    audit.purge()
    assert audit.count(logs.ALL_RUNS) == 0 and quarantine.count() == 1


def test_artifact(spark):
    scored = spark.createDataFrame([(90.0, True)] * 5 + [(50.0, False)] * 5, "confidence double, label boolean")
    c = confidence.calibrate(scored)
    text = confidence.artifact(c, confidence.confusion(scored, c.threshold))
    assert confidence.read_artifact(text) == (c.threshold, confidence.WEIGHTS) and json.loads(text)["frozen"] == {"tp": 5, "fp": 0, "tn": 5, "fn": 0}
    for bad in ("", "[]", "{}", text.replace('"gstin"', '"other"'), text.replace(str(c.threshold), "101.0")):
        with pytest.raises(ValueError):
            confidence.read_artifact(bad)


def test_command_line_writes_reports_and_exports(spark, sides, tmp_path):
    left, right = sides
    frame(spark, [r.asDict() for r in left.select(*columns_of("purchase_register")).collect()], columns_of("purchase_register")).write.parquet(f"{tmp_path}/left")
    right.select(*FILING_COLUMNS).write.parquet(f"{tmp_path}/right")
    labels = "pr_record_id,expected_outcome,split\n" + "".join(f"P{i},{'auto_reconcile' if i != 3 else 'indeterminate'},{'calibration' if i % 2 else 'frozen_test'}\n" for i in range(12))
    (tmp_path / "labels.csv").write_text(labels)
    base = ["--left", f"{tmp_path}/left", "--right", f"{tmp_path}/right", "--labels", f"{tmp_path}/labels.csv", "--artifact", f"{tmp_path}/artifact.json"]
    assert main(["calibrate", *base, "--split", "calibration", "--frozen", "frozen_test"]) == 0
    assert main(["run", *base, "--export", f"{tmp_path}/out", "--logs", f"{tmp_path}/logs", "--snapshot", f"{tmp_path}/right"]) == 0
    data = json.loads((tmp_path / "out/report.json").read_text())
    assert data["accuracy"]["n"] == 12 and (tmp_path / "out/report.txt").read_text().startswith("Reconciliation report")
    for name, n in (("decisions", 13), ("quarantine", 1), ("audit", 13), ("queue", data["outcomes"]["indeterminate"])):
        assert spark.read.option("header", True).csv(f"{tmp_path}/out/{name}").count() == n
    summary = report.audit_summary(logs.audit_log(spark, f"{tmp_path}/logs").read(), report.read_labels(spark, f"{tmp_path}/labels.csv")).collect()
    assert sum(r["n"] for r in summary) == 13 and {r["split"] for r in summary} == {"calibration", "frozen_test", None}


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from ledgerloom import session

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Spark:
        sparkContext = Context
        conf = {}

    with pytest.raises(ValueError):
        session.shared_dir(Spark)
