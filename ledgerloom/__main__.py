"""Command line: run, report, calibrate, benchmark."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import confidence, rules
from .plans import pipeline, report
from .session import local_session, read_text, write_text
from .sources import logs
from .sources.tables import as_source, read_csv


def _read(spark: SparkSession, path: str, source: str) -> DataFrame:
    return read_csv(spark, path, source) if path.endswith(".csv") else as_source(spark.read.parquet(path), source)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="ledgerloom", description=__doc__)
    p.add_argument("command", choices=["run", "report", "calibrate", "benchmark"])
    p.add_argument("--left", required=True, help="register, CSV or Parquet")
    p.add_argument("--right", required=True, help="filings, CSV or Parquet")
    p.add_argument("--rules", help="YAML document of rules")
    p.add_argument("--threshold", type=float, default=pipeline.THRESHOLD)
    p.add_argument("--artifact", help="calibration to take threshold and weights from, or, with calibrate, to write")
    p.add_argument("--frozen", help="split on which a calibration is evaluated once")
    p.add_argument("--snapshot", help="earlier extract, CSV or Parquet, for rules on presence")
    p.add_argument("--logs", help="folder of the append-only logs")
    p.add_argument("--now", default="", help="time to write into the logs")
    p.add_argument("--labels", help="CSV of pr_record_id, expected_outcome, split")
    p.add_argument("--split", help="restrict the report to a split, or calibrate on it")
    p.add_argument("--repeats", type=int, default=3)
    p.add_argument("--verify", action="store_true", help="run twice and compare fingerprints")
    p.add_argument("--export", help="folder for CSV exports")
    a = p.parse_args(argv)
    spark = SparkSession.getActiveSession() or local_session()
    left, right = _read(spark, a.left, "purchase_register"), _read(spark, a.right, "gstr2b")
    options = {"threshold": a.threshold, "rule_set": rules.load(a.rules) if a.rules else pipeline.NO_RULES}
    if a.artifact and a.command != "calibrate":
        options["threshold"], options["weights"] = confidence.read_artifact(read_text(spark, a.artifact))
    if a.snapshot:
        options["snapshot"] = _read(spark, a.snapshot, "gstr2b_prior_period")
    if a.command == "benchmark":
        print(json.dumps(pipeline.benchmark(left, right, a.repeats, **options)))
        return 0
    result = pipeline.run(left, right, log_folder=a.logs, now=a.now, **options)
    labels = report.read_labels(spark, a.labels) if a.labels else None
    if a.command == "calibrate":
        if labels is None:
            p.error("calibrate needs --labels")

        def scored(split: str | None) -> DataFrame:
            chosen = labels.where(labels["split"] == split) if split else labels
            return result.decisions.join(chosen.select(chosen["pr_record_id"].alias("left_id"), (chosen["expected_outcome"] == confidence.AUTO).alias("label")), "left_id").select("confidence", "label")

        c = confidence.calibrate(scored(a.split))
        text = confidence.artifact(c, confidence.confusion(scored(a.frozen), c.threshold) if a.frozen else None)
        if a.artifact:
            write_text(spark, a.artifact, text)
        print(text)
        return 0
    if a.verify:
        one, two = pipeline.fingerprint(result), pipeline.fingerprint(pipeline.run(left, right, **options))
        print(json.dumps({"fingerprint": one, "reproducible": one == two}))
        if one != two:
            return 1
    data = report.report(result.decisions, result.invalid, labels, a.split)
    print(report.render(data) if a.command == "report" else report.export_json(data))
    if a.export:
        report.write_report(spark, data, a.export)
        queue = report.review_queue(result.decisions, F.when(F.col("found"), 1).otherwise(2), F.col("evidence.tax_heads.left_total"))
        report.export_csv(report.EXPORTS["queue"](queue), f"{a.export}/queue")
        if a.logs:
            report.export_csv(report.EXPORTS["audit"](logs.audit_log(spark, a.logs).read(result.run_id)), f"{a.export}/audit")
        report.export_csv(report.EXPORTS["decisions"](result.decisions), f"{a.export}/decisions")
        report.export_csv(report.EXPORTS["quarantine"](result.invalid), f"{a.export}/quarantine")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
