"""Evaluation of a run against labels, review queue, and exports."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import confidence, matching
from ..session import write_text

# --- Labels: read on this side only -------------------------------------------------------------------------------------


def read_labels(spark: SparkSession, path: str, source: str = "purchase_register") -> DataFrame:
    """(record_id, expected_outcome, split, ...) of a label file with a header; record_id as the pipeline's source_id."""
    rows = spark.read.option("header", True).csv(path)
    return rows.withColumn("record_id", F.concat(F.lit(f"{source}:"), F.col("pr_record_id")))


def of_split(decisions: DataFrame, labels: DataFrame, split: str, key: str = "left_id", label_key: str = "pr_record_id") -> DataFrame:
    """Decisions whose record a split holds."""
    return decisions.join(labels.where(F.col("split") == split).select(F.col(label_key).alias(key)), key, "left_semi")


# --- Aggregates -----------------------------------------------------------------------------------------------------------


def match_type() -> Column:
    """exact, fuzzy, rule_classified or none, by outcome and whether a field differs."""
    return (
        F.when(F.col("outcome") == confidence.AUTO, F.when(F.size("mismatched_fields") == 0, "exact").otherwise("fuzzy"))
        .when(F.col("outcome") == confidence.CLASSIFIED, "rule_classified")
        .otherwise("none")
    )


def match_rates(decisions: DataFrame) -> DataFrame:
    """One row: numbers of each match type, resolved, total, and the rate; 0 of nothing is 0."""
    t = decisions.select(match_type().alias("t"))
    n = lambda k: F.count_if(F.col("t") == k).alias(k)
    out = t.agg(n("exact"), n("fuzzy"), n("rule_classified"), n("none"), F.count("*").alias("total"))
    resolved = F.col("exact") + F.col("fuzzy") + F.col("rule_classified")
    return out.withColumn("resolved", resolved).withColumn("rate", F.coalesce(F.try_divide(resolved.cast("double"), "total"), F.lit(0.0)))


def exceptions_by_category(decisions: DataFrame) -> DataFrame:
    """Classified records by category; operational checks are never mixed in."""
    return decisions.where(F.col("outcome") == confidence.CLASSIFIED).groupBy(F.col("classification.category").alias("category")).agg(F.count("*").alias("n"))


def check_counts(decisions: DataFrame) -> DataFrame:
    """(check_id, status, n) of the operational checks."""
    return decisions.select(F.explode("flags").alias("f")).groupBy("f.check_id", "f.status").agg(F.count("*").alias("n"))


def confidence_summary(decisions: DataFrame) -> DataFrame:
    """(outcome, n, mean, least, most); the row with a null outcome is of all: one pass, by rollup."""
    out = decisions.rollup("outcome").agg(F.count("*").alias("n"), F.avg("confidence").alias("mean"), F.min("confidence").alias("least"), F.max("confidence").alias("most"))
    return out.withColumn("mean", F.round("mean", 6))


def confidence_histogram(decisions: DataFrame) -> DataFrame:
    """(confidence, n), greatest first."""
    return decisions.groupBy("confidence").agg(F.count("*").alias("n")).orderBy(F.col("confidence").desc())


def accuracy(decisions: DataFrame, labels: DataFrame, key: str = "pr_record_id") -> tuple[DataFrame, DataFrame]:
    """(one row: n, right, rate; the disagreements). Records without label don't count."""
    both = decisions.join(labels.select(F.col(key).alias("left_id"), "expected_outcome"), "left_id").where("expected_outcome is not null")
    right = F.count_if(F.col("outcome") == F.col("expected_outcome"))
    rate = F.coalesce(F.try_divide(right.cast("double"), F.count("*")), F.lit(0.0))
    return both.agg(F.count("*").alias("n"), right.alias("right"), rate.alias("rate")), both.where("outcome <> expected_outcome").select("left_id", "outcome", "expected_outcome", "reason")


def audit_summary(audit_entries: DataFrame, labels: DataFrame, label_key: str = "pr_record_id") -> DataFrame:
    """(split, action, n, reviewed, mean_confidence) of audit rows by the split that their labels name; without a label the split is null."""
    splits = labels.select(F.col(label_key).alias("record_id"), "split").groupBy("record_id").agg(F.min("split").alias("split"))
    rows = audit_entries.join(splits, "record_id", "left")
    return rows.groupBy("split", "action").agg(F.count("*").alias("n"), F.count("reviewer_decision").alias("reviewed"), F.round(F.avg("confidence_score"), 6).alias("mean_confidence"))


def exposure(totals: DataFrame) -> DataFrame:
    """One row over group totals (see rules.group_totals): sums and numbers of groups, of all and of those above the limit."""
    above = F.col("status") == "breached"
    zero = F.lit(0).cast("decimal(24,2)")
    return totals.agg(
        F.coalesce(F.sum("total"), zero).cast("decimal(24,2)").alias("total"), F.coalesce(F.sum(F.when(above, F.col("total"))), zero).cast("decimal(24,2)").alias("above_total"),
        F.count_distinct("key").alias("groups"), F.count_distinct(F.when(above, F.col("key"))).alias("groups_above"),
    )


def review_queue(decisions: DataFrame, priority: Column, amount: Column) -> DataFrame:
    """Undecided records with their place in the queue: by priority, greatest amount first, then record id."""
    waiting = decisions.where(F.col("outcome") == confidence.INDETERMINATE).withColumns({"priority": priority, "at_risk": amount})
    return matching.ranked(waiting, F.col("priority"), F.col("at_risk").desc_nulls_last(), F.col("left_id"))


def report(
    decisions: DataFrame, invalid: DataFrame, labels: DataFrame | None = None, split: str | None = None, totals: DataFrame | None = None, audit_entries: DataFrame | None = None
) -> dict:
    """A report as a plain dict, from small aggregates. split: restrict decisions to it; quarantine counts are of the whole batch. totals:
    group totals whose exposure is reported; audit_entries: audit rows to summarise by the labels' splits."""
    d = of_split(decisions, labels, split) if labels is not None and split else decisions
    rows = lambda df: [r.asDict() for r in df.collect()]
    out = {
        "split": split or "all",
        "outcomes": {r["outcome"]: r["n"] for r in confidence.outcome_counts(d).collect()},
        "match_rate": rows(match_rates(d))[0],
        "exceptions": rows(exceptions_by_category(d).orderBy("category")) if "classification" in d.columns else [],
        "checks": rows(check_counts(d).orderBy("check_id", "status")) if "flags" in d.columns else [],
        "confidence": rows(confidence_summary(d).orderBy(F.col("outcome").asc_nulls_first())),
        "histogram": rows(confidence_histogram(d)),
        "quarantined": rows(invalid.groupBy(F.col("error.error_type").alias("error_type")).agg(F.count("*").alias("n")).orderBy("error_type")),
    }
    if labels is not None:
        out["accuracy"] = rows(accuracy(d, labels)[0])[0]
        if audit_entries is not None:
            out["audit"] = rows(audit_summary(audit_entries, labels).orderBy("split", "action"))
    if totals is not None:
        out["exposure"] = rows(exposure(totals))[0]
    return out


def render(data: dict) -> str:
    """The report as text, one section for each of its parts."""
    lines = [f"Reconciliation report, split {data['split']}", ""]
    for name, part in data.items():
        if name == "split":
            continue
        lines += [name.replace("_", " ").capitalize(), "-" * len(name)]
        for row in part if isinstance(part, list) else [part]:
            lines.append("  " + ", ".join(f"{k}: {'all' if v is None and k == 'outcome' else v}" for k, v in row.items()))
        lines.append("")
    return "\n".join(lines)


# --- Exports: name to (columns, builder) ---------------------------------------------------------------------------------

DECISIONS = ["record_id", "invoice_id", "matched_record_id", "outcome", "confidence", "rule_id", "category", "differing_fields", "reason"]


def decisions_table(decisions: DataFrame) -> DataFrame:
    rule = (lambda n: F.col(f"classification.{n}")) if "classification" in decisions.columns else (lambda n: F.lit(None).cast("string"))
    return decisions.select(
        F.col("left_id").alias("record_id"), F.col("evidence.invoice_number.left_value").alias("invoice_id"), F.col("right_id").alias("matched_record_id"), "outcome", "confidence",
        rule("rule_id").alias("rule_id"), rule("category").alias("category"), F.array_join("mismatched_fields", "|").alias("differing_fields"), "reason",
    )


def quarantine_table(invalid: DataFrame) -> DataFrame:
    return invalid.select("source", "source_id", F.col("error.error_type").alias("validation_error"), F.col("error.field").alias("error_field"), F.col("error.message").alias("validation_message"))


def queue_table(queue: DataFrame) -> DataFrame:
    """A review_queue as a table."""
    return queue.select("place", F.col("left_id").alias("record_id"), F.col("right_id").alias("matched_record_id"), "priority", "at_risk", "confidence", F.array_join("mismatched_fields", "|").alias("differing_fields"), "reason")


def audit_table(audit_entries: DataFrame) -> DataFrame:
    return audit_entries.select("run_id", "run_sequence", "record_id", "invoice_id", "rule_id_fired", "category", "confidence_score", "action", "reviewer_decision", "reason", "timestamp")


EXPORTS: dict[str, Callable[[DataFrame], DataFrame]] = {"decisions": decisions_table, "quarantine": quarantine_table, "queue": queue_table, "audit": audit_table}


def export_csv(table: DataFrame, path: str) -> None:
    """One folder of CSV with a header; as many files as the table has partitions."""
    table.write.mode("overwrite").option("header", True).csv(path)


def export_json(data: dict) -> str:
    return json.dumps(data, sort_keys=True, default=str, indent=2)


def write_report(spark: SparkSession, data: dict, folder: str) -> None:
    """The report as report.json and report.txt in a folder of any file system."""
    write_text(spark, f"{folder}/report.json", export_json(data))
    write_text(spark, f"{folder}/report.txt", render(data))
