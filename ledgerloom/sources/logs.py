"""Append-only, run-scoped logs as partitioned Parquet: quarantine, audit, reviewer events."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import delete, store

ALL_RUNS = "*"
LEGACY_RUN = "run-legacy"

QUARANTINE = "run_sequence int, record_id string, source string, source_record_id string, source_row_number int, validation_error string, validation_message string, error_field string, raw_record_snapshot string, timestamp string, run_id string"
AUDIT = "run_sequence int, record_id string, invoice_id string, evidence_snapshot string, rule_id_fired string, category string, confidence_score double, action string, reviewer_decision string, reason string, timestamp string, run_id string"
REVIEWS = "seq bigint, record_id string, reviewer_decision string, reviewer string, note string, timestamp string, run_id string"


class ImmutableLogError(ValueError):
    """A run's rows would be written twice."""


class QuarantinedRecordError(ValueError):
    """A quarantined record would be audited."""


def sorted_json(columns: list[str] | None = None, value: Column | None = None) -> Column:
    """JSON of the columns with sorted keys, nulls kept."""
    body = value if value is not None else F.struct(*sorted(columns or []))
    return F.to_json(body, {"ignoreNullFields": "false"})


@dataclass
class Log:
    """A log in a folder, one partition per run. Reads of one run touch its partition only."""

    spark: SparkSession
    path: str
    schema: str

    def read(self, run_id: str | None = None) -> DataFrame:
        """Rows of a run, of the latest run by default, or of ALL_RUNS. A log not yet written is empty."""
        try:
            rows = self.spark.read.schema(T.StructType.fromDDL(self.schema)).parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rows = self.spark.createDataFrame([], T.StructType.fromDDL(self.schema))
        if run_id == ALL_RUNS:
            return rows
        run_id = run_id or self.latest_run(rows)
        return rows.where(F.col("run_id") == F.lit(run_id))

    def latest_run(self, rows: DataFrame | None = None) -> str | None:
        """The run with the greatest sequence; run lists are as long as there are runs."""
        rows = rows if rows is not None else self.read(ALL_RUNS)
        order = F.struct("run_sequence", "run_id") if "run_sequence" in rows.columns else F.struct("run_id")
        return rows.agg(F.max_by("run_id", order).alias("r")).collect()[0]["r"]

    def next_sequence(self) -> int:
        got = self.read(ALL_RUNS).agg(F.max("run_sequence").alias("m")).collect()[0]["m"]
        return (got or 0) + 1

    def append(self, rows: DataFrame) -> None:
        """Add rows in one write. A run and record that are there already, or come twice, raise ImmutableLogError.

        Only the partitions of the runs in rows are read. One writer at a time: two that append the same run at once can't see each other.
        """
        names = [f.name for f in T.StructType.fromDDL(self.schema)]
        rows = rows.select(*[F.col(n) if n in rows.columns else F.lit(None).alias(n) for n in names])
        rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in T.StructType.fromDDL(self.schema)])
        if "run_sequence" in names:
            rows = store(rows)
            runs = [r["run_id"] for r in rows.select("run_id").distinct().collect()]  # as many as runs are written at once
            twice = rows.groupBy("run_id", "record_id").agg(F.count("*").alias("n")).where("n > 1")
            known = rows.join(self.read(ALL_RUNS).where(F.col("run_id").isin(runs)).select("run_id", "record_id"), ["run_id", "record_id"], "left_semi")
            if not twice.isEmpty() or not known.isEmpty():
                raise ImmutableLogError("a record of a run is in the log already, or twice in the rows to add")
        rows.write.mode("append").partitionBy("run_id").parquet(self.path)

    def runs(self) -> DataFrame:
        """(run_id, n, first_timestamp) of all runs."""
        return runs_of(self.read(ALL_RUNS))

    def count(self, run_id: str | None = None) -> int:
        return self.read(run_id).count()

    def counts_by(self, column: str, run_id: str | None = None) -> DataFrame:
        """(column, n); null counts as ``(none)``."""
        return counts_of(self.read(run_id), column)

    def history(self, record_id: str) -> DataFrame:
        """All rows of a record in the order of runs."""
        return self.read(ALL_RUNS).where(F.col("record_id") == record_id).orderBy("run_sequence" if "run_sequence" in self.schema else "seq")

    def purge(self) -> None:
        """Delete the log, on whatever file system it is; for tests. A log not yet written is no error."""
        delete(self.spark, self.path)


def runs_of(rows: DataFrame) -> DataFrame:
    """(run_id, n, first_timestamp) of the runs of log rows."""
    return rows.groupBy("run_id").agg(F.count("*").alias("n"), F.min("timestamp").alias("first_timestamp"))


def counts_of(rows: DataFrame, column: str, *by: str) -> DataFrame:
    """(by, column, n) of log rows; null counts as ``(none)``."""
    return rows.groupBy(*by, F.coalesce(F.col(column), F.lit("(none)")).alias(column)).agg(F.count("*").alias("n"))


def quarantine_log(spark: SparkSession, folder: str) -> Log:
    return Log(spark, f"{folder}/quarantine_log", QUARANTINE)


def audit_log(spark: SparkSession, folder: str) -> Log:
    return Log(spark, f"{folder}/audit_log", AUDIT)


def review_log(spark: SparkSession, folder: str) -> Log:
    return Log(spark, f"{folder}/reviewer_events", REVIEWS)


def quarantine_rows(invalid: DataFrame, columns: list[str], run_id: str, sequence: int, now: str) -> DataFrame:
    """Rows of the quarantine log from failing records (see validate.partition): the raw record goes along as JSON."""
    return invalid.select(
        F.lit(run_id).alias("run_id"), F.lit(sequence).alias("run_sequence"), F.col("source_id").alias("record_id"), "source",
        F.col("record_id").alias("source_record_id"), (F.col("row_number") if "row_number" in invalid.columns else F.lit(None)).alias("source_row_number"),
        F.col("error.error_type").alias("validation_error"), F.col("error.message").alias("validation_message"), F.col("error.field").alias("error_field"),
        sorted_json(columns).alias("raw_record_snapshot"), F.lit(now).alias("timestamp"),
    )


def audit_rows(decisions: DataFrame, run_id: str, sequence: int, now: str) -> DataFrame:
    """Rows of the audit log from decisions (see confidence.decide); reviewer_decision is never written here."""
    rule = (lambda n: F.col(f"classification.{n}")) if "classification" in decisions.columns else (lambda n: F.lit(None))
    return decisions.select(
        F.lit(run_id).alias("run_id"), F.lit(sequence).alias("run_sequence"), F.col("left_id").alias("record_id"), F.col("evidence.invoice_number.left_value").alias("invoice_id"),
        sorted_json(value=F.col("evidence")).alias("evidence_snapshot"), rule("rule_id").alias("rule_id_fired"), rule("category").alias("category"),
        F.col("confidence").alias("confidence_score"), F.col("outcome").alias("action"), "reason", F.lit(now).alias("timestamp"),
    )


def record_audit(audit: Log, quarantine: Log, rows: DataFrame, prefix: str = "", any_run: bool = False) -> None:
    """Append audit rows; QuarantinedRecordError if the same run, or any run if any_run, quarantined one of them. prefix: what the
    quarantine log's record ids have before the audited ones."""
    run = rows.select("run_id", F.concat(F.lit(prefix), F.col("record_id")).alias("record_id"))
    bad = quarantine.read(ALL_RUNS)
    if not any_run:
        bad = bad.where(F.col("run_id").isin([r["run_id"] for r in rows.select("run_id").distinct().collect()]))
    if not run.join(bad.select("run_id", "record_id"), ["record_id"] if any_run else ["run_id", "record_id"], "left_semi").isEmpty():
        raise QuarantinedRecordError("a quarantined record of this run can't be audited")
    audit.append(rows)


def record_review(audit: Log, reviews: Log, record_id: str, decision: str, reviewer: str, note: str = "", now: str = "", run_id: str | None = None) -> None:
    """Append a reviewer's decision on an audited record, of its latest run unless one is given. KeyError if there is no such record."""
    rows = audit.read(ALL_RUNS).where(F.col("record_id") == record_id)
    rows = rows.where(F.col("run_id") == run_id) if run_id else rows
    found = rows.agg(F.max_by("run_id", F.struct("run_sequence", "run_id")).alias("r")).collect()[0]["r"]
    if found is None:
        raise KeyError(record_id)
    seq = (reviews.read(ALL_RUNS).agg(F.max("seq").alias("m")).collect()[0]["m"] or 0) + 1
    reviews.append(reviews.spark.createDataFrame([(seq, record_id, decision, reviewer, note, now, found)], T.StructType.fromDDL(REVIEWS)))


def with_reviews(audit_entries: DataFrame, events: DataFrame) -> DataFrame:
    """Audit rows with the last reviewer decision of their run and record in reviewer_decision."""
    last = events.groupBy("run_id", "record_id").agg(F.max_by("reviewer_decision", "seq").alias("_d"))
    out = audit_entries.join(last, ["run_id", "record_id"], "left")
    return out.withColumn("reviewer_decision", F.coalesce("_d", "reviewer_decision")).select(*audit_entries.columns)


def pending_review(audit_entries: DataFrame, events: DataFrame, waiting: str = "indeterminate") -> DataFrame:
    """Audit rows that wait for a person and have no reviewer decision."""
    return audit_entries.where(F.col("action") == waiting).join(events.select("run_id", "record_id"), ["run_id", "record_id"], "left_anti")


def migrate_legacy(log: Log, old: DataFrame, reviews: Log | None = None, now: str = "") -> None:
    """Append rows of a log from before runs as the run LEGACY_RUN with sequence 0; decisions that reviewers wrote into them become
    events of their own. A second call raises ImmutableLogError."""
    log.append(old.drop("reviewer_decision").withColumn("run_id", F.lit(LEGACY_RUN)).withColumn("run_sequence", F.lit(0)))
    if reviews is not None and "reviewer_decision" in old.columns:
        done = old.where("reviewer_decision is not null").select(
            F.xxhash64("record_id").alias("seq"), "record_id", "reviewer_decision", F.lit("unknown").alias("reviewer"),
            F.lit("taken over from a log without runs").alias("note"), F.lit(now).alias("timestamp"), F.lit(LEGACY_RUN).alias("run_id"),
        )
        reviews.append(done)
