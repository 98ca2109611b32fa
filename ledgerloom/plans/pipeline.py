"""The reconciliation pipeline: validate, quarantine, normalise, match, compare, classify, decide, log."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import confidence, evidence, matching, normalize, rules, validate
from ..session import store
from ..sources import logs
from ..sources.tables import columns_of

# Fixed value: the calibrated threshold.
THRESHOLD = 80.25
NO_RULES = rules.RuleSet("none")


@dataclass
class Run:
    """What a run gave. All tables but metrics are DataFrames; those used more than once were written to the shared folder."""

    run_id: str
    threshold: float
    rules_version: str
    valid_left: DataFrame
    valid_right: DataFrame
    invalid: DataFrame
    matching: matching.Matching
    decisions: DataFrame
    seconds: dict[str, float] = field(default_factory=dict)

    def outcome_counts(self) -> DataFrame:
        return confidence.outcome_counts(self.decisions)

    def metrics(self) -> dict[str, float]:
        """Records read, quarantined (by side) and scored, and scored records a second over the timed stages."""
        left, right = self.valid_left.count(), self.valid_right.count()
        bad = {r["source"]: r["n"] for r in self.invalid.groupBy("source").agg(F.count("*").alias("n")).collect()}
        spent = sum(self.seconds.values())
        out = {"scored": left, "valid_right": right, "read": left + right + sum(bad.values()), "quarantined": sum(bad.values())}
        return out | {f"quarantined_{k}": v for k, v in bad.items()} | {"records_per_second": (left + right) / spent if spent else 0.0}


def run(
    left: DataFrame, right: DataFrame, *, threshold: float = THRESHOLD, rule_set: rules.RuleSet = NO_RULES, weights: dict[str, float] = confidence.WEIGHTS,
    min_score: float = matching.MIN_SCORE, snapshot: DataFrame | None = None, cleaner: Callable[[str], str] | None = None,
    log_folder: str | None = None, now: str = "", run_id: str | None = None, timed: bool = False,
) -> Run:
    """Reconcile two ledgers in the form of sources.tables.as_source, left being decided on.

    snapshot: an earlier extract; each decided record gets ``in_snapshot``, whether its raw invoice_id is in it, for rules to use.
    cleaner: see normalize.clean_names. log_folder: append to the logs there, both under one run id. timed: run each stage by
    itself and keep its seconds; otherwise stages are fused as Spark sees fit.
    """
    spark = left.sparkSession
    seconds: dict[str, float] = {}
    began = time.time()

    def stage(name: str, df: DataFrame) -> DataFrame:
        nonlocal began
        if timed:
            df = store(df)
            seconds[name] = time.time() - began
            began = time.time()
        return df

    both = left.unionByName(right, allowMissingColumns=True)
    valid, invalid = validate.partition(both)
    invalid = store(invalid)
    names = {s: columns_of(s) for s in {r["source"] for r in both.select("source").distinct().collect()}}
    source_left = left.select("source").limit(1).collect()
    source_left = source_left[0]["source"] if source_left else "purchase_register"
    normalized = normalize.normalize(valid)
    if cleaner:
        normalized, _ = normalize.clean_names(normalized, cleaner)
    normalized = stage("validate_normalize", store(normalized))
    l, r = normalized.where(F.col("source") == source_left), normalized.where(F.col("source") != source_left)  # noqa: E741
    matched = matching.match(l, r, min_score)
    matched.matches = stage("match", store(matched.matches))
    found = stage("evidence", evidence.compare(matched.matches, l, r))
    extra = l.select(F.col("record_id").alias("left_id"), F.col("raw").alias("left_raw"), *[F.col(c) for c in ("itc_claimed_date", "rule88d_intimation_date", "simulated_current_date") if c in l.columns])
    records = found.join(extra, "left_id")
    if snapshot is not None:
        # invoice_id is never normalised, so the evidence holds it as written.
        records = records.withColumn("_number", F.col("evidence.invoice_number.left_value"))
        records = rules.with_presence(records, snapshot.select(F.col("invoice_id").alias("_number")), "_number", "in_snapshot").drop("_number")
    records = stage("rules", rules.with_checks(rules.classify(records, rule_set), rule_set))
    decided = store(confidence.decide(confidence.score(records, weights), threshold))
    if timed:
        seconds["gate"] = time.time() - began
        began = time.time()
    result = Run(run_id or "run-1", threshold, rule_set.version, l, r, invalid, matched, decided, seconds)
    if log_folder:
        quarantine, audit = logs.quarantine_log(spark, log_folder), logs.audit_log(spark, log_folder)
        sequence = max(quarantine.next_sequence(), audit.next_sequence())
        result.run_id = run_id or f"run-{sequence}"
        for s, columns in names.items():
            quarantine.append(logs.quarantine_rows(invalid.where(F.col("source") == s), columns, result.run_id, sequence, now))
        logs.record_audit(audit, quarantine, logs.audit_rows(decided, result.run_id, sequence, now), f"{source_left}:")
        if timed:
            seconds["logs"] = time.time() - began
    return result


def fingerprint(result: Run) -> str:
    """A digest of all that a run decided: threshold, rules version, pairs and scores, unmatched and quarantined records, fields
    that differ, flags. Neither times nor the order of rows count.

    Rows are digested where they are; the digests of all rows add up to one number, so nothing is gathered and order doesn't matter.
    """
    part = lambda df, kind, *cs: df.select(F.sha2(F.concat_ws("\u0001", F.lit(kind), *[F.coalesce(c.cast("string"), F.lit("\u0000")) for c in cs]), 256).alias("h"))
    d = result.decisions
    flags = F.to_json("flags") if "flags" in d.columns else F.lit("")
    rows = part(d, "decision", F.col("left_id"), F.col("right_id"), F.col("outcome"), F.col("confidence"), F.array_join("mismatched_fields", ","), flags)
    rows = rows.unionByName(part(result.matching.matches, "match", F.col("left_id"), F.col("right_id"), F.col("score")))
    rows = rows.unionByName(part(result.matching.unmatched, "unmatched", F.col("right_id")))
    rows = rows.unionByName(part(result.invalid, "quarantined", F.col("source_id"), F.col("error.error_type")))
    # Four numbers of 15 hexadecimal digits each; sums as decimals don't overflow.
    sums = [F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(4)]
    total = rows.agg(F.count("*").alias("n"), *sums).collect()[0]
    import hashlib

    return hashlib.sha256(repr((result.threshold, result.rules_version, *total)).encode()).hexdigest()


def decision_differences(one: DataFrame, two: DataFrame) -> DataFrame:
    """Records whose partner, outcome or confidence differs between two tables of decisions, nulls being equal to each other."""
    a, b = (x.select("left_id", F.col("right_id").alias(f"right_{i}"), F.col("outcome").alias(f"outcome_{i}"), F.col("confidence").alias(f"confidence_{i}")) for i, x in ((1, one), (2, two)))
    return a.join(b, "left_id", "full").where(~(F.col("outcome_1").eqNullSafe(F.col("outcome_2")) & F.col("right_1").eqNullSafe(F.col("right_2")) & F.col("confidence_1").eqNullSafe(F.col("confidence_2"))))


def differences(one: Run, two: Run) -> tuple[DataFrame, DataFrame]:
    """(decisions that differ, fields whose evidence differs) of two runs over the same records, nulls being equal to each other."""
    decisions = decision_differences(one.decisions, two.decisions)
    c, d = (evidence.long_form(x.decisions).select("left_id", "field", F.struct("left_value", "right_value", "match").alias(f"v{i}")) for i, x in ((1, one), (2, two)))
    fields = c.join(d, ["left_id", "field"], "full").where(~F.col("v1").eqNullSafe(F.col("v2")))
    return decisions, fields


def benchmark(left: DataFrame, right: DataFrame, repeats: int = 3, **options) -> dict[str, dict[str, float]]:
    """Median, least and most seconds of each stage, and in all, over several timed runs."""
    from statistics import median

    times: list[dict[str, float]] = []
    for _ in range(repeats):
        s = run(left, right, timed=True, **options).seconds
        times.append(s | {"elapsed": sum(s.values())})
    return {k: {"median": median(t[k] for t in times), "min": min(t[k] for t in times), "max": max(t[k] for t in times)} for k in times[0]}
