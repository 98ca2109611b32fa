"""Registered queries for the reconciliation operators, over the buyer's register and the newest filed snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import gstin, parse, text
from ..operators import confidence, evidence, matching, normalize, rules, validate
from ..session import store
from ..sources import logs
from ..sources.tables import FILING_COLUMNS, as_source, table
from . import pipeline, report

MONEY = "decimal(24,2)"


def register(spark: SparkSession, folder: str) -> DataFrame:
    return as_source(table(spark, folder, "purchase_register"), "purchase_register")


def periods(spark: SparkSession, folder: str) -> tuple[str | None, str | None]:
    """(newest, the one before) of the delivered snapshots; null where there is none. The driver gets these two only."""
    p = table(spark, folder, "gstr2b_prior_period").select(parse.filled("gstr2b_period").alias("p")).where("p is not null").distinct()
    return (*[r["p"] for r in p.orderBy(F.col("p").desc()).limit(2).collect()], None, None)[:2]


def filings(spark: SparkSession, folder: str, period: str | None = None) -> DataFrame:
    """A filed snapshot, the newest by default, one row for each record_id: of rows delivered twice the greatest stands."""
    period = period or periods(spark, folder)[0]
    rows = table(spark, folder, "gstr2b_prior_period").where(F.col("gstr2b_period") == F.lit(period)).select(*FILING_COLUMNS)
    once = rows.groupBy("record_id").agg(F.max(F.struct(*FILING_COLUMNS)).alias("v")).select("v.*")
    return as_source(once, "gstr2b")


def _both(spark: SparkSession, folder: str) -> DataFrame:
    return register(spark, folder).unionByName(filings(spark, folder), allowMissingColumns=True)


def _valid(spark: SparkSession, folder: str) -> DataFrame:
    return normalize.normalize(validate.partition(_both(spark, folder))[0])


def _sides(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    v = _valid(spark, folder)
    return v.where("source = 'purchase_register'"), v.where("source = 'gstr2b'")


def _stored_sides(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    cells = ["source", "record_id", "invoice_id", "vendor_gstin", "vendor_name", "taxable_value", "invoice_date", "igst", "cgst", "sgst"]
    v = store(_valid(spark, folder).select(*cells))
    return v.where("source = 'purchase_register'"), v.where("source = 'gstr2b'")


def _matched(spark: SparkSession, folder: str) -> tuple[matching.Matching, DataFrame, DataFrame]:
    """(match, left, right) of the one-to-one match, as pipeline.run has them. The cells that matching and evidence read are
    written once, so that neither parses again."""
    l, r = _stored_sides(spark, folder)  # noqa: E741
    return matching.match(l, r), l, r


def _evidence(spark: SparkSession, folder: str) -> DataFrame:
    found, l, r = _matched(spark, folder)  # noqa: E741
    return evidence.compare(found.matches, l, r)


RULES = rules.load(
    {
        "version": "registered",
        "rules": [
            {"rule_id": "N1", "category": "no_counterpart", "when": "not found", "reason": "'no filed record is assigned'"},
            {"rule_id": "N2", "category": "other_holder", "when": "substring(evidence.gstin.left_value, 3, 10) <> substring(evidence.gstin.right_value, 3, 10)", "reason": "'holder differs'"},
            {"rule_id": "N3", "category": "amount_differs", "when": "abs(evidence.amount.delta) > 1.00", "reason": "concat('amount differs by ', cast(evidence.amount.delta as string))"},
        ],
        "checks": [{"kind": "group_sum", "check_id": "sum", "key": "gstin_key", "amount": "evidence.tax_heads.left_total", "limit": 75000}],
    }
)


def _decided(spark: SparkSession, folder: str) -> DataFrame:
    e = _evidence(spark, folder).withColumn("gstin_key", F.col("evidence.gstin.left_value"))
    return confidence.decide(confidence.score(rules.with_checks(rules.classify(e, RULES), RULES)), 80.25)


# --- Validation and normalisation ------------------------------------------------------------------------------------------


def validation_errors(spark: SparkSession, folder: str) -> DataFrame:
    """First failing check of each invalid record of either ledger."""
    return validate.partition(_both(spark, folder))[1].select("source", "record_id", "error.error_type", "error.field")


def quarantine_by_error(spark: SparkSession, folder: str) -> DataFrame:
    return validate.counts_by_error(validate.partition(_both(spark, folder))[1])


def all_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Every failing check, not the first only."""
    e = validate.with_errors(_both(spark, folder)).select("source", "record_id", F.explode("errors").alias("e"))
    return e.select("source", "record_id", "e.error_type", "e.field")


def gstin_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Different GSTINs of either ledger as written, whether they're valid, and the digit that those of 15 characters ought to end in."""
    g = _both(spark, folder).select(parse.filled("vendor_gstin").alias("g")).where("g is not null").distinct()
    return g.select(F.col("g").alias("vendor_gstin"), gstin.is_valid("g").alias("valid"), F.when(F.length("g") == 15, gstin.check_digit(F.substring("g", 1, 14))).alias("digit"))


def normalized_ledger(spark: SparkSession, folder: str) -> DataFrame:
    return _valid(spark, folder).select("source", "record_id", "invoice_id", "vendor_gstin", "vendor_name", "invoice_date", "taxable_value", "cgst", "sgst", "igst")


def change_log(spark: SparkSession, folder: str) -> DataFrame:
    return normalize.change_log(_valid(spark, folder), "source", "record_id")


def messy_names(spark: SparkSession, folder: str) -> DataFrame:
    """Different names of either ledger that look damaged."""
    n = _both(spark, folder).select("vendor_name").distinct()
    return n.where(text.looks_messy("vendor_name"))


def head_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """Valid records by the tax heads that hold money."""
    amount = lambda c: parse.parse_amount(c)
    p = evidence.head_profile(amount("igst"), amount("cgst"), amount("sgst"))
    return _valid(spark, folder).groupBy("source", p.alias("profile")).agg(F.count("*").alias("n"))


# --- Matching ----------------------------------------------------------------------------------------------------------------


def sure_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs that reach the floor without any comparison of texts."""
    l, r = (matching.prepared(x) for x in _stored_sides(spark, folder))
    pairs = matching.cheap_scores(matching.sure_candidates(l, r), l, r)
    total = F.col("gstin") + F.col("amount") + F.col("date") + F.col("invoice")
    return pairs.withColumn("sure", total).where(F.col("sure") >= matching.MIN_SCORE)


def scored_pairs(spark: SparkSession, folder: str) -> DataFrame:
    l, r = (matching.prepared(x) for x in _stored_sides(spark, folder))
    return matching.every_scored_pair(l, r)


def assigned_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """One-to-one assignment of the whole ledgers."""
    return matching.match(*_stored_sides(spark, folder)).matches


def unmatched_filings(spark: SparkSession, folder: str) -> DataFrame:
    """Valid filed records that the one-to-one match leaves over."""
    found, _, r = _matched(spark, folder)
    return r.join(found.unmatched.select(F.col("right_id").alias("record_id")), "record_id", "left_semi").select("record_id", "invoice_id")


def in_earlier_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """Register rows and whether their number, as written, is in the snapshot before."""
    rows = register(spark, folder).select("record_id", "invoice_id")
    earlier = periods(spark, folder)[1]
    known = filings(spark, folder, earlier) if earlier else filings(spark, folder).where("false")
    return rules.with_presence(rows, known, "invoice_id", "present")


# --- Evidence, confidence, gate ---------------------------------------------------------------------------------------------


def evidence_fields(spark: SparkSession, folder: str) -> DataFrame:
    return evidence.long_form(_evidence(spark, folder)).select("left_id", "field", "match")


def evidence_deltas(spark: SparkSession, folder: str) -> DataFrame:
    e = _evidence(spark, folder).where("found")
    return e.select("left_id", "right_id", F.col("evidence.amount.delta").cast("double").alias("amount_delta"), F.col("evidence.date.delta_days").alias("date_delta"), F.col("evidence.tax_heads.delta").cast("double").alias("tax_delta"))


def decisions(spark: SparkSession, folder: str) -> DataFrame:
    return _decided(spark, folder).select("left_id", "confidence", "outcome", "classification.rule_id")


def outcome_counts(spark: SparkSession, folder: str) -> DataFrame:
    return confidence.outcome_counts(_decided(spark, folder))


def match_rates(spark: SparkSession, folder: str) -> DataFrame:
    return report.match_rates(_decided(spark, folder))


def exceptions_by_category(spark: SparkSession, folder: str) -> DataFrame:
    return report.exceptions_by_category(_decided(spark, folder))


def confidence_summary(spark: SparkSession, folder: str) -> DataFrame:
    return report.confidence_summary(_decided(spark, folder))


def confidence_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return report.confidence_histogram(_decided(spark, folder))


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    """Scores with a label for the sweep: whether the date agrees too."""
    return _decided(spark, folder).select("confidence", F.col("evidence.date.match").alias("label"))


def threshold_sweep(spark: SparkSession, folder: str) -> DataFrame:
    return confidence.sweep(_labelled(spark, folder)).select("threshold", "tp", "fp", "tn", "fn", F.round("youden_j", 9).alias("youden_j"))


def threshold_plateau(spark: SparkSession, folder: str) -> DataFrame:
    return confidence.plateau(confidence.sweep(_labelled(spark, folder)))


def split_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """A stratified split of the register by place, as numbers of rows."""
    rows = register(spark, folder).select("record_id", "place_of_supply")
    return confidence.stratified_split(rows, "place_of_supply", "record_id").groupBy("place_of_supply", "split").agg(F.count("*").alias("n"))


# --- Sums, queue, logs ---------------------------------------------------------------------------------------------------------


def _tax() -> Column:
    zero = lambda c: F.coalesce(parse.parse_amount(c).cast(MONEY), F.lit(0).cast(MONEY))
    return zero("cgst") + zero("sgst") + zero("igst")


def supplier_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Tax of valid register rows by supplier, and whether it exceeds the limit."""
    l, _ = _sides(spark, folder)
    totals = rules.group_totals(l.withColumn("tax", _tax()), rules.GroupCheck("sum", "vendor_gstin", "tax", 75000))
    return totals.select(F.col("key").alias("vendor_gstin"), F.col("total").cast("double").alias("total"), "status")


def supplier_exposure(spark: SparkSession, folder: str) -> DataFrame:
    l, _ = _sides(spark, folder)
    e = report.exposure(rules.group_totals(l.withColumn("tax", _tax()), rules.GroupCheck("sum", "vendor_gstin", "tax", 75000)))
    return e.withColumns({c: F.col(c).cast("double") for c in ("total", "above_total")})


def review_queue(spark: SparkSession, folder: str) -> DataFrame:
    """Undecided records in the order in which a person should see them: counterpart found first, most tax first."""
    d = _decided(spark, folder)
    d = d.withColumn("outcome", F.when(F.col("outcome") == confidence.AUTO, F.col("outcome")).otherwise(confidence.INDETERMINATE))
    return report.review_queue(d, F.when(F.col("found"), 1).otherwise(2), F.col("evidence.tax_heads.left_total")).select("place", "left_id", F.col("at_risk").cast("double").alias("at_risk"))


def name_points(spark: SparkSession, folder: str) -> DataFrame:
    """How alike the names of assigned pairs are, as written and whatever the order of their words."""
    found, l, r = _matched(spark, folder)  # noqa: E741
    named = lambda df, i, n: df.select(F.col("record_id").alias(i), F.col("vendor_name").alias(n), text.sorted_words("vendor_name").alias(f"{n}_sorted"))
    pairs = found.matches.where("right_id is not null").join(named(l, "left_id", "a"), "left_id").join(named(r, "right_id", "b"), "right_id")
    pairs = text.with_ratio(text.with_ratio(pairs, "a", "b", "ratio"), "a_sorted", "b_sorted", "sorted_ratio")
    return pairs.select("left_id", F.round("ratio", 9).alias("ratio"), F.round("sorted_ratio", 9).alias("sorted_ratio"))


def contributions(spark: SparkSession, folder: str) -> DataFrame:
    """What each field gave to the confidence of each record."""
    d = confidence.score(_evidence(spark, folder))
    return d.select("left_id", F.explode("contributions").alias("field", "points"))


def check_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Statuses of the operational checks over all records."""
    return report.check_counts(_decided(spark, folder))


def check_flags(spark: SparkSession, folder: str) -> DataFrame:
    """The status of the check of sums of each record."""
    return _decided(spark, folder).select("left_id", rules.flag("sum")["status"].alias("status"))


def running_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Tax of each supplier up to and with each valid register row, by record."""
    l, _ = _sides(spark, folder)
    rows = rules.running_total(l.withColumn("tax", _tax()), "vendor_gstin", "tax", "record_id", "so_far")
    return rows.select("record_id", F.col("so_far").cast("double").alias("so_far"))


def calibrated(spark: SparkSession, folder: str) -> DataFrame:
    """The threshold that a calibration on the labels of the sweep chooses, and the counts at the point nearest to it."""
    c = confidence.calibrate(store(_labelled(spark, folder)))
    row = (c.threshold, c.low, c.high, *[c.best[k] for k in ("tp", "fp", "tn", "fn")])
    return spark.createDataFrame([row], "threshold double, low double, high double, tp bigint, fp bigint, tn bigint, fn bigint")


def stricter_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """Decisions that a threshold of 95 instead of 80.25 changes, as the difference of two runs."""
    scored = store(confidence.score(rules.classify(_evidence(spark, folder), RULES)))
    one, two = (confidence.decide(scored, t) for t in (80.25, 95.0))
    return pipeline.decision_differences(one, two).select("left_id", "outcome_1", "outcome_2")


def pending_by_run(spark: SparkSession, folder: str) -> DataFrame:
    """Log rows that no later run logs again, by run."""
    rows = _log(spark, folder).select("record_id", "run_id", "run_sequence", "id")
    return matching.latest(rows, ["record_id"], F.struct("run_sequence", "id")).groupBy("run_id").agg(F.count("*").alias("n"))


def decision_fields(spark: SparkSession, folder: str) -> DataFrame:
    """The export of decisions."""
    return report.decisions_table(_decided(spark, folder)).select("record_id", "invoice_id", "matched_record_id", "outcome", "differing_fields")


def _log(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "quarantine_log")


def log_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of the log with their rows and first time."""
    return logs.runs_of(_log(spark, folder)).withColumn("first_timestamp", F.date_format("first_timestamp", "yyyy-MM-dd HH:mm:ss"))


def log_counts_by_error(spark: SparkSession, folder: str) -> DataFrame:
    """Logged reasons by run, null as (none)."""
    return logs.counts_of(_log(spark, folder), "validation_error", "run_id")


def log_latest(spark: SparkSession, folder: str) -> DataFrame:
    """The last log row of each record."""
    rows = _log(spark, folder).select("record_id", "run_id", "run_sequence", "id")
    return matching.latest(rows, ["record_id"], F.struct("run_sequence", "id"))


QUERIES = {
    f.__name__: f
    for f in (
        validation_errors, quarantine_by_error, all_errors, gstin_checks, normalized_ledger, change_log, messy_names, head_profiles, sure_pairs, scored_pairs,
        assigned_pairs, unmatched_filings, in_earlier_snapshot, evidence_fields, evidence_deltas, decisions, outcome_counts, match_rates, exceptions_by_category,
        confidence_summary, confidence_histogram, threshold_sweep, threshold_plateau, split_sizes, supplier_totals, supplier_exposure, review_queue,
        name_points, contributions, check_counts, check_flags, running_totals, calibrated, stricter_decisions, pending_by_run, decision_fields, log_runs, log_counts_by_error, log_latest,
    )
}
