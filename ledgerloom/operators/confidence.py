"""Confidence from evidence, the three-way gate, and calibration of its threshold."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Weights of the compared fields, and those that must match for a record to pass without review.
WEIGHTS = {"gstin": 30.0, "amount": 30.0, "invoice_number": 20.0, "date": 10.0, "vendor_name": 5.0, "tax_heads": 5.0}
CLEAN = ("gstin", "amount", "invoice_number")
AUTO, CLASSIFIED, INDETERMINATE = "auto_reconcile", "classified_exception", "indeterminate"
OUTCOMES = (AUTO, CLASSIFIED, INDETERMINATE)


def score(evidence: DataFrame, weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """evidence with ``confidence`` (0 to 100, four decimals), ``contributions`` by field, and ``clean_match``."""
    got = {f: F.when(F.col(f"evidence.{f}.match"), F.lit(float(w))).otherwise(0.0) for f, w in weights.items()}
    total = float(sum(weights.values()))
    value = F.round(F.lit(100.0) * sum(got.values(), F.lit(0.0)) / total, 4) if total else F.lit(0.0)
    clean = F.col("found")
    for f in CLEAN:
        clean = clean & F.col(f"evidence.{f}.match")
    pairs = [x for f, v in got.items() for x in (F.lit(f), v)]
    return evidence.withColumns({"confidence": value, "contributions": F.create_map(*pairs), "clean_match": clean})


def explain(weights: Mapping[str, float] = WEIGHTS) -> Column:
    """The arithmetic of a score as text: what each matching field gave, out of what."""
    parts = [F.when(F.col(f"evidence.{f}.match"), F.lit(f"{f} {w:g}")) for f, w in weights.items()]
    return F.concat(F.array_join(F.array_compact(F.array(*parts)), " + "), F.lit(f" of {sum(weights.values()):g}"))


def decide(scored: DataFrame, threshold: float) -> DataFrame:
    """scored with ``outcome`` and ``reason``. A clean match at or above threshold passes, whatever rule fired; else a fired rule
    classifies; all else waits for a person. ``classification`` may be absent: then no rule fired."""
    passes = (F.col("confidence") >= threshold) & F.col("clean_match")
    fired = F.col("classification.rule_id").isNotNull() if "classification" in scored.columns else F.lit(False)
    shown = F.col("confidence").cast("decimal(7,4)").cast("string")
    why = (
        F.when(passes, F.concat(F.lit("confidence "), shown, F.lit(f" reaches {threshold:g} and number, GSTIN and amount agree")))
        .when(fired, F.col("classification.reason") if "classification" in scored.columns else F.lit(""))
        .otherwise(F.concat(F.lit("confidence "), shown, F.lit(f" against {threshold:g}; no rule fired")))
    )
    return scored.withColumns({"outcome": F.when(passes, AUTO).when(fired, CLASSIFIED).otherwise(INDETERMINATE), "reason": why})


def outcome_counts(decisions: DataFrame) -> DataFrame:
    """(outcome, n) with a row for each outcome, zero where there is none."""
    spark = decisions.sparkSession
    names = spark.createDataFrame([(o,) for o in OUTCOMES], "outcome string")
    found = decisions.groupBy("outcome").agg(F.count("*").alias("n"))
    return F.broadcast(names).join(found, "outcome", "left").select("outcome", F.coalesce("n", F.lit(0)).alias("n"))


def guard_disjoint(evaluated: DataFrame, quarantined: DataFrame, key: str) -> None:
    """ValueError if a quarantined key was evaluated. Runs a job."""
    bad = evaluated.select(key).join(quarantined.select(key), key, "left_semi").limit(5).collect()  # only for the message
    if bad:
        raise ValueError(f"quarantined records were evaluated: {', '.join(str(r[0]) for r in bad)}")


# --- Calibration ------------------------------------------------------------------------------------------------------------


def sweep(scored_labels: DataFrame, start: float = 0.0, stop: float = 100.0, step: float = 0.5) -> DataFrame:
    """Confusion counts and rates of each threshold: (threshold, tp, fp, tn, fn, sensitivity, specificity, youden_j, accuracy).

    scored_labels: (confidence, label). Scores are counted by value first; the thresholds join the counts, not the rows.
    A rate with nothing to divide by is 0. Rows with a null score or label don't count.
    """
    steps = int(round((stop - start) / step))
    spark = scored_labels.sparkSession
    counts = scored_labels.where("confidence is not null and label is not null")
    # A score counts at the last threshold it reaches: as many rows as there are thresholds, however many scores.
    last = F.least(F.floor((F.col("confidence") - start) / step + 1e-9), F.lit(steps)).cast("int")
    counts = counts.groupBy(last.alias("i")).agg(F.count_if("label").alias("pos"), F.count_if(~F.col("label")).alias("neg"))
    grid = spark.range(-1, steps + 1).select(F.col("id").cast("int").alias("i")).join(F.broadcast(counts.select(F.greatest("i", F.lit(-1)).alias("i"), "pos", "neg").groupBy("i").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))), "i", "left").na.fill(0)
    above = Window.orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = grid.select("i", F.sum("pos").over(above).alias("tp"), F.sum("neg").over(above).alias("fp"), F.sum("pos").over(whole).alias("p"), F.sum("neg").over(whole).alias("q"))
    out = out.where("i >= 0").select(F.round(F.lit(start) + F.col("i") * F.lit(step), 6).alias("threshold"), "i", "tp", "fp", (F.col("q") - F.col("fp")).alias("tn"), (F.col("p") - F.col("tp")).alias("fn"))
    rate = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    sens, spec = rate(F.col("tp"), F.col("tp") + F.col("fn")), rate(F.col("tn"), F.col("tn") + F.col("fp"))
    return out.select(
        "threshold", "tp", "fp", "tn", "fn", sens.alias("sensitivity"), spec.alias("specificity"), (sens + spec - 1).alias("youden_j"),
        rate(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")).alias("accuracy"), "i",
    )


def plateau(points: DataFrame) -> DataFrame:
    """(low, high, threshold): the longest run of neighbouring thresholds with the greatest youden_j, the first of equally long
    ones, and its middle. points: a sweep, as many rows as there are thresholds."""
    best = F.max("youden_j").over(Window.partitionBy(F.lit(1)))
    top = points.withColumn("best", best).where(F.abs(F.col("youden_j") - F.col("best")) < 1e-12)
    runs = top.withColumn("run", F.col("i") - F.row_number().over(Window.orderBy("i")))
    runs = runs.groupBy("run").agg(F.min("threshold").alias("low"), F.max("threshold").alias("high"), F.count("*").alias("n"))
    return runs.orderBy(F.col("n").desc(), "low").limit(1).select("low", "high", ((F.col("low") + F.col("high")) / 2).alias("threshold"))


@dataclass(frozen=True)
class Calibration:
    threshold: float
    low: float
    high: float
    best: dict


def calibrate(scored_labels: DataFrame) -> Calibration:
    """The chosen threshold with its plateau and the sweep's point nearest to it, the lower of two. ValueError without labels."""
    if scored_labels.where("confidence is not null and label is not null").isEmpty():
        raise ValueError("nothing to calibrate on: no scored labels")
    points = sweep(scored_labels)
    chosen = plateau(points).collect()[0]
    near = points.orderBy(F.abs(F.col("threshold") - chosen["threshold"]), "threshold").limit(1).collect()[0]
    return Calibration(chosen["threshold"], chosen["low"], chosen["high"], {k: near[k] for k in near.asDict() if k != "i"})


def artifact(chosen: Calibration, frozen: dict[str, int] | None = None, weights: Mapping[str, float] = WEIGHTS) -> str:
    """A calibration as JSON: threshold, plateau, the sweep's point, weights, and the one evaluation on the frozen split."""
    return json.dumps({"threshold": chosen.threshold, "low": chosen.low, "high": chosen.high, "best": chosen.best, "weights": dict(weights), "frozen": frozen}, sort_keys=True)


def read_artifact(text: str) -> tuple[float, dict[str, float]]:
    """(threshold, weights) of an artifact; ValueError if either is missing or out of place."""
    try:
        data = json.loads(text)
        threshold, weights = float(data["threshold"]), {str(k): float(v) for k, v in data["weights"].items()}
    except (KeyError, TypeError, AttributeError, json.JSONDecodeError) as e:
        raise ValueError(f"no calibration artifact: {e}") from e
    if not 0 <= threshold <= 100 or set(weights) != set(WEIGHTS):
        raise ValueError("threshold or weights of the artifact are out of place")
    return threshold, weights


def confusion(scored_labels: DataFrame, threshold: float) -> dict[str, int]:
    """Counts at one threshold; a score equal to it is positive."""
    hit = F.col("confidence") >= threshold
    row = scored_labels.agg(F.count_if(hit & F.col("label")).alias("tp"), F.count_if(hit & ~F.col("label")).alias("fp"), F.count_if(~hit & ~F.col("label")).alias("tn"), F.count_if(~hit & F.col("label")).alias("fn")).collect()[0]
    return row.asDict()


def stratified_split(rows: DataFrame, strata: str, key: str, share: float = 0.7, seed: int = 7, names: tuple[str, str] = ("calibration", "frozen_test")) -> DataFrame:
    """rows with ``split``: in each stratum exactly round(share * n) rows, chosen by a seeded hash of the key, come first.

    A stratum of any size is ranked in hash buckets: whole buckets fall on one side and only the bucket at the border is
    ranked row by row.
    """
    h = F.xxhash64(F.col(key), F.lit(seed))
    hashed = rows.withColumn("_h", h).withColumn("_b", F.pmod(F.shiftrightunsigned("_h", 8), F.lit(256)).cast("int"))
    sizes = hashed.groupBy(strata, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(strata).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumns({"_before": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_take": F.round(share * F.sum("_n").over(Window.partitionBy(strata)))})
    sizes = sizes.select(F.col(strata).alias("_s"), F.col("_b").alias("_c"), "_before", "_take")
    rank = F.row_number().over(Window.partitionBy(strata, "_b").orderBy("_h", key))
    out = hashed.withColumn("_r", rank).join(sizes, F.col(strata).eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_c")))
    return out.withColumn("split", F.when(F.col("_before") + F.col("_r") <= F.col("_take"), names[0]).otherwise(names[1])).select(*rows.columns, "split")
