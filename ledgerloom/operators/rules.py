"""First-fired-wins classification and per-record checks from a versioned document of rules.

The engine knows no business rule: a document names its rules, in order, each with a condition in Spark SQL over the
record's columns. Documents are YAML or plain dicts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Rule:
    """when: condition; reason: SQL of a text. applies: condition under which the rule is tried at all."""

    rule_id: str
    category: str
    when: str
    reason: str = "cast(null as string)"
    applies: str = "true"


@dataclass(frozen=True)
class GroupCheck:
    """Whether the sum of an amount over all records of a key exceeds a limit, strictly."""

    check_id: str
    key: str
    amount: str
    limit: float
    above: str = "breached"
    within: str = "within_threshold"


@dataclass(frozen=True)
class DeadlineCheck:
    """Days from one date to another against a limit; no or negative days mean that the check doesn't apply."""

    check_id: str
    since: str
    until: str
    days: int
    inside: str = "within_window"
    outside: str = "outside_window"
    neither: str = "not_applicable"


CheckBuilder = Callable[[dict], object]
#: kinds of checks a document may name; more can be registered
CHECKS: dict[str, CheckBuilder] = {"group_sum": lambda d: GroupCheck(**d), "deadline": lambda d: DeadlineCheck(**d)}


@dataclass(frozen=True)
class RuleSet:
    version: str
    rules: tuple[Rule, ...] = ()
    checks: tuple[object, ...] = ()
    extra: dict = field(default_factory=dict)


def load(document: str | Path | dict) -> RuleSet:
    """A rule set from a YAML file or a dict: version, rules (list of Rule fields), checks (kind and fields).

    An unknown kind of check, or a rule without id, category or condition, raises ValueError.
    """
    if not isinstance(document, dict):
        import yaml

        document = yaml.safe_load(Path(document).read_text())
    try:
        rules = tuple(Rule(**r) for r in document.get("rules", ()))
        checks = []
        for c in document.get("checks", ()):
            rest = {k: v for k, v in c.items() if k != "kind"}
            if c.get("kind") not in CHECKS:
                raise ValueError(f"unknown kind of check {c.get('kind')!r}; known: {', '.join(sorted(CHECKS))}")
            checks.append(CHECKS[c["kind"]](rest))
    except TypeError as e:
        raise ValueError(f"bad rule document: {e}") from e
    return RuleSet(str(document.get("version", "")), rules, tuple(checks), {k: v for k, v in document.items() if k not in ("version", "rules", "checks")})


def classify(records: DataFrame, rules: RuleSet, none_reason: str = "'no rule fired'") -> DataFrame:
    """records with ``classification`` (rule_id, category, reason) of the first rule that fires; ids are null if none does."""
    kind = "struct<rule_id:string,category:string,reason:string>"

    def fired(r: Rule) -> Column:
        hit = F.coalesce(F.expr(f"({r.applies}) and ({r.when})"), F.lit(False))
        return F.when(hit, F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.category).alias("category"), F.expr(r.reason).cast("string").alias("reason")))

    none = F.struct(F.lit(None).cast("string").alias("rule_id"), F.lit(None).cast("string").alias("category"), F.expr(none_reason).alias("reason"))
    return records.withColumn("classification", F.coalesce(*[fired(r) for r in rules.rules], none).cast(kind))


def group_totals(records: DataFrame, check: GroupCheck) -> DataFrame:
    """(key, total, status) of each group; the sum is of decimals, so its order doesn't matter."""
    total = F.sum(F.expr(check.amount).cast("decimal(24,2)")).alias("total")
    status = F.when(F.col("total") > check.limit, check.above).otherwise(check.within)
    return records.groupBy(F.col(check.key).alias("key")).agg(total).withColumn("status", status)


def with_checks(records: DataFrame, rules: RuleSet) -> DataFrame:
    """records with ``flags``, an array of (check_id, status, detail) in the order of the document.

    Sums are aggregated by key first and joined back, so one key that holds a third of all rows is summed on the map side;
    the join back lets AQE split it.
    """
    out, flags = records, []
    for i, c in enumerate(rules.checks):
        if isinstance(c, GroupCheck):
            totals = group_totals(records, c).select(F.col("key").alias(f"_k{i}"), F.col("total").alias(f"_t{i}"), F.col("status").alias(f"_s{i}"))
            out = out.join(totals, F.col(c.key).eqNullSafe(F.col(f"_k{i}")), "left")
            flags.append((c.check_id, F.col(f"_s{i}"), F.concat(F.lit("total "), F.col(f"_t{i}").cast("string"))))
        else:
            days = F.datediff(F.expr(c.until), F.expr(c.since))
            status = F.when(days.isNull() | (days < 0), c.neither).when(days <= c.days, c.inside).otherwise(c.outside)
            flags.append((c.check_id, status, F.concat(days.cast("string"), F.lit(" days"))))
    each = [F.struct(F.lit(i).alias("check_id"), s.alias("status"), d.alias("detail")) for i, s, d in flags]
    empty = F.array().cast("array<struct<check_id:string,status:string,detail:string>>")
    return out.withColumn("flags", F.array(*each) if each else empty).drop(*[f"_{x}{i}" for i in range(len(rules.checks)) for x in "kts"])


def flag(check_id: str) -> Column:
    """The entry of one check in ``flags``; null if there is none."""
    return F.get(F.filter("flags", lambda f: f["check_id"] == check_id), F.lit(0))


def with_presence(records: DataFrame, snapshot: DataFrame, key: str, out: str) -> DataFrame:
    """records with whether their key occurs in a snapshot (raw, blank keys never do): an existence join."""
    known = snapshot.select(F.col(key).alias("_known")).where("_known <> ''").distinct()
    return records.join(known, F.col(key) == F.col("_known"), "left").withColumn(out, F.col("_known").isNotNull()).drop("_known")


def running_total(records: DataFrame, key: str, amount: str, order: str, out: str) -> DataFrame:
    """records with the sum of amount within their key up to and with them, in a total order."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return records.withColumn(out, F.sum(F.col(amount).cast("decimal(24,2)")).over(w))
