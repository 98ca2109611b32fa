"""Matching of register rows to filed invoices that share no reliable identifier.

Method: probabilistic record linkage. Several blocking passes propose pairs; four attributes are compared on agreement
levels; expectation-maximisation over the counts of level patterns learns how often matches show each level, against the
levels of random pairs; the posterior, shared among all invoices proposed for a register row and the chance that it
books none, is the confidence.

Levels are 2 (equal), 1 (close) and 0 (differs), or -1 where a side has nothing comparable, which is no evidence.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parse
from ..session import store

FIELDS = ("number", "holder", "date", "value")
# Days and share of the value that count as close.
CLOSE_DAYS = 7
CLOSE_SHARE = 0.02
# A holder with at most so many invoice versions is compared whole; larger ones by keys that find the same pairs. See candidates().
WHOLE = 256
# Above so many versions of a holder, pairs were counted instead of listed once. All are listed now, and nothing depends on it.
CROWD = 2_000
# value_pairs leaves out what meets more versions than this unless it is asked for all, as candidates() does.
ALIKE = 64
# A register number without month of so many digits may be the end of a longer serial: clerks type the last five or six.
TAILS = (5, 6, 7)
# Random pairs that the levels of unrelated pairs are learned from, for each register row.
RANDOM_PAIRS_PER_ROW = 1
THRESHOLD = 0.5


def with_number(rows: DataFrame, c: str) -> DataFrame:
    """rows with month, serial, digits and tail of an invoice number as people write it.

    A leading word that isn't some form of "invoice number" makes it a number of another series, which compares with
    nothing. Letters that look like digits are read as digits after that word. Year and month stand before or after the
    serial, or not at all. Digits are those of the serial, filled up to eight where they are clearly shortened. tail: how many they
    are, where they may be the end of a serial only (TAILS).
    """
    rows = parse.staged(rows, {"_text": F.upper(parse.filled(c))})
    own = F.regexp_replace(F.regexp_extract("_text", r"^([A-Z. #]*)", 1), r"[^A-Z]", "").rlike(r"^(?:INV(?:OICE)?(?:NO|NUMBER)?)?$")
    rest = F.translate(F.regexp_replace("_text", r"^[A-Z. #]*[-/ ]*", ""), "OILSBZ", "011582")
    rows = parse.staged(rows, {"_rest": F.when(own, rest)})
    take = lambda pattern, i: F.nullif(F.regexp_extract("_rest", pattern, i), F.lit(""))
    before, joined, after = r"^(\d{2}(?:0[1-9]|1[0-2]))[-/ ]+(\d+)$", r"^(\d{2}(?:0[1-9]|1[0-2]))(\d{8})$", r"^(\d+)/(\d{2})-(\d{2})$"
    month = F.coalesce(take(before, 1), take(joined, 1), F.concat(take(after, 2), take(after, 3)))
    digits = F.coalesce(take(before, 2), take(joined, 2), take(after, 1), take(r"^(\d+)$", 1))
    rows = parse.staged(rows, {"_month": month, "_digits": F.when(F.length(digits) <= 18, digits)})
    return rows.withColumns({
        "month": F.when(F.col("_digits").isNotNull(), F.col("_month")),
        "serial": F.col("_digits").cast("bigint"),
        "digits": F.when(F.length("_digits") >= 7, F.col("_digits")).otherwise(F.lpad("_digits", 8, "0")),
        "tail": F.when(F.col("_month").isNull() & F.length("_digits").isin(*TAILS), F.length("_digits")),
    }).drop("_text", "_rest", "_month", "_digits")


def _typed(rows: DataFrame, amounts: dict[str, str]) -> DataFrame:
    """rows with holder, date and the named amounts; each cell is stripped once."""
    texts = {"_g": parse.standard_gstin("vendor_gstin"), "_d": parse.strip("invoice_date")} | {f"_{n}": parse.strip(c) for n, c in amounts.items()}
    holder = F.when(F.length("_g") == 15, F.substring("_g", 3, 10)).when(F.length("_g") == 10, F.col("_g"))
    typed = {"holder": holder, "date": parse.date_of(F.col("_d"))} | {n: parse.amount_of(F.col(f"_{n}")).cast("double") for n in amounts}
    return parse.staged(parse.staged(rows, texts), typed).drop(*texts)


def register_side(register: DataFrame) -> DataFrame:
    """Comparable attributes of register rows: n, id, month, serial, digits, tail, holder, date, value. n stands for the id, and rows
    with the same id are readings of one row. Rows without id are left out."""
    rows = _typed(register.select("record_id", "invoice_id", "vendor_gstin", "invoice_date", "invoice_value").where("record_id is not null"), {"value": "invoice_value"})
    rows = rows.select(F.col("record_id").alias("id"), "invoice_id", "holder", "date", "value")
    return with_number(rows, "invoice_id").drop("invoice_id").withColumn("n", F.xxhash64("id"))


def filed_side(filings: DataFrame) -> DataFrame:
    """One row per version of an invoice: n, id, month, serial, digits, tail, holder, date, value, net (the taxable value). A version is a
    different reading of holder, date, value and net in any snapshot; n stands for the id.

    Rows without invoice_id name no invoice and are left out.
    """
    raw = _typed(filings.select("invoice_id", "vendor_gstin", "invoice_date", "invoice_value", "taxable_value"), {"value": "invoice_value", "net": "taxable_value"})
    raw = raw.select(parse.record_key("invoice_id").alias("id"), "holder", "date", "value", "net").where("id is not null")
    return with_number(raw.distinct(), "id").withColumn("n", F.xxhash64("id"))


def with_counts(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(a, b, holders). holders: versions of each holder, n_holder. a and b get n_holder where it is above WHOLE, so that only a short
    list meets them, and b n_value, the versions of its holder with its value to the rupee. Counts are aggregated by key on the map
    side; only values that a holder bills twice are kept for the join."""
    holders = store(b.where("holder is not null").groupBy("holder").agg(F.count("*").alias("n_holder")))
    large = store(holders.where(F.col("n_holder") > WHOLE))
    value_key = F.xxhash64("holder", F.floor("value"))
    both = b.where("holder is not null and value is not null").groupBy(value_key.alias("k")).agg(F.count("*").alias("n_value")).where("n_value > 1")
    b = b.withColumn("k", F.when(F.col("holder").isNotNull() & F.col("value").isNotNull(), value_key)).join(store(both), "k", "left").drop("k")
    b = b.withColumn("n_value", F.coalesce("n_value", F.lit(1)))
    return a.join(large, "holder", "left"), b.join(large, "holder", "left"), holders


def _end(serial: Column, tail: Column) -> Column:
    """The last digits of a serial, as many as tail; all of it without one."""
    return reduce(lambda out, k: F.when(tail == k, serial % 10**k).otherwise(out), TAILS, serial)


def _number_level(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
    other_month = F.coalesce(a("month") != b("month"), F.lit(False))
    edits = F.levenshtein(a("digits"), b("digits"), 2)
    same_digits = F.array_sort(F.split(a("digits"), "")) == F.array_sort(F.split(b("digits"), ""))
    return (
        F.when(a("digits").isNull() | b("digits").isNull(), -1).when(other_month, 0).when(a("serial") == _end(b("serial"), a("tail")), 2)
        .when((edits == 1) | ((edits == 2) & same_digits), 1).otherwise(0)
    )


def _date_level(x: Column, y: Column) -> Column:
    turned = (F.year(x) == F.year(y)) & (F.month(x) == F.day(y)) & (F.day(x) == F.month(y))
    close = (F.abs(F.datediff(x, y)) <= CLOSE_DAYS) | turned
    return F.when(x.isNull() | y.isNull(), -1).when(x == y, 2).when(close, 1).otherwise(0)


def _value_level(x: Column, y: Column, net: Column) -> Column:
    gap = F.abs(x - y)
    as_net = F.coalesce(F.abs(x - net) <= 1.0, F.lit(False))
    return F.when(x.isNull() | y.isNull(), -1).when(gap <= 1.0, 2).when(as_net | (gap <= CLOSE_SHARE * F.abs(y)), 1).otherwise(0)


def _holder_level(x: Column, y: Column) -> Column:
    """Two holders are close where they are at most two changes apart and agree in a part, as any two with two characters typed wrong do."""
    part = reduce(lambda p, q: p | q, [F.substring(x, *p) == F.substring(y, *p) for p in _PARTS])
    return F.when(x.isNull() | y.isNull(), -1).when(x == y, 2).when(part & (F.levenshtein(x, y, 2) >= 0), 1).otherwise(0)


def levels(a: Callable[[str], Column], b: Callable[[str], Column]) -> list[Column]:
    """Agreement levels of a register row a and a version b of an invoice, in the order of FIELDS."""
    return [_number_level(a, b), _holder_level(a("holder"), b("holder")), _date_level(a("date"), b("date")), _value_level(a("value"), b("value"), b("net"))]


# --- Candidates -----------------------------------------------------------------------------------------------------------

WEEK = 16  # days of a date block
_MAGNITUDE = 0.05  # width of a value block on the log scale
_SALTS = 16  # parts of a holder's rows that blank cells make meet whole
_CELL = 4  # rupees of a value cell
_PARTS = ((1, 3), (4, 4), (8, 3))  # parts of a holder: two changed characters leave one of them as it is


def _week(date: Column) -> Column:
    return F.floor(F.datediff(date, F.lit("2000-01-01").cast("date")) / WEEK)


def _magnitude(value: Column) -> Column:
    return F.when(value > 0, F.floor(F.log(value) / _MAGNITUDE))


def _sizes(value: Column) -> Column:
    """Value blocks of all values that a value may be close to."""
    # The least value that another may be close to is a little off by the rupee that equal values may differ.
    low, high = value / (1 + CLOSE_SHARE) - 1, value / (1 - CLOSE_SHARE) + 1
    return F.when(value > 0, F.sequence(_magnitude(F.greatest(low, F.lit(0.01))), _magnitude(high)))


def _cells(rows: DataFrame) -> DataFrame:
    """rows by each ``cell`` that values within a rupee fall into."""
    return rows.withColumn("cell", F.explode(F.sequence(F.floor((F.col("value") - 1) / _CELL), F.floor((F.col("value") + 1) / _CELL))))


def _key(number: int, *parts: Column | str) -> Column:
    return F.xxhash64(F.lit(number).cast("byte"), *[F.col(p) if isinstance(p, str) else p for p in parts])


_TURNED = "case when day(date) <= 12 then make_date(year(date), day(date), month(date)) end"


def _dated(rows: DataFrame) -> DataFrame:
    """rows by ``d``, their date and the one with day and month exchanged."""
    return rows.withColumn("d", F.explode(F.array_distinct(F.array_compact(F.array("date", F.expr(_TURNED))))))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _close_enough() -> Column:
    """Whether a pair of one holder needs a comparison: nothing speaks against it, or date or value is equal."""
    date, value = F.col("date"), F.col("value")
    return ((date != 0) & (value != 0)) | (date == 2) | (value == 2)


def _sketch(rows: DataFrame, net: bool) -> Column:
    """What the pass of numbers knows of holder (three hashes of a byte, 0 if unknown) and value (steps of a percent; 0 if
    unknown, 1 if it is small) of a row, in 48 bits."""
    out = F.lit(0).cast("bigint")
    for at, size in _PARTS:
        out = out * 256 + F.coalesce(F.pmod(F.hash(F.substring("holder", at, size)), F.lit(255)) + 1, F.lit(0))
    for c in ("value", "net" if net else "value"):
        step = F.when(F.col(c) < 60, 1).otherwise(F.least(F.floor(F.log(F.col(c)) * 100), F.lit(4000)) + 2)
        out = out * 4096 + F.coalesce(step, F.lit(0))
    return out


def _may_agree(x: Column, y: Column) -> Column:
    """Whether by their sketches a pair can be of the same or a close holder, or of close values, or lacks either."""
    bits = lambda c, shift, mask: F.shiftright(c, shift).bitwiseAND(F.lit(mask))
    holder = reduce(lambda p, q: p | q, [bits(x, s, 255) == bits(y, s, 255) for s in (40, 32, 24)]) | (bits(x, 40, 255) == 0) | (bits(y, 40, 255) == 0)
    v = bits(x, 12, 4095)
    value = (v <= 1) | reduce(lambda p, q: p | q, [(w <= 1) | (F.abs(v - w) <= 3) for w in (bits(y, 12, 4095), bits(y, 0, 4095))])
    return holder | value


def _number_keys(rows: DataFrame, alone: DataFrame, net: bool) -> DataFrame:
    """(key, n, p): month with the serial itself (place 0), or with what is left of it when the digit at a place is dropped; and the serial
    without month of the rows in alone, on the right also each end of it (with digit 1 if the serial is longer). p: sketch, place and
    dropped digit. A leading zero isn't there, so a form has none."""
    known = rows.where("month is not null").select("n", "month", "serial", _sketch(rows, net).alias("s"))
    ten = lambda k: F.expr(f"cast(power(10, {k}) as bigint)")
    each = known.withColumn("i", F.explode(F.sequence(F.lit(0), F.length(F.col("serial").cast("string"))))).withColumn("t", F.greatest(ten("i - 1"), F.lit(1)))
    form = F.when(F.col("i") == 0, F.col("serial")).otherwise(F.expr("serial div (t * 10) * t + serial % t"))
    digit = F.when(F.col("i") == 0, 0).otherwise(F.expr("serial div t % 10 + 1"))
    packed = F.shiftleft("s", 12).bitwiseOR(F.col("i").cast("bigint") * 128 + digit).alias("p")
    ends = alone.where("serial is not null").select("n", "serial", _sketch(alone, net).alias("s"), F.explode(F.array(*map(F.lit, (0, *TAILS)))) if net else F.coalesce("tail", F.lit(0))).toDF("n", "serial", "s", "k")
    end = _end(F.col("serial"), F.col("k"))
    whole = ends.select(_key(1, F.lit("*"), "k", end).alias("key"), "n", F.shiftleft("s", 12).bitwiseOR((end != F.col("serial")).cast("bigint")).alias("p"))
    return each.select(_key(1, "month", form).alias("key"), "n", packed).unionByName(whole)


def number_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a_n, b_n) of equal months and serials at most one slip apart: a digit dropped, added, changed or two neighbours exchanged; and of
    equal serials where a register row has no month, or of serials that end as its number. Numbers need no block sizes: an invoice number occurs once.

    A pair whose numbers aren't equal is kept only if holder or value may agree, or are unknown."""
    side = lambda df, p: df.select("key", F.col("n").alias(f"{p}_n"), F.col("p").alias(p))
    x, y = side(_number_keys(a, a.where("month is null"), False), "a"), side(_number_keys(b, b, True), "b")
    i = lambda p: F.shiftright(p, 7).bitwiseAND(F.lit(31))
    c = lambda p: F.col(p).bitwiseAND(F.lit(127))
    s = lambda p: F.shiftrightunsigned(p, 12)
    # What drops equal digits at one place is equal, and has met with nothing dropped.
    slip = ((i("a") == i("b")) & ((i("a") == 0) | (c("a") != c("b")))) | ((i("a") == 0) != (i("b") == 0)) | ((F.abs(i("a") - i("b")) == 1) & (c("a") == c("b")))
    equal = (i("a") == 0) & (i("b") == 0) & (c("b") == 0)
    return x.join(y, "key").where(slip & (equal | _may_agree(s("a"), s("b")))).select("a_n", "b_n")


def value_pairs(a: DataFrame, b: DataFrame, every: bool = False) -> DataFrame:
    """(a_n, b_n) of equal date, or date with day and month exchanged, and equal value, whoever the holder is; all of them if every.

    Else, where more than ALIKE versions share date and value cell, they are grouped by date, value to the paisa and holder. A
    holder that may be close, and an unknown one, is found by its own keys; of all others, which agree equally well, those of
    register rows that meet more than ALIKE are left out, as none could reach a posterior of one half. A holder that is equal is found
    by the passes over holders.
    """
    l = _cells(_dated(a.where("value is not null and date is not null"))).withColumn("key", _key(3, "d", "cell"))  # noqa: E741
    r = b.where("value is not null and date is not null").withColumn("key", _key(3, "date", F.floor(F.col("value") / _CELL)))
    if every:
        both = l.select("key", F.col("n").alias("a_n"), F.col("value").alias("v")).join(r.select("key", F.col("n").alias("b_n"), "value"), "key")
        return both.where(F.abs(F.col("v") - F.col("value")) <= 1.0).select("a_n", "b_n")
    large = store(r.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > ALIKE).select("key"))
    plain = r.join(large, "key", "left_anti").select("key", F.col("n").alias("b_n"))
    out = l.select("key", F.col("n").alias("a_n")).join(plain, "key").select("a_n", "b_n")
    if large.isEmpty():
        return out
    l, r = l.join(large, "key", "left_semi"), r.join(large, "key", "left_semi")  # noqa: E741
    member = r.select("key", "value", "holder", F.col("n").alias("b_n"), F.xxhash64("key", "value", F.coalesce("holder", F.lit(""))).alias("g"))
    groups = member.groupBy("g", "key", "value", "holder").agg(F.count_distinct("b_n").alias("c"))
    gap = F.abs(F.col("v") - F.col("value")) <= 1.0
    rows = l.select("key", F.col("n").alias("a_n"), F.col("value").alias("v"), F.col("holder").alias("h"))
    part = lambda df, c: [df.withColumn("part", F.concat(F.lit(str(j)), F.substring(c, *p))) for j, p in enumerate(_PARTS)]
    own = _union([*part(groups.where("holder is not null"), "holder"), groups.where("holder is null").withColumn("part", F.lit("?"))])
    asked = _union([*part(rows.where("h is not null"), "h"), rows.where("h is not null").withColumn("part", F.lit("?"))])
    near = asked.join(own, ["key", "part"]).where(gap & _holder_level(F.col("h"), F.col("holder")).isin(1, -1) & (F.col("c") <= ALIKE)).select("a_n", "g").distinct()
    by_value = groups.groupBy("key", "value").agg(F.sum("c").alias("c"))
    few = rows.join(by_value, "key").where(gap).groupBy("a_n").agg(F.sum("c").alias("c")).where(F.col("c") <= ALIKE).select("a_n")
    rest = rows.join(few, "a_n", "left_semi").join(groups, "key").where(gap).select("a_n", "g")
    return out.unionByName(near.unionByName(rest).distinct().join(member.select("g", "b_n"), "g").select("a_n", "b_n"))


def _together(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Compared pairs of one holder, where keys meet, of which nothing speaks against date and value, or date, value or number agrees.
    left has a struct a and right a struct b."""
    # Most pairs of a holder have nothing else in common: a test of plain comparisons comes before the levels.
    x, y, v, w = F.col("a.date"), F.col("b.date"), F.col("a.value"), F.col("b.value")
    one_month = F.coalesce(F.col("a.month") == F.col("b.month"), F.lit(True))
    near = lambda p, q, most: F.coalesce(F.abs(p - q) <= most, F.lit(True))
    value = near(v, w, F.greatest(F.lit(1.0), CLOSE_SHARE * F.abs(w))) | near(v, F.col("b.net"), F.lit(1.0))
    date = F.coalesce(F.abs(F.datediff(x, y)) <= CLOSE_DAYS, F.lit(True)) | (F.month(x) == F.day(y))
    number = (F.col("a.serial") == _end(F.col("b.serial"), F.col("a.tail"))) | (F.levenshtein("a.digits", "b.digits", 2) >= 0)
    worth = (date & value) | (x == y) | (F.abs(v - w) <= 1.0) | (one_month & number)
    meet = reduce(lambda p, q: p & q, [left[k] == right[k] for k in keys])
    return _packed(left.join(right, meet & (F.col("a.holder") == F.col("b.holder")) & worth), lambda z: z.where(_close_enough() | (F.col("number") > 0)))


def whole_pairs(a: DataFrame, b: DataFrame, holders: DataFrame) -> DataFrame:
    """Compared pairs of all holders with at most WHOLE versions: every register row of a holder against every version."""
    small = lambda df: df.where("n_holder is null and holder is not null").drop("n_holder")
    right = small(b).join(holders.where(F.col("n_holder") <= WHOLE), "holder")
    return _together(small(a).select("holder", _side("a", *_OF_A)), right.select("holder", _side("b", *_OF_B)), ["holder"])


def large_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Compared pairs of holders with more than WHOLE versions: those that whole_pairs would give, found by keys of the holder and what
    can make a pair agree.

    Date and value that are close (2, in blocks of days and magnitude), or not positive values (3, by days); equal dates (4); values equal to value or
    net (5). A blank agrees with anything: the other field alone is the key (6 and 7 for values, 8 and 9 for dates), and the holder alone where that isn't known on
    either side (10 to 13), its rows salted. Numbers: digits with one dropped at most (14), in any order (15), equal serials or ends of them (16).
    """
    l, r = (x.where("n_holder is not null") for x in (a, b))
    date, value, month, digits = (F.col(c) for c in ("date", "value", "month", "digits"))
    kd, kv, plus = date.isNotNull(), value.isNotNull(), F.coalesce(value > 0, F.lit(False))
    week, salt, cell = _week(date), F.pmod(F.xxhash64("n", F.lit(3)), F.lit(_SALTS)).cast("int"), lambda c: F.floor(F.col(c) / _CELL)
    key = lambda kind, *parts: _key(kind, "holder", *parts)
    one = lambda when, kind, *parts: F.when(when, F.array(key(kind, *parts)))
    many = lambda when, xs, kind, *parts: F.when(when, F.transform(xs, lambda x: key(kind, *parts, x)))
    salts = F.sequence(F.lit(0), F.lit(_SALTS - 1))
    forms = F.transform(F.sequence(F.lit(0), F.length(digits)), lambda i: F.when(i == 0, digits).otherwise(F.concat(F.substring(digits, F.lit(1), i - 1), F.substring(digits, i + 1, F.length(digits)))))
    numbers = [
        many(digits.isNotNull(), F.array_distinct(forms), 14), one(digits.isNotNull(), 15, F.array_join(F.array_sort(F.split(digits, "")), "")),
    ]
    ends = [one(F.col("serial").isNotNull(), 16, F.lit(k), _end(F.col("serial"), F.lit(k))) for k in (0, *TAILS)]
    own = [
        one(kd & plus, 2, week, _magnitude(value)), one(kd & kv & ~plus, 3, week), one(kd, 4, "date"), one(kv, 5, cell("value")), one(kv, 5, cell("net")),
        one(kd, 6, week), one(kd & ~kv, 7, week), one(kv & plus, 8, _magnitude(value)), one(kv & ~plus, 8, F.lit(0.5)), one(~kd & kv & plus, 9, _magnitude(value)), one(~kd & kv & ~plus, 9, F.lit(0.5)),
        one(F.lit(True), 10, salt), many(~kd & ~kv, salts, 11), one(kd & ~kv, 12, salt), one(~kd & kv, 13, salt), *numbers, *ends,
    ]
    weeks = F.concat(F.sequence(_week(F.date_sub("date", CLOSE_DAYS)), _week(F.date_add("date", CLOSE_DAYS))), F.array(_week(F.expr(_TURNED))))
    weeks, sizes = F.array_distinct(F.array_compact(weeks)), _sizes(value)
    cells = F.sequence(F.floor((value - 1) / _CELL), F.floor((value + 1) / _CELL))
    # What is close to a value of no magnitude is itself of none, or within a rupee.
    asked = [
        F.when(kd & plus, F.flatten(F.transform(weeks, lambda w: F.transform(sizes, lambda z: key(2, w, z))))), many(kd & kv & ~plus, weeks, 3), one(kd, 4, "date"), many(kv, cells, 5),
        many(kd & ~kv, weeks, 6), many(kd & kv, weeks, 7), many(~kd & plus, sizes, 8), one(~kd & kv & ~plus, 8, F.lit(0.5)), many(kd & plus, sizes, 9), one(kd & kv & ~plus, 9, F.lit(0.5)),
        many(~kd & ~kv, salts, 10), one(kd | kv, 11, salt), many(~kd & kv, salts, 12), many(kd & ~kv, salts, 13), *numbers, one(F.col("serial").isNotNull(), 16, F.coalesce("tail", F.lit(0)), "serial"),
    ]
    none = F.array().cast("array<bigint>")
    by_key = lambda df, keys, side: df.select(F.explode(F.array_distinct(F.concat(*[F.coalesce(F.array_compact(k), none) for k in keys]))).alias("key"), side)
    return _together(by_key(l, asked, _side("a", *_OF_A)), by_key(r, own, _side("b", *_OF_B)), ["key"])


_OF_A = ("n", "month", "serial", "digits", "tail", "holder", "date", "value")
_OF_B = (*_OF_A, "net", "n_holder", "n_value")
_MANY = (1 << 22) - 1


def _side(name: str, *columns: str) -> Column:
    return F.struct(*columns).alias(name)


def _packed(both: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
    """(a_n, b_n, p) of rows with structs a and b: levels, whether the months are equal, n_holder and n_value in one number, the sum
    of levels first, so that the maximum over versions is that of the one that agrees best."""
    by = levels(lambda n: F.col(f"a.{n}"), lambda n: F.col(f"b.{n}"))
    month = F.coalesce(F.col("a.month") == F.col("b.month"), F.lit(False)).cast("bigint")
    capped = lambda c: F.least(F.coalesce(F.col(c), F.lit(1)), F.lit(_MANY)).cast("bigint")
    each = keep(parse.staged(both.select("a", "b"), {f: x.cast("bigint") for f, x in zip(FIELDS, by, strict=True)}))
    packed = sum((F.col(f) for f in FIELDS[1:]), F.col(FIELDS[0])) + 4
    for f in FIELDS:
        packed = packed * 4 + F.col(f) + 1
    packed = ((packed * 2 + month) * (_MANY + 1) + capped("b.n_holder")) * (_MANY + 1) + capped("b.n_value")
    return each.select(F.col("a.n").alias("a_n"), F.col("b.n").alias("b_n"), packed.alias("p"))


def _unpacked(best: DataFrame) -> DataFrame:
    bits = lambda shift, width: F.shiftright("p", shift).bitwiseAND(F.lit((1 << width) - 1))
    fields = [(bits(45 + 2 * i, 2) - 1).cast("byte").alias(f) for i, f in enumerate(reversed(FIELDS))]
    return best.select("a_n", "b_n", bits(44, 1).cast("byte").alias("month"), *fields, bits(22, 22).alias("n_holder"), bits(0, 22).alias("n_value"))


def compared(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """(a_n, b_n, p) of pairs of row numbers, for every version of the invoice."""
    both = pairs.join(a.select(F.col("n").alias("a_n"), _side("a", *_OF_A)), "a_n").join(b.select(F.col("n").alias("b_n"), _side("b", *_OF_B)), "b_n")
    return _packed(both)


def candidates(a: DataFrame, b: DataFrame, holders: DataFrame, crowd: int = 0) -> tuple[DataFrame, DataFrame]:
    """(pairs, counted): compared pairs of register rows and invoices that some pass proposes, with the levels of the version that
    agrees best. Sides come from with_counts. Every pair is listed, whatever the size of its holder: crowd says nothing any more, and
    counted, pairs that stood for several, is empty.

    Numbers that nearly agree (number_pairs), date and value that agree (value_pairs), and, within a holder, date and value that
    don't contradict each other, or a number that nearly agrees (whole_pairs up to WHOLE versions, large_pairs, which finds the same by keys, beyond).
    """
    narrow = number_pairs(a, b).unionByName(value_pairs(a, b, every=True)).distinct()
    # A pair of one holder comes from whole_pairs with n_holder, and so is the greater one.
    every = _union([whole_pairs(a, b, holders), large_pairs(a, b), compared(narrow, a, b)]).repartition("a_n")
    best = every.groupBy("a_n", "b_n").agg(F.max("p").alias("p"))
    # A pair with neither number, holder nor value in common, though a pass proposed it, has no chance; it needn't be kept. Nor need one of
    # one holder that the passes over holders don't give.
    pairs = _unpacked(best).where((F.col("number") > 0) | F.when(F.col("holder") == 2, _close_enough()).otherwise((F.col("holder") > 0) | (F.col("value") > 0)))
    return pairs, pairs.sparkSession.range(0).select(F.col("id").alias("a_n"), F.col("id").alias("times"))


@dataclass
class Model:
    """Shares of matches (m) and of random pairs (u) that show each level 0, 1, 2 of each field; share of register rows that
    book an invoice. Levels aren't independent among pairs that don't match: numbers hold the month, so where they are
    close, dates are held against random pairs of one month (u_date), and suppliers bill a value again and again, so
    where the holder is the same, values are held against pairs of different invoices of one holder (u_value)."""

    m: np.ndarray
    u: np.ndarray
    u_date: np.ndarray
    u_value: np.ndarray
    booked: float
    invoices: int


def _levels_of(patterns: list, weights: np.ndarray) -> np.ndarray:
    out = np.zeros((len(FIELDS), 3))
    for p, w in zip(patterns, weights, strict=True):
        for f, level in enumerate(p):
            if level >= 0:
                out[f, level] += w
    return out


def learn(
    patterns: list[tuple[int, ...]], counts: np.ndarray, random: list[tuple[int, ...]], random_counts: np.ndarray, one_holder: np.ndarray, rows: int, invoices: int,
) -> Model:
    """Expectation-maximisation over counts of level patterns.

    one_holder: pairs of invoices of one holder by level of value. u is of random pairs, plus one chance in the number of invoices
    for each level, so that none is impossible. m and the share of matches among all rows * invoices pairs follow from the
    proposed pairs; pairs that no pass proposes can't be matches. Only pattern counts arrive here, at most 256 of them, however
    many pairs there are.
    """
    u = _levels_of([p[:-1] for p in random], random_counts) + max(1.0, random_counts.sum()) / max(1, invoices)
    u /= u.sum(1, keepdims=True)
    month = [(p[:-1], n) for p, n in zip(random, random_counts, strict=True) if p[-1]]
    u_date = _levels_of([p for p, _ in month], np.array([n for _, n in month]))[2] + 1.0
    u_date /= u_date.sum()
    u_value = (one_holder + 1.0) / (one_holder + 1.0).sum()
    m, booked = np.tile([0.05, 0.15, 0.8], (len(FIELDS), 1)), 0.5
    index = np.array(patterns, int).reshape(-1, len(FIELDS))
    for _ in range(200):
        each = np.where(index >= 0, np.take_along_axis(m / u, np.maximum(index, 0).T, 1).T, 1.0)
        each[:, 2] = np.where((index[:, 0] > 0) & (index[:, 2] >= 0), (m[2] / u_date)[index[:, 2]], each[:, 2])
        each[:, 3] = np.where((index[:, 1] == 2) & (index[:, 3] >= 0), (m[3] / u_value)[index[:, 3]], each[:, 3])
        ratio = each.prod(1)
        odds = booked / max(1, invoices) * ratio
        weight = counts * odds / (1 - booked + odds)
        new = _levels_of(patterns, weight) + 0.1
        new /= new.sum(1, keepdims=True)
        share = min(0.99, max(0.01, weight.sum() / max(1, rows)))
        done = abs(new - m).max() + abs(share - booked) < 1e-6
        m, booked = new, share
        if done:
            break
    return Model(m, u, u_date, u_value, booked, invoices)


def _by_level(name: str, by_level: np.ndarray) -> Column:
    c = F.col(name)
    out = F.when(c < 0, F.lit(1.0))
    for level in range(3):
        out = out.when(c == level, F.lit(float(by_level[level])))
    return out


def odds(model: Model) -> Column:
    """Odds of a pair against booking nothing.

    How rare a holder, and a value with it, is among the invoices replaces the average chance of agreeing on them: sharing
    a value that a supplier bills again and again says less than sharing one that occurs once.
    """
    ratio = model.m / model.u
    n = float(max(1, model.invoices))
    m_holder, m_value = float(model.m[1, 2]), float(model.m[3, 2])
    both = (F.col("holder") == 2) & (F.col("value") == 2)
    joint = (
        F.when(both, m_holder * m_value * n / F.coalesce("n_value", F.lit(1)))
        .when(F.col("holder") == 2, m_holder * n / F.coalesce("n_holder", F.lit(1)) * _by_level("value", model.m[3] / model.u_value))
        .otherwise(_by_level("holder", ratio[1]) * _by_level("value", ratio[3]))
    )
    date = F.when(F.col("number") > 0, _by_level("date", model.m[2] / model.u_date)).otherwise(_by_level("date", ratio[2]))
    return joint * _by_level("number", ratio[0]) * date * (model.booked / n / (1 - model.booked))


def _one_holder(b: DataFrame, holders: DataFrame, seed: int) -> np.ndarray:
    """Numbers of pairs of different invoices of one holder, by level of value. Each version meets about one other of
    its holder, by hashes modulo the holder's number of versions, so a large holder is spread over as many keys."""
    v = b.where("holder is not null and value is not null").select("n", "holder", "value", "net").join(holders, "holder")
    at = lambda s: F.pmod(F.xxhash64("n", F.lit(s)), F.col("n_holder"))
    # The holder goes into the key only: a collision of keys pairs two holders by chance, as rarely as hashes collide.
    key = lambda s: F.xxhash64("holder", at(s)).alias("k")
    one = v.select(key(seed), F.col("n").alias("n_1"), F.col("value").alias("value_1"))
    two = v.select(key(seed + 1), "n", "value", "net")
    level = _value_level(F.col("value_1"), F.col("value"), F.col("net"))
    out = np.zeros(3)
    for r in one.join(two, "k").where("n_1 <> n").groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect():
        out[r["level"]] = r["n"]
    return out


def link(register: DataFrame, filings: DataFrame, threshold: float = THRESHOLD, seed: int = 11) -> DataFrame:
    """(pr_record_id, invoice_id, confidence): the invoice that each register row books, if its posterior reaches threshold.

    A register row books at most one invoice and an invoice may be booked by several rows. threshold is at least one half
    (else ValueError): no two invoices can both reach that, so there are no ties. A repeated
    register row comes out once per record_id; rows without record_id are left out, as nothing could name them. Blank
    or unreadable cells are no evidence for or against. Empty tables give no rows; further columns are never read.

    The sides and the compared pairs are written to the shared folder; what the driver gets are counts of rows and of level patterns.
    """
    if threshold < 0.5:
        raise ValueError("a threshold below one half leaves ties undecided")
    a, b, holders = with_counts(store(register_side(register)), store(filed_side(filings)))
    a, b = store(a), store(b)
    rows, invoices = (x.agg(F.count_distinct("n")).collect()[0][0] for x in (a, b))
    spread = max(1, invoices // RANDOM_PAIRS_PER_ROW)
    at = lambda s: F.pmod(F.xxhash64("n", F.lit(s)), F.lit(spread)).alias("k")
    chance = a.select(at(seed), _side("a", *_OF_A)).join(b.select(at(seed + 1), _side("b", *_OF_B)), "k")
    count = lambda df, *by: [tuple(r) for r in df.groupBy(*FIELDS, *by).agg(F.count("*").alias("n")).collect()]
    split = lambda x: ([r[:-1] for r in x], np.array([float(r[-1]) for r in x]))
    random, one_holder = split(count(_unpacked(_packed(chance)), "month")), _one_holder(b, holders, seed)
    pairs = store(candidates(a, b, holders)[0])
    model = learn(*split(count(pairs)), *random, one_holder, rows, invoices)
    weights = pairs.select("a_n", "b_n", odds(model).alias("odds"))
    top = weights.groupBy("a_n").agg(F.max("odds").alias("best"), F.sum("odds").alias("all"), F.max_by("b_n", "odds").alias("b_n"))
    top = top.withColumn("confidence", F.col("best") / (1 + F.col("all"))).where(F.col("confidence") >= threshold)
    named = lambda df, n, out: df.groupBy(F.col("n").alias(n)).agg(F.min("id").alias(out))
    return top.join(named(b, "b_n", "invoice_id"), "b_n").join(named(a, "a_n", "pr_record_id"), "a_n").select("pr_record_id", "invoice_id", "confidence")
