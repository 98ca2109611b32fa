"""One-to-one matching of two normalised ledgers by score."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import parse, text
from ..session import store

# Points, bands and floor of the score.
INVOICE_EQUAL, INVOICE_CLOSE, INVOICE_FROM = 40.0, 8.0, 0.85
GSTIN_EQUAL, GSTIN_HOLDER = 30.0, 20.0
AMOUNT_EQUAL, AMOUNT_BANDS = 30.0, ((0.02, 12.0), (0.10, 6.0))
NAME_EQUAL, NAME_FROM = 10.0, 0.60
DATE_BANDS = ((0, 6.0), (2, 4.0), (7, 2.0), (30, 1.0))
MIN_SCORE = 45.0
# Below this score a pair may agree on neither number, holder nor amount, and no key proposes it.
LOWEST_FLOOR = 36.0
BLOCK = 1000
# Only pairs of holder and amount, or of number and one of these, reach STRONG: all else has at most 30 + 12 + 8 + 10 + 6 points. FAIR is
# out of reach for a pair with neither the number, nor a holder with an amount within 10 percent: it has at most 30 + 8 + 10 + 6.
STRONG, FAIR = 70.0, 55.0
# Numbers of which both are shorter can be three characters apart only below the floor.
LONG = 19


def keyed(records: DataFrame, record_id: str = "record_id") -> DataFrame:
    """What matching reads of normalised records, typed once: id, invoice, gstin, holder, amount, date, words."""
    cells = {
        "id": F.col(record_id), "invoice": F.coalesce(F.col("invoice_id"), F.lit("")), "gstin": F.coalesce(F.col("vendor_gstin"), F.lit("")),
        "amount": parse.parse_amount("taxable_value").cast("double"), "date": parse.parse_date("invoice_date"), "words": text.sorted_words(F.coalesce(F.col("vendor_name"), F.lit(""))),
    }
    out = parse.staged(records, {f"_{k}": v for k, v in cells.items()}).select(*[F.col(f"_{k}").alias(k) for k in cells])
    return out.withColumn("holder", F.when(F.length("gstin") == 15, parse.pan("gstin")))


def prepared(records: DataFrame, record_id: str = "record_id") -> DataFrame:
    """keyed, written to the shared folder: eight kinds of keys and the scores read it, none of them parses again."""
    return store(keyed(records, record_id))


def _key(kind: int, *parts: Column) -> Column:
    known = reduce(lambda x, y: x & y, [p.isNotNull() for p in parts])
    return F.when(known, F.xxhash64(F.lit(kind), *[p.cast("string") for p in parts]))


_WEEK, _STEP = 8, 0.11
# As many days, and such a step of the logarithm, as the second bands of date and amount are wide.
_SURE_DAYS, _SURE_STEP = 2, 0.0203
SALTS = 4
PLAIN_ROUNDS = 2


def _band(c: str) -> Column:
    return F.when(F.col(c) > 0, F.floor(F.log(F.col(c)) / _STEP))


def _forms(rows: DataFrame) -> DataFrame:
    i = F.explode(F.sequence(F.lit(0), F.length("invoice")))
    form = F.when(F.col("_i") == 0, F.col("invoice")).otherwise(F.expr("concat(left(invoice, _i - 1), substring(invoice, _i + 1))"))
    return rows.where("invoice <> ''").withColumn("_i", i).withColumn("form", form)


def _shorter(rows: DataFrame, own: bool) -> DataFrame:
    """Numbers with any two characters dropped if own, else as they are, of lengths at which such a pair can reach the floor and is
    not of LONG numbers both."""
    if not own:
        return rows.where(F.length("invoice").between(13, LONG - 1)).withColumn("form", F.col("invoice"))
    once = _forms(rows.where(F.length("invoice").between(15, LONG + 1))).where("_i > 0")
    later = once.withColumn("_j", F.explode(F.sequence(F.col("_i"), F.length("form"))))
    return later.withColumn("form", F.expr("concat(left(form, _j - 1), substring(form, _j + 1))"))


def _around(rows: DataFrame, out: str, c: Column, spread: int) -> DataFrame:
    return rows.withColumn(out, F.explode(F.sequence(c - spread, c + spread))) if spread else rows.withColumn(out, c)


def _cells(rows: DataFrame, *parts: tuple[int, DataFrame, list[Column]]) -> DataFrame:
    """(kind, key, id) of rows for each kind of key."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(k).cast("byte").alias("kind"), _key(k, *ps).alias("key"), "id").where("key is not null") for k, df, ps in parts])


def _listed(keys: DataFrame) -> DataFrame:
    """keys that no join broadcasts: a stored table that is read as many keys a row is taken for as small as its file."""
    return keys.hint("merge")


def _meet(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of ids with a key in common, each once."""
    return _listed(left).select("key", F.col("id").alias("left_id")).join(right.select("key", F.col("id").alias("right_id")), "key").select("left_id", "right_id").distinct()


def _who() -> Column:
    """What records of one GSTIN, and of one holder, have in common."""
    return F.coalesce("holder", F.nullif(F.col("gstin"), F.lit("")))


def _strong_keys(rows: DataFrame, spread: int, floor: float) -> DataFrame:
    """Keys of pairs that reach STRONG (who and amount, or the number with either) or FAIR (the number, or who with a near amount)."""
    known = rows.where("amount is not null")
    amounts = _around(known, "cell", F.floor("amount"), spread)
    named = F.nullif(F.col("invoice"), F.lit(""))
    if floor >= STRONG:
        return _cells(rows, (12, amounts, [_who(), F.col("cell")]), (13, rows, [named, _who()]), (14, amounts, [named, F.col("cell")]))
    # Amounts of a rupee or less may be equal though their logarithms are far apart.
    banded = _around(known.where("amount > 0"), "cell", _band("amount"), spread)
    return _cells(rows, (12, amounts, [_who(), F.col("cell")]), (15, banded, [_who(), F.col("cell")]), (1, rows, [named]))


def _week(c: str) -> Column:
    return F.floor(F.datediff(F.col(c), F.lit("2000-01-01").cast("date")) / _WEEK)


def _salted(rows: DataFrame, every: bool) -> DataFrame:
    """rows by ``salt``: all of them on one side, the record's own on the other, so that SALTS tasks share a large week."""
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))) if every else F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))


def _keys(rows: DataFrame, spread: int) -> DataFrame:
    """(kind, key, id); spread 1 on one side makes neighbouring cells meet."""
    known = rows.where("amount is not null")
    amounts = _around(known, "cell", F.floor("amount"), spread)
    banded = _around(known.where("amount > 0 and holder is not null"), "cell", _band("amount"), spread)
    coded = rows.where("gstin <> ''")
    weekly = lambda df: _salted(_around(df.where("date is not null"), "week", _week("date"), spread), spread > 0)
    parts = [
        (1, rows.where("invoice <> ''"), [F.col("invoice")]),
        (2, amounts, [F.col("cell")]),
        (3, coded, [F.col("gstin")]),
        (4, banded, [F.col("holder"), F.col("cell")]),
        (5, weekly(coded), [F.col("gstin"), F.col("week"), F.col("salt")]),
        (6, _forms(coded), [F.col("gstin"), F.col("form")]),
        (7, weekly(amounts), [F.col("cell"), F.col("week"), F.col("salt")]),
        (8, _forms(amounts), [F.col("cell"), F.col("form")]),
    ]
    for k, own in ((9, spread > 0), (10, spread == 0)):
        parts += [(k, _shorter(coded, own), [F.lit("g"), F.col("gstin"), F.col("form")]), (k, _shorter(amounts, own), [F.lit("a"), F.col("cell"), F.col("form")])]
    long = F.length("invoice") >= LONG
    parts += [(11, coded.where(long), [F.lit("g"), F.col("gstin")]), (11, amounts.where(long), [F.lit("a"), F.col("cell")])]
    return _cells(rows, *parts)


def _in_week() -> Column:
    """Whether a pair of one week can still reach MIN_SCORE with 40 points for all but date and number: on one day it can; else its
    numbers, d and e, must be as alike as the points that the date leaves open ask for. Edits are at most the characters by which the
    ratio falls short."""
    days = F.abs(F.datediff("p", "q"))
    enough = F.lit(False)
    for most, points in DATE_BANDS[:3]:
        ratio = INVOICE_FROM + (1 - INVOICE_FROM) * max(0.0, MIN_SCORE - AMOUNT_EQUAL - NAME_EQUAL - points) / INVOICE_CLOSE
        room = F.floor((1 - ratio) * (F.length("d") + F.length("e")) + 1e-9)
        enough = enough | ((days <= most) & (F.lit(points >= MIN_SCORE - AMOUNT_EQUAL - NAME_EQUAL) | (F.levenshtein("d", "e") <= room)))
    return F.coalesce(enough, F.lit(False))


def candidate_pairs(left: DataFrame, right: DataFrame, floor: float = MIN_SCORE, banded: bool = True) -> DataFrame:
    """Pairs (left_id, right_id) that may reach floor, each once.

    A pair that shares neither invoice number, nor holder, nor amount to the rupee has at most 8 + 12 + 10 + 6 points. What it
    shares otherwise decides which keys find it. From STRONG on: GSTIN or holder with the amount, or the number with either. From FAIR on: the
    number, or GSTIN or holder with an amount within 10 percent. Below: the number itself (1); the amount (2); the whole GSTIN (3);
    the holder with an amount within 10 percent, without which a holder alone reaches at most 44 points (4).
    Blocks of keys 2 and 3 with more than BLOCK right rows are split. For a GSTIN: by neighbouring weeks (5) and by numbers
    one slip apart (6), and 4; for an amount: by neighbouring weeks (7), by numbers one slip apart (8), and 4. Weeks are salted, and
    what meets in one is kept only if its date and number can reach MIN_SCORE. A pair of a large
    block that neither weeks nor 4 propose has 41 points at most without its numbers and needs a ratio of 0.925 of them to reach
    MIN_SCORE. That is one slip, or two characters more on the left (9) or on the right (10), or more where both numbers have
    LONG characters, which all meet in their block (11). Floors below MIN_SCORE may lose pairs of large blocks. Without banded, 4 is left to
    the caller, see every_scored_pair.
    """
    if floor >= FAIR:
        return _meet(_strong_keys(left, 1, floor), _strong_keys(right, 0, floor))
    l, r = (k if banded else k.where("kind <> 4") for k in (_keys(left, 1), _keys(right, 0)))  # noqa: E741
    sizes = r.where("kind in (2, 3)").groupBy("kind", "key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    large = store(sizes.select("kind", "key"))
    if large.isEmpty():
        return _meet(l.where("kind <= 4"), r.where("kind <= 4"))
    whole = r.where("kind in (1, 4)").unionByName(r.where("kind in (2, 3)").join(large, ["kind", "key"], "left_anti"))
    # Finer keys are many: only for rows of large blocks, on either side.
    def fine(rows: DataFrame, keys: DataFrame, spread: int) -> DataFrame:
        inside = keys.where("kind in (2, 3)").join(large, ["kind", "key"], "left_semi").select("id").distinct()
        return _keys(store(rows.join(inside, "id", "left_semi")), spread).where("kind >= 5")

    fine_left, fine_right = fine(left, l, 1), fine(right, r, 0)
    pairs = _meet(l.where("kind <= 4"), whole).unionByName(_meet(fine_left.where("kind not in (5, 7)"), fine_right.where("kind not in (5, 7)")))
    side = lambda keys, rows, i, d, n: _listed(keys.where("kind in (5, 7)")).join(rows.select("id", F.col("date").alias(d), F.col("invoice").alias(n)), "id").withColumnRenamed("id", i).drop("kind")
    weekly = _listed(side(fine_left, left, "left_id", "p", "d")).join(side(fine_right, right, "right_id", "q", "e"), "key").where(_in_week())
    return pairs.unionByName(weekly.select("left_id", "right_id")).distinct()


def _sure_keys(rows: DataFrame, spread: int) -> DataFrame:
    """Keys of pairs that can reach MIN_SCORE without their texts, see sure_candidates."""
    known = rows.where("amount is not null")
    # Amounts of a rupee or less, of which no logarithm tells how close they are, are equal if they are close at all.
    near = known.where("amount <> 0 and date is not null and gstin <> ''").withColumn("day", F.floor(F.datediff("date", F.lit("2000-01-01").cast("date")) / _SURE_DAYS))
    near = _around(_around(near, "cell", F.floor(F.log(F.abs("amount")) / _SURE_STEP), spread), "day", F.col("day"), spread)
    return _cells(
        rows, (1, rows.where("invoice <> ''"), [F.col("invoice")]), (12, _around(known, "cell", F.floor("amount"), spread), [_who(), F.col("cell")]),
        (16, near, [F.col("gstin"), F.col("amount") > 0, F.col("cell"), F.col("day")]),
    )


def sure_candidates(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (left_id, right_id) that may reach MIN_SCORE without any comparison of texts, each once.

    Without the number (1), only GSTIN or holder with an equal amount (12) and the GSTIN with an amount within 2 percent and a date within
    two days (16) reach it: a holder with an amount that isn't equal has at most 20 + 12 + 6 points, a GSTIN with an amount farther away
    30 + 6 + 6, an amount alone 30 + 6. No block is larger than what these have in common, so none is split.
    """
    return _meet(_sure_keys(left, 1), _sure_keys(right, 0))


def all_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every pair, for floors of at most LOWEST_FLOOR; quadratic, for comparison on small ledgers only."""
    return left.select(F.col("id").alias("left_id")).crossJoin(right.select(F.col("id").alias("right_id")))


# --- Scores: name to a builder of a column over the structs l and r ----------------------------------------------------


def gstin_points() -> Column:
    a, b = F.col("l.gstin"), F.col("r.gstin")
    holder = F.coalesce(F.col("l.holder") == F.col("r.holder"), F.lit(False))
    return F.when((a != "") & (a == b), GSTIN_EQUAL).when(holder, GSTIN_HOLDER).otherwise(0.0)


def amount_points() -> Column:
    a, b = F.col("l.amount"), F.col("r.amount")
    gap = F.abs(a - b)
    base = F.greatest(F.abs(a), F.abs(b), F.lit(1.0))
    out = F.when(a.isNull() | b.isNull(), 0.0).when(gap <= 1.0, AMOUNT_EQUAL)
    for share, points in AMOUNT_BANDS:
        out = out.when(gap / base <= share, points)
    return out.otherwise(0.0)


def date_points() -> Column:
    days = F.abs(F.datediff(F.col("l.date"), F.col("r.date")))
    out = F.when(days.isNull(), 0.0)
    for most, points in DATE_BANDS:
        out = out.when(days <= most, points)
    return out.otherwise(0.0)


def invoice_equal_points() -> Column:
    return F.when((F.col("l.invoice") != "") & (F.col("l.invoice") == F.col("r.invoice")), INVOICE_EQUAL).otherwise(0.0)


SCORERS: dict[str, Callable[[], Column]] = {"gstin": gstin_points, "amount": amount_points, "date": date_points, "invoice": invoice_equal_points}


def _sides(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    l = left.select(F.col("id").alias("left_id"), F.struct(*left.columns).alias("l"))  # noqa: E741
    r = right.select(F.col("id").alias("right_id"), F.struct(*right.columns).alias("r"))
    return pairs.join(l, "left_id").join(r, "right_id")


def cheap_scores(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """pairs with the points that need no comparison of texts: gstin, amount, date, and equal invoice numbers."""
    return _sides(pairs, left, right).select("left_id", "right_id", *[f().alias(n) for n, f in SCORERS.items()])


def scored_pairs(pairs: DataFrame, left: DataFrame, right: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """Pairs that reach min_score: (left_id, right_id, score, gstin, amount, date, invoice, name).

    Texts are compared only for pairs that can still reach it. Two texts have at most as many edits as their ratio lacks characters, so
    edits, counted inside Spark, tell which texts earn nothing; equal ones earn all.
    """
    return _scored(_sides(pairs, left, right), min_score)


def _scored(both: DataFrame, min_score: float) -> DataFrame:
    """scored_pairs of rows with left_id, right_id and the records as structs l and r."""
    both = both.select("left_id", "right_id", "l", "r", *[f().alias(n) for n, f in SCORERS.items()])
    sure = sum((F.col(n) for n in SCORERS), F.lit(0.0))
    both = both.where(sure + NAME_EQUAL + F.when(F.col("invoice") > 0, 0.0).otherwise(INVOICE_CLOSE) >= min_score)

    def may(a: str, b: str, start: float) -> Column:
        edits = F.levenshtein(a, b) < (1 - start) * (F.length(a) + F.length(b)) + 1e-9
        return (F.col(a) != "") & (F.col(b) != "") & ((F.col(a) == F.col(b)) | edits)

    texts = {"_a": F.col("l.words"), "_b": F.col("r.words"), "_c": F.col("l.invoice"), "_d": F.col("r.invoice")}
    texts = parse.staged(both.select("left_id", "right_id", *SCORERS, *[c.alias(n) for n, c in texts.items()]), {
        "_names": may("_a", "_b", NAME_FROM), "_numbers": (F.col("invoice") == 0) & may("_c", "_d", INVOICE_FROM),
    })
    texts = texts.where(sure + F.when(F.col("_names"), NAME_EQUAL).otherwise(0.0) + F.when(F.col("_numbers"), INVOICE_CLOSE).otherwise(0.0) >= min_score)
    # What needs no comparison goes along as null.
    some = lambda ok, c, d: F.when(F.col(ok) & (F.col(c) != F.col(d)), F.col(c))
    texts = texts.select("*", some("_names", "_a", "_b").alias("_w"), some("_names", "_b", "_a").alias("_x"), some("_numbers", "_c", "_d").alias("_y"), some("_numbers", "_d", "_c").alias("_z"))
    texts = text.with_ratio(text.with_ratio(texts, "_w", "_x", "_name"), "_y", "_z", "_invoice")
    close = lambda ok, r, start, points: F.when(F.col(ok) & F.col(r).isNull(), points).when(F.col(r) > start, points * (F.col(r) - start) / (1 - start)).otherwise(0.0)
    name = close("_names", "_name", NAME_FROM, NAME_EQUAL)
    invoice = F.when(F.col("invoice") > 0, F.col("invoice")).otherwise(close("_numbers", "_invoice", INVOICE_FROM, INVOICE_CLOSE))
    out = texts.withColumn("name", name).withColumn("invoice", invoice)
    total = F.round(F.col("invoice") + F.col("gstin") + F.col("amount") + F.col("name") + F.col("date"), 6)
    return out.withColumn("score", total).where(F.col("score") >= min_score).select("left_id", "right_id", "score", "gstin", "amount", "date", "invoice", "name")


def _banded(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of one holder with amounts in the same or neighbouring bands, with their records, each once as a right record has one band: no pair
    is shuffled. Rows are salted, so that tasks share a large band."""
    known = lambda df: df.where("amount > 0 and holder is not null")
    l = _salted(_around(known(left), "band", _band("amount"), 1), True)  # noqa: E741
    r = _salted(known(right).withColumn("band", _band("amount")), False)
    keys = ["holder", "band", "salt"]
    struct = lambda df, rows, i, n: df.select(F.col("id").alias(i), *keys, F.struct(*rows.columns).alias(n))
    return _listed(struct(l, left, "left_id", "l")).join(struct(r, right, "right_id", "r"), keys).drop(*keys)


def every_scored_pair(left: DataFrame, right: DataFrame) -> DataFrame:
    """scored_pairs of all candidates at MIN_SCORE. Nearly all of them are of one holder with amounts in neighbouring bands, and so quadratic
    in its records: these are scored where they meet; only others are proposed and their records joined."""
    band = lambda c: F.when(F.col(c) > 0, F.floor(F.log(F.col(c)) / _STEP))
    near = (F.col("l.holder") == F.col("r.holder")) & (F.abs(band("l.amount") - band("r.amount")) <= 1)
    others = _sides(candidate_pairs(left, right, banded=False), left, right).where(~F.coalesce(near, F.lit(False)))
    return _scored(_banded(left, right), MIN_SCORE).unionByName(_scored(others, MIN_SCORE))


def _tied(best: DataFrame) -> DataFrame:
    """Pairs (left_id, right_id, score) of full blocks: every left record of it is best with exactly the right records of the block, all by one
    score, and the other way round. Taking such pairs one by one pairs the records by their ranks.

    best: pairs with ``all_left`` and ``all_right``, for how many records each side's best score stands. Records whose best
    partners are the same are recognised by their number and two hashes over them.
    """
    seen = lambda of, by, n: best.groupBy(by).agg(F.count("*").alias(f"{n}_c"), F.bit_xor(F.xxhash64(of)).alias(f"{n}_x"), F.bit_xor(F.xxhash64(F.lit(1), of)).alias(f"{n}_y"))
    both = best.join(seen("right_id", "left_id", "l"), "left_id").join(seen("left_id", "right_id", "r"), "right_id").where("l_c = all_left and r_c = all_right")
    block = ["l_c", "l_x", "l_y", "r_c", "r_x", "r_y", "score"]
    # A full block has as many pairs as its sides multiply to.
    full = both.groupBy(*block).agg(F.count("*").alias("n")).where("n = l_c * r_c").drop("n")
    inside = both.join(full, block, "left_semi")
    rank = lambda c: inside.select(c, *block).distinct().withColumn("rank", F.row_number().over(Window.partitionBy(*block).orderBy(c)))
    return rank("left_id").join(rank("right_id"), [*block, "rank"]).select("left_id", "right_id", "score")


def assign(scored: DataFrame) -> DataFrame:
    """Strictly one-to-one pairs, best score first, ties by left_id and then right_id in code point order.

    Each round keeps the pairs that are first for both their sides, and after PLAIN_ROUNDS whole blocks of ties (see _tied), and takes away all
    others of these sides, until none is left. As the order is strict, that gives the same pairs as taking them one by one. Each round's tables are written to the
    shared folder. One pass over the pairs finds the first of either side with map-side combination, so a record with very
    many pairs is no hot group.
    """
    rest = store(scored.select("left_id", "right_id", "score"))
    taken: list[DataFrame] = []
    while not rest.isEmpty():
        first = lambda by, other, n: rest.groupBy(by).agg(F.max("score").alias(f"{n}_s"), F.min_by(other, F.struct((-F.col("score")).alias("s"), other)).alias(f"{n}_m"))  # noqa: B023, E731
        both = rest.join(first("left_id", "right_id", "l"), "left_id").join(first("right_id", "left_id", "r"), "right_id")
        mutual = lambda df: df.where("right_id = l_m and left_id = r_m").select("left_id", "right_id", "score")
        if len(taken) < PLAIN_ROUNDS:
            won = store(mutual(both))
        else:
            top = store(both.where("score = l_s or score = r_s"))
            many = lambda by, s, n: top.where(f"score = {s}").groupBy(by).agg(F.count("*").alias(n))  # noqa: B023, E731
            best = top.where("score = l_s and score = r_s")
            known = best.select("left_id", "right_id", "score").join(many("left_id", "l_s", "all_left"), "left_id").join(many("right_id", "r_s", "all_right"), "right_id")
            won = store(mutual(best).unionByName(_tied(known)).distinct())
        taken.append(won)
        rest = store(rest.join(won.select("left_id"), "left_id", "left_anti").join(won.select("right_id"), "right_id", "left_anti"))
    return reduce(DataFrame.unionByName, taken) if taken else rest


@dataclass
class Matching:
    """matches: one row per left record, right_id and score null without a partner; unmatched: right ids without one."""

    matches: DataFrame
    unmatched: DataFrame


def match(left: DataFrame, right: DataFrame, min_score: float = MIN_SCORE) -> Matching:
    """Match two normalised ledgers. Record ids must be unique on each side; ValueError if they aren't.

    Pairs are taken by descending score, so those of the highest scores are proposed, scored and assigned first, and lower ones
    among the records left over only: what two records of one supplier share anyway is never listed for records that have a partner.
    """
    l, r = prepared(left), prepared(right)  # noqa: E741
    for name, side in (("left", l), ("right", r)):
        if not side.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 or id is null").isEmpty():
            raise ValueError(f"record ids of the {name} ledger aren't unique")
    if min_score <= LOWEST_FLOOR:
        pairs = assign(scored_pairs(all_pairs(l, r), l, r, min_score))
        return Matching(*_outer(l, r, pairs))
    taken: list[DataFrame] = []
    x, y = l, r
    for floor in [f for f in (STRONG, FAIR) if f > min_score] + [min_score]:
        won = assign(scored_pairs(candidate_pairs(x, y, floor), x, y, floor))
        taken.append(won)
        if floor > min_score:
            x, y = (store(df.join(won.select(F.col(c).alias("id")), "id", "left_anti")) for df, c in ((x, "left_id"), (y, "right_id")))
    return Matching(*_outer(l, r, store(reduce(DataFrame.unionByName, taken))))


def _outer(l: DataFrame, r: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:  # noqa: E741
    return (
        l.select(F.col("id").alias("left_id")).join(pairs, "left_id", "left"),
        r.select(F.col("id").alias("right_id")).join(pairs.select("right_id"), "right_id", "left_anti"),
    )


def latest(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The last row of each key by order, by aggregation with map-side combination."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("v")).select(*keys, "v.*")


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with their place in a global order, from 1. Rows are range-partitioned and counted, so no task sees all of them."""
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = parts.withColumn("_p", F.spark_partition_id())
    parts = store(parts.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(*order))))
    before = parts.groupBy("_p").agg(F.count("*").alias("n"))
    before = before.withColumn("_before", F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    return parts.join(F.broadcast(before), "_p").withColumn("place", F.col("_i") + F.col("_before")).drop("_p", "_i", "_before")
