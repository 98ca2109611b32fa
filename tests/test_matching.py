import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.operators import matching, normalize

from .conftest import frame, ledger


def plain_score(a, b):
    ratio = text.ratio(a["invoice"], b["invoice"])
    invoice = 0.0 if not a["invoice"] or not b["invoice"] else 40.0 if a["invoice"] == b["invoice"] else 8 * (ratio - 0.85) / 0.15 if ratio > 0.85 else 0.0
    gstin = 30.0 if a["gstin"] and a["gstin"] == b["gstin"] else 20.0 if len(a["gstin"]) == len(b["gstin"]) == 15 and a["gstin"][2:12] == b["gstin"][2:12] else 0.0
    gap, base = abs(a["amount"] - b["amount"]), max(abs(a["amount"]), abs(b["amount"]), 1.0)
    amount = 30.0 if gap <= 1 else 12.0 if gap / base <= 0.02 else 6.0 if gap / base <= 0.1 else 0.0
    r = text.ratio(a["words"], b["words"])
    name = 0.0 if not a["words"] or not b["words"] else 10 * (r - 0.6) / 0.4 if r > 0.6 else 0.0
    days = abs((a["date"] - b["date"]).days)
    return round(invoice + gstin + amount + name + next((p for m, p in matching.DATE_BANDS if days <= m), 0.0), 6)


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(11)
    holders = ["AAPFU0939F", "AAGCB7383J", "LGNZR4577D"]

    def row(i):
        return ledger(
            record_id=f"r{i:03d}", invoice_id=f"INV-2604-{rng.randint(1, 60):05d}", vendor_gstin=f"{rng.choice(['27', '07'])}{rng.choice(holders)}1Z{rng.choice('VH')}",
            taxable_value=f"{rng.choice([1000, 1000.9, 1015, 1080, 5000, 90000]) + rng.choice([0, 0.5, 40])}", vendor_name=rng.choice(["Acme Mills", "Mills Acme", "Bora Tea", ""]),
            invoice_date=str(date(2026, 4, 1) + timedelta(rng.randint(0, 45))),
        )

    left, right = ([row(i) for i in range(70)] for _ in "lr")
    return matching.keyed(normalize.normalize(frame(spark, left))), matching.keyed(normalize.normalize(frame(spark, right)))


@pytest.mark.parametrize("block", [1000, 3])
def test_candidates_lose_no_pair(sides, block, monkeypatch):
    monkeypatch.setattr(matching, "BLOCK", block)
    left, right = sides
    a, b = ([r.asDict() for r in s.collect()] for s in sides)
    want = {(x["id"], y["id"]): plain_score(x, y) for x in a for y in b}
    want = {k: v for k, v in want.items() if v >= 45}
    got = {(r["left_id"], r["right_id"]): r["score"] for r in matching.scored_pairs(matching.candidate_pairs(left, right), left, right).collect()}
    assert got == pytest.approx(want)


@pytest.mark.parametrize("block", [1000, 3])
def test_every_scored_pair_once_and_those_of_a_band_not_shuffled(sides, block, monkeypatch):
    monkeypatch.setattr(matching, "BLOCK", block)
    left, right = sides
    a, b = ([r.asDict() for r in s.collect()] for s in sides)
    want = {(x["id"], y["id"]): s for x in a for y in b if (s := plain_score(x, y)) >= 45}
    rows = matching.every_scored_pair(left, right).collect()
    assert len(rows) == len(want) and {(r["left_id"], r["right_id"]): r["score"] for r in rows} == pytest.approx(want)
    # What meets in a band is never grouped or joined again.
    plan = matching._scored(matching._banded(left, right), matching.MIN_SCORE)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Aggregate" not in plan


def test_keys_are_never_broadcast(sides, monkeypatch):
    """A small file holds rows whose keys are many times its size; the driver would have to hold them all."""
    monkeypatch.setattr(matching, "BLOCK", 3)
    left, right = (matching.store(s) for s in sides)
    for df in (matching.candidate_pairs(left, right), matching.candidate_pairs(left, right, matching.FAIR), matching._banded(left, right)):
        lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
        depth = lambda line: next(i for i, c in enumerate(line) if c.isalpha())
        lines = [x for x in lines if any(c.isalpha() for c in x)]
        for i, line in enumerate(lines):
            if "BroadcastExchange" in line:
                below = [x for j, x in enumerate(lines[i + 1 :], i + 1) if all(depth(y) > depth(line) for y in lines[i + 1 : j + 1])]
                assert not [x for x in below if "Generate" in x]


def test_large_blocks_propose_numbers_two_characters_apart(spark, monkeypatch):
    monkeypatch.setattr(matching, "BLOCK", 3)
    numbers = [("INV251000009235", "INV-2510-00009235"), ("INV-2511-00000417", "INV251100000417"), ("A-2510-0000-0000-00007", "A2510000000000007X"), ("ACME-2510-000000-12345", "ACME2510000000-12345")]
    cells = [{"taxable_value": "100"}, {"taxable_value": "100", "vendor_gstin": "29AAGCB7383J1Z4"}]
    left = [ledger(record_id=f"l{i}{j}", invoice_id=a, **c) for i, (a, _) in enumerate(numbers) for j, c in enumerate(cells)]
    right = [ledger(record_id=f"r{i}{k}", invoice_id=b, invoice_date="2026-05-05", taxable_value=v) for i, (_, b) in enumerate(numbers) for k, v in enumerate(("100", "900"))]
    x, y = (matching.keyed(normalize.normalize(frame(spark, rows))) for rows in (left, right))
    a, b = ([r.asDict() for r in side.collect()] for side in (x, y))
    want = {(p["id"], q["id"]): s for p in a for q in b if (s := plain_score(p, q)) >= 45}
    got = {(r["left_id"], r["right_id"]): r["score"] for r in matching.scored_pairs(matching.candidate_pairs(x, y), x, y).collect()}
    assert ("l00", "r01") in want and ("l10", "r11") in want and ("l01", "r00") in want and got == pytest.approx(want)


def test_sure_candidates_are_few_and_lose_no_pair(spark, sides):
    """All pairs that reach the floor without texts, and of a supplier of many rows none that can't."""
    left, right = sides
    total = F.col("gstin") + F.col("amount") + F.col("date") + F.col("invoice")
    sure = lambda pairs, x, y: {tuple(p) for p in matching.cheap_scores(pairs, x, y).where(total >= matching.MIN_SCORE).select("left_id", "right_id").collect()}
    want = sure(matching.all_pairs(left, right), left, right)
    assert len(want) > 100 and sure(matching.sure_candidates(left, right), left, right) == want
    near = [("100", 0), ("102.04", 2), ("98", -2), ("98", -3), ("0.50", 0), ("-100", 1), ("-101.5", 2), ("0", 0), ("100.9", 90)]
    rows = [{"id": str(i), "invoice": "", "gstin": "27AAPFU0939F1ZV", "holder": "AAPFU0939F", "amount": float(a), "date": date(2026, 4, 15) + timedelta(d), "words": ""} for i, (a, d) in enumerate(near)]
    rows = spark.createDataFrame(rows, "id string, invoice string, gstin string, holder string, amount double, date date, words string")
    want = sure(matching.all_pairs(rows, rows), rows, rows)
    assert {("0", "1"), ("0", "2"), ("5", "6"), ("0", "8")} <= want and sure(matching.sure_candidates(rows, rows), rows, rows) == want
    many = rows.where("id = '0'").crossJoin(spark.range(60).select(F.col("id").alias("n"))).withColumns({"id": F.col("n").cast("string"), "amount": F.col("amount") * F.exp(F.col("n") / 10)}).drop("n")
    assert matching.candidate_pairs(many, many).count() == 3600 and matching.sure_candidates(many, many).count() == 60


def greedy(rows):
    left, right, out = set(), set(), []
    for s, a, b in sorted((-s, a, b) for a, b, s in rows):
        if a not in left and b not in right:
            out.append((a, b, -s))
            left.add(a)
            right.add(b)
    return sorted(out)


def test_assign_equals_greedy(spark):
    rng = random.Random(4242)
    for n in (1, 8, 40):
        rows = list({(f"a{rng.randint(0, n)}", f"b{rng.randint(0, n)}"): None for _ in range(4 * n)})
        rows = [(a, b, float(rng.choice([50, 60, 60, 70]))) for a, b in rows]
        df = spark.createDataFrame(rows, "left_id string, right_id string, score double")
        assert sorted(tuple(r[c] for c in ("left_id", "right_id", "score")) for r in matching.assign(df).collect()) == greedy(rows)
    df = spark.createDataFrame([("p1", "b1", 60.0), ("p1", "b2", 90.0), ("p2", "b2", 80.0)], "left_id string, right_id string, score double")
    assert [(r["left_id"], r["right_id"]) for r in matching.assign(df).collect()] == [("p1", "b2")]
    assert matching.assign(df.limit(0)).count() == 0


def test_match_identical_scores_116_and_guards(spark):
    one = normalize.normalize(frame(spark, [ledger()]))
    m = matching.match(one, one)
    assert [(r["left_id"], r["right_id"], r["score"]) for r in m.matches.collect()] == [("R1", "R1", 116.0)] and m.unmatched.count() == 0
    m = matching.match(one, one.limit(0))
    assert [(r["left_id"], r["right_id"]) for r in m.matches.collect()] == [("R1", None)]
    with pytest.raises(ValueError):
        matching.match(one.union(one), one)


@pytest.mark.parametrize("amount, points", [("100000.00", 30), ("100000.99", 30), ("101000", 12), ("105000", 6), ("300000", 0)])
def test_amount_bands(spark, amount, points):
    l, r = (matching.keyed(normalize.normalize(frame(spark, [ledger(taxable_value=x)]))) for x in ("100000.00", amount))  # noqa: E741
    assert matching.cheap_scores(matching.all_pairs(l, r), l, r).collect()[0]["amount"] == points


@pytest.mark.parametrize("day, points", [("2026-04-15", 6), ("2026-04-17", 4), ("2026-04-20", 2), ("2026-05-10", 1), ("2026-07-30", 0)])
def test_date_bands(spark, day, points):
    l, r = (matching.keyed(normalize.normalize(frame(spark, [ledger(invoice_date=x)]))) for x in ("2026-04-15", day))  # noqa: E741
    assert matching.cheap_scores(matching.all_pairs(l, r), l, r).collect()[0]["date"] == points


def test_ranked_and_latest(spark):
    df = spark.range(500).select(F.col("id"), (F.col("id") % 7).alias("k"))
    got = matching.ranked(df, F.col("k"), F.col("id").desc()).orderBy("place").collect()
    assert [r["place"] for r in got] == list(range(1, 501)) and [(r["k"], -r["id"]) for r in got] == sorted((r["k"], -r["id"]) for r in got)
    assert {r["k"]: r["id"] for r in matching.latest(df, ["k"], F.col("id")).collect()} == {k: max(i for i in range(500) if i % 7 == k) for k in range(7)}


def test_a_block_of_ties_takes_few_rounds(spark, monkeypatch):
    """200 x 200 pairs of one score, beside a smaller block, a chain and pairs that differ, in a fixed number of rounds."""
    rows = [(f"a{i:03d}", f"b{j:03d}", 60.0) for i in range(200) for j in range(200)]
    rows += [(f"c{i}", f"d{j}", 50.0) for i in range(7) for j in range(3)] + [(f"c{i}", "b000", 55.0) for i in range(2)]
    rows += [(f"e{i}", f"f{i + k}", 70.0) for i in range(6) for k in (0, 1)] + [("g1", "d0", 80.0), ("g1", "h", 50.0), ("g2", "h", 50.0)]
    tables = []
    store = matching.store
    monkeypatch.setattr(matching, "store", lambda df: tables.append(1) or store(df))
    got = matching.assign(spark.createDataFrame(rows, "left_id string, right_id string, score double"))
    assert sorted(tuple(r) for r in got.collect()) == greedy([(a, b, s) for a, b, s in rows])
    assert len(tables) <= 1 + 3 * 9
