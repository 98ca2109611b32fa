import os
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import linkage, names
from ledgerloom.session import cut
from ledgerloom.sources.tables import FILING_COLUMNS, REGISTER_COLUMNS

from ..conftest import frame, ledger

SMALL = "/root/testdata/sf0.001"


def invoice(i, rng):
    holder = "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZ") for _ in range(5)) + f"{rng.randint(0, 9999):04d}X"
    day = date(2025, 4, 1) + timedelta(rng.randint(0, 300))
    value = rng.randint(10_000, 900_000)
    return ledger(record_id=f"B{i}", invoice_id=f"INV-{day:%y%m}-{i:08d}", vendor_gstin=f"27{holder}1Z5", invoice_date=str(day), invoice_value=f"{value}.40", taxable_value=f"{value / 1.18:.2f}")


@pytest.fixture(scope="module")
def linked(spark):
    rng = random.Random(7)
    filed = [invoice(1000 + 37 * i, rng) for i in range(300)]
    forms = [lambda n: n, lambda n: n.lower(), lambda n: str(int(n[9:])), lambda n: n.replace("0", "O"), lambda n: f"BILL/{rng.randint(10**5, 10**6)}", lambda n: None, lambda n: n[:-1] + str((int(n[-1]) + 1) % 10), lambda n: n.replace("-", "")]
    rows, truth = [], set()
    for i, f in enumerate(filed[:220]):
        cells = dict(f, record_id=f"P{i}", invoice_id=rng.choice(forms)(f["invoice_id"]))
        if i % 7 == 0:
            cells["invoice_date"] = str(date.fromisoformat(f["invoice_date"]) + timedelta(2))
        if i % 11 == 0:
            cells["vendor_gstin"] = None
        if i % 13 == 0:
            cells["invoice_value"] = ""
        rows.append(cells)
        truth.add((f"P{i}", f["invoice_id"]))
    rows += [dict(invoice(900_000 + i, rng), record_id=f"N{i}") for i in range(60)]
    rows.append(dict(rows[0], record_id="P0b"))
    truth.add(("P0b", filed[0]["invoice_id"]))
    rows.append(dict(rows[0], record_id=None))
    filed += [dict(f, record_id="again", gstr2b_period="2026-03", invoice_id=f" {f['invoice_id'].lower()}") for f in filed[:50]] + [ledger(invoice_id=" ")]
    return frame(spark, rows, REGISTER_COLUMNS), frame(spark, filed, FILING_COLUMNS), truth


def test_link_accuracy(linked):
    register, filed, truth = linked
    rows = linkage.link(register, filed).collect()
    got = {(r["pr_record_id"], r["invoice_id"]) for r in rows}
    assert len(rows) == len(got) == len({a for a, _ in got}) and all(0.5 <= r["confidence"] <= 1 for r in rows)
    assert len(got & truth) >= 0.9 * len(got) and len(got & truth) >= 0.9 * len(truth)


def sides(register, filed):
    a, b, holders = linkage.with_counts(linkage.store(linkage.register_side(register)), linkage.store(linkage.filed_side(filed)))
    return linkage.store(a), linkage.store(b), holders


@pytest.mark.parametrize("whole", [256, 0])
def test_candidates_hold_every_pair_that_agrees(linked, monkeypatch, whole):
    """Against all pairs, with every holder compared whole and with every holder by keys."""
    register, filed, _ = linked
    monkeypatch.setattr(linkage, "WHOLE", whole)
    a, b, holders = sides(register, filed)
    pairs, counted = linkage.candidates(a, b, holders, linkage.CROWD)
    got = {(r["a_n"], r["b_n"]) for r in pairs.collect()}
    assert counted.count() == 0
    every = a.select(F.col("n").alias("a_n")).crossJoin(b.select(F.col("n").alias("b_n")).distinct())
    missed = []
    for r in linkage._unpacked(linkage.compared(every, a, b).groupBy("a_n", "b_n").agg(F.max("p").alias("p"))).collect():
        number = r["number"] == 2 and r["month"] or r["number"] == 1 and r["month"] and (r["holder"] or r["value"] > 0)
        holder = r["holder"] == 2 and (r["date"] == 2 or r["value"] == 2 or (r["date"] > 0 and r["value"] > 0))
        if number or holder or (r["date"] == 2 and r["value"] == 2):
            missed += [r] if (r["a_n"], r["b_n"]) not in got else []
    # Digits of which two far apart are exchanged are as close, but no pass over numbers proposes them.
    assert [r for r in missed if r["number"] != 1 or r["holder"] == 2] == []


def test_a_date_and_value_of_many_holders_finds_the_near_and_the_unknown_ones(spark):
    rng, day = random.Random(9), {"invoice_date": "2025-08-14", "invoice_value": "5000.00"}
    filed = [invoice(1000 + i, rng) | day for i in range(100)] + [invoice(2000, rng) | day | {"vendor_gstin": None}, invoice(2001, rng) | day | {"invoice_value": "5002.00"}]
    g = filed[17]["vendor_gstin"]
    wrong = g[:4] + ("A" if g[4] != "A" else "B") + g[5:9] + str((int(g[9]) + 1) % 10) + g[10:]
    rows = [dict(filed[0], record_id=k, invoice_id=None, **c) for k, c in (("near", {"vendor_gstin": wrong}), ("none", {"vendor_gstin": None}), ("third", {"vendor_gstin": None, "invoice_value": "5002.50"}))]
    a, b, _ = sides(frame(spark, rows, REGISTER_COLUMNS), frame(spark, filed, FILING_COLUMNS))
    name = {r["n"]: r["id"] for s in (a, b) for r in s.collect()}
    got = {(name[r["a_n"]], name[r["b_n"]]) for r in linkage.value_pairs(a, b).collect()}
    assert got == {("near", filed[17]["invoice_id"]), ("near", filed[100]["invoice_id"]), ("third", filed[101]["invoice_id"])}


@pytest.mark.parametrize("whole", [256, 0])
def test_the_last_digits_of_a_long_number_agree_with_it(spark, linked, monkeypatch, whole):
    """Serials grow with the data; clerks type the last five or six digits. The serial that is no longer than these is another invoice."""
    register, filed, _ = linked
    monkeypatch.setattr(linkage, "WHOLE", whole)
    rng = random.Random(8)
    long = [invoice(1_000_000 * (i + 1) + 50_123 + 2 * i, rng) for i in range(12)]
    short = [invoice(50_123 + 2 * i, rng) for i in range(12)]
    # Without date and value only number and holder tell.
    rows = [dict(f, record_id=f"T{i}", invoice_id=f["invoice_id"][-5:] if i % 2 else f"INV-{f['invoice_id'][-6:]}", invoice_value=None, invoice_date=None) for i, f in enumerate(long)]
    rows += [dict(short[0], record_id="T12", invoice_id=short[0]["invoice_id"][-5:], invoice_value=None)]
    a, b, holders = sides(register.unionByName(frame(spark, rows, REGISTER_COLUMNS)), filed.unionByName(frame(spark, long + short, FILING_COLUMNS)))
    name = {r["n"]: r["id"] for s in (a, b) for r in s.collect()}
    got = {(name[r["a_n"]], name[r["b_n"]]) for r in linkage.candidates(a, b, holders)[0].where("number = 2 and holder = 2").collect()}
    assert {(f"T{i}", f["invoice_id"]) for i, f in enumerate(long)} | {("T12", short[0]["invoice_id"])} <= got


def of_one_holder(i, day, value):
    return ledger(record_id=f"B{i}", invoice_id=f"INV-{day:%y%m}-{i:08d}", invoice_date=str(day), invoice_value=f"{value:.2f}", taxable_value=f"{value / 1.18:.2f}")


def confidences(register, filed):
    return {(r["pr_record_id"], r["invoice_id"]): r["confidence"] for r in linkage.link(register, filed).collect()}


def test_a_full_block_loses_no_link(spark, linked):
    """A supplier has many invoices about that day and value, of which one agrees far better than all others."""
    register, filed, _ = linked
    rng, day = random.Random(3), date(2025, 8, 14)
    crowd = [of_one_holder(5000 + i, day + timedelta(rng.choice([-5, -4, -3, -2, -1, 1])), 100_000 * (1.025 + 0.0002 * i)) for i in range(90)]
    crowd += [of_one_holder(6000, day, 100_500), of_one_holder(6001, day, 300_000), of_one_holder(6002, day, 900_000)]
    rows = [dict(crowd[90], record_id="PX", invoice_id="BILL/77", invoice_value="100000.00")]
    for h in range(80):  # other suppliers, whose values are often a little off in the register
        own = [invoice(7000 + 10 * h + i, rng) for i in range(8)]
        crowd += [dict(f, vendor_gstin=own[0]["vendor_gstin"]) for f in own]
        rows.append(dict(crowd[-1], record_id=f"O{h}", invoice_value=f"{float(crowd[-1]['invoice_value']) * 1.004:.2f}"))
    got = confidences(register.unionByName(frame(spark, rows, REGISTER_COLUMNS)), filed.unionByName(frame(spark, crowd, FILING_COLUMNS)))
    assert got["PX", "INV-2508-00006000"] > 0.75


def test_a_supplier_of_thousands_links_as_if_all_pairs_were_listed(spark, linked, monkeypatch):
    register, filed, _ = linked
    rng = random.Random(5)
    many = [of_one_holder(10_000 + 7 * i, date(2025, 4, 1) + timedelta(rng.randint(0, 300)), rng.choice([5000, 10_000, rng.randint(1000, 900_000)]) + 0.4) for i in range(5000)]
    many += [of_one_holder(90_000 + 7 * i, date(2025, 9, 9), 7777.0) for i in range(100)]
    rows = [dict(f, record_id=f"Q{i}", invoice_id=f["invoice_id"] if i % 3 == 0 else f"BILL/{i}") for i, f in enumerate(many[::40])]
    rows += [dict(many[-1], record_id="QA", invoice_id="BILL/1")]
    register, filed = register.unionByName(frame(spark, rows, REGISTER_COLUMNS)), filed.unionByName(frame(spark, many, FILING_COLUMNS))
    found = []
    for whole, crowd, alike in ((256, 2000, 64), (10**9, 10**9, 10**9)):
        for name, value in (("WHOLE", whole), ("CROWD", crowd), ("ALIKE", alike)):
            monkeypatch.setattr(linkage, name, value)
        found.append(confidences(register, filed))
    fast, plain = found
    assert fast.keys() == {k for k, v in plain.items() if k in fast or v > 0.6} and all(abs(v - plain[k]) < 0.12 for k, v in fast.items())
    # One of a hundred invoices alike has no link by itself.
    assert not any(k == "QA" for k, _ in fast) and sum(k[0] == "Q" for k, _ in fast) > 40


def test_results_do_not_depend_on_the_size_of_a_holder(spark, monkeypatch):
    """With holders compared whole or by keys, and few or many counting as a crowd: cells blank, negative, turned or exchanged."""
    rng = random.Random(21)
    filed = [of_one_holder(1000 + 3 * i, date(2025, 4, 1) + timedelta(rng.randint(0, 60)), rng.choice([-1, 1, 1]) * rng.choice([0.5, 5000, rng.randint(100, 9000)])) for i in range(120)]
    rows = []
    for i in range(90):
        f = dict(rng.choice(filed), record_id=f"P{i}")
        serial = list(f["invoice_id"][9:])
        x, y = rng.sample(range(4, 8), 2)
        serial[x], serial[y] = serial[y], serial[x]
        f["invoice_id"] = rng.choice([f["invoice_id"], f["invoice_id"][:9] + "".join(serial), "".join(serial), "BILL/1", None])
        f["invoice_value"] = rng.choice([f["invoice_value"], f["taxable_value"], f"{float(f['invoice_value']) * 1.01:.2f}"])
        rows.append(f | {c: None for c in ("invoice_date", "invoice_value") if rng.random() < 0.2})
    filed = [f | {c: None for c in ("invoice_date", "invoice_value") if rng.random() < 0.1} for f in filed]
    register, filed = frame(spark, rows, REGISTER_COLUMNS), frame(spark, filed, FILING_COLUMNS)
    found = []
    for whole, crowd, alike in ((10**9, 10**9, 10**9), (0, 3, 1)):
        for name, value in (("WHOLE", whole), ("CROWD", crowd), ("ALIKE", alike)):
            monkeypatch.setattr(linkage, name, value)
        pairs, _ = linkage.candidates(*sides(register, filed), linkage.CROWD)
        found.append((sorted(tuple(r) for r in pairs.collect()), confidences(register, filed)))
    (pairs, links), (by_keys, links_by_keys) = found
    assert by_keys == pairs and len(pairs) > 500 and links_by_keys == pytest.approx(links) and len(links) > 10


def test_link_empty_and_threshold(linked):
    register, filed, _ = linked
    assert linkage.link(register.limit(0), filed).count() == 0 and linkage.link(register, filed.limit(0)).count() == 0
    with pytest.raises(ValueError):
        linkage.link(register, filed, threshold=0.4)


def test_numbers(spark):
    cases = {"INV-2603-OOOO664I": ("2603", 6641), "inv no. 2504-00001450": ("2504", 1450), "#260100007200": ("2601", 7200), "17361/25-10": ("2510", 17361), "00878": (None, 878), "BILL/409777": (None, None), "DOC4554988": (None, None), None: (None, None), " ": (None, None), "INV/2602/1513": ("2602", 1513)}
    got = linkage.with_number(spark.createDataFrame([(c,) for c in cases], "c string"), "c").collect()
    assert [(r["month"], r["serial"]) for r in got] == list(cases.values())


ONE = [
    "Gidmav Binkuv Bearings Limited", "gidmav binkuv bearings limited", "Gidmav  Binkuv Bearings Ltd", "Gidmav B1nkuv Bearings Limited", "Gidmav Binkuv Brgs Limited", "Gidmav Binkuv Lmtd (Bearings)",
    "M/s Gidmavbinkuv Bearings Limited *", "Bearings, Gidmav Binkuv Limited", "Gidmav-Binkuv Bearings", "Gidmav Binkuv Bearings Limited, Pellur", " Gidmav Binkvu Bearin9s P. Ltd",
]
TWO = ["Gidmav Binkuv Timber Limited", "Timber Gidmav Binkuv Limited (Pellur)"]
PERSON = ["Richard Lolpimvunles Engineering", "Dick L0lpimvunles Engineering", "R Lolpimvunles Engineering", "Lolpimvunles, Richard - Engrg", "Messrs Richd. Lolpim Vunles Engineering"]
OTHER = ["Robert Lolpimvunles Timber", "Tekzar Lutpov Foods - Pellur", "Tekzar Lutpov Foods", "Morwal Kelmat Cables, Pellur"]


def test_resolve(spark):
    every = ONE + TWO + PERSON + OTHER
    df = spark.createDataFrame([(n, "x") for n in every + every[:5] + [None, "", "  "]], "vendor_name string, cluster string")
    got = {r["name"]: r["cluster"] for r in names.resolve(df).collect()}
    assert set(got) == set(every)
    groups = {frozenset(n for n in every if got[n] == c) for c in set(got.values())}
    assert groups == {frozenset(ONE), frozenset(TWO), frozenset(PERSON), frozenset(OTHER[:1]), frozenset(OTHER[1:3]), frozenset(OTHER[3:])}
    pairs = names.spelling_pairs(names.resolve(df)).collect()
    want = {(a, b) for g in groups for a in g for b in g if a < b}
    assert {tuple(r) for r in pairs} == want and len(pairs) == len(want)
    assert names.resolve(df.limit(0)).count() == 0


def test_merging_enriches(spark):
    """Two spellings two slips apart meet through a third that either is one slip from."""
    chain = ["Murgakmurmur Exports", "Murgakmurnur Exports", "Murgakmuznur Exports"]
    df = spark.createDataFrame([(n,) for n in chain], "vendor_name string")
    assert names.resolve(df).select("cluster").distinct().count() == 1
    assert names.resolve(df.where("vendor_name <> 'Murgakmurnur Exports'")).select("cluster").distinct().count() == 2


def grouped(spark, every):
    df = spark.createDataFrame([(n,) for n in every], "vendor_name string")
    got = {r["name"]: r["cluster"] for r in names.resolve(df).collect()}
    return {frozenset(n for n in got if got[n] == c) for c in set(got.values())}


def test_a_name_that_says_less_is_no_bridge(spark):
    """A surname alone, an initial and a short form of two names fit several persons and join none; where one fits, they join."""
    several = ["Smith Traders", "Robert Smith Traders", "Joseph Smith Traders", "R Smith Traders", "Richard Smith Traders"]
    one = ["Morkel Cables", "William Morkel Cables", "Bill Morkel Cables", "W. Morkel Cables"]
    short = ["Chris Vantok Foods", "Christine Vantok Foods", "Christopher Vantok Foods"]
    unlisted = ["Mary Kolvar Timber", "Kolvar Timber", "M Kolvar Timber", "Rajesh Sharmak Tea", "Sharmak Tea", "Zed Sharmak Tea", "Abel Lurvok Paints", "Z Lurvok Paints"]
    assert grouped(spark, several + one + short + unlisted) == {
        *[frozenset([n]) for n in several + short], frozenset(one), frozenset(unlisted[:3]), *[frozenset([n]) for n in unlisted[3:]],
    }


def test_links_do_not_depend_on_how_many_names_there_are(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("bdgklmnprstvz") + rng.choice("aeiou") for _ in range(4)).capitalize()
    own = ["Gidmav Timber", "Gidmav Timber, Zubtown", "Pelluk Foods", "Pelluk Foods (Zubtown)", "Rimtok Cables - Zubtown", "Rimtok Cables", "Rimtok Cables Zubtown"]
    want = {frozenset(own[:2]), frozenset(own[2:4]), frozenset(own[4:])}
    for n in (50, 7000):
        assert want <= grouped(spark, own + [f"{word()} {word()} Tea" for _ in range(n)])


def test_lines_of_trade_are_learned(spark):
    """Groceries is in no list; it tells organisations apart all the same."""
    shops = [f"{x} Groceries Limited" for x in ("Gidmav", "Pelluk", "Rimtok", "Zodvar", "Tulmek", "Bexnor")]
    assert frozenset(["Gidmav Groceries Limited", "Groceries, Gidmav"]) in grouped(spark, [*shops, "Groceries, Gidmav", "Gidmav Timber"])


def test_many_holders_of_one_surname(spark):
    """Hundreds of persons of one surname and trade, each in two spellings, beside the surname alone."""
    firsts = sorted(names.SHORT_NAMES)
    every = [f"{f.capitalize()} Lolpimvun{x} Tea" for f in firsts for x in ("les", "lles")] + ["Lolpimvunles Tea"]
    got = grouped(spark, every)
    assert len(got) == len(firsts) + 1 and frozenset(["Lolpimvunles Tea"]) in got


@pytest.mark.skipif(not os.path.exists(SMALL), reason="no test tables")
def test_registered_queries_have_the_given_columns(spark):
    from ledgerloom.llm import queries

    want = {"p3_found": ["invoice_id", "pr_record_id"], "p4_found": ["name_a", "name_b"], "p6_ids": ["doc_id", "ids"], "p8_found": ["doc_id", "kind", "found_text"]}
    for name, columns in want.items():
        df = queries.QUERIES[name](spark, SMALL)
        assert df.columns == columns and df.count() > 0


def test_the_size_that_a_table_is_taken_for_does_not_grow_with_the_rounds(spark):
    """Else its digits double with each join of a round, until they fill the driver's memory."""
    to = cut(spark.range(64).select("id", (F.col("id") / 2).cast("bigint").alias("into")))
    for _ in range(6):
        on = to.select(F.col("id").alias("into"), F.col("into").alias("further"))
        to = cut(to.join(on, "into", "left").select("id", F.coalesce("further", "into").alias("into")))
    assert {r["into"] for r in to.collect()} == {0}
    assert to._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() <= 64
