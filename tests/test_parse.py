from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import gstin, parse, text
from ledgerloom.operators import normalize


def column(spark, values, build):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(build(F.col("v"))).collect()]


def test_dates(spark):
    good = ["2026-04-15", "15/04/2026", "15-04-2026", "2026/04/15", "15.04.2026", " 2026-4-15 ", " 2026-04-15"]
    assert column(spark, good, parse.parse_date) == [date(2026, 4, 15)] * len(good)
    bad = ["2026-02-31", "2026-13-05", "31/04/2026", "not-a-date", "15 April 2026", "", "  ", None, "2026-04-001", "15/04-2026", "15/04/26", "2026-04-15T00:00:00"]
    assert column(spark, bad, parse.parse_date) == [None] * len(bad)


def test_amounts(spark):
    good = {"1,00,000.00": "100000", "₹9,000.00": "9000", " 4200 ": "4200", "1234.5": "1234.5", "-1.00": "-1", "0": "0", "1e3": "1000", ".5": "0.5", "5.": "5", "1_000": "1000"}
    assert column(spark, list(good), parse.parse_amount) == [Decimal(x) for x in good.values()]
    bad = ["N/A", "12,345.67abc", "abc", "1.2.3", "", None, "nan", "inf", "1.5d", "(5)", "88399 Rs 05"]
    assert column(spark, bad, parse.parse_amount) == [None] * len(bad)


def test_blank_is_not_zero(spark):
    assert column(spark, ["", None, " ", "0", "0.00", "7.5", "7.50", "x"], parse.amount_key) == [None, None, None, "0.000000", "0.000000", "7.500000", "7.500000", "?x"]


@pytest.mark.parametrize("bad", ["27AAPFU0939F1Z", "27AAPFU0939F1ZVV", "27AAPFU0939F1ZX", "40AAPFU0939F1ZV", "00AAPFU0939F1ZV", "2712345U0939F1ZV", "27aapfu0939f1zv", "27AAPFU0939F1YV", "27AAPFU0939F-ZV", "", None])
def test_gstin_invalid(spark, bad):
    assert column(spark, [bad], gstin.is_valid) == [False]


def test_gstin_valid_and_standard(spark):
    assert column(spark, ["27AAPFU0939F1ZV", "29AAGCB7383J1Z4"], gstin.is_valid) == [True, True]
    assert column(spark, ["27aapfu0939f1zv", "27 AAPFU 0939 F1ZV", "27-AAPFU-0939F1ZV", " ", None], parse.standard_gstin) == ["27AAPFU0939F1ZV"] * 3 + [None, None]
    assert column(spark, ["27AAPFU0939F1ZX"], gstin.problem) == ["wrong check digit or character"]


def test_standard_text_amount_date(spark):
    cases = {"  Acme   Industries  ": "Acme Industries", "M/s Acme Industries": "Acme Industries", "Messrs. Acme": "Acme", "Acme Pvt Ltd.": "Acme Pvt Ltd", "Acme  Inds. ;": "Acme Inds", None: ""}
    assert column(spark, list(cases), text.standard_text) == list(cases.values())
    assert column(spark, ["1,00,000.00", "1234.5", "₹9,000.00", "0", "", None, "x "], normalize.standard_amount) == ["100000.00", "1234.50", "9000.00", "0.00", "", "", "x"]
    assert column(spark, ["15/04/2026", "soon ", None], normalize.standard_date) == ["2026-04-15", "soon", ""]


def test_messy(spark):
    clean, messy = ["Acme Industries Private Limited", "Rao & Sons (India)"], ["Konark Fabricat0,rs and C0mpany", "De,ccan Soluti0ns 1ndia Pvt. Ltd.", "Acme Industries — Ltd"]
    assert column(spark, clean + ["", None], text.looks_messy) == [False] * 4
    assert column(spark, messy, text.looks_messy) == [True] * 3


def plain_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_ratio_equals_table():
    import random

    rng = random.Random(5)
    for _ in range(2000):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randint(0, 12))) for _ in "ab")
        assert text.common_subsequence(a, b) == plain_subsequence(a, b)
    assert text.ratio("", "") == 1.0 and text.ratio(None, "a") is None


def test_sorted_words_and_ratio_column(spark):
    df = spark.createDataFrame([("b  A", "a b"), ("", None)], "x string, y string")
    got = text.with_ratio(df.withColumns({"x": text.sorted_words("x"), "y": text.sorted_words("y")}), "x", "y", "r").collect()
    assert [(r["x"], r["y"], r["r"]) for r in got] == [("A B", "A B", 1.0), ("", None, None)]
