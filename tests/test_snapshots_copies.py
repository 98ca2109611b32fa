import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ledgerloom.operators import copydiff, snapshots
from ledgerloom.sources.tables import FILING_COLUMNS

from .conftest import frame, ledger


def test_changes_against_brute_force(spark):
    rng = random.Random(3)
    periods = ["2025-09", "2025-10", "2026-01", "2026-03"]
    rows = [(f" k{k}" if rng.random() < 0.3 else f"K{k}", p, rng.choice("ab"), "extra") for k in range(40) for p in periods if rng.random() < 0.7]
    rows += [r for r in rows if rng.random() < 0.2] + [(None, "2025-10", "a", ""), (" ", "2026-02", "a", ""), ("K1", None, "a", "")]
    df = spark.createDataFrame(rows, "key string, period string, value string, change string")
    got = snapshots.snapshot_changes(df, F.upper(F.trim("key")).substr(1, 9), F.col("period"), [F.col("value")], "key", "period").where("key <> ''")
    state = {}
    for k, p, v, _ in rows:
        if p and k and k.strip():
            state[p, k.strip().upper()] = v
    delivered = sorted({p for _, p, _, _ in rows if p})
    want = set()
    for before, p in zip(delivered, delivered[1:], strict=False):
        for k in {k for _, k in state}:
            was, now = state.get((before, k)), state.get((p, k))
            if was != now:
                want.add((p, k, "added" if was is None else "removed" if now is None else "changed"))
    assert {tuple(r) for r in got.collect()} == want


def test_filing_changes_typed(spark):
    a = ledger(gstr2b_period="2026-01")
    same = ledger(gstr2b_period="2026-02", invoice_id=" inv-2604-00001", vendor_gstin="27-aapfu0939f1zv", invoice_date="15/04/2026", taxable_value="₹1,00,000.0", vendor_name="other")
    blank = ledger(gstr2b_period="2026-03", igst="")
    df = frame(spark, [a, same, same, blank], FILING_COLUMNS)
    assert [tuple(r) for r in snapshots.filing_changes(df).collect()] == [("2026-03", "INV-2604-00001", "changed")]
    assert snapshots.filing_changes(df.limit(0)).count() == 0
    assert [tuple(r) for r in snapshots.changes_by_snapshot(snapshots.filing_changes(df)).collect()] == [("2026-03", 0, 0, 1)]


def test_values_that_move_to_a_blank_field(spark):
    first = ledger(gstr2b_period="2026-01", cgst="9000", sgst="")
    moved = first | {"gstr2b_period": "2026-02", "cgst": "", "sgst": "9000"}
    got = snapshots.filing_changes(frame(spark, [first, moved, moved | {"gstr2b_period": "2026-03"}], FILING_COLUMNS))
    assert [tuple(r) for r in got.collect()] == [("2026-02", "INV-2604-00001", "changed")]


def test_presence_bitmaps():
    rng = np.random.default_rng(1)
    for n in (0, 1, 64, 65, 1000, 5000):
        for p, q in ((0.5, 0.95), (1, 0.999), (0.999, 1), (0, 1), (0.01, 0.999)):
            # Stretches of each, so that runs of full and empty words meet mixed ones.
            a, b = (np.flatnonzero((rng.random(n) < x) ^ (np.arange(n) // 300 % 3 == k)) for k, x in ((0, p), (1, q)))
            x, y = copydiff.Presence.of(a), copydiff.Presence.of(b)
            assert x.ordinals().tolist() == a.tolist()
            assert x.and_not(y).ordinals().tolist() == sorted(set(a) - set(b)) and x.intersect(y).ordinals().tolist() == sorted(set(a) & set(b))
    full, half = copydiff.Presence.of(np.arange(64_000_000)), copydiff.Presence.of(np.arange(32_000_000, 96_000_010))
    assert full.full.tolist() == [[0, 1_000_000]] and not len(full.words)
    both = full.intersect(half)  # a few steps, however many ordinals the runs stand for
    assert both.full.tolist() == [[500_000, 1_000_000]] and half.and_not(full).full.tolist() == [[1_000_000, 1_500_000]]
    assert not hasattr(copydiff.Presence, "dense")


def test_copy_against_brute_force(spark):
    rng = random.Random(4)
    cell = lambda: rng.choice(["", None, "0", "0.00", "1", "1.0", "x", "y", "₹2,000"])
    left = [ledger(invoice_id=f"k{i}", taxable_value=cell(), igst=cell(), gstr2b_period="2026-03") for i in range(80) if rng.random() < 0.9]
    right = [ledger(invoice_id=f" K{i}", taxable_value=cell(), igst=cell()) for i in range(80) if rng.random() < 0.9]
    left += left[:5] + [ledger(invoice_id=None, gstr2b_period="2026-03"), ledger(invoice_id="old", gstr2b_period="2026-02")]

    def norm(v):
        v = (v or "").replace("₹", "").replace(",", "").strip()
        try:
            return float(v) if v else None
        except ValueError:
            return v

    a, b = ({r["invoice_id"].strip().upper(): r for r in side if r["invoice_id"] and r["invoice_id"] != "old"} for side in (left, right))
    want = {(k, "missing_in_copy") for k in a.keys() - b.keys()} | {(k, "missing_in_prior") for k in b.keys() - a.keys()}
    want |= {(k, f) for k in a.keys() & b.keys() for f in ("taxable_value", "igst") if norm(a[k][f]) != norm(b[k][f])}
    for rows_per_bucket in (10, 100_000):
        got = copydiff.copy_differences(
            frame(spark, left).where("gstr2b_period = '2026-03'"), frame(spark, right), copydiff.parse.record_key("invoice_id"), ("taxable_value", "cgst", "sgst", "igst"),
            ("missing_in_prior", "missing_in_copy"), "invoice_id", rows_per_bucket,
        )
        rows = [tuple(r) for r in got.collect()]
        assert set(rows) == want and len(rows) == len(want)


def test_copy_empty(spark):
    df = frame(spark, [ledger(gstr2b_period="2026-03")])
    assert [tuple(r) for r in copydiff.filing_copy_differences(df, df.limit(0)).collect()] == [("INV-2604-00001", "missing_in_copy")]
    assert copydiff.filing_copy_differences(df.limit(0), df.limit(0)).count() == 0


def test_compare_bucket_types():
    t = pa.table({"key": ["a", "a", "b"], "right": [False, True, True], "x": [1, 2, 3], "x_kind": pa.array([1, 1, 1], pa.int8())})
    assert copydiff.compare_bucket(t, ["x"], ("no left", "no right")).to_pylist() == [{"key": "b", "difference": "no left"}, {"key": "a", "difference": "x"}]
