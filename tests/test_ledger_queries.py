import random
from datetime import date, timedelta

import pytest

from ledgerloom.functions import text
from ledgerloom.operators import matching, normalize
from ledgerloom.plans import ledger_queries
from ledgerloom.sources.tables import FILING_COLUMNS, REGISTER_COLUMNS

from .conftest import frame, ledger
from .test_matching import greedy, plain_score


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    """A folder with both ledgers, the register writing the numbers of the filings in its own ways, and the pairs that taking all
    pairs one by one by score gives."""
    rng = random.Random(7)
    holders = ["27AAPFU0939F1ZV", "29AAGCB7383J1Z4"]
    filed = [
        ledger(
            record_id=f"B{i:02d}", invoice_id=f"INV-2603-{i % 25:05d}", vendor_gstin=rng.choice(holders), taxable_value=f"{rng.choice([1000, 1010, 5000, 90000]) + i}",
            invoice_date=str(date(2026, 3, 1) + timedelta(rng.randint(0, 27))), gstr2b_period="2026-03",
        )
        for i in range(30)
    ]
    ways = [lambda n: n, str.lower, lambda n: n.replace("-", "/"), lambda n: n.replace("0", "O"), lambda n: "#" + n[4:].replace("-", ""), lambda n: f"BILL/{n[-3:]}"]
    register = [ledger(**(filed[i] | {"record_id": f"P{i:02d}", "invoice_id": ways[i % 6](filed[i]["invoice_id"])})) for i in range(28)]
    register += [ledger(record_id="P98", invoice_id="none", taxable_value="7", vendor_gstin="07AAPFU0939F1ZX", invoice_date="2026-01-01", vendor_name="Zed"), ledger(record_id="P99", taxable_value="bad")]
    folder = str(tmp_path_factory.mktemp("ledgers"))
    frame(spark, register, REGISTER_COLUMNS).write.parquet(f"{folder}/purchase_register.parquet")
    frame(spark, filed, FILING_COLUMNS).write.parquet(f"{folder}/gstr2b_prior_period.parquet")
    a, b = ([r.asDict() for r in matching.keyed(normalize.normalize(frame(spark, x))).collect()] for x in (register[:-1], filed))
    scores = [(x["id"], y["id"], s) for x in a for y in b if (s := plain_score(x, y)) >= matching.MIN_SCORE]
    return folder, [r["record_id"] for r in register[:-1]], [r["record_id"] for r in filed], {x: y for x, y, _ in greedy(scores)}


def test_queries_take_the_assigned_pairs(spark, written):
    folder, left, _, pairs = written
    got = {r["record_id"]: r for r in ledger_queries.decision_fields(spark, folder).collect()}
    assert {k: r["matched_record_id"] for k, r in got.items()} == {k: pairs.get(k) for k in left}
    assert len(pairs) > 24 and "P98" not in pairs and text.ratio(got["P04"]["invoice_id"], "INV-2603-00004") < 1
    assert {(r["left_id"], r["right_id"]) for r in ledger_queries.evidence_deltas(spark, folder).collect()} == set(pairs.items())
    assert {r["left_id"] for r in ledger_queries.decisions(spark, folder).where("rule_id = 'N1'").collect()} == set(left) - set(pairs)
    queue = [r["left_id"] for r in ledger_queries.review_queue(spark, folder).orderBy("place").collect()]
    assert [k in pairs for k in queue] == sorted((k in pairs for k in queue), reverse=True)


def test_unmatched_filings_are_those_left_over(spark, written):
    folder, _, right, pairs = written
    assert sorted(r["record_id"] for r in ledger_queries.unmatched_filings(spark, folder).collect()) == sorted(set(right) - set(pairs.values()))


def test_change_log_holds_all_fields(spark, tmp_path):
    messy = ledger(record_id="P1", vendor_name="M/s Acme  Mills", cgst="9,000", sgst="9000", igst="0", total_tax="18000.0", invoice_value="1,18,000", itc_claimed_date="15/04/2026")
    frame(spark, [messy], REGISTER_COLUMNS).write.parquet(f"{tmp_path}/purchase_register.parquet")
    frame(spark, [ledger(gstr2b_period="2026-03", supplier_filing_date="10/05/2026")], FILING_COLUMNS).write.parquet(f"{tmp_path}/gstr2b_prior_period.parquet")
    got = {(r["source"], r["field"]) for r in ledger_queries.change_log(spark, str(tmp_path)).collect()}
    assert got == {("purchase_register", f) for f in ("vendor_name", "cgst", "sgst", "igst", "total_tax", "invoice_value", "itc_claimed_date")} | {("gstr2b", "supplier_filing_date")}
