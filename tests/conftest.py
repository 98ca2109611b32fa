import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from ledgerloom.session import local_session

    s = local_session("tests", cores=4, partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    yield s
    s.stop()


def ledger(**cells):
    """A valid filed record; cells replace its own."""
    row = {
        "record_id": "R1", "invoice_id": "INV-2604-00001", "vendor_name": "Acme Industries Private Limited", "vendor_gstin": "27AAPFU0939F1ZV",
        "invoice_date": "2026-04-15", "place_of_supply": "27-Maharashtra", "tax_rate": "18", "taxable_value": "100000.00", "cgst": "9000.00", "sgst": "9000.00",
        "igst": "0.00", "total_tax": "18000.00", "invoice_value": "118000.00", "supplier_filing_date": "2026-05-10", "gstr2b_period": "2026-04",
        "simulated_current_date": "2026-06-10",
    }
    return row | cells


def frame(spark, rows, columns=None):
    """A table of text columns; columns name them where there are no rows."""
    names = columns or list(rows[0])
    return spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], ", ".join(f"`{c}` string" for c in names))
