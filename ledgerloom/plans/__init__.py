"""Composed plans: the reconciliation pipeline, calibration, reporting, registered queries."""
