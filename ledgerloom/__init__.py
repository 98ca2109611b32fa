"""Ledgerloom: Spark-native reconciliation of independently kept ledgers.

Every operator takes and returns DataFrames; nothing is executed until the caller acts on the result,
except where a docstring says that a job runs while the plan is built.
"""

__version__ = "0.1.0"
