"""Data-quality checks and their history, as PySpark DataFrame operations."""

from assay.spec import Change, Check, Clause, Rule, Suite

__all__ = ["Change", "Check", "Clause", "Rule", "Suite"]
