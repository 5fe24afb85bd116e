"""Registered queries of the audit and the SQL they are checked against."""

from importlib import import_module

from .base import ORACLES, QUERIES, WHOLE, WHOLE_ORACLES

for _name in ("scalar_queries", "selection_queries", "audit_queries", "statistic_queries", "pair_queries", "gate_queries"):
    import_module(f"{__name__}.{_name}")

__all__ = ["ORACLES", "QUERIES", "WHOLE", "WHOLE_ORACLES"]
