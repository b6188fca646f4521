"""Registered queries, each with the SQL over the same tables that checks it."""

from pagetables.catalog import (  # noqa: F401
    arrivals, fields, records, rules, scan, sequence, temporal, totals, windows,
)
from pagetables.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
