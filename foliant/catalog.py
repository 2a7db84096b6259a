"""Queries over the test tables, and the SQL that they are held against."""

from __future__ import annotations

from foliant.plans.queries import ORACLE_SQL, QUERIES

FLAGSHIP = "flagship_contract_fields"
__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
