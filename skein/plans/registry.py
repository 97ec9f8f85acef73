"""All queries of the library, by name: importing the plan modules registers them."""

from __future__ import annotations

from skein.plans import dialogue, knowledge, operations, retrieval, understanding  # noqa: F401
from skein.plans.catalog import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
