"""All queries of the library and their SQL, by name."""

from __future__ import annotations

from .plans.queries import ORACLES, QUERIES, flagship

__all__ = ["ORACLES", "QUERIES", "flagship"]
