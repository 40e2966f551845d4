"""Every query of the engine by name, with the SQL that must give the same rows."""

from __future__ import annotations

from .plans import corpus, profiles, records, rules, statistics  # noqa: F401  (each registers its queries)
from .plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
