"""All queries of the library by name, and their SQL."""

from __future__ import annotations

from inventra.plans import identity, inventory, reports, review, similar, structure, timeline  # noqa: F401
from inventra.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
