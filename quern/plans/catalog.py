"""All queries over the reference's operators and their SQL."""

from __future__ import annotations

from quern.plans import cards, drafting, layout, library, markdown, markup  # noqa: F401
from quern.plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
