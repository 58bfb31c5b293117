"""The engine's queries over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from ..registry import ORACLE_SQL, QUERIES
from . import agreements, laws, negotiations, relational, schedules, snapshots, states, texts, versions, wordings  # noqa: F401  (they register their queries)

FLAGSHIP = "severity_summary"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
