"""All named queries and their SQL, gathered from the modules that define them."""

from __future__ import annotations

from terrafolio import queries_appraisal, queries_gate, queries_panels, queries_search, queries_sheet, queries_watch  # noqa: F401  (they register their queries)
from terrafolio.queries import FLAGSHIP, ORACLES, QUERIES

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
