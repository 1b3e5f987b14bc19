"""All registered queries and their SQL oracles."""

from __future__ import annotations

from tidemark.plans import basic, composites, history, knowledge, panels, sources_combined, stored  # noqa: F401  (they register their queries)
from tidemark.plans.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
