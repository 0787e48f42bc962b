"""All queries and their DuckDB counterparts; importing the plan modules registers them."""

from __future__ import annotations

from .plans import files, identities, learning, quality_checks, relational, reviews, scalars, search, streams, timelines, vectors  # noqa: F401
from .plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
