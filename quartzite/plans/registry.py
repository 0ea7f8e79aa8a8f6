"""All queries of the library with their DuckDB twins."""

from __future__ import annotations

from . import analyses, cleaning, entities, profiling, reports, summaries

FLAGSHIP = "entity_tags"
_PARTS = (cleaning, entities, profiling, reports, summaries, analyses)


def queries() -> dict:
    return {k: q for part in _PARTS for k, q in part.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for part in _PARTS for k, s in part.SQL.items()}
