"""Queries of the engine over the driver tables, most with DuckDB SQL for the same rows."""

from canvass.queries import campaigns, catalog, control, evidence, ingest, texts, timeline, vectors, writes  # noqa: F401
from canvass.queries.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
