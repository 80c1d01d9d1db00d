"""The registered queries: each engine operator over whole test tables, with its SQL."""

from siltgate.catalog import casts, edits, files, loads, profiles, rows, workbooks  # noqa: F401
from siltgate.catalog.registry import oracles, queries

__all__ = ["oracles", "queries"]
