"""Queries over the shared test tables, each with the SQL that must agree with it."""

from faultline.catalogue import files, incidents, questions, reporting, search, streams, texts  # noqa: F401
from faultline.catalogue.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
