"""Queries of the library by name, and the SQL that DuckDB holds against them."""

from textloom.queries import aggregates, extras, filters, flows, joins, scalars, vectors, windows  # noqa: F401
from textloom.queries.flows import flagship
from textloom.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]
