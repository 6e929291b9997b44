"""Connected components of an edge table."""

from textloom.operators.components import components

__all__ = ["components"]
