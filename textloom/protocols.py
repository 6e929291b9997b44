"""What callers can pass in: each has a deterministic offline default in the library."""

from __future__ import annotations

from typing import Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame


@runtime_checkable
class Embedder(Protocol):
    """A text column to a vector column; default: operators.vectors.hash_embedding. For a model see sources.models.Provider."""

    def __call__(self, text: Column) -> Column: ...


@runtime_checkable
class TermClassifier(Protocol):
    """Adds predicted and confidence to rows that no alias decided; default: none, every row stays unknown."""

    def __call__(self, rows: DataFrame) -> DataFrame: ...


@runtime_checkable
class Summarizer(Protocol):
    """Adds summary to rows with a text column; default: sources.services.summarize."""

    def __call__(self, rows: DataFrame, text: str) -> DataFrame: ...


@runtime_checkable
class Client(Protocol):
    """One remote call: the fields of an answer, or None; see sources.services.request for retries."""

    def __call__(self, *values: object) -> dict | None: ...
