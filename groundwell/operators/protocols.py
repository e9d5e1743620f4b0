"""What callers may put in the place of the built-in parts. Everything takes and gives tables, so a batch is one job."""

from __future__ import annotations

from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame

from groundwell.operators.security import Scope


@runtime_checkable
class Backend(Protocol):
    """Second layer: hits of queries (``qid``, ``hint``, perhaps ``path``) for a caller's scope, as ``search.retrieve`` gives them."""

    def retrieve(self, queries: DataFrame, k: int, scope: Scope | None) -> DataFrame: ...


@runtime_checkable
class PageEngine(Protocol):
    """First layer: ranked pages of queries, and pages by slug or path."""

    def search(self, queries: DataFrame, k: int) -> DataFrame: ...

    def read(self, path: str) -> DataFrame: ...
