"""Extension points: anything of these shapes can stand in for the local defaults."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame

#: Grader of (query text column, passage text column) from 0 to 10.
Grader = Callable[[str, str], Column]
#: Chunker of (documents, key, text).
Chunker = Callable[[DataFrame, str, str], DataFrame]


class Embedder(Protocol):
    """(key columns, tokens column) -> DataFrame with ``embedding``."""

    def __call__(self, df: DataFrame, key: list[str], tokens: str, dim: int = 64) -> DataFrame: ...


class Retriever(Protocol):
    """Queries and rows -> (query_id, rank, id, score)."""

    def __call__(self, queries: DataFrame, rows: DataFrame, k: int) -> DataFrame: ...


class Judge(Protocol):
    """Prompts -> replies, one each; a :class:`lectern.operators.services.Service` sends them in batches."""

    def __call__(self, texts: list[str]) -> list[str]: ...


def choose(kind: str, name: str, known: dict[str, object]) -> object:
    """The strategy of that name; an unknown one fails at once and names the others."""
    if name not in known:
        raise ValueError(f"unknown {kind} {name!r}; one of {', '.join(sorted(known))}")
    return known[name]
