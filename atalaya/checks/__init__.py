"""Queries that check every operator over the supplied tables."""

from __future__ import annotations

from collections.abc import Callable


def _load() -> None:
    from atalaya.checks import (  # noqa: F401
        analysis,
        foundation,
        learning,
        relations,
        storage,
    )


def all_queries() -> dict[str, Callable]:
    from atalaya.checks.registry import QUERIES

    _load()
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    from atalaya.checks.registry import SQL

    _load()
    return dict(SQL)
