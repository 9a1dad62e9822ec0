"""Registered queries of all families, each with its SQL where SQL can say the same."""

from __future__ import annotations

from importlib import import_module

from barweave.catalog.registry import ORACLE, QUERIES, Query

FAMILIES = ("quality", "returns", "metrics", "features", "sources", "covariance", "allocation", "walkforward", "regime", "ml")


def _load() -> None:
    for name in FAMILIES:
        import_module(f"barweave.catalog.q_{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLE)
