"""Registered queries over the driver's tables and their SQL checks."""

from __future__ import annotations

import importlib

from tidemark.catalog.base import ORACLES, QUERIES, Query

SECTIONS = ("market", "forward", "replay", "ledger", "learning", "scans", "streams")


def _load() -> None:
    for name in SECTIONS:
        importlib.import_module(f"tidemark.catalog.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)
