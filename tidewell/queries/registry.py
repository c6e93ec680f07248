"""All core queries together."""

from __future__ import annotations

import importlib

from tidewell.queries import Query

MODULES = ("stream", "patterns", "intervals", "forecast", "adapt", "series", "dataflow", "packs", "io")


def _registries() -> list:
    return [importlib.import_module(f"tidewell.queries.{m}").R for m in MODULES]


def all_queries() -> dict[str, Query]:
    return {k: v for r in _registries() for k, v in r.queries.items()}


def all_sql() -> dict[str, str]:
    return {k: v for r in _registries() for k, v in r.sql.items()}
