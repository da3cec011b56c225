"""All queries of the engine with their DuckDB counterparts."""

from __future__ import annotations

from importlib import import_module

MODULES = ("relational", "timeseries", "statistics", "spatial", "scalars", "signals", "events", "io", "formats", "workbooks", "streams", "stacks", "archives")


def _all(kind: str) -> dict:
    found: dict = {}
    for name in MODULES:
        part = getattr(import_module(f"lodestream.plans.{name}"), kind)
        clash = found.keys() & part.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        found.update(part)
    return found


def queries() -> dict:
    return _all("QUERIES")


def oracles() -> dict:
    return _all("ORACLES")
