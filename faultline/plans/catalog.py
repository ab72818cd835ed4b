"""All registered queries. Importing the modules below fills the registry."""

from __future__ import annotations

import importlib

from faultline.plans import registry

MODULES = (
    "scans",
    "windows",
    "traces",
    "series",
    "scores",
    "causal",
    "rankings",
    "evaluate",
    "events",
    "learning",
    "streams",
    "incident_report",
)


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"faultline.plans.{module}")


def queries():
    _load()
    return {name: registry.bind(name) for name in registry.QUERIES}


def oracle_sql():
    _load()
    return dict(registry.SQL)
