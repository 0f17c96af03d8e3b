"""Every operator as a query over the given tables."""

from __future__ import annotations

import importlib

from sluice.plans.registry import ORACLES, QUERIES, SURVEY_IDS

_MODULES = ["ingest", "dashboards", "rolling", "mining", "scoring", "live"]


def _load() -> None:
    for name in _MODULES:
        importlib.import_module(f"sluice.plans.{name}")


def queries():
    _load()
    return dict(QUERIES)


def oracle_sql():
    _load()
    return dict(ORACLES)


def survey_ids():
    _load()
    return dict(SURVEY_IDS)
