"""The registered queries of the annotation operators, and their SQL."""

from __future__ import annotations

import importlib

from . import registry

MODULES = ("composition", "expression_queries", "evaluation_queries", "graph_queries", "review_queries", "table_queries", "report_queries")


def queries():
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    return registry.QUERIES


def oracles():
    queries()
    return registry.ORACLES
