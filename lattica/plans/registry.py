"""Collects the queries of all plan modules: a function of (spark, sf_dir) and, where SQL can say it, its oracle."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
MODULES = ("graph", "statistics", "relational", "texts", "review", "models", "extras", "recovery", "vocabulary", "replicates")


def query(name: str, sql: str | None = None):
    """Registers the decorated function under ``name``."""

    def wrap(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return wrap


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"lattica.plans.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open triangles of the part hypergraph over all orders, at least two joint orders per pair."""
    from ..operators import hypergraph as H
    from .bindings import incidence

    edges = H.hyperedges(incidence(spark, sf_dir, "part", window=None))
    stable = H.supported_pairs(H.pair_counts(edges), 2)
    return H.open_triangles(stable, H.closed_triads(edges, stable), keep_all_tasks=True)
