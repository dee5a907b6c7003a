"""Name -> query and name -> DuckDB text, filled by the modules listed in MODULES."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

MODULES: tuple[str, ...] = (
    "stepfree.operators.filters",
    "stepfree.operators.risk",
    "stepfree.operators.reports",
    "stepfree.operators.evaluation",
    "stepfree.operators.scalars",
    "stepfree.operators.graph",
    "stepfree.operators.hierarchy",
    "stepfree.operators.profiles",
    "stepfree.operators.intake",
    "stepfree.operators.places",
    "stepfree.operators.shardstats",
    "stepfree.operators.tiers",
    "stepfree.operators.assist",
    "stepfree.operators.mesh",
    "stepfree.streaming.jobs",
    "stepfree.streaming.jobstate",
    "stepfree.streaming.ingest",
    "stepfree.streaming.snapshot",
    "stepfree.sources.osm",
    "stepfree.sources.tables",
    "stepfree.sources.artifacts",
    "stepfree.sources.mvt",
)

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a function of (spark, sf_dir) under ``name``, with its DuckDB text if there is one."""

    def add(fn: Query) -> Query:
        if _QUERIES.get(name, fn) is not fn:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = fn
        if oracle is not None:
            _ORACLES[name] = oracle
        return fn

    return add


def _load() -> None:
    for module in MODULES:
        import_module(module)


def all_queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def all_oracles() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
