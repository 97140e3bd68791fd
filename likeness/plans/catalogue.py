"""All registered queries: name -> plan, and name -> oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]
_PLANS: dict[str, Plan] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan under its function's name, with the SQL that gives the same rows."""

    def add(f: Plan) -> Plan:
        key = name or f.__name__
        if key in _PLANS:
            raise ValueError(f"{key} is registered twice")
        _PLANS[key] = f
        if sql:
            _SQL[key] = sql
        return f

    return add


def _loaded() -> None:
    from likeness.plans import checks, evaluation, identities, pictures, rasters, requests, vectors  # noqa: F401  they register their queries


def queries() -> dict[str, Plan]:
    _loaded()
    return dict(_PLANS)


def oracle_sql() -> dict[str, str]:
    _loaded()
    return dict(_SQL)
