"""Named queries: a Spark plan and, where SQL can say it, the same result as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.plans.sqlviews import with_views
from ledgerloom.session import prepare
from ledgerloom.sources.fixtures import Fixtures

_PLANS: dict[str, Callable[[Fixtures], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, needs: tuple[str, ...] | list[str] = ()):
    def register(plan: Callable[[Fixtures], DataFrame]):
        if name in _PLANS:
            raise ValueError(f"query {name} registered twice")
        _PLANS[name] = plan
        if sql is not None:
            _SQL[name] = with_views(list(needs), sql)
        return plan
    return register


def _load() -> None:
    import importlib

    for module in ("basics", "functions", "ingest", "matching", "posting", "pages", "personal", "reports", "streams"):
        importlib.import_module(f"ledgerloom.plans.{module}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()

    def runner(plan):
        return lambda spark, sf_dir: plan(Fixtures(prepare(spark), sf_dir))

    return {name: runner(plan) for name, plan in _PLANS.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
