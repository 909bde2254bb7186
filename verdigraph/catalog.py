"""Every registered query of the library and its SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from verdigraph.plans import registry


def _load() -> None:
    import importlib
    import pkgutil

    from verdigraph import plans

    for module in pkgutil.iter_modules(plans.__path__):
        importlib.import_module(f"verdigraph.plans.{module.name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(registry.ORACLES)
