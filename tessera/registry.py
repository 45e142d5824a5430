"""Every query of the engine by name, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function of a table reader t as the query `name`, with its SQL."""

    def add(f: Callable) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _load() -> None:
    from tessera.plans import aggregates, documents, evaluation, filters, lifecycle, packing, passages, relational, resolution, retrieval, stores, streams, views  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["r7_hybrid_retrieval"](spark, sf_dir)
