"""Registered queries and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from merchantry.plans.semantic import MetricQuery
from merchantry.plans.warehouse import MODELS, Warehouse
from merchantry.session import prepare
from merchantry.workloads import building_blocks as blocks, exports, oracle, reports
from merchantry.workloads.present import present

Query = Callable[[SparkSession, str], DataFrame]


_OPEN: dict[tuple[str, int, str], Warehouse] = {}


def warehouse(spark: SparkSession, folder: str) -> Warehouse:
    """Lazy tables over a folder; their plans (no rows) are kept for the session."""
    key = (spark.sparkContext.applicationId, id(spark), folder)
    if key not in _OPEN:
        _OPEN[key] = Warehouse(prepare(spark), exports.catalog(spark, folder), exports.SETTINGS)
    return _OPEN[key]


def forget() -> None:
    """Build all facts anew from here on: running numbers and last touches run a job when they are built."""
    for house in _OPEN.values():
        house.forget_facts()


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    query = MetricQuery(
        "fct_orders", ("store_id", "order_month"), ("total_revenue", "order_count"), sort=("order_month", False)
    )
    return present(warehouse(spark, folder).query(query))


def _model(name: str) -> Query:
    return lambda spark, folder: present(warehouse(spark, folder).table(name))


def queries() -> dict[str, Query]:
    return {**{name: _model(name) for name in MODELS}, **blocks.BLOCKS, **reports.queries()}


def oracle_sql() -> dict[str, str]:
    return {**{name: oracle.table_sql(name) for name in MODELS}, **blocks.SQL, **reports.oracle_sql()}
