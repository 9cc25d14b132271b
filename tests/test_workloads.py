"""The registered queries against their SQL on the smallest tables."""

import importlib
import math

import duckdb
import pytest

from merchantry.plans.warehouse import FACTS, MODELS
from merchantry.workloads import queries as workloads, reports

entry = importlib.import_module("__spark_entry__")
QUERIES, SQL = entry.queries(), entry.oracle_sql()
TABLES = "region nation customer supplier part orders lineitem events".split()
SAMPLE = [
    *FACTS, "stg_klaviyo__events", "stg_shopify__orders", "stg_cin7__customer_addresses", "stg_prospect_crm__contacts",
    "latest_line_per_key", "last_touch_5d", "part_pairs", "order_seq_per_customer", "spine_nation_month", "json_path_props",
    "contamination_audit", "quality_report", "pivot_month_status", "scalar_text", "scalar_dates_numbers",
    "metrics_fct_orders", "metrics_fct_ga_sessions", "metrics_dim_customer_unified", "chart_customer_mix_aov_split", "chart_gross_sales",
    "chart_return_order_rate_cin7_by_channel", "chart_cross_brand_month", "checks_facts_marketing", "stream_last_touch",
    "stream_first_per_order", "stream_daily_counts", "incremental_append", "contamination_purge_store", "alias_scan", "registered_views",
    "report_combined_orders", "report_customer_mix_aov_split", "report_paid_search_shopping", "report_primary_attribution_sankey",
]


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


def norm(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return str(value)


def table(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(norm(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_agrees_with_sql(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    cursor = duck.execute(SQL[name])
    want = table([c[0] for c in cursor.description], cursor.fetchall())
    assert got == want
    assert got[1]


def test_every_query_has_sql():
    assert set(workloads.oracle_sql()) == set(workloads.queries())
    assert set(SQL) <= set(QUERIES)
    assert set(MODELS) <= set(QUERIES)
    assert sum(n.startswith("chart_") for n in QUERIES) == 101
    assert sum(n.startswith("report_") for n in QUERIES) == 29


def test_entry(spark, small):
    df = entry.entry(spark)
    assert df.columns == ["store_id", "order_month", "total_revenue", "order_count"] and df.count() > 0


def test_invariants(spark, small):
    from pyspark.sql import functions as F

    house = reports.written(spark, small)
    credited, orders = house.table("fct_klaviyo_revenue"), house.table("stg_klaviyo__placed_orders")
    assert credited.join(orders, "event_id", "left_anti").count() == 0
    whole = credited.agg(F.sum("revenue")).collect()[0][0]
    parts = sum(house.table(t).agg(F.sum("revenue")).collect()[0][0] for t in ("fct_klaviyo_campaign_revenue", "fct_klaviyo_flow_revenue"))
    assert whole == pytest.approx(parts)
    by_channel = house.table("fct_ga_channel_sessions").agg(F.sum("sessions")).collect()[0][0]
    assert by_channel == house.table("fct_ga_sessions").agg(F.sum("sessions")).collect()[0][0]
    assert house.table("fct_orders").filter("gross_sales < net_sales - 0.005").count() == 0


def test_tables_can_be_written_again(spark, small, tmp_path):
    from merchantry.sources.loads import read_current
    from merchantry.workloads import exports

    house = reports.Warehouse(spark, exports.catalog(spark, small), exports.SETTINGS)
    lazy = house.table("fct_klaviyo_subscriber_growth").count()
    for _ in range(2):
        house.materialize("fct_klaviyo_subscriber_growth", str(tmp_path), ("order_month",))
    assert house.view("fct_klaviyo_subscriber_growth").count() == lazy
    assert spark.sql("select * from fct_klaviyo_subscriber_growth").count() == lazy
    root = f"{tmp_path}/fct_klaviyo_subscriber_growth"
    assert read_current(spark, root).count() == lazy and "version" not in read_current(spark, root).columns


def test_models_compare_all_of_their_columns(spark, small):
    house = workloads.warehouse(spark, small)
    for name in MODELS:
        compared = [c.rpartition(":")[2] for c in workloads.oracle.COLUMNS[name].split()]
        assert sorted(compared) == sorted(house.table(name).columns), name
