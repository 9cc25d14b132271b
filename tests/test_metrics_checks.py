import os
from datetime import date

import pytest
from pyspark.sql import functions as F

from merchantry import Settings, Store
from merchantry.plans import charts, checks, metrics
from merchantry.sources import sinks
from merchantry.plans.semantic import Calc, Explore, Filter, MetricQuery, metric_query
from tests.conftest import rows

FACT = Explore("t", {"n": "count(1)", "v": "sum(v)", "rate": "sum(v) / nullif(sum(w), 0)"}, {"kind": lambda: F.upper("k")})


@pytest.fixture(scope="module")
def fact(spark):
    data = [("a", date(2024, 1, 1), 1.0, 2), ("a", date(2024, 2, 1), 2.0, 0), ("b", date(2024, 3, 1), 3.0, 1), (None, date(2024, 3, 1), 4.0, 1)]
    return spark.createDataFrame(data, "k string, m date, v double, w int")


def ask(fact, *args, as_of=date(2024, 3, 15), **kw):
    return metric_query(fact, FACT, MetricQuery("t", *args, **kw), as_of)


@pytest.mark.parametrize(
    "f, total",
    [(Filter("kind", "equals", ("A",)), 3.0), (Filter("kind", "equals", ("A", "B")), 6.0), (Filter("kind", "notEquals", ("A",)), 7.0),
     (Filter("kind", "isNull"), 4.0), (Filter("kind", "isNotNull"), 6.0), (Filter("m", "inThePast", (2,)), 9.0),
     (Filter("m", "inBetween", ("2024-01-01", "2024-02-01")), 3.0)],
)
def test_filters(fact, f, total):
    assert ask(fact, (), ("v",), (f,)).collect()[0].v == total


def test_unknown_filter(fact):
    with pytest.raises(ValueError):
        ask(fact, (), ("v",), (Filter("kind", "like", ("A",)),))


def test_group_sort_limit_and_calcs(fact):
    got = ask(fact, ("kind",), ("v", "n", "rate"), sort=("v", True), limit=2, calcs=(Calc("pct", "share", "v"), Calc("per", "ratio", "v", "n"), Calc("rest", "complement", "n", "v")))
    out = [tuple(r) for r in got.collect()]
    assert [r[0] for r in out] == [None, "A"]
    assert out[1] == ("A", 3.0, 2, 1.5, 0.3, 1.5, 1 - 2 / 3.0)


def test_dimension_only_and_pivot(fact):
    assert rows(ask(fact, ("kind",))) == [("A",), ("B",), (None,)]
    wide = ask(fact, ("m", "kind"), ("v",), sort=("m", False), pivot=("kind", ("A", "B")))
    assert wide.columns[:3] == ["m", "A", "B"] and set(wide.columns[3:]) <= {"no_kind"}
    assert rows(wide, "m", "A", "B") == [(date(2024, 1, 1), 1.0, None), (date(2024, 2, 1), 2.0, None), (date(2024, 3, 1), None, 3.0)]
    # values that nobody listed have their columns too
    assert ask(fact, ("m", "kind"), ("v",), pivot=("kind", ("B",))).columns == ["m", "B", "A", *wide.columns[3:]]
    assert ask(fact, ("m", "kind"), ("v",), pivot=("kind", ("Z", "B", "A"))).columns == ["m", "Z", "B", "A", *wide.columns[3:]]


def test_top_k_plan(fact):
    plan = ask(fact, ("kind",), ("v",), sort=("v", True), limit=2)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_catalogue_is_complete():
    settings = Settings()
    every = metrics.explores(settings)
    assert sum(len(e.metrics) for e in every.values()) == 108
    listed = charts.charts(settings)
    assert len(listed) == 101
    for query in listed.values():
        assert set(query.metrics) <= set(every[query.explore].metrics)
    assert sum(c.count() for c in checks.DECLARED.values()) == 190


def test_store_names_come_from_settings(tmp_path):
    path = tmp_path / "deployment.json"
    path.write_text('{"stores": [{"store_id": "north", "label": "North Shop"}, {"store_id": "south", "label": "South"}], "brand_terms": ["acme"], "refund_stores": ["north"]}')
    settings = Settings.from_json(os.fspath(path))
    listed = charts.charts(settings)
    assert listed["primary-aov"].filters[0].values == ("North Shop",)
    assert listed["ad-spend"].filters[0].values == ("north",)
    assert "seen_in_shopify_south" in listed["top-individual-leads"].dims
    assert "total_north_spend" in metrics.explores(settings)["dim_customer_unified"].metrics
    assert settings.primary == Store("north", "North Shop")


def test_report_filter_is_remapped():
    report = charts.monthly_report(Settings(), "2026-04-01", "2026-04-30")
    assert report["primary-crm-open-rate"].filters[-1].field == "send_month"
    assert report["meta-spend"].filters[-1] == Filter("order_month", "inBetween", ("2026-04-01", "2026-04-30"))
    assert len(charts.attribution_report(Settings(), "2026-04-01", "2026-04-30")) == 1


def test_kpi_windows(spark):
    days = [date(2024, 1, 31), date(2024, 1, 1), date(2023, 12, 31), date(2023, 12, 2), date(2023, 12, 1)]
    df = spark.createDataFrame([(d, "alpha", 1.0, 1.0, 1, 1, 2.0, 4) for d in days],
                               "date date, store_id string, gross_sales double, net_sales double, orders bigint, new_customer_orders bigint, ad_spend double, sessions bigint")
    explore = metrics.explores(Settings(), date(2024, 1, 31))["fct_marketing_kpis_daily"]
    got = metric_query(df, explore, MetricQuery(explore.table, (), ("orders_l30d", "orders_p30d", "blended_roas_l30d", "conversion_rate_p30d"))).collect()[0]
    assert tuple(got) == (2, 2, 0.5, 0.25)


def test_checks(spark):
    df = spark.createDataFrame([(1, "x", -1.0), (1, "y", 2.0), (None, "z", None), (None, "x", 0.0)], "id int, kind string, v double")
    declared = checks.Checks("id kind", "id", "v", {"kind": ("x", "y")}, ("id", "kind"))
    got = checks.run_checks(df, "t", declared)
    assert rows(got, "check_name", "column_name", "failures") == [
        ("accepted_range", "v", 1), ("accepted_values", "kind", 1), ("not_null", "id", 2), ("not_null", "kind", 0), ("unique", "id", 1),
        ("unique_combination", "id,kind", 0),
    ]
    assert declared.count() == 6


def test_displayed_values_filter_the_stored_column(spark, tmp_path):
    data = [("alpha", date(2024, 1, 1), 1), ("beta", date(2024, 2, 1), 2), ("gamma", date(2024, 2, 1), 4), (None, None, 8)]
    df = spark.createDataFrame(data, "store_id string, order_month date, sessions long")
    sinks.write_table(df, f"{tmp_path}/t", ("order_month",))
    table = spark.read.parquet(f"{tmp_path}/t")
    explore = metrics.explores(Settings())["fct_ga_sessions"]

    def total(*filters):
        query = MetricQuery(explore.table, (), ("total_ga_sessions",), tuple(filters))
        out = metric_query(table, explore, query)
        return out.collect()[0][0], out._jdf.queryExecution().executedPlan().toString()

    assert total(Filter("store_id", "equals", ("Alpha Store",)))[0] == 1
    assert total(Filter("store_id", "equals", ("gamma", "Beta Store")))[0] == 6
    assert total(Filter("store_id", "equals", ("alpha",)))[0] is None  # shown under its label only
    assert total(Filter("store_id", "notEquals", ("Alpha Store",)))[0] == 14
    got, plan = total(Filter("order_month_label", "equals", ("2024-02", "not a month")), Filter("store_id", "equals", ("Beta Store",)))
    assert got == 2
    assert "PushedFilters: [In(store_id" in plan and "PartitionFilters: [isnotnull(order_month" in plan


def test_all_checks_of_a_table_read_it_once(spark, tmp_path):
    spark.createDataFrame([(1, "a", None, -1.0), (1, "b", "x", 2.0), (2, "b", "y", 3.0), (None, "c", "y", None)], "k int, s string, t string, v double").write.parquet(f"{tmp_path}/t")
    table = spark.read.parquet(f"{tmp_path}/t")
    got = checks.run_checks(table, "t", checks.Checks("k t", "k s", "v", {"s": ("a", "b")}, ("s", "t")))
    assert rows(got, "check_name", "column_name", "failures") == [
        ("accepted_range", "v", 1), ("accepted_values", "s", 1), ("not_null", "k", 1), ("not_null", "t", 1), ("unique", "k", 1), ("unique", "s", 1), ("unique_combination", "s,t", 0),
    ]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Expand") == 0
    assert checks.run_checks(table, "t", checks.Checks()).count() == 0


def test_several_distinct_counts_without_row_expansion(spark):
    data = [("x", 1, "p", 1.0), ("x", 1, "q", 2.0), ("x", None, "q", 3.0), (None, 2, None, 4.0), ("y", None, None, None)]
    df = spark.createDataFrame(data, "d string, a int, b string, v double")
    explore = Explore("t", {"as": "count(distinct a)", "bs": "count(distinct b)", "v": "sum(v)", "m": "avg(v)"}, {"d": lambda: F.col("d")})
    got = metric_query(df, explore, MetricQuery("t", ("d",), ("as", "bs", "v", "m"), sort=("d", False)))
    want = df.groupBy("d").agg(F.count_distinct("a").alias("as"), F.count_distinct("b").alias("bs"), F.sum("v").alias("v"), F.avg("v").alias("m"))
    assert got.columns == want.columns and rows(got) == rows(want)
    assert "Expand" not in got._jdf.queryExecution().executedPlan().toString()
    assert rows(metric_query(df, explore, MetricQuery("t", (), ("as", "bs", "v")))) == [(2, 2, 10.0)]
    assert rows(metric_query(df, explore, MetricQuery("t", (), ("bs", "as")))) == [(2, 2)]
    assert rows(metric_query(df.limit(0), explore, MetricQuery("t", (), ("as", "bs", "v")))) == [(0, 0, None)]
    assert rows(metric_query(df.limit(0), explore, MetricQuery("t", ("d",), ("as", "bs")))) == []
