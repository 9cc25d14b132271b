"""Sales lines move without what can be added after, and lines of other ledgers as bare marks."""

from datetime import datetime

from pyspark.sql import functions as F

from merchantry.plans import facts_sales as fs, staging_crm as crm
from merchantry.plans.checks import Checks, run_checks
from merchantry.plans.staging_stock import LOADED_AT, newest
from merchantry.sources.catalog import Catalog
from tests.conftest import rows
from tests.test_written_facts import ITEMS, LEDGERS, LINES, ORDERS

OLD, NEW = datetime(2024, 1, 1), datetime(2024, 2, 1)
RAW = [
    ("t1", "L1", 1.0, OLD), ("t1", "L1", 2.0, NEW), ("t1", "L1", 9.0, None),
    ("t2", "L1", 1.0, OLD), ("t2", "L2", 2.0, NEW),  # left the wanted ledger
    ("t3", "L2", 1.0, OLD), ("t3", "L1", 2.0, NEW),  # came to it
    ("t4", None, 1.0, NEW), ("t5", "L1", None, None), ("t6", "L2", 1.0, NEW),
    ("t7", "L1", 1.0, NEW), ("t7", "L2", 1.0, NEW), ("t8", "L1", 5.0, NEW), ("t8", "L1", 6.0, NEW),  # told apart by a digest
    (None, "L1", 3.0, OLD), (None, "L1", 4.0, NEW),
]


def _raw(spark):
    return spark.createDataFrame(RAW, f"id string, Ledger string, v double, {LOADED_AT} timestamp").repartition(3)


def test_newest_of_chosen_values_ranks_all_loads(spark):
    raw = _raw(spark)
    whole = newest(raw, "id", ["ledger", "v"])
    for ids in ([("L1",)], [("L2",), ("L7",)], []):
        wanted = spark.createDataFrame(ids, "k string")
        got = newest(raw, "id", ["ledger", "v"], ("ledger", wanted))
        assert got.columns == whole.columns
        assert rows(got) == rows(whole.filter(F.col("Ledger").isin(*[k for (k,) in ids])) if ids else whole.limit(0))


def test_lines_of_chosen_ledgers(spark):
    made = {c: F.lit(None).cast("string") for c in crm.renames("sales_transactions").values()}
    raw = _raw(spark).withColumnRenamed("Ledger", "ledger").withColumn("linevalue", F.col("v"))
    raw = raw.withColumns({c: v for c, v in made.items() if c not in raw.columns})
    ids = spark.createDataFrame([("L1",)], "sales_ledger_id string")
    whole = crm.sales_transactions(raw).filter("sales_ledger_id = 'L1'")
    assert rows(crm.sales_transactions(raw, ids)) == rows(whole) and whole.count() >= 4


def _padded(spark, made, ddl):
    return spark.createDataFrame([(*r, *[None] * (ddl.count(",") + 1 - len(r))) for r in made], ddl)


def test_terms_of_ledgers_do_not_move_with_lines(spark, monkeypatch):
    lines = _padded(spark, [("t1", "L1", "O1", "P1"), ("t2", "L2", "O1", None), ("t3", None, None, "P1"), ("t5", "L5", "O9", "P1")], LINES)
    ledgers = spark.createDataFrame(
        [("L1", "a", "N1", 1.0, False), ("L2", "b", "N1", 1.0, True), ("L5", "d", "N2", 1.0, False), ("L5", "e", "N2", 1.0, False)], LEDGERS
    )
    orders, items = _padded(spark, [("O1", datetime(2024, 1, 5))], ORDERS), _padded(spark, [("P1", "s", "text")], ITEMS)
    traded, asked = lines.select("sales_ledger_id"), []

    def of_ledgers(ids):
        asked.append(rows(ids))
        return lines.join(ids, ["sales_ledger_id"], "left_semi")

    few = fs.fct_b2b_sales(ledgers, lines, orders, items, traded, of_ledgers)
    assert asked == [[("L1",), ("L5",)]]
    joins = [line for line in few._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in line]
    assert "Inner" in joins[0] and "LeftOuter" in joins[1] and "LeftOuter" in joins[2]
    monkeypatch.setattr(fs, "FEW_LEDGERS", 1)
    many = fs.fct_b2b_sales(ledgers, lines, orders, items, traded, of_ledgers)
    whole = fs.fct_b2b_sales(ledgers, lines, orders, items)
    assert len(asked) == 1 and few.columns == many.columns == whole.columns
    assert rows(few) == rows(many) == rows(whole) and len(rows(few)) == 3


def test_revenue_is_worked_out_after_lines_moved(spark):
    lines = spark.createDataFrame(
        [(1, 10, 7, 8, "x", "s", 2, 1.5, None, "a"), (2, 10, 7, 8, "x", "s", None, 1.5, False, "a"), (3, 11, 7, 8, "x", "s", 1, 1.0, True, "a")],
        "line_item_id long, order_id long, product_id long, variant_id long, product_title string, sku string, quantity long, "
        "unit_price_gbp double, is_gift_card boolean, store_id string",
    )
    orders = spark.createDataFrame(
        [(10, "a", 5, None, None, "paid", 1, None, "GB")],
        "order_id long, store_id string, customer_id long, order_month date, created_at timestamp, financial_status string, "
        "is_first_order int, uk_region string, shipping_country_code string",
    )
    sold = fs.fct_product_sales(lines, orders)
    plan = sold._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("line_revenue_gbp") < plan.index("Join ") and plan.count("AS line_revenue_gbp") == 1
    assert plan.rindex("AS line_revenue_gbp") < plan.index("Join ")
    assert sold.columns.index("line_revenue_gbp") == sold.columns.index("unit_price_gbp") + 1
    assert rows(sold, "line_item_id", "line_revenue_gbp", "financial_status") == [(1, 3.0, "paid"), (2, None, "paid")]


def test_a_catalogue_gives_streams_where_it_has_them(spark):
    key = ("a", "b", None)
    made = Catalog(spark, frames={key: lambda: spark.range(2), ("a", "c", None): lambda: spark.range(4)}, streams={key: lambda: spark.range(3)})
    assert made.source("a", "b").count() == 2 and made.streamed("a", "b").count() == 3 and made.streamed("a", "c").count() == 4


def test_whole_numbers_are_checked_as_they_are(spark):
    made = [(1, "a"), (1, "a"), (2, "b"), (0, None), (0, "c"), (-1, "c"), (None, "d"), (None, "e"), (2**31 - 1, "f")]
    df = spark.createDataFrame(made, "k int, t string")
    for kind in ("int", "long"):
        checked = run_checks(df.withColumn("k", F.col("k").cast(kind)), "x", Checks("k t", "k t", "k", {}, ("k", "t")))
        assert rows(checked, "check_name", "column_name", "failures") == [
            ("accepted_range", "k", 1), ("not_null", "k", 2), ("not_null", "t", 1), ("unique", "k", 2), ("unique", "t", 2), ("unique_combination", "k,t", 1),
        ]
    one = run_checks(df, "x", Checks("", "k"))._jdf.queryExecution().analyzed().toString()
    assert "xxhash64" not in one and "xxhash64" in run_checks(df, "x", Checks("", "t"))._jdf.queryExecution().analyzed().toString()
