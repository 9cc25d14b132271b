"""Written facts are compressed by zstd, and business lines meet only the ledgers that lines name."""

from merchantry.plans import facts_sales as fs
from merchantry.sources import loads
from tests.conftest import rows

LINES = (
    "transaction_id string, sales_ledger_id string, order_number string, product_item_id string, ordered_at timestamp, invoice_number long, "
    "product_description string, qty_ordered double, qty_invoiced double, qty_delivered double, line_value double, gross_value double, "
    "cost_value double, cost_price double, margin_value double, margin_percent double, discount_rate double, currency_code string, "
    "transaction_type string, warehouse_code string, transacted_at timestamp, transaction_month date, invoiced_at timestamp, delivered_at timestamp"
)
ORDERS = "order_number string, ordered_at timestamp, order_month date, platform string, source_channel string, order_status string, delivery_country string, delivery_postcode string"
ITEMS = "product_item_id string, sku string, description string, manufacturer string, category_id string, product_family_id long, product_type string"
LEDGERS = "sales_ledger_id string, customer_name string, country string, credit_limit double, is_b2c boolean"


def test_facts_are_written_with_zstd(spark, tmp_path):
    path = loads.full_refresh(spark.range(100).toDF("k"), str(tmp_path / "fact"))
    read = spark.read.parquet(path)
    assert read.count() == 100 and all(f.endswith(".zstd.parquet") for f in read.inputFiles())


def test_business_lines_do_not_move_to_meet_ledgers(spark):
    padded = lambda made, ddl: spark.createDataFrame([(*r, *[None] * (ddl.count(",") + 1 - len(r))) for r in made], ddl)
    lines = padded([("t1", "L1", "O1", "P1"), ("t2", "L2", "O1", None), ("t3", None, None, "P1"), ("t4", "L3", None, None), ("t5", "L5", "O9", "P1"), (None, "L1", "O1", "P9")], LINES)
    ledgers = spark.createDataFrame(
        [("L1", "a", "N1", 1.0, False), ("L2", "b", "N1", 1.0, True), ("L3", "c", None, 2.0, None), ("L4", "never traded", "N1", 1.0, False), ("L5", "d", "N2", 1.0, False), ("L5", "e", "N2", 1.0, False), (None, "f", "N1", 1.0, False)],
        LEDGERS,
    )
    orders, items = padded([("O1",)], ORDERS), padded([("P1", "s")], ITEMS)
    stale = spark.createDataFrame([("L7",)], "sales_ledger_id string")  # of an older load
    sales = fs.fct_b2b_sales(ledgers, lines, orders, items, lines.select("sales_ledger_id").union(stale))
    (held,) = {f.rpartition("/")[0] for f in sales.inputFiles() if "/business-" in f}
    assert rows(spark.read.parquet(held), "customer_name") == [("a",), ("d",), ("e",)]
    whole = fs.fct_b2b_sales(ledgers, lines, orders, items)
    assert rows(sales) == rows(whole) and sales.columns == whole.columns and len(rows(sales)) == 4
