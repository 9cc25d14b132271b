"""Lines move once on their way to buyers, and repeat buyers are still those with two different orders."""

from merchantry.plans import facts_sales as fs
from tests.conftest import rows

SCHEMA = "product_id long, store_id string, customer_id long, order_id long, product_title string"
LINES = [
    (1, "a", 5, 10, "x"), (1, "a", 5, 10, "y"),  # one order, two lines
    (1, "a", 6, 10, "x"), (1, "a", 6, 11, None), (1, "a", 6, None, "z"),
    (1, "a", 7, None, "x"), (1, "a", 7, 12, "x"),  # an order without an id is none
    (1, "a", None, 13, "zz"), (1, "a", None, 14, "x"),  # guests give the title alone
    (2, None, 5, 15, None), (2, None, 5, 16, None),
    (3, "a", None, 17, "guests"), (None, "a", 5, 18, "x"),
]


def test_repeat_buyers_have_two_orders(spark):
    repeat = fs.fct_product_repeat_rate(spark.createDataFrame(LINES, SCHEMA))
    assert rows(repeat, "product_id", "store_id", "product_title", "unique_buyers", "repeat_buyers") == [
        (1, "a", "zz", 3, 1), (2, None, None, 1, 1),
    ]


def test_lines_are_shuffled_twice_not_thrice(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = fs.fct_product_repeat_rate(spark.createDataFrame(LINES, SCHEMA))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange") == 2
