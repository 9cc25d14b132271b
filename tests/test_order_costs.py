"""What a row of the order and spend facts costs: one sort of an order, one walk of an array, no move of rows that are streamed."""

from pyspark.sql import functions as F

from merchantry.operators import combine
from merchantry.plans import facts_sales as fs
from merchantry.workloads import exports
from tests.conftest import rows

ORDERS = (
    "order_id long, store_id string, customer_id long, created_at timestamp, created_date date, "
    "total_price double, subtotal_price double, total_discounts double"
)
REFUNDS = "order_id long, store_id string, refund_amount double, refund_subtotal double"


def _orders(spark):
    made = [
        (1, "a", 5, "2024-01-02"), (1, "a", 6, "2024-01-01"), (1, "a", 6, "2024-01-01"),  # landed thrice, by two customers
        (1, "b", 5, "2024-01-03"), (2, "a", 5, "2024-01-01"), (3, "a", 7, None), (4, "a", None, "2024-01-05"),
        (None, "a", 8, "2024-01-01"), (5, None, 9, "2024-01-01"), (6, "a", 10, "2024-01-01"), (6, "a", 10, None),
    ]
    typed = spark.createDataFrame([(*r, 10.0, 8.0, 2.0) for r in made], ORDERS.replace("created_at timestamp, created_date date", "at string"))
    return typed.withColumns({"created_at": F.col("at").cast("timestamp"), "created_date": F.col("at").cast("date")}).drop("at")


def test_orders_are_sorted_once(spark):
    refunds = spark.createDataFrame([(1, "a", 3.0, 2.0), (6, "a", 1.0, 1.0), (9, "a", 1.0, 1.0)], REFUNDS)
    limits = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in limits}
    for k, v in limits.items():
        spark.conf.set(k, v)
    try:
        facts = fs.fct_orders(_orders(spark), refunds)
        plan = facts._jdf.queryExecution().executedPlan().toString()
        found = rows(facts, "order_id", "store_id", "customer_id", F.col("created_at").cast("string"), "is_first_order", "refund_amount")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum("Sort [order_id" in line for line in plan.splitlines()) == 2  # the orders, and what joins them
    at = lambda day: f"2024-01-0{day} 00:00:00"
    marked = [r for r in found if r[4] == 1]
    assert sorted(r[:2] for r in marked) == [(1, "a"), (2, "a"), (3, "a"), (4, "a"), (6, "a")]
    assert (1, "a", 6, at(1), 1, 3.0) in marked and (6, "a", 10, at(1), 1, 1.0) in marked
    assert len(found) == 11 and sum(r[5] for r in found) == 3 * 3.0 + 2 * 1.0


def test_an_array_is_walked_once(spark):
    df = spark.createDataFrame(
        [(1, [("p", "1.5"), ("q", "9"), ("p", None), ("p", "2")]), (2, []), (3, None), (4, [None, ("p", "x"), (None, "4")])],
        "k int, a array<struct<k string, v string>>",
    )
    value = lambda e: e.v.try_cast("double")
    chosen = combine.sum_elements(F.col("a"), lambda e: e.k == "p", value)
    summed = df.select("k", chosen.alias("chosen"), combine.sum_elements(F.col("a"), None, value).alias("all"))
    assert rows(summed) == [(1, 3.5, 12.5), (2, 0.0, 0.0), (3, 0.0, 0.0), (4, 0.0, 4.0)]
    text = summed._jdf.queryExecution().analyzed().toString()
    assert "transform(" not in text and "filter(" not in text


def test_streamed_rows_do_not_move(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(exports, "PIECE_ROWS", 100)
    cores = spark.sparkContext.defaultParallelism
    shuffled = lambda path, **how: "Repartition" in exports.read_spread(spark, str(path), **how)._jdf.queryExecution().toString()
    even, lone, lopsided = tmp_path / "even", tmp_path / "lone", tmp_path / "lopsided"
    spark.conf.set("spark.sql.files.openCostInBytes", "128MB")  # a piece per file
    try:
        spark.range(0, 2000 * cores, 1, cores).toDF("k").write.parquet(str(even))
        spark.range(0, 2000, 1, 1).toDF("k").write.parquet(str(lone))
        for _ in range(2):
            spark.range(0, 10 * cores, 1, cores).toDF("k").write.mode("append").parquet(str(lopsided))
        spark.range(0, 5000, 1, 1).toDF("k").write.mode("append").parquet(str(lopsided))
        assert shuffled(even) and not shuffled(even, streamed=True)
        assert shuffled(lone, streamed=True) and shuffled(lopsided, streamed=True)
        assert exports.read_spread(spark, str(lopsided), streamed=True).count() == 5000 + 20 * cores
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
