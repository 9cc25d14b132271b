"""What a write shuffled leaves the disk with it, and business lines are written between their moves."""

import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from merchantry import Settings
from merchantry.plans import facts_sales as fs, staging_crm as crm
from merchantry.plans.warehouse import Warehouse
from merchantry.sources import loads, sinks
from merchantry.sources.catalog import Catalog
from tests.conftest import rows
from tests.test_written_facts import ITEMS, LEDGERS, LINES, ORDERS


def _shuffled(spark):
    held = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {b for b in held.mkString(" ").split() if b.startswith("shuffle_") and b.endswith("_0.data")}


def _left(spark, before):
    until = time.time() + 20
    while (left := _shuffled(spark) - before) and time.time() < until:
        time.sleep(0.2)  # files are deleted in the background
    return left


@pytest.mark.parametrize("given", [None, "false", "true"])
def test_what_a_write_shuffled_leaves_the_disk(spark, tmp_path, given):
    if given:
        spark.conf.set(sinks.FREED, given)
    moved = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    before = _shuffled(spark)
    kept = sinks.scratch(moved, "counted")
    path = loads.full_refresh(moved, str(tmp_path / "fact"))
    assert _left(spark, before) == set()
    assert rows(kept) == rows(spark.read.parquet(path)) == rows(moved) and kept.count() == 7
    assert all(f.endswith(".zstd.parquet") for f in kept.inputFiles())
    assert spark.conf.get(sinks.FREED, None) == given
    with pytest.raises(ZeroDivisionError), sinks.moves_freed(spark):
        assert spark.conf.get(sinks.FREED) == "true" and 1 / 0
    assert spark.conf.get(sinks.FREED, None) == given
    spark.conf.unset(sinks.FREED)


def _padded(spark, made, ddl):
    return spark.createDataFrame([(*r, *[None] * (ddl.count(",") + 1 - len(r))) for r in made], ddl)


def test_business_lines_are_written_between_their_moves(spark, monkeypatch):
    at = datetime(2024, 1, 5)
    lines = _padded(
        spark,
        [("t1", "L1", "O1", "P1", None), ("t1", "L1", "O1", "P1", None), ("t2", "L2", "O1", None, None), ("t3", None, None, "P1", None), ("t4", "L1", None, None, at), (None, "L5", "O9", "P9", None), ("t6", "L1", "O2", "P2", at)],
        LINES,
    )
    ledgers = spark.createDataFrame(
        [("L1", "a", "N1", 1.0, False), ("L2", "b", "N1", 1.0, True), ("L5", "d", "N2", 1.0, False), ("L5", "e", "N2", 1.0, False), (None, "f", "N1", 1.0, False)], LEDGERS
    )
    orders = _padded(spark, [("O1", at), ("O2", None, None, "web"), ("O2", at), (None, at)], ORDERS)
    items = _padded(spark, [("P1", "s", "text"), ("P1", "s2"), (None, "s3")], ITEMS)
    whole, traded = fs.fct_b2b_sales(ledgers, lines, orders, items), lines.select("sales_ledger_id")
    for most in (fs.FEW_LEDGERS, 1):
        monkeypatch.setattr(fs, "FEW_LEDGERS", most)
        asked = []

        def kept(df, purpose, asked=asked):
            asked.append((purpose, df.count()))
            return sinks.scratch(df, purpose)

        sales = fs.fct_b2b_sales(ledgers, lines, orders, items, traded, kept=kept)
        assert [p for p, _ in asked] == ["lines", "dated"] and asked[0][1] < asked[1][1]
        plan = sales._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("LeftOuter") == 1  # what is left to do is the move to products
        assert {f.rpartition("/")[0].rpartition("/")[2].partition("-")[0] for f in sales.inputFiles()} >= {"dated"}
        assert rows(sales) == rows(whole) and sales.columns == whole.columns and sales.dtypes == whole.dtypes


def _export(spark, table, made, ddl):
    df = spark.createDataFrame(made, ddl)
    return df.withColumns({c: F.lit(None).cast("string") for c in crm.renames(table).values() if c not in df.columns})


def test_a_warehouse_writes_business_lines_between_their_moves(spark):
    frames = {
        "sales_ledgers": _export(spark, "sales_ledgers", [("L1", "a", False), ("L2", "b", True)], "salesledgerid string, name string, isb2c boolean"),
        "sales_transactions": _export(spark, "sales_transactions", [("t1", "L1", "O1", "P1"), ("t2", "L2", "O1", "P1"), ("t3", "L1", None, None)], "id string, ledger string, ordernumber string, productitemid string"),
        "sales_order_headers": _export(spark, "sales_order_headers", [("O1", "L1", "open")], "ordernumber string, salesledgerid string, orderstatus string"),
        "product_items": _export(spark, "product_items", [("P1", "s")], "productitemid string, sku string"),
    }
    house = Warehouse(spark, Catalog(spark, frames={("prospect_crm", t, None): df for t, df in frames.items()}), Settings())
    sales = house.table("fct_b2b_sales")
    assert any("/dated-" in f for f in sales.inputFiles()) and not any("/lines-" in f for f in sales.inputFiles())
    assert rows(sales, "transaction_id", "customer_name", "order_status", "sku") == [("t1", "a", "open", "s"), ("t3", "a", None, None)]
