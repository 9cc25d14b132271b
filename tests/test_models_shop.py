from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from merchantry.plans import facts_sales as fs, staging_crm as crm, staging_shop as shop, staging_stock as stock
from tests.conftest import rows

ORDER = (
    "id bigint, name string, email string, created_at string, processed_at string, updated_at string, total_price string, "
    "subtotal_price string, total_tax string, total_discounts string, currency string, financial_status string, "
    "fulfillment_status string, customer struct<id: bigint>, source_name string, tags string, "
    "shipping_address struct<city: string, country_code: string, province: string, zip: string>, "
    "_airbyte_meta struct<changes: array<string>>"
)


def order(id_, who=None, at="2024-03-01T10:00:00Z", price="10", zip_="m1 1aa", changes=None, email=" A@B.c "):
    return (
        id_, f"#{id_}", email, at, "never", at, price, "8", "1", "2", "GBP", "paid", None, (who,) if who else None, "web", "",
        ("City", "GB", None, zip_), (changes,),
    )


def orders_frame(spark, *items):
    return spark.createDataFrame(list(items), ORDER)


def test_orders_staging(spark):
    raw = {
        "alpha": orders_frame(spark, order(1, 5, "2024-03-31T23:30:00-05:00"), order(2, None, price="oops"), order(3, changes=["price"])),
        "beta": orders_frame(spark, order(1, 6, zip_="123", email=None)),
    }
    got = shop.orders(raw)
    assert rows(got, "store_id", "order_id", "customer_id", "total_price", "uk_region", "email") == [
        ("alpha", 1, 5, 10.0, "North West", "a@b.c"),
        ("alpha", 2, None, None, "North West", "a@b.c"),
        ("beta", 1, 6, 10.0, "International", None),
    ]
    first = got.filter("store_id = 'alpha' and order_id = 1").collect()[0]
    assert first.created_date == date(2024, 3, 31) and first.processed_at is None
    assert got.filter("order_id = 1 and store_id = 'alpha'").select(F.col("created_at").cast("string")).collect()[0][0] == "2024-04-01 04:30:00"


def test_orders_from_json_text_equal_structs(spark):
    raw = orders_frame(spark, order(1, 5), order(2, None), order(3, 7, changes=["x"]))
    as_text = raw.withColumns({c: F.to_json(c) for c in ("customer", "shipping_address", "_airbyte_meta")})
    assert rows(shop.orders({"a": raw})) == rows(shop.orders({"a": as_text}))


LINES = (
    "id bigint, line_items array<struct<id: bigint, product_id: bigint, variant_id: bigint, title: string, sku: string, "
    "quantity: bigint, price_set: struct<shop_money: struct<amount: string>>, gift_card: boolean>>, "
    "_airbyte_meta struct<changes: array<string>>"
)


def line(id_, product, title="T", quantity=1, amount="2.5", gift=None):
    return (id_, product, 1, title, "S", quantity, ((amount,),), gift)


def lines_frame(spark, *docs):
    return spark.createDataFrame([(i, items, (None,)) for i, items in docs], LINES)


def test_lines_skip_empty_and_missing_arrays(spark):
    raw = lines_frame(spark, (1, [line(10, 1), line(11, 2, gift=True)]), (2, []), (3, None))
    got = shop.order_line_items({"alpha": raw})
    assert rows(got, "order_id", "line_item_id", "unit_price_gbp", "is_gift_card") == [(1, 10, 2.5, None), (1, 11, 2.5, True)]


def test_refunds_two_grains_do_not_multiply(spark):
    schema = (
        "order_id bigint, created_at timestamp, transactions array<struct<amount: string, kind: string, status: string>>, "
        "refund_line_items array<struct<subtotal_set: struct<shop_money: struct<amount: string>>>>"
    )
    at = datetime(2024, 1, 1)
    good = lambda x: (x, "Refund", "SUCCESS")
    raw = spark.createDataFrame(
        [
            (1, at, [good("5"), good("7"), ("9", "sale", "success")], [((("4",),),), ((("6",),),)]),
            (1, datetime(2024, 1, 2), [good("1")], None),
            (2, at, [("3", "refund", "pending")], [((("2",),),)]),
            (3, at, [good(None)], []),
            (4, at, [("3", "refund", "failure")], []),
            (5, at, None, None),
        ],
        schema,
    )
    got = shop.order_refunds({"alpha": raw})
    last = got.filter("order_id = 1").collect()[0].last_refunded_at
    assert rows(got, "order_id", "refund_amount", "refund_subtotal") == [(1, 13.0, 10.0), (2, 0.0, 2.0), (3, 0.0, 0.0)]
    assert last == datetime(2024, 1, 2)
    assert got.filter("order_id = 2").collect()[0].last_refunded_at is None


def refunds_frame(spark, *items):
    return spark.createDataFrame(list(items), "order_id bigint, store_id string, refund_amount double, refund_subtotal double")


def test_order_facts(spark):
    staged = shop.orders(
        {
            "alpha": orders_frame(
                spark, order(1, 5), order(2, 5, "2024-02-01T00:00:00Z"), order(3, None), order(4, None, "2024-01-01T00:00:00Z"),
                order(6, 9), order(7, 9),
            ),
            "beta": orders_frame(spark, order(5, 5, "2023-01-01T00:00:00Z")),
        }
    )
    got = fs.fct_orders(staged, refunds_frame(spark, (1, "alpha", 3.0, 2.0)))
    # a customer counts across stores, all guests share one first order, ties go to the lower id
    assert rows(got.filter("is_first_order = 1"), "order_id") == [(4,), (5,), (6,)]
    landed_twice = fs.fct_orders(staged.unionByName(staged), refunds_frame(spark))
    assert rows(landed_twice.filter("is_first_order = 1"), "order_id") == [(4,), (5,), (6,)] and landed_twice.count() == 14
    per_store = fs.fct_orders(staged, refunds_frame(spark), per_store_first=True)
    assert rows(per_store.filter("is_first_order = 1"), "order_id") == [(2,), (4,), (5,), (6,)]
    one = got.filter("order_id = 1").collect()[0]
    assert (one.gross_sales, one.net_sales, one.total_sales_after_returns) == (10.0, 6.0, 7.0)
    assert one.order_month == date(2024, 3, 1)
    assert got.filter("gross_sales < net_sales").count() == 0 and got.count() == 7


def test_order_facts_move_orders_once(spark, small):
    from merchantry.workloads import queries

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        house = queries.Warehouse(spark, queries.exports.catalog(spark, small), queries.exports.SETTINGS)
        plan = house.table("fct_orders")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    wide = [l for l in plan.splitlines() if "Join" in l]
    assert len(wide) == 1


def test_customer_dimension(spark):
    people = spark.createDataFrame([(1, "alpha"), (2, "alpha"), (1, "beta")], "customer_id bigint, store_id string")
    bought = spark.createDataFrame(
        [(1, datetime(2024, 1, 1), 5.0), (1, datetime(2024, 2, 1), 7.0), (None, datetime(2024, 1, 1), 9.0)],
        "customer_id bigint, created_at timestamp, total_price double",
    )
    got = fs.dim_customers(people, bought)
    assert rows(got, "customer_id", "store_id", "lifetime_orders", "lifetime_revenue") == [
        (1, "alpha", 2, 12.0), (1, "beta", 2, 12.0), (2, "alpha", None, None),
    ]


def test_products(spark):
    lines = shop.order_line_items(
        {
            "alpha": lines_frame(
                spark, (1, [line(1, 10, "A"), line(2, 20, "B"), line(3, 10, "A"), line(9, 30, "G", gift=True)]),
                (2, [line(4, 10, "A"), line(5, 20, "B2")]), (3, [line(6, 10, "A", 3)]), (99, [line(7, 20, "B")]),
            )
        }
    )
    pairs = fs.fct_product_pairs(lines)
    assert rows(pairs, "product_a_id", "product_b_id", "product_b", "orders_together") == [(10, 20, "B", 1), (10, 20, "B2", 1)]
    orders = fs.fct_orders(
        shop.orders({"alpha": orders_frame(spark, order(1, 5), order(2, 5), order(3, 6))}), refunds_frame(spark)
    )
    sold = fs.fct_product_sales(lines, orders)
    assert sold.count() == 7 and sold.filter("customer_id is null").count() == 1
    assert sold.filter("line_item_id = 6").collect()[0].line_revenue_gbp == 7.5
    repeat = fs.fct_product_repeat_rate(sold)
    assert rows(repeat, "product_id", "product_title", "unique_buyers", "repeat_buyers", "repeat_rate_pct") == [
        (10, "A", 2, 1, 50.0), (20, "B2", 1, 1, 100.0),
    ]


def sale(id_, who, at, paid, status="DONE", loaded="2024-01-01", channel="Shopify"):
    return (id_, who, "n", at, paid, paid, "GBP", "GBP", status, "o", "f", channel, datetime.fromisoformat(loaded) if loaded else None)


SALE = (
    "saleid string, customerid string, customer string, orderdate string, paidamount double, invoiceamount double, basecurrency string, "
    "customercurrency string, status string, orderstatus string, fulfilmentstatus string, sourcechannel string, _airbyte_extracted_at timestamp"
)


def test_stock_sales(spark):
    raw = spark.createDataFrame(
        [
            sale("a", "c1", "2024-01-05T10:00:00", 5.0), sale("a", "c1", "2024-01-05T10:00:00", 6.0, loaded="2024-02-01"),
            sale("a", "c1", "2024-01-05T10:00:00", 99.0, loaded=None), sale("b", "c1", "2024-01-05T10:00:00", 1.0),
            sale("v", "c1", "2024-01-01", 1.0, "VOIDED"), sale("n", "c1", "2024-01-01", 1.0, None), sale("x", "c1", "soon", 1.0),
            sale("g", None, "2024-01-02", 1.0, channel="Kiosk"),
        ],
        SALE,
    )
    sales = stock.sales(raw)
    assert rows(sales, "sale_id", "paid_amount", "channel_group") == [("a", 6.0, "shopify_dtc"), ("b", 1.0, "shopify_dtc"), ("g", 1.0, "other")]
    people = spark.createDataFrame(
        [
            ("c1", "One", [(" X@Y.z",)], [("2", "C", "UK", " m1 1aa", None, "Shipping", "true"), ("1", "C", "UK", "LS1", None, "Shipping", "true"),
                                          ("0", "C", "UK", "B1", None, "Billing", "true")], datetime(2024, 1, 1)),
            ("c2", "Two", [], [], datetime(2024, 1, 1)), ("c3", "Three", None, None, None),
        ],
        f"id string, name string, contacts {stock.CONTACTS}, addresses {stock.ADDRESSES}, _airbyte_extracted_at timestamp",
    ).withColumns({c: F.lit(None).cast("string") for c in ("status", "currency", "pricetier", "lastmodifiedon")}).withColumn(
        "creditlimit", F.lit(1.0)
    )
    customers, addresses = stock.customers(people), stock.customer_addresses(people)
    assert rows(customers, "customer_id", "email") == [("c1", "x@y.z"), ("c2", None), ("c3", None)]
    assert rows(addresses, "address_id", "postcode", "postcode_area") == [("0", "B1", "B"), ("1", "LS1", "LS"), ("2", "m1 1aa", "M")]
    fact = fs.fct_stock_sales(sales, addresses)
    assert rows(fact, "sale_id", "customer_order_number", "is_first_order", "uk_region") == [
        ("a", 1, 1, "Yorkshire"), ("b", 2, 0, "Yorkshire"), ("g", 1, 1, "International"),
    ]
    dim = fs.dim_stock_customers(customers, sales)
    assert rows(dim, "customer_id", "lifetime_orders", "lifetime_revenue", "channels_used", "customer_segment") == [
        ("c1", 2, 7.0, 1, "occasional"), ("c2", 0, 0.0, 0, "no_orders"), ("c3", 0, 0.0, 0, "no_orders"),
    ]


def whole(table, raw):
    """An export with all of its columns: those not given are there without a value."""
    missing = [c for c in dict.fromkeys(crm.renames(table).values()) if c not in raw.columns]
    kind = {True: "timestamp", False: "string"}
    return raw.withColumns({c: F.lit(None).cast(kind["date" in c or c == "created"]) for c in missing})


def test_crm_exports_must_have_their_columns(spark):
    raw = spark.createDataFrame([("P1", "Serum")], "productitemid string, description string")
    with pytest.raises(KeyError, match="barcode"):
        crm.product_items(raw)
    assert crm.product_items(whole("product_items", raw)).columns == list(crm.renames("product_items"))


def test_crm_staging_drops_null_and_demo_ledgers(spark):
    at = datetime(2024, 1, 1)
    raw = spark.createDataFrame(
        [("1", "L1", at, at), ("2", "CRMPRODTOUR", at, at), ("3", None, at, at), (None, "L1", at, at), ("1", "OLD", at, None)],
        "ordernumber string, salesledgerid string, orderdate timestamp, _airbyte_extracted_at timestamp",
    )
    got = crm.sales_orders(whole("sales_order_headers", raw), "CRMPRODTOUR")
    assert rows(got, "order_number", "sales_ledger_id", "order_month") == [("1", "L1", date(2024, 1, 1))]
    assert set(crm.renames("sales_order_headers")) | {"order_month"} == set(got.columns)


def test_customer_unified(spark):
    at = datetime(2024, 1, 1)
    ledgers = spark.createDataFrame(
        [("L1", "both@salon.com", "Both", False, at), ("L2", "both@salon.com", "Older", True, None), ("L3", "crm@salon.com", "Crm", None, at), ("L4", None, "x", True, at)],
        "sales_ledger_id string, email string, customer_name string, is_b2c boolean, last_updated_at timestamp",
    ).withColumns({c: F.lit(None).cast("string") for c in ("country", "currency_code")}).withColumns(
        {c: F.lit(1.0) for c in ("balance", "credit_limit")}
    ).withColumn("last_invoice_at", F.lit(None).cast("timestamp"))
    contacts = spark.createDataFrame(
        [("K1", "contact@salon.com", "Con Tact", at)], "contact_id string, email string, full_name string, last_updated_at timestamp"
    ).withColumns({"klaviyo_id": F.lit("k"), "opt_in": F.lit(True)})
    people = spark.createDataFrame(
        [(1, "both@salon.com", "B", None, 2, 5.0, None, "alpha"), (2, "lead@salon.com", None, None, 1, 3.0, True, "alpha"),
         (3, "lead@salon.com", "L", "D", 1, None, False, "alpha"), (4, "lead@salon.com", "Z", None, None, 4.0, None, "beta"),
         (5, "home@gmail.com", "H", "G", 1, 9.0, False, "beta"), (6, "", None, None, 1, 1.0, False, "beta"), (7, None, "N", None, 1, 1.0, True, "beta")],
        "customer_id bigint, email string, first_name string, last_name string, orders_count bigint, total_spent double, accepts_marketing boolean, store_id string",
    ).withColumn("updated_at", F.lit(at))
    got = fs.dim_customer_unified(ledgers, contacts, people, ("alpha", "beta"))
    assert rows(got, "email", "display_name", "seen_in_crm", "customer_universe", "total_shopify_spend", "is_dtc_b2b_lead") == [
        ("", "", None, "shopify_beta_only", 1.0, False),
        ("both@salon.com", "Both", "b2b", "crm_and_shopify", 5.0, False),
        ("contact@salon.com", "Con Tact", None, "unknown", 0.0, False),
        ("crm@salon.com", "Crm", "b2b", "crm_only", 0.0, False),
        ("home@gmail.com", "H G", None, "shopify_beta_only", 9.0, False),
        ("lead@salon.com", "L D", None, "both_shopify_stores", 7.0, True),
    ]
    lead = got.filter("email = 'lead@salon.com'").collect()[0]
    assert (lead.shopify_alpha_orders_count, lead.shopify_beta_orders_count, lead.accepts_marketing) == (2, 0, True)


def test_b2b_sales_keep_business_ledgers_only(spark):
    at = datetime(2024, 5, 5)
    typed = lambda table, data, cols: crm._named(table, whole(table, spark.createDataFrame(data, cols)))
    ledgers = typed("sales_ledgers", [("L1", "A", False), ("L2", "B", True), ("L3", "C", None)], "salesledgerid string, name string, isb2c boolean")
    lines = crm.sales_transactions(
        whole("sales_transactions", spark.createDataFrame(
            [("T1", "L1", "O1", "P1", "text", at, at), ("T2", "L1", "O9", "P9", "text", at, at), ("T3", "L2", "O1", "P1", "t", at, at), ("T4", "L3", "O1", "P1", "t", at, at)],
            "id string, ledger string, ordernumber string, productitemid string, productdescription string, transactiondate timestamp, orderdate timestamp",
        ))
    )
    orders = crm.sales_orders(
        whole("sales_order_headers", spark.createDataFrame([("O1", "L1", datetime(2024, 4, 4))], "ordernumber string, salesledgerid string, orderdate timestamp")), "DEMO"
    )
    products = crm.product_items(whole("product_items", spark.createDataFrame([("P1", "Serum")], "productitemid string, description string")))
    got = fs.fct_b2b_sales(ledgers, lines, orders, products)
    assert rows(got, "transaction_id", "order_month", "product_description") == [
        ("T1", date(2024, 4, 1), "Serum"), ("T2", date(2024, 5, 1), "text"),
    ]
