"""Order, product, customer and business-sales facts and dimensions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from merchantry.functions import classify, dates, regions, scalars
from merchantry.operators import combine, ranking
from merchantry.sources import sinks

#: Business ledgers that are few enough for every task to hold their ids and terms.
FEW_LEDGERS = 500_000


def fct_orders(orders: DataFrame, refunds: DataFrame, per_store_first: bool = False) -> DataFrame:
    """One row per order with gross, net and after-return amounts.

    Refunds and first-order marks are merged into one small side first, so the
    orders themselves are moved once, by (order, store).  By default a customer
    id counts across stores; guests share the null id, so one guest order is
    first.  Of an order landed several times, the earliest row alone is marked; its
    rows are numbered by the key that then joins them, so one sort does for both.
    """
    key = ["order_id", "store_id"]
    entity = ["store_id", "customer_id"] if per_store_first else ["customer_id"]
    firsts = ranking.first_rows(orders, entity, "created_at", key).withColumn("is_first_order", F.lit(1))
    returned = refunds.select(*key, "refund_amount", "refund_subtotal")
    side = combine.spine_join({"first": firsts, "returned": returned}, key)
    amounts = ("refund_amount", "refund_subtotal")
    numbered = orders.withColumn("_nth", ranking.place_in_key(key, "created_at", ranking.row_digest(orders)))
    joined = numbered.join(side, key, "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in amounts})
    is_first = F.when(F.col("_nth") == 1, F.coalesce("is_first_order", F.lit(0))).otherwise(F.lit(0))
    return joined.withColumns(
        {
            "is_first_order": is_first,
            "gross_sales": F.col("subtotal_price") + F.col("total_discounts"),
            "net_sales": F.col("subtotal_price") - F.col("refund_subtotal"),
            "total_sales_after_returns": F.col("total_price") - F.col("refund_amount"),
            "order_month": dates.month_start(F.col("created_date")),
        }
    ).drop("_nth")


def dim_customers(customers: DataFrame, orders: DataFrame) -> DataFrame:
    lifetime = orders.groupBy("customer_id").agg(
        F.min("created_at").alias("first_order_at"),
        F.max("created_at").alias("last_order_at"),
        F.count(F.lit(1)).alias("lifetime_orders"),
        F.sum("total_price").alias("lifetime_revenue"),
    )
    return customers.join(lifetime, ["customer_id"], "left")


def fct_product_sales(lines: DataFrame, orders: DataFrame) -> DataFrame:
    """Sold lines with attributes of their order; revenue is worked out after the lines moved."""
    wanted = orders.select(
        "order_id", "store_id", "customer_id", "order_month", "created_at", "financial_status",
        "is_first_order", "uk_region", "shipping_country_code",
    )
    sold = lines.filter(~F.coalesce("is_gift_card", F.lit(False))).select(
        "line_item_id", "order_id", "product_id", "variant_id", "product_title", "sku", "quantity",
        "unit_price_gbp", "store_id",
    )
    joined = sold.join(wanted, ["order_id", "store_id"], "left")
    revenue = (F.col("quantity") * F.col("unit_price_gbp")).alias("line_revenue_gbp")
    after = joined.columns.index("unit_price_gbp") + 1
    return joined.select(*joined.columns[:after], revenue, *joined.columns[after:])


def fct_product_pairs(lines: DataFrame, per_store: bool = False) -> DataFrame:
    """Orders in which two products occur together, per pair of (id, title)."""
    sold = lines.filter(~F.coalesce("is_gift_card", F.lit(False)))
    group = ["order_id", "store_id"] if per_store else ["order_id"]
    pairs = combine.pairs_within(sold, group, "product_id", ["product_title"])
    return pairs.select(
        F.col("product_id_a").alias("product_a_id"),
        F.col("product_title_a").alias("product_a"),
        F.col("product_id_b").alias("product_b_id"),
        F.col("product_title_b").alias("product_b"),
        F.col("together").alias("orders_together"),
    )


def fct_product_repeat_rate(product_sales: DataFrame) -> DataFrame:
    """Buyers and repeat buyers per product and store.

    Two narrowing aggregates (buyer, product); a buyer whose least and greatest order
    differ bought again, so lines move once.  The title rides along, so no join is
    needed and no product sits in one task before it is small.
    """
    sold = product_sales.filter(F.col("product_id").isNotNull())
    product = ["product_id", "store_id"]
    per_buyer = sold.groupBy(*product, "customer_id").agg(
        F.min("order_id").alias("_first"), F.max("order_id").alias("_last"), F.max("product_title").alias("product_title")
    )
    known = F.col("customer_id").isNotNull()
    per_product = per_buyer.groupBy(*product).agg(
        F.max("product_title").alias("product_title"),
        F.count("customer_id").alias("unique_buyers"),
        F.sum(F.coalesce(known & (F.col("_first") < F.col("_last")), F.lit(False)).cast("long")).alias("repeat_buyers"),
    )
    rate = scalars.percent(F.col("repeat_buyers"), F.col("unique_buyers"))
    return per_product.filter(F.col("unique_buyers") > 0).withColumn("repeat_rate_pct", rate)


def fct_stock_sales(sales: DataFrame, addresses: DataFrame) -> DataFrame:
    """Sales with the customer's default shipping address and order number."""
    shipping = ranking.top_n_per_group(
        addresses.filter((F.col("address_type") == "Shipping") & F.col("is_default")).select(
            "customer_id", "address_id", "city", "country", "postcode", "postcode_area"
        ),
        ["customer_id"],
        [F.col(c).asc_nulls_last() for c in ("address_id", "city", "country", "postcode")],
    ).select(
        "customer_id",
        F.col("city").alias("shipping_city"),
        F.col("country").alias("shipping_country"),
        F.col("postcode").alias("shipping_postcode"),
        "postcode_area",
    )
    numbered = ranking.sequence_per_key(
        sales, ["customer_id"], "ordered_at", ["sale_id"], "customer_order_number"
    )
    joined = numbered.join(shipping, ["customer_id"], "left")
    return joined.withColumns(
        {
            "uk_region": regions.uk_region(F.col("postcode_area")),
            "is_first_order": (F.col("customer_order_number") == 1).cast("int"),
        }
    )


def dim_stock_customers(customers: DataFrame, sales: DataFrame) -> DataFrame:
    per_channel = sales.groupBy("customer_id", "channel_group").agg(
        F.count("sale_id").alias("_n"),
        F.sum("paid_amount").alias("_paid"),
        F.min("ordered_at").alias("_first"),
        F.max("ordered_at").alias("_last"),
    )
    lifetime = per_channel.groupBy("customer_id").agg(
        F.sum("_n").alias("lifetime_orders"),
        F.sum("_paid").alias("lifetime_revenue"),
        F.min("_first").alias("first_order_at"),
        F.max("_last").alias("last_order_at"),
        F.count("channel_group").alias("channels_used"),
    )
    base = customers.select("customer_id", "customer_name", "email", "status", "currency", "price_tier")
    joined = base.join(lifetime, ["customer_id"], "left")
    return joined.withColumns(
        {
            "lifetime_orders": F.coalesce("lifetime_orders", F.lit(0)),
            "lifetime_revenue": F.coalesce("lifetime_revenue", F.lit(0.0)),
            "channels_used": F.coalesce("channels_used", F.lit(0)),
            "customer_segment": classify.lifetime_segment(F.col("lifetime_orders")),
        }
    )


def _best_per_email(df: DataFrame, side: str, id_column: str, kept: Sequence[str]) -> DataFrame:
    """(email, side, order of the side): the side's columns as a struct, and a struct whose least value is the best row's."""
    at, own = F.col("last_updated_at").cast("timestamp"), F.col(id_column)
    order = F.struct(at.isNull().alias("a"), (-F.unix_micros(at)).alias("b"), own.isNull().alias("c"), own.alias("d"), *kept)
    return df.filter(F.col("email").isNotNull()).select("email", F.struct(id_column, *kept).alias(side), order.alias(f"{side}_order"))


def dim_customer_unified(
    ledgers: DataFrame, contacts: DataFrame, shop_customers: DataFrame, store_ids: Sequence[str]
) -> DataFrame:
    """One row per email over the CRM and every shop.

    The rows of all sides are stacked and merged by one aggregate, which takes the best
    row of each side and sums up each shop: every table is read once, and rows move once,
    by email, after they were merged where they are.
    """
    crm = {
        "_ledger": (ledgers, "sales_ledger_id", ["customer_name", "country", "is_b2c", "balance", "credit_limit", "currency_code", "last_invoice_at"]),
        "_contact": (contacts, "contact_id", ["full_name", "klaviyo_id", "opt_in"]),
    }
    shops = shop_customers.filter(F.col("store_id").isin(*store_ids) & F.col("email").isNotNull())
    sides = [_best_per_email(df, side, own, kept) for side, (df, own, kept) in crm.items()]
    sides.append(shops.select("email", "store_id", "total_spent", "orders_count", "accepts_marketing", "first_name", "last_name"))
    stacked = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), sides)
    merged = [F.min_by(side, f"{side}_order").alias(side) for side in crm]
    for s in store_ids:
        of = lambda value, s=s: F.when(F.col("store_id") == s, value)
        merged += [
            F.sum(of(F.coalesce("total_spent", F.lit(0.0)))).alias(f"_spent_{s}"),
            F.sum(of(F.coalesce("orders_count", F.lit(0)))).alias(f"_orders_{s}"),
            F.bool_or(of(F.coalesce("accepts_marketing", F.lit(False)))).alias(f"_marketing_{s}"),
            F.max(of(F.col("first_name"))).alias(f"_first_{s}"),
            F.max(of(F.col("last_name"))).alias(f"_last_{s}"),
        ]
    joined = stacked.groupBy("email").agg(*merged).select("*", "_ledger.*", "_contact.*")

    zero, no = F.lit(0.0), F.lit(False)
    seen = {s: F.col(f"_spent_{s}").isNotNull() for s in store_ids}
    spent = {s: F.coalesce(f"_spent_{s}", zero) for s in store_ids}
    count = {s: F.coalesce(f"_orders_{s}", F.lit(0)) for s in store_ids}
    firsts = F.coalesce(*[F.col(f"_first_{s}") for s in store_ids], F.lit(""))
    lasts = F.coalesce(*[F.col(f"_last_{s}") for s in store_ids], F.lit(""))

    in_shop = scalars.any_of(seen.values())
    n_shops = sum((c.cast("int") for c in seen.values()), F.lit(0))
    in_crm = F.col("_ledger").isNotNull()
    universe = F.when(in_crm & in_shop, "crm_and_shopify").when(in_crm, "crm_only").when(
        n_shops > 1, "both_shopify_stores"
    )
    for s in store_ids:
        universe = universe.when(seen[s], f"shopify_{s}_only")
    domain = scalars.email_domain(F.col("email"))
    spend = sum(spent.values(), zero)
    business = classify.business_email(domain)

    per_store = {}
    for s in store_ids:
        per_store[f"seen_in_shopify_{s}"] = seen[s]
        per_store[f"shopify_{s}_total_spent"] = spent[s]
        per_store[f"shopify_{s}_orders_count"] = count[s]
    out = {
        "email": F.col("email"),
        "display_name": F.coalesce("customer_name", "full_name", scalars.full_name(firsts, lasts)),
        "country": F.col("country"),
        "crm_sales_ledger_id": F.col("sales_ledger_id"),
        "crm_contact_id": F.col("contact_id"),
        "klaviyo_id": F.col("klaviyo_id"),
        "crm_balance": F.col("balance"),
        "crm_credit_limit": F.col("credit_limit"),
        "crm_currency_code": F.col("currency_code"),
        "crm_last_invoice_at": F.col("last_invoice_at"),
        "crm_opt_in": F.col("opt_in"),
        "seen_in_crm": F.when(~in_crm, None).when(F.col("is_b2c"), "b2c").otherwise("b2b"),
        **per_store,
        "total_shopify_spend": spend,
        "total_shopify_orders": sum(count.values(), F.lit(0)),
        "accepts_marketing": scalars.any_of(F.coalesce(f"_marketing_{s}", no) for s in store_ids),
        "customer_universe": universe.otherwise("unknown"),
        "email_domain": domain,
        "is_likely_business_email": business,
        "is_dtc_b2b_lead": business & ~in_crm & in_shop & (spend > 0),
    }
    return joined.select(*[col.alias(name) for name, col in out.items()])


def fct_b2b_sales(
    ledgers: DataFrame,
    transactions: DataFrame,
    orders: DataFrame,
    products: DataFrame,
    traded: DataFrame | None = None,
    of_ledgers: Callable[[DataFrame], DataFrame] | None = None,
    kept: Callable[[DataFrame, str], DataFrame] | None = None,
) -> DataFrame:
    """Transaction lines of business ledgers with order and product attributes.

    ``traded`` (sales_ledger_id, repeats allowed) holds the ledgers of all lines.  The business
    ledgers among them are written first.  Where they are few (``FEW_LEDGERS``) no line moves
    to meet them, lines of others are dropped before they move, and a ledger's terms come
    last, so that they do not move with the lines.  ``of_ledgers`` makes the transactions of
    given ledgers (distinct ids) alone, for less than all ``transactions`` cost.

    Lines move by three keys that have nothing in common.  ``kept`` (rows, purpose), such as
    ``sinks.scratch``, writes them after the first and the second move, so that the disk holds
    the pieces of one move at a time.
    """
    terms = ["customer_name", "country", "credit_limit"]
    business = ledgers.filter(~F.col("is_b2c")).select("sales_ledger_id", *terms)
    few = False
    if traded is not None:
        business = sinks.scratch(business.join(traded.distinct(), ["sales_ledger_id"], "left_semi"), "business")
        few = business.count() <= FEW_LEDGERS
    if few:
        ids = business.select("sales_ledger_id").where("sales_ledger_id is not null").distinct()
        if of_ledgers is None:
            transactions = transactions.join(F.broadcast(ids), ["sales_ledger_id"], "left_semi")
        else:
            transactions = of_ledgers(ids)
    headers = orders.select(
        "order_number", F.col("ordered_at").alias("_ordered_at"), F.col("order_month").alias("_order_month"),
        "platform", "source_channel", "order_status", "delivery_country", "delivery_postcode",
    )
    items = products.select(
        "product_item_id", "sku", F.col("description").alias("_description"), "manufacturer", "category_id",
        "product_family_id", "product_type",
    )
    lines = transactions.select(
        "transaction_id", "sales_ledger_id", "order_number", "ordered_at", "invoice_number", "product_item_id",
        "product_description", "qty_ordered", "qty_invoiced", "qty_delivered", "line_value", "gross_value",
        "cost_value", "cost_price", "margin_value", "margin_percent", "discount_rate", "currency_code",
        "transaction_type", "warehouse_code", "transacted_at", "transaction_month", "invoiced_at", "delivered_at",
    )
    step = kept or (lambda df, purpose: df)
    sold = step(lines if few else lines.join(business, ["sales_ledger_id"]), "lines")
    dated = sold.join(headers, ["order_number"], "left").withColumns(
        {
            "order_month": F.coalesce("_order_month", dates.month_start(F.col("ordered_at"))),
            "ordered_at": F.coalesce("_ordered_at", "ordered_at"),
        }
    )
    described = step(dated.drop("_order_month", "_ordered_at"), "dated").join(items, ["product_item_id"], "left")
    joined = described.join(F.broadcast(business), ["sales_ledger_id"]) if few else described
    first = ["product_item_id", "order_number", "sales_ledger_id"]
    own = [c for c in lines.columns if c not in first]
    of_order = [c for c in headers.columns if c not in ("order_number", "_ordered_at", "_order_month")]
    of_item = [c for c in items.columns if c not in ("product_item_id", "_description")]
    return joined.withColumn("product_description", F.coalesce("_description", "product_description")).select(
        *first, *own, *terms, *of_order, *of_item, "order_month"
    )
