"""Shop exports: orders, customers, order lines and refunds of every store."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from merchantry.functions import dates, payload, regions, scalars
from merchantry.operators import combine

MONEY = "struct<shop_money: struct<amount: string>>"
ORDER_SHAPES = {
    "_airbyte_meta": payload.META_SHAPE,
    "customer": "struct<id: string>",
    "shipping_address": "struct<city: string, country_code: string, province: string, zip: string>",
}
LINE_SHAPES = {
    "_airbyte_meta": payload.META_SHAPE,
    "line_items": "array<struct<id: string, product_id: string, variant_id: string, title: string, sku: string, "
    f"quantity: string, price_set: {MONEY}, gift_card: string>>",
}
REFUND_SHAPES = {
    "transactions": "array<struct<amount: string, kind: string, status: string>>",
    "refund_line_items": f"array<struct<subtotal_set: {MONEY}>>",
}


def orders(raw: dict[str, DataFrame]) -> DataFrame:
    def shape(df: DataFrame) -> DataFrame:
        df = payload.clean_rows(payload.unpack(df, ORDER_SHAPES))
        get = lambda path, to: payload.field(df, path, to)
        address = lambda part: get(("shipping_address", part), "string")
        area = scalars.postcode_area(address("zip"))
        return df.select(
            get("id", "bigint").alias("order_id"),
            get("name", "string").alias("order_name"),
            scalars.email(get("email", "string")).alias("email"),
            dates.instant(df, "created_at").alias("created_at"),
            dates.local_date(df, "created_at").alias("created_date"),
            get("processed_at", "timestamp_ntz").alias("processed_at"),
            dates.instant(df, "updated_at").alias("updated_at"),
            *[get(c, "double").alias(c) for c in ("total_price", "subtotal_price", "total_tax", "total_discounts")],
            *[get(c, "string").alias(c) for c in ("currency", "financial_status", "fulfillment_status")],
            get(("customer", "id"), "bigint").alias("customer_id"),
            *[get(c, "string").alias(c) for c in ("source_name", "tags")],
            address("city").alias("shipping_city"),
            address("country_code").alias("shipping_country_code"),
            address("province").alias("shipping_province"),
            address("zip").alias("shipping_postcode"),
            area.alias("postcode_area"),
            regions.uk_region(area).alias("uk_region"),
        )

    return combine.union_tenants(raw, shape)


def customers(raw: dict[str, DataFrame]) -> DataFrame:
    def shape(df: DataFrame) -> DataFrame:
        df = payload.clean_rows(payload.unpack(df, {"_airbyte_meta": payload.META_SHAPE}))
        get = lambda path, to: payload.field(df, path, to)
        return df.select(
            get("id", "bigint").alias("customer_id"),
            scalars.email(get("email", "string")).alias("email"),
            get("first_name", "string").alias("first_name"),
            get("last_name", "string").alias("last_name"),
            dates.instant(df, "created_at").alias("created_at"),
            dates.instant(df, "updated_at").alias("updated_at"),
            get("orders_count", "bigint").alias("orders_count"),
            get("total_spent", "double").alias("total_spent"),
            get("accepts_marketing", "boolean").alias("accepts_marketing"),
        )

    return combine.union_tenants(raw, shape)


def order_line_items(raw: dict[str, DataFrame]) -> DataFrame:
    def shape(df: DataFrame) -> DataFrame:
        df = payload.clean_rows(payload.unpack(df, LINE_SHAPES))
        kind = payload.element_type(df, "line_items")
        lines = combine.flatten(
            df.select(payload.field(df, "id", "bigint").alias("order_id"), "line_items"), "line_items", "li"
        )
        get = lambda to, *path: payload.dig(F.col("li"), kind, path, to)
        return lines.select(
            "order_id",
            get("bigint", "id").alias("line_item_id"),
            get("bigint", "product_id").alias("product_id"),
            get("bigint", "variant_id").alias("variant_id"),
            get("string", "title").alias("product_title"),
            get("string", "sku").alias("sku"),
            get("bigint", "quantity").alias("quantity"),
            get("double", "price_set", "shop_money", "amount").alias("unit_price_gbp"),
            get("boolean", "gift_card").alias("is_gift_card"),
        )

    return combine.union_tenants(raw, shape)


def order_refunds(raw: dict[str, DataFrame]) -> DataFrame:
    """Per order: money sent back, and the goods part of it.

    The two arrays of a refund are summed inside the row, so the two grains
    never multiply and one aggregate replaces two flattens and a full join.  An
    order appears if it has a successful refund transaction or any goods line.
    """

    def shape(df: DataFrame) -> DataFrame:
        df = payload.unpack(df, REFUND_SHAPES)
        money, goods = payload.element_type(df, "transactions"), payload.element_type(df, "refund_line_items")

        def is_refund(t):
            kind = F.lower(payload.dig(t, money, ("kind",), "string"))
            status = F.lower(payload.dig(t, money, ("status",), "string"))
            return (kind == "refund") & (status == "success")

        paid = combine.sum_elements(
            F.col("transactions"), is_refund, lambda t: payload.dig(t, money, ("amount",), "double")
        )
        returned = combine.sum_elements(
            F.col("refund_line_items"),
            None,
            lambda r: payload.dig(r, goods, ("subtotal_set", "shop_money", "amount"), "double"),
        )
        rows = df.select(
            payload.field(df, "order_id", "bigint").alias("order_id"),
            dates.instant(df, "created_at").alias("created_at"),
            combine.any_element(F.col("transactions"), is_refund).alias("_paid"),
            (F.coalesce(F.size("refund_line_items"), F.lit(0)) > 0).alias("_goods"),
            paid.alias("refund_amount"),
            returned.alias("refund_subtotal"),
        ).filter("_paid or _goods")
        return rows.groupBy("order_id").agg(
            F.sum("refund_amount").alias("refund_amount"),
            F.sum("refund_subtotal").alias("refund_subtotal"),
            F.max(F.when(F.col("_paid"), F.col("created_at"))).alias("last_refunded_at"),
        )

    return combine.union_tenants(raw, shape)
