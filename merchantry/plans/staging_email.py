"""Email platform exports: events, catalogues, placed orders and engagement."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from merchantry.functions import dates, payload, scalars
from merchantry.operators import combine, ranking

# Event names of the platform.
RECEIVED, OPENED, CLICKED = "Received Email", "Opened Email", "Clicked Email"
PLACED_ORDER = "Placed Order"
SUBSCRIBED, UNSUBSCRIBED = "Subscribed to Email Marketing", "Unsubscribed from Email Marketing"

PROPERTIES = (
    "struct<`$campaign`: string, `$flow`: string, `$message`: string, `Campaign Name`: string, "
    "`$value`: string, `$value_currency`: string, OrderID: string>"
)
LINK = "struct<data: struct<id: string>>"
EVENT_SHAPES = {
    "_airbyte_meta": payload.META_SHAPE,
    "attributes": f"struct<value: string, value_currency: string, unique_id: string, event_properties: {PROPERTIES}>",
    "relationships": f"struct<profile: {LINK}, metric: {LINK}>",
}
CAMPAIGN_SHAPES = {
    "_airbyte_meta": payload.META_SHAPE,
    "attributes": "struct<name: string, status: string, channel: string, send_time: string, created_at: string, "
    "updated_at: string, audiences: struct<included: string>>",
}
STATISTICS = (
    "opens", "unique_opens", "clicks", "unique_clicks", "delivered", "bounced", "unsubscribed", "spam_complaints",
)
STATS_SHAPES = {
    "_airbyte_meta": payload.META_SHAPE,
    "statistics": "struct<" + ", ".join(f"{s}: string" for s in (*STATISTICS, "revenue")) + ">",
}


def events(raw: dict[str, DataFrame]) -> DataFrame:
    def shape(df: DataFrame) -> DataFrame:
        df = payload.clean_rows(payload.unpack(df, EVENT_SHAPES))
        prop = lambda key, to: payload.field(df, ("attributes", "event_properties", key), to)
        attr = lambda key, to: payload.field(df, ("attributes", key), to)
        return df.select(
            payload.field(df, "id", "string").alias("event_id"),
            payload.field(df, "type", "string").alias("event_type"),
            dates.instant(df, "datetime").alias("occurred_at"),
            dates.local_date(df, "datetime").alias("occurred_date"),
            attr("value", "double").alias("value"),
            attr("value_currency", "string").alias("value_currency"),
            attr("unique_id", "string").alias("unique_id"),
            prop("$campaign", "string").alias("campaign_id"),
            prop("$flow", "string").alias("flow_id"),
            prop("$message", "string").alias("message_id"),
            prop("Campaign Name", "string").alias("campaign_name"),
            prop("$value", "double").alias("order_value"),
            prop("$value_currency", "string").alias("order_currency"),
            prop("OrderID", "string").alias("order_id"),
            payload.field(df, ("relationships", "profile", "data", "id"), "string").alias("profile_id"),
            payload.field(df, ("relationships", "metric", "data", "id"), "string").alias("metric_id"),
        )

    return combine.union_tenants(raw, shape)


def metrics(raw: dict[str, DataFrame]) -> DataFrame:
    def shape(df: DataFrame) -> DataFrame:
        df = payload.unpack(df, {"attributes": "struct<name: string, integration: struct<name: string>>"})
        return df.select(
            payload.field(df, "id", "string").alias("metric_id"),
            payload.field(df, ("attributes", "name"), "string").alias("metric_name"),
            payload.field(df, ("attributes", "integration", "name"), "string").alias("integration_name"),
        )

    return combine.union_tenants(raw, shape)


def flows(raw: dict[str, DataFrame]) -> DataFrame:
    def shape(df: DataFrame) -> DataFrame:
        df = payload.unpack(df, {"attributes": "struct<name: string, status: string>"})
        return df.select(
            payload.field(df, "id", "string").alias("flow_id"),
            payload.field(df, ("attributes", "name"), "string").alias("flow_name"),
            payload.field(df, ("attributes", "status"), "string").alias("flow_status"),
        )

    return combine.union_tenants(raw, shape)


def campaigns(raw: dict[str, DataFrame]) -> DataFrame:
    """Campaign catalogue; the audience list stays JSON (or a variant) as landed."""

    def shape(df: DataFrame) -> DataFrame:
        df = payload.clean_rows(payload.unpack(df, CAMPAIGN_SHAPES))
        attr = lambda key, to: payload.field(df, ("attributes", key), to)
        return df.select(
            payload.field(df, "id", "string").alias("campaign_id"),
            attr("name", "string").alias("campaign_name"),
            attr("status", "string").alias("status"),
            attr("channel", "string").alias("channel"),
            *[attr(c, "timestamp").alias(c) for c in ("send_time", "created_at", "updated_at")],
            payload.field(df, ("attributes", "audiences", "included"), "string").alias("audiences_included"),
        )

    return combine.union_tenants(raw, shape)


def campaign_stats(raw: dict[str, DataFrame]) -> DataFrame:
    def shape(df: DataFrame) -> DataFrame:
        df = payload.clean_rows(payload.unpack(df, STATS_SHAPES))
        return df.select(
            payload.field(df, "campaign_id", "string").alias("campaign_id"),
            payload.field(df, "campaign_message_id", "string").alias("campaign_message_id"),
            payload.field(df, "date", "date").alias("stat_date"),
            payload.field(df, "send_channel", "string").alias("send_channel"),
            *[payload.field(df, ("statistics", s), "bigint").alias(s) for s in STATISTICS],
            payload.field(df, ("statistics", "revenue"), "double").alias("revenue"),
        )

    return combine.union_tenants(raw, shape)


def named_events(events: DataFrame, metrics: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Events of the given names.

    The names filter reaches the catalogue scan, and the catalogue is one small
    table, so Spark's own size check broadcasts it and events are not moved.
    """
    wanted = metrics.filter(F.col("metric_name").isin(*names)).select("store_id", "metric_id", "metric_name")
    return events.join(wanted, ["store_id", "metric_id"])


def placed_orders(events: DataFrame, metrics: DataFrame, merge_missing_ids: bool = False) -> DataFrame:
    """One event per order: several senders report the same order.

    Events without an order id cannot be matched with others and all stay;
    ``merge_missing_ids`` keeps a single one of them per store instead.
    """
    placed = named_events(events, metrics, (PLACED_ORDER,))
    key = F.col("order_id") if merge_missing_ids else F.coalesce(F.concat(F.lit("o:"), "order_id"), F.concat(F.lit("e:"), "event_id"))
    order = [F.col("occurred_at").asc_nulls_last(), F.col("event_id").asc_nulls_last()]
    needed = placed.select(
        "event_id", "store_id", "profile_id", "occurred_at",
        dates.month_start(F.col("occurred_date")).alias("order_month"),
        "order_id", F.col("order_value").alias("revenue"), F.col("order_currency").alias("currency"),
        key.alias("_key"),
    )
    return ranking.top_n_per_group(needed, ["store_id", "_key"], order).drop("_key")


def email_engagement(events: DataFrame, metrics: DataFrame) -> DataFrame:
    """Delivered, unique opens and unique clicks per store and month.

    Distinct (message, profile) pairs are folded by a first aggregate on the
    fine grain, so neither pass holds a month in one task.
    """
    fine = (
        named_events(events, metrics, (RECEIVED, OPENED, CLICKED))
        .groupBy(
            "store_id",
            dates.month_start(F.col("occurred_date")).alias("send_month"),
            "metric_name", "message_id", "profile_id",
        )
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    paired = F.col("message_id").isNotNull() & F.col("profile_id").isNotNull()
    monthly = fine.groupBy("store_id", "send_month").agg(
        F.coalesce(F.sum(F.when(F.col("metric_name") == RECEIVED, F.col("_n"))), F.lit(0)).alias("delivered"),
        F.count_if((F.col("metric_name") == OPENED) & paired).alias("unique_opens"),
        F.count_if((F.col("metric_name") == CLICKED) & paired).alias("unique_clicks"),
    )
    key = scalars.readable_key(F.col("store_id"), dates.month_label(F.col("send_month")))
    return monthly.select(key.alias("engagement_id"), *monthly.columns)
