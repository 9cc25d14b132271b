"""Advertising, web-analytics and paid-search exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from merchantry.functions import classify, dates, payload, scalars
from merchantry.operators import combine

ACTIONS = "array<struct<action_type: string, value: string>>"


def ads_spend(raw: dict[str, DataFrame]) -> DataFrame:
    """Spend per day and audience with purchase count and value.

    Both action arrays are summed inside the row, so one aggregate per store
    gives all measures without flattening and re-joining.
    """

    def shape(df: DataFrame) -> DataFrame:
        df = payload.unpack(df, {"actions": ACTIONS, "action_values": ACTIONS})

        def purchases(column: str):
            kind = payload.element_type(df, column)
            return combine.sum_elements(
                F.col(column),
                lambda a: payload.dig(a, kind, ("action_type",), "string") == "purchase",
                lambda a: payload.dig(a, kind, ("value",), "double"),
            )

        audience = classify.audience_type(
            payload.field(df, "campaign_name", "string"), payload.field(df, "adset_name", "string")
        )
        rows = df.select(
            payload.field(df, "date_start", "date").alias("spend_date"),
            audience.alias("audience_type"),
            payload.field(df, "spend", "double").alias("spend"),
            payload.field(df, "impressions", "bigint").alias("impressions"),
            payload.field(df, "clicks", "bigint").alias("clicks"),
            purchases("actions").alias("purchases"),
            purchases("action_values").alias("purchase_value"),
        ).filter(F.col("spend_date").isNotNull())
        measures = ("spend", "impressions", "clicks", "purchases", "purchase_value")
        return rows.groupBy("spend_date", "audience_type").agg(*[F.sum(m).alias(m) for m in measures])

    daily = combine.union_tenants(raw, shape)
    return daily.withColumn("order_month", dates.month_start(F.col("spend_date")))


def _daily(raw: dict[str, DataFrame], grain: dict, sums: dict[str, str], keep=None) -> DataFrame:
    """Sums per day, store and further grain columns, with the month added."""

    def shape(df: DataFrame) -> DataFrame:
        df = df.filter(F.col("date").isNotNull())
        if keep is not None:
            df = df.filter(keep)
        by = [dates.compact_date(payload.field(df, "date", "string")).alias("session_date")]
        by += [col.alias(name) for name, col in grain.items()]
        return df.groupBy(*by).agg(*[F.sum(src).alias(name) for name, src in sums.items()])

    out = combine.union_tenants(raw, shape)
    return out.withColumn("order_month", dates.month_start(F.col("session_date")))


def web_sessions(raw: dict[str, DataFrame]) -> DataFrame:
    sums = {"sessions": "sessions", "engaged_sessions": "engagedsessions", "total_revenue": "totalrevenue"}
    return _daily(raw, {}, sums)


def web_channel_sessions(raw: dict[str, DataFrame]) -> DataFrame:
    grain = {"channel": classify.fold_channel(F.col("sessiondefaultchannelgrouping"))}
    return _daily(raw, grain, {"sessions": "sessions", "channel_revenue": "totalrevenue"})


def web_source_medium(raw: dict[str, DataFrame]) -> DataFrame:
    grain = {
        "session_source": F.col("sessionsource"),
        "session_medium": F.col("sessionmedium"),
        "source_medium": F.concat("sessionsource", F.lit(" / "), "sessionmedium"),
    }
    return _daily(raw, grain, {"sessions": "sessions", "revenue": "totalrevenue"})


def web_transactions(raw: dict[str, DataFrame]) -> DataFrame:
    return _daily(raw, {}, {"transactions": "eventcount"}, keep=F.col("eventname") == "purchase")


def web_users(raw: dict[str, DataFrame]) -> DataFrame:
    return _daily(raw, {}, {"users": "totalusers"})


def search_terms(raw: DataFrame, store_id: str, brand_terms: tuple[str, ...]) -> DataFrame:
    """Clicks, cost and conversions per day and search term."""
    rows = raw.filter(F.col("segments_date").isNotNull() & F.col("search_term_view_search_term").isNotNull()).select(
        dates.iso_date(payload.field(raw, "segments_date", "string")).alias("search_date"),
        scalars.email(F.col("search_term_view_search_term")).alias("search_term"),
        F.col("metrics_clicks").alias("clicks"),
        scalars.from_micros(F.col("metrics_cost_micros")).alias("cost"),
        F.col("metrics_conversions").alias("conversions"),
    )
    sums = [F.sum(c).alias(c) for c in ("clicks", "cost", "conversions")]
    daily = rows.groupBy("search_date", "search_term").agg(*sums)
    month = dates.month_start(F.col("search_date"))
    return daily.withColumns(
        {
            "order_month": month,
            "order_month_label": dates.month_label(month),
            "store_id": F.lit(store_id),
            "brand_intent": classify.brand_intent(F.col("search_term"), brand_terms),
        }
    )
