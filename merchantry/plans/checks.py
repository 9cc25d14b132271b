"""Data-quality checks: declared per table, run as few passes."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegralType

AUDIENCES = ("remarketing", "acquisition", "other")
INTENTS = ("branded", "non_branded")


@dataclass(frozen=True)
class Checks:
    """``required`` must not be null, ``unique`` not repeat, ``not_negative`` be >= 0."""

    required: str = ""
    unique: str = ""
    not_negative: str = ""
    accepted: dict[str, tuple] = field(default_factory=dict)
    unique_together: tuple[str, ...] = ()

    def count(self) -> int:
        lists = sum(len(s.split()) for s in (self.required, self.unique, self.not_negative))
        return lists + len(self.accepted) + bool(self.unique_together)


# Declared checks of every table.
DECLARED = {
    "stg_shopify__orders": Checks("order_id store_id created_at total_price", "order_id"),
    "stg_shopify__customers": Checks("customer_id store_id", "customer_id"),
    "stg_klaviyo__events": Checks("event_id store_id occurred_at", "event_id"),
    "stg_klaviyo__metrics": Checks("metric_id metric_name store_id"),
    "stg_klaviyo__flows": Checks("flow_id store_id", "flow_id"),
    "stg_klaviyo__placed_orders": Checks("event_id store_id order_month", "event_id", "revenue"),
    "stg_klaviyo__campaigns": Checks("campaign_id"),
    "stg_klaviyo__campaign_stats": Checks("campaign_id store_id"),
    "stg_klaviyo__email_engagement": Checks("engagement_id store_id send_month", "engagement_id", "delivered"),
    "stg_cin7__sales": Checks("sale_id customer_id ordered_at channel_group", "sale_id"),
    "stg_cin7__customers": Checks("customer_id", "customer_id"),
    "stg_cin7__customer_addresses": Checks("customer_id"),
    "stg_shopify__order_line_items": Checks("line_item_id order_id store_id", "line_item_id"),
    "stg_prospect_crm__sales_ledgers": Checks("sales_ledger_id", "sales_ledger_id"),
    "stg_prospect_crm__contacts": Checks("contact_id", "contact_id"),
    "stg_prospect_crm__companies": Checks("company_id", "company_id"),
    "stg_prospect_crm__leads": Checks("lead_id", "lead_id"),
    "stg_prospect_crm__addresses": Checks("address_id", "address_id"),
    "stg_prospect_crm__sales_orders": Checks("order_number sales_ledger_id ordered_at", "order_number"),
    "stg_prospect_crm__sales_invoices": Checks("invoice_number", "invoice_number"),
    "stg_prospect_crm__sales_transactions": Checks("transaction_id sales_ledger_id", "transaction_id"),
    "stg_prospect_crm__product_items": Checks("product_item_id", "product_item_id"),
    "stg_meta__ads_spend": Checks(
        "spend_date store_id audience_type", "", "spend purchases purchase_value", {"audience_type": AUDIENCES}
    ),
    "stg_google_analytics__sessions": Checks("session_date order_month store_id"),
    "stg_google_analytics__channel_sessions": Checks("session_date order_month store_id channel"),
    "stg_google_analytics__transactions": Checks("session_date order_month store_id"),
    "stg_google_analytics__users": Checks("session_date order_month store_id"),
    "stg_google_analytics__source_medium": Checks("session_date order_month store_id source_medium"),
    "stg_shopify__order_refunds": Checks("order_id store_id", "order_id"),
    "stg_google_ads__search_terms": Checks(
        "search_date search_term order_month order_month_label store_id brand_intent",
        "", "clicks cost conversions", {"brand_intent": INTENTS},
    ),
    "fct_orders": Checks("order_id store_id is_first_order", "order_id", "", {"is_first_order": (0, 1)}),
    "dim_customers": Checks("customer_id store_id", "customer_id"),
    "fct_campaign_performance": Checks(
        "engagement_id store_id send_month", "engagement_id", "delivered unique_opens unique_clicks"
    ),
    "dim_campaigns": Checks("campaign_id store_id", "campaign_id"),
    "fct_cin7_sales": Checks("sale_id customer_id", "sale_id"),
    "dim_cin7_customers": Checks("customer_id", "customer_id"),
    "fct_product_sales": Checks("line_item_id", "line_item_id"),
    "fct_product_repeat_rate": Checks("product_id store_id"),
    "dim_customer_unified": Checks("email", "email"),
    "fct_b2b_sales": Checks("transaction_id sales_ledger_id", "transaction_id"),
    "fct_ad_spend": Checks("spend_date store_id audience_type", "", "", {"audience_type": AUDIENCES}),
    "fct_klaviyo_revenue": Checks("event_id store_id order_month", "event_id", "revenue"),
    "fct_klaviyo_campaign_revenue": Checks(
        "campaign_id store_id order_month revenue", "", "revenue", {}, ("campaign_id", "store_id", "order_month")
    ),
    "fct_klaviyo_flow_revenue": Checks(
        "flow_id flow_name store_id order_month revenue", "", "revenue", {}, ("flow_id", "store_id", "order_month")
    ),
    "fct_ga_sessions": Checks("session_date order_month store_id", "", "users transactions"),
    "fct_ga_channel_sessions": Checks(
        "session_date order_month store_id channel", "", "sessions channel_revenue"
    ),
    "fct_ga_source_medium": Checks(
        "session_date order_month store_id session_source session_medium source_medium",
        "", "sessions revenue", {}, ("session_date", "store_id", "source_medium"),
    ),
    "fct_brand_monthly_summary": Checks("store_id order_month"),
    "fct_marketing_kpis_daily": Checks("date store_id"),
    "fct_google_ads_search_terms": Checks(
        "order_month order_month_label store_id brand_intent", "", "", {"brand_intent": INTENTS}
    ),
    "fct_klaviyo_subscriber_growth": Checks(
        "subscriber_growth_id store_id order_month", "subscriber_growth_id", "subscribers_added unsubscribes"
    ),
}

RESULT = "table_name string, check_name string, column_name string, failures bigint"


def run_checks(df: DataFrame, table: str, checks: Checks) -> DataFrame:
    """One row per check with its number of failures, in one pass over the table.

    A row gives an entry to each check that it may fail: to a row-wise check if it does,
    to a uniqueness check its key, unless a part of it is null: a single whole number as it
    is, which moves in half the bytes, any other key as a 128-bit hash.
    Equal entries are counted before they are moved, and once more after.
    """
    named, entries = [], []

    def entry(kind: str, columns: str, given: Column, *hashes: Column) -> None:
        found = F.struct(F.lit(len(named)).alias("i"), *[h.cast("long").alias(f"h{k}") for k, h in enumerate(hashes)])
        entries.append(F.when(given, found))
        named.append((len(named), kind, columns))

    none = F.lit(None)
    for c in checks.required.split():
        entry("not_null", c, F.col(c).isNull(), none, none)
    for c, values in checks.accepted.items():
        entry("accepted_values", c, ~F.col(c).isin(*values), none, none)
    for c in checks.not_negative.split():
        entry("accepted_range", c, F.col(c) < 0, none, none)
    keys = [("unique", [c]) for c in checks.unique.split()]
    if checks.unique_together:
        keys.append(("unique_combination", list(checks.unique_together)))
    for kind, columns in keys:
        known = reduce(and_, [F.col(c).isNotNull() for c in columns])
        whole = len(columns) == 1 and isinstance(df.select(*columns).schema[0].dataType, IntegralType)
        hashes = (F.col(columns[0]), F.lit(0)) if whole else (F.xxhash64(*columns), F.xxhash64(F.lit(len(columns)), *columns))
        entry(kind, ",".join(columns), known, *hashes)
    if not named:
        return df.sparkSession.createDataFrame([], RESULT)
    stacked = df.select(F.inline(F.filter(F.array(*entries), lambda x: x.isNotNull())))
    counted = stacked.groupBy("i", "h0", "h1").agg(F.count(F.lit(1)).alias("n"))
    row_wise = F.col("h0").isNull()
    failed = counted.groupBy("i").agg(F.sum(F.when(row_wise, F.col("n")).otherwise((F.col("n") > 1).cast("long"))).alias("failures"))
    listed = df.sparkSession.createDataFrame(named, "i int, check_name string, column_name string")
    return listed.join(failed, "i", "left").select(F.lit(table).alias("table_name"), "check_name", "column_name", F.coalesce("failures", F.lit(0)).cast("long").alias("failures"))
