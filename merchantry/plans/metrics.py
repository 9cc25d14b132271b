"""The metric catalogue: every explore with its metrics and dimensions."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import functions as F

from merchantry.config import Settings
from merchantry.functions import classify, dates
from merchantry.plans.semantic import Explore, Labelled, MonthLabel

# Metric definitions by fact table.
METRICS = {
    "fct_orders": {
        "order_count": "count(distinct order_id)",
        "total_gross_sales": "sum(gross_sales)",
        "gross_aov": "avg(gross_sales)",
        "total_net_sales": "sum(net_sales)",
        "net_aov": "avg(net_sales)",
        "total_revenue": "sum(total_price)",
        "aov": "avg(total_price)",
        "total_sales_after_returns_sum": "sum(total_sales_after_returns)",
        "total_refunds": "sum(refund_amount)",
        "total_returns": "sum(refund_subtotal)",
        "new_customer_orders": "sum(is_first_order)",
        "returning_customer_orders": "sum(case when is_first_order = 0 then 1 else 0 end)",
        "new_customer_share": "avg(is_first_order)",
    },
    "dim_customers": {
        "customer_count": "count(distinct customer_id)",
        "total_customer_revenue": "sum(lifetime_revenue)",
        "avg_orders_per_customer": "avg(lifetime_orders)",
    },
    "fct_campaign_performance": {
        "avg_open_rate": "sum(unique_opens) / nullif(sum(delivered), 0)",
        "avg_click_rate": "sum(unique_clicks) / nullif(sum(delivered), 0)",
        "total_delivered": "sum(delivered)",
        "total_unique_opens": "sum(unique_opens)",
        "total_unique_clicks": "sum(unique_clicks)",
    },
    "fct_cin7_sales": {
        "order_count": "count(distinct sale_id)",
        "active_customers": "count(distinct customer_id)",
        "total_revenue": "sum(paid_amount)",
        "aov": "avg(paid_amount)",
        "new_customer_orders": "sum(is_first_order)",
    },
    "dim_cin7_customers": {
        "customer_count": "count(distinct customer_id)",
        "total_customer_ltv": "sum(lifetime_revenue)",
        "avg_ltv": "avg(lifetime_revenue)",
        "avg_orders_per_customer": "avg(lifetime_orders)",
    },
    "fct_product_sales": {
        "line_item_count": "count(distinct line_item_id)",
        "order_count": "count(distinct order_id)",
        "unique_buyers": "count(distinct customer_id)",
        "units_sold": "sum(quantity)",
        "product_revenue": "sum(line_revenue_gbp)",
        "avg_unit_price": "avg(line_revenue_gbp)",
    },
    "fct_product_pairs": {"times_bought_together": "sum(orders_together)"},
    "fct_product_repeat_rate": {
        "total_buyers": "sum(unique_buyers)",
        "total_repeat_buyers": "sum(repeat_buyers)",
        "avg_repeat_rate": "avg(repeat_rate_pct)",
    },
    "dim_customer_unified": {
        "customer_count": "count(distinct email)",
        "total_dtc_spend": "sum(total_shopify_spend)",
        "avg_dtc_spend_per_customer": "avg(total_shopify_spend)",
        "total_dtc_orders": "sum(total_shopify_orders)",
    },
    "fct_b2b_sales": {
        "b2b_line_count": "count(distinct transaction_id)",
        "b2b_active_customers": "count(distinct sales_ledger_id)",
        "b2b_order_count": "count(distinct order_number)",
        "b2b_revenue": "sum(line_value)",
        "b2b_aov": "avg(line_value)",
        "b2b_cost": "sum(cost_value)",
        "b2b_margin": "sum(margin_value)",
        "avg_margin_pct": "avg(margin_percent)",
        "b2b_units": "sum(qty_invoiced)",
    },
    "fct_ad_spend": {
        "total_meta_spend": "sum(spend)",
        "total_impressions": "sum(impressions)",
        "total_meta_clicks": "sum(clicks)",
        "total_meta_purchases": "sum(purchases)",
        "total_meta_purchase_value": "sum(purchase_value)",
        "total_meta_revenue": "sum(purchase_value)",
    },
    "fct_klaviyo_revenue": {"total_klaviyo_revenue": "sum(revenue)"},
    "fct_klaviyo_campaign_revenue": {"total_campaign_revenue": "sum(revenue)"},
    "fct_klaviyo_flow_revenue": {"total_flow_revenue": "sum(revenue)"},
    "fct_ga_sessions": {
        "ga_conversion_rate": "sum(transactions) / nullif(sum(sessions), 0)",
        "ga_revenue_per_session": "sum(total_revenue) / nullif(sum(sessions), 0)",
        "ga_aov": "sum(total_revenue) / nullif(sum(transactions), 0)",
        "total_ga_sessions": "sum(sessions)",
        "total_engaged_sessions": "sum(engaged_sessions)",
        "ga_total_revenue": "sum(total_revenue)",
        "total_ga_users": "sum(users)",
        "total_ga_transactions": "sum(transactions)",
    },
    "fct_ga_channel_sessions": {
        "total_ga_channel_sessions": "sum(sessions)",
        "total_ga_channel_revenue": "sum(channel_revenue)",
    },
    "fct_ga_source_medium": {
        "ga_source_medium_rps": "sum(revenue) / nullif(sum(sessions), 0)",
        "total_ga_source_medium_sessions": "sum(sessions)",
        "total_ga_source_medium_revenue": "sum(revenue)",
    },
    "fct_brand_monthly_summary": {
        "total_shopify_revenue": "sum(shopify_revenue)",
        "total_shopify_orders": "sum(shopify_orders)",
        "total_ga_sessions": "sum(ga_sessions)",
        "total_ga_revenue": "sum(ga_revenue)",
        "total_ga_transactions": "sum(ga_transactions)",
    },
    "fct_google_ads_search_terms": {
        "total_clicks": "sum(clicks)",
        "total_cost": "sum(cost)",
        "total_conversions": "sum(conversions)",
    },
    "fct_klaviyo_subscriber_growth": {
        "total_subscribers_added": "sum(subscribers_added)",
        "total_unsubscribes": "sum(unsubscribes)",
        "total_net_subscriber_change": "sum(net_subscriber_change)",
    },
}

# Display labels.
AUDIENCE_LABELS = {"remarketing": "Remarketing", "acquisition": "Acquisition", "other": "Other"}
INTENT_LABELS = {"branded": "Branded", "non_branded": "Non-branded"}
NEW, RETURNING = "New customers", "Returning customers"

STORE_LABELLED = (
    "fct_orders", "fct_campaign_performance", "fct_ad_spend", "fct_klaviyo_revenue",
    "fct_klaviyo_campaign_revenue", "fct_klaviyo_flow_revenue", "fct_ga_sessions",
    "fct_ga_channel_sessions", "fct_ga_source_medium", "fct_brand_monthly_summary",
    "fct_klaviyo_subscriber_growth",
)
# Month column behind the month label of each table.
MONTH_LABELLED = {
    **{t: "order_month" for t in STORE_LABELLED},
    "fct_campaign_performance": "send_month",
    "fct_google_ads_search_terms": "order_month",
}


def kpi_windows(as_of: date) -> dict[str, str]:
    """KPI metrics over the last 30 days and the 30 days before them."""
    recent, before = as_of - timedelta(days=30), as_of - timedelta(days=60)
    inside = {
        "l30d": f"date >= date '{recent}'",
        "p30d": f"date >= date '{before}' and date < date '{recent}'",
    }
    out = {}
    for tag, when in inside.items():
        total = lambda c: f"sum(case when {when} then {c} else 0 end)"  # noqa: B023, E731
        rate = lambda a, b: f"{total(a)} / nullif({total(b)}, 0)"
        out |= {
            f"gross_sales_{tag}": total("gross_sales"),
            f"net_sales_{tag}": total("net_sales"),
            f"orders_{tag}": total("orders"),
            f"new_customer_pct_{tag}": rate("new_customer_orders", "orders"),
            f"ad_spend_{tag}": total("ad_spend"),
            f"blended_roas_{tag}": rate("net_sales", "ad_spend"),
            f"blended_cac_{tag}": rate("ad_spend", "new_customer_orders"),
            f"sessions_{tag}": total("sessions"),
            f"conversion_rate_{tag}": rate("orders", "sessions"),
            f"aov_{tag}": rate("net_sales", "orders"),
        }
    return out


def explores(settings: Settings, as_of: date | None = None) -> dict[str, Explore]:
    metrics = {table: dict(defs) for table, defs in METRICS.items()}
    metrics["fct_marketing_kpis_daily"] = kpi_windows(as_of or date.today())
    for sid in settings.store_ids:
        metrics["dim_customer_unified"][f"total_{sid}_spend"] = f"sum(shopify_{sid}_total_spent)"
    dims: dict[str, dict] = {table: {} for table in metrics}
    labels = settings.display_labels()
    for table in STORE_LABELLED:
        dims[table]["store_id"] = Labelled("store_id", labels)
    for table, month in MONTH_LABELLED.items():
        dims[table]["order_month_label"] = MonthLabel(month)
    dims["fct_orders"]["customer_type"] = lambda: F.when(F.col("is_first_order") == 1, NEW).otherwise(RETURNING)
    dims["fct_ad_spend"]["audience_type"] = Labelled("audience_type", AUDIENCE_LABELS)
    dims["fct_google_ads_search_terms"]["brand_intent"] = Labelled("brand_intent", INTENT_LABELS)
    dims["fct_ga_source_medium"]["channel"] = lambda: classify.source_medium_channel(
        F.col("session_source"), F.col("session_medium")
    )
    dims["fct_klaviyo_subscriber_growth"]["order_month_name"] = lambda: dates.month_name(F.col("order_month"))
    return {table: Explore(table, defs, dims[table]) for table, defs in metrics.items()}
