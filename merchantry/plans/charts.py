"""Saved metric queries (charts) and the filters dashboards put across them.

``$s1`` and ``$s2`` in a column name stand for the first and second store id;
``$store`` and ``$label`` for the primary store's id and display label.
"""

from __future__ import annotations

from dataclasses import replace

from merchantry.config import Settings
from merchantry.functions.classify import ORDER_CHANNELS as CHANNEL_CODES
from merchantry.plans.semantic import Calc, Filter, MetricQuery, across_tiles

ORDER_CHANNELS = (*CHANNEL_CODES.values(), "other")
BRAND = Filter("store_id", "equals", ("$label",))
STORE = Filter("store_id", "equals", ("$store",))
LEADS = Filter("is_dtc_b2b_lead", "equals", (True,))
LAST_TWO_MONTHS = Filter("order_month", "inThePast", (2,))
YEAR = Filter("order_month_label", "equals", ("$months",))
# The report year of the subscriber charts.
REPORT_MONTHS = (
    "2025-05", "2025-06", "2025-07", "2025-08", "2025-09", "2025-10", "2025-11", "2025-12",
    "2026-01", "2026-02", "2026-03", "2026-04",
)


def chart(name, explore, dims, metrics, sort, limit, filters=(), calcs=(), pivot=None):
    order = None
    if sort:
        column, way = sort.split()
        order = (column, way == "desc")
    query = MetricQuery(
        explore, tuple(dims.split()), tuple(metrics.split()), tuple(filters), order, limit, tuple(calcs), pivot
    )
    return name, query


# Name, table, dimensions, metrics, sort and row limit of each chart.
CHARTS = [
    chart("active-customers-by-month", "fct_cin7_sales", "order_month", "active_customers", "order_month asc", 24),
    chart("ad-spend", "fct_marketing_kpis_daily", "", "ad_spend_l30d ad_spend_p30d", None, 1, filters=(STORE,), calcs=(Calc("change", "change", "ad_spend_l30d", "ad_spend_p30d"),)),
    chart("aov-by-uk-region-cin7", "fct_cin7_sales", "uk_region", "aov", "aov desc", 15, filters=(Filter("uk_region", "notEquals", ("International",)),)),
    chart("average-order-value-by-channel-cin7", "fct_cin7_sales", "channel_group", "aov", "aov desc", 10),
    chart("average-order-value", "fct_marketing_kpis_daily", "", "aov_l30d aov_p30d", None, 1, filters=(STORE,), calcs=(Calc("change", "change", "aov_l30d", "aov_p30d"),)),
    chart("b2b-accounts-with-highest-dtc-spend", "dim_customer_unified", "display_name country seen_in_shopify_$s1 seen_in_shopify_$s2", "total_dtc_spend total_dtc_orders", "total_dtc_spend desc", 50, filters=(Filter("seen_in_crm", "equals", ("b2b",)),)),
    chart("b2b-customers-also-shopping-dtc", "dim_customer_unified", "customer_universe", "customer_count", "customer_count desc", 10, filters=(Filter("seen_in_crm", "equals", ("b2b",)),)),
    chart("b2b-customers-by-primary-dtc-spend-tier", "dim_customer_unified", "seen_in_shopify_$s1", "customer_count", "customer_count desc", 5, filters=(Filter("seen_in_crm", "equals", ("b2b",)),)),
    chart("b2b-margin-by-category", "fct_b2b_sales", "product_description", "avg_margin_pct", "avg_margin_pct desc", 15),
    chart("b2b-order-status-mix", "fct_b2b_sales", "order_status", "b2b_order_count", "b2b_order_count desc", 10),
    chart("b2b-revenue-by-country", "fct_b2b_sales", "country", "b2b_revenue", "b2b_revenue desc", 15),
    chart("b2b-revenue-by-manufacturer", "fct_b2b_sales", "manufacturer", "b2b_revenue", "b2b_revenue desc", 10),
    chart("b2b-revenue-by-month", "fct_b2b_sales", "order_month", "b2b_revenue b2b_margin", "order_month asc", 24),
    chart("blended-cac", "fct_marketing_kpis_daily", "", "blended_cac_l30d blended_cac_p30d", None, 1, filters=(STORE,), calcs=(Calc("change", "change", "blended_cac_l30d", "blended_cac_p30d"),)),
    chart("blended-roas-mer", "fct_marketing_kpis_daily", "", "blended_roas_l30d blended_roas_p30d", None, 1, filters=(STORE,), calcs=(Calc("change", "change", "blended_roas_l30d", "blended_roas_p30d"),)),
    chart("channel-breakdown-table", "fct_ga_channel_sessions", "channel", "total_ga_channel_revenue total_ga_channel_sessions", "total_ga_channel_revenue desc", 500, calcs=(Calc("pct_of_total", "share", "total_ga_channel_revenue"),)),
    chart("combined-meta-spend", "fct_ad_spend", "", "total_meta_spend", None, 1),
    chart("crm-customers-b2b-vs-b2c", "dim_customer_unified", "seen_in_crm", "customer_count", "customer_count desc", 5),
    chart("customer-mix-aov-split", "fct_orders", "customer_type", "order_count total_gross_sales total_net_sales", "customer_type asc", 500, filters=(BRAND,), calcs=(Calc("pct_orders", "share", "order_count"), Calc("pct_revenue", "share", "total_gross_sales"), Calc("gross_aov", "ratio", "total_gross_sales", "order_count"), Calc("net_aov", "ratio", "total_net_sales", "order_count"),)),
    chart("customer-segments", "dim_cin7_customers", "customer_segment", "customer_count", "customer_count desc", 10),
    chart("customers-by-country", "dim_customer_unified", "country", "customer_count", "customer_count desc", 15),
    chart("customers-by-number-of-channels-used", "dim_cin7_customers", "channels_used", "customer_count", "channels_used asc", 10),
    chart("customers-by-universe", "dim_customer_unified", "customer_universe", "customer_count", "customer_count desc", 10),
    chart("dtc-spend-by-b2b-customers", "dim_customer_unified", "customer_universe", "total_dtc_spend total_dtc_orders", "total_dtc_spend desc", 10, filters=(Filter("seen_in_crm", "equals", ("b2b",)),)),
    chart("gross-sales", "fct_marketing_kpis_daily", "", "gross_sales_l30d gross_sales_p30d", None, 1, filters=(STORE,), calcs=(Calc("change", "change", "gross_sales_l30d", "gross_sales_p30d"),)),
    chart("primary-aov", "fct_orders", "", "gross_aov net_aov", None, 1, filters=(BRAND,), calcs=(Calc("change", "change", "gross_aov", "net_aov"),)),
    chart("primary-attribution-sankey", "fct_ga_source_medium", "channel source_medium", "total_ga_source_medium_revenue", "total_ga_source_medium_revenue desc", 25, filters=(BRAND,)),
    chart("primary-crm-campaign-revenue", "fct_klaviyo_revenue", "", "total_klaviyo_revenue", None, 1, filters=(BRAND, Filter("attribution_kind", "equals", ("campaign",)),)),
    chart("primary-crm-click-rate", "fct_campaign_performance", "", "avg_click_rate", None, 1, filters=(BRAND,)),
    chart("primary-crm-flow-revenue", "fct_klaviyo_revenue", "", "total_klaviyo_revenue", None, 1, filters=(BRAND, Filter("attribution_kind", "equals", ("flow",)),)),
    chart("primary-crm-open-rate", "fct_campaign_performance", "", "avg_open_rate", None, 1, filters=(BRAND,)),
    chart("primary-crm-total-revenue", "fct_klaviyo_revenue", "", "total_klaviyo_revenue", None, 1, filters=(BRAND,)),
    chart("primary-customer-mix", "fct_orders", "", "new_customer_share", None, 1, filters=(BRAND,)),
    chart("primary-ga-aov", "fct_ga_sessions", "", "ga_aov", None, 1, filters=(BRAND,)),
    chart("primary-ga-cvr", "fct_ga_sessions", "", "ga_conversion_rate", None, 1, filters=(BRAND,)),
    chart("primary-ga-rps", "fct_ga_sessions", "", "ga_revenue_per_session", None, 1, filters=(BRAND,)),
    chart("primary-ga-sessions", "fct_ga_sessions", "", "total_ga_sessions", None, 1, filters=(BRAND,)),
    chart("primary-ga-users", "fct_ga_sessions", "", "total_ga_users", None, 1, filters=(BRAND,)),
    chart("primary-ga4-attributed-revenue", "fct_ga_sessions", "", "ga_total_revenue", None, 1, filters=(BRAND,)),
    chart("primary-klaviyo-revenue", "fct_klaviyo_revenue", "", "total_klaviyo_revenue", None, 1, filters=(BRAND,)),
    chart("primary-net-subscriber-change-12mo", "fct_klaviyo_subscriber_growth", "", "total_net_subscriber_change", None, 1, filters=(BRAND, YEAR,)),
    chart("primary-pr-media-highlights", "fct_ga_source_medium", "source_medium", "total_ga_source_medium_sessions total_ga_source_medium_revenue", "total_ga_source_medium_sessions desc", 8, filters=(Filter("session_medium", "equals", ("referral", "quiz",)),)),
    chart("primary-shopify-orders", "fct_orders", "", "order_count", None, 1, filters=(BRAND,)),
    chart("primary-shopify-revenue", "fct_orders", "", "total_gross_sales total_net_sales", None, 1, filters=(BRAND,), calcs=(Calc("change", "change", "total_gross_sales", "total_net_sales"),)),
    chart("primary-subscribers-added-12mo", "fct_klaviyo_subscriber_growth", "", "total_subscribers_added", None, 1, filters=(BRAND, YEAR,)),
    chart("primary-top-converting-sources-by-rps", "fct_ga_source_medium", "source_medium", "total_ga_source_medium_revenue total_ga_source_medium_sessions ga_source_medium_rps", "ga_source_medium_rps desc", 8),
    chart("primary-top-flows", "fct_klaviyo_flow_revenue", "flow_name", "total_flow_revenue", "total_flow_revenue desc", 5, filters=(BRAND,)),
    chart("primary-top-performing-campaigns", "fct_klaviyo_campaign_revenue", "campaign_name", "total_campaign_revenue", "total_campaign_revenue desc", 5, filters=(BRAND,)),
    chart("primary-top-traffic-sources", "fct_ga_source_medium", "source_medium", "total_ga_source_medium_sessions total_ga_source_medium_revenue", "total_ga_source_medium_sessions desc", 8),
    chart("primary-unsubscribes-12mo", "fct_klaviyo_subscriber_growth", "", "total_unsubscribes", None, 1, filters=(BRAND, YEAR,)),
    chart("klaviyo-bridge-contacts-with-klaviyo-profile", "dim_customer_unified", "seen_in_crm", "customer_count", "customer_count desc", 5, filters=(Filter("klaviyo_id", "isNotNull"),)),
    chart("leads-by-country", "dim_customer_unified", "country", "customer_count", "customer_count desc", 10, filters=(LEADS,)),
    chart("likely-b2b-leads-from-dtc", "dim_customer_unified", "is_dtc_b2b_lead", "customer_count", "customer_count desc", 2, filters=(LEADS,)),
    chart("meta-remarketing-vs-acquisition", "fct_ad_spend", "audience_type", "total_meta_spend total_meta_purchases total_meta_revenue", "total_meta_spend desc", 500, filters=(BRAND,), calcs=(Calc("roas", "ratio", "total_meta_revenue", "total_meta_spend"), Calc("cpa", "ratio", "total_meta_spend", "total_meta_purchases"),)),
    chart("meta-spend", "fct_ad_spend", "", "total_meta_spend", None, 1, filters=(BRAND,)),
    chart("multi-channel-customer-ltv", "dim_cin7_customers", "channels_used", "avg_ltv avg_orders_per_customer", "channels_used asc", 10),
    chart("net-sales", "fct_marketing_kpis_daily", "", "net_sales_l30d net_sales_p30d", None, 1, filters=(STORE,), calcs=(Calc("change", "change", "net_sales_l30d", "net_sales_p30d"),)),
    chart("new-customer", "fct_marketing_kpis_daily", "", "new_customer_pct_l30d new_customer_pct_p30d", None, 1, filters=(STORE,), calcs=(Calc("change", "change", "new_customer_pct_l30d", "new_customer_pct_p30d"),)),
    chart("new-vs-repeat-orders-by-channel", "fct_cin7_sales", "channel_group", "order_count new_customer_orders", "order_count desc", 10),
    chart("new-vs-repeat-orders-by-month", "fct_cin7_sales", "order_month", "order_count new_customer_orders", "order_month asc", 24),
    chart("new-vs-returning-orders-cin7", "fct_cin7_sales", "order_month", "order_count new_customer_orders", "order_month asc", 120, calcs=(Calc("return_order_rate", "complement", "new_customer_orders", "order_count"),)),
    chart("orders-by-month-shopify-dtc", "fct_orders", "order_month", "order_count", "order_month asc", 36),
    chart("orders-by-month-shopify", "fct_orders", "order_month", "order_count", "order_month asc", 36),
    chart("orders-by-uk-region-shopify", "fct_product_sales", "uk_region", "order_count", "order_count desc", 15, filters=(Filter("uk_region", "notEquals", ("International",)),)),
    chart("paid-search-shopping", "fct_google_ads_search_terms", "brand_intent", "total_clicks total_cost total_conversions", "total_cost desc", 500, calcs=(Calc("pct_of_cost", "share", "total_cost"),)),
    chart("repeat-buyers-vs-unique-buyers", "fct_product_repeat_rate", "product_title store_id", "total_buyers total_repeat_buyers", "total_buyers desc", 25),
    chart("repeat-rate-distribution", "fct_product_repeat_rate", "product_title store_id", "avg_repeat_rate total_buyers", "avg_repeat_rate desc", 50),
    chart("return-order-rate-cin7-by-channel", "fct_cin7_sales", "order_month channel_group", "order_count new_customer_orders", "order_month asc", 600, calcs=(Calc("return_order_rate", "complement", "new_customer_orders", "order_count"),), pivot=("channel_group", ORDER_CHANNELS)),
    chart("returning-customers-shopify-by-store", "fct_orders", "store_id", "order_count new_customer_orders", "order_count desc", 10),
    chart("revenue-by-channel-cin7", "fct_cin7_sales", "channel_group", "total_revenue", "total_revenue desc", 10),
    chart("revenue-by-customer-segment", "dim_cin7_customers", "customer_segment", "total_customer_ltv", "total_customer_ltv desc", 10),
    chart("revenue-by-store-product-view", "fct_product_sales", "store_id", "product_revenue", "product_revenue desc", 10),
    chart("revenue-by-store-shopify", "fct_orders", "store_id", "total_revenue", "total_revenue desc", 10),
    chart("revenue-by-uk-region-cin7", "fct_cin7_sales", "uk_region", "total_revenue order_count", "total_revenue desc", 15, filters=(Filter("uk_region", "notEquals", ("International",)),)),
    chart("revenue-by-uk-region-shopify", "fct_product_sales", "uk_region", "product_revenue order_count", "product_revenue desc", 15, filters=(Filter("uk_region", "notEquals", ("International",)),)),
    chart("sessions", "fct_marketing_kpis_daily", "", "sessions_l30d sessions_p30d", None, 1, filters=(STORE,), calcs=(Calc("change", "change", "sessions_l30d", "sessions_p30d"),)),
    chart("shopify-conversion-rate", "fct_marketing_kpis_daily", "", "conversion_rate_l30d conversion_rate_p30d", None, 1, filters=(STORE,), calcs=(Calc("change", "change", "conversion_rate_l30d", "conversion_rate_p30d"),)),
    chart("shopify-revenue-by-store-this-vs-last-month", "fct_orders", "store_id order_month", "total_revenue", "total_revenue desc", 10, filters=(LAST_TWO_MONTHS,)),
    chart("subscriber-growth-monthly-bar-chart", "fct_klaviyo_subscriber_growth", "order_month", "total_net_subscriber_change", "order_month asc", 12, filters=(BRAND, YEAR,)),
    chart("subscriber-growth-monthly-table", "fct_klaviyo_subscriber_growth", "order_month order_month_name", "total_subscribers_added total_unsubscribes total_net_subscriber_change", "order_month asc", 12, filters=(BRAND, YEAR,)),
    chart("top-b2b-accounts", "fct_b2b_sales", "customer_name country", "b2b_revenue b2b_margin b2b_order_count", "b2b_revenue desc", 30),
    chart("top-cross-sell-pairs", "fct_product_pairs", "product_a product_b", "times_bought_together", "times_bought_together desc", 25),
    chart("top-customers-by-lifetime-value", "dim_cin7_customers", "customer_name email customer_id", "total_customer_ltv avg_orders_per_customer", "total_customer_ltv desc", 25),
    chart("top-domains-by-dtc-spend", "dim_customer_unified", "email_domain", "total_dtc_spend", "total_dtc_spend desc", 20, filters=(LEADS,)),
    chart("top-domains-by-lead-count", "dim_customer_unified", "email_domain", "customer_count", "customer_count desc", 20, filters=(LEADS,)),
    chart("top-dtc-spenders-crm-presence-flags", "dim_customer_unified", "display_name country seen_in_crm customer_universe", "total_dtc_spend total_dtc_orders", "total_dtc_spend desc", 50),
    chart("top-individual-leads", "dim_customer_unified", "display_name email email_domain country seen_in_shopify_$s1 seen_in_shopify_$s2", "total_dtc_spend total_dtc_orders", "total_dtc_spend desc", 50, filters=(LEADS,)),
    chart("top-products-by-repeat-rate", "fct_product_repeat_rate", "product_title store_id", "avg_repeat_rate", "avg_repeat_rate desc", 20),
    chart("top-products-by-revenue", "fct_product_sales", "product_title", "product_revenue", "product_revenue desc", 20),
    chart("top-products-by-units-sold", "fct_product_sales", "product_title", "units_sold", "units_sold desc", 20),
    chart("total-dtc-spend-by-customer-universe", "dim_customer_unified", "customer_universe", "total_dtc_spend", "total_dtc_spend desc", 10),
    chart("total-orders", "fct_marketing_kpis_daily", "", "orders_l30d orders_p30d", None, 1, filters=(STORE,), calcs=(Calc("change", "change", "orders_l30d", "orders_p30d"),)),
    chart("total-revenue-by-month-cin7", "fct_cin7_sales", "order_month", "total_revenue", "order_month asc", 36),
    chart("total-shopify-revenue-this-vs-last-month", "fct_orders", "order_month", "total_revenue", "order_month asc", 5, filters=(LAST_TWO_MONTHS,)),
    chart("total-uncaptured-dtc-revenue", "dim_customer_unified", "is_dtc_b2b_lead", "total_dtc_spend", "total_dtc_spend desc", 2, filters=(LEADS,)),
    chart("combined-total-sales", "fct_orders", "", "total_revenue", None, 1),
    chart("total-sales-by-brand", "fct_orders", "store_id", "total_revenue", "total_revenue desc", 500),
    chart("combined-orders", "fct_orders", "", "order_count", None, 1),
    chart("spend-by-brand", "fct_ad_spend", "store_id", "total_meta_spend", "total_meta_spend desc", 10),
    chart("web-revenue-by-brand", "fct_ga_sessions", "store_id", "ga_total_revenue", "ga_total_revenue desc", 10),
    chart("cross-brand-month", "fct_brand_monthly_summary", "store_id shopify_revenue shopify_orders ga_sessions ga_transactions shopify_cvr_pct shopify_rps_gbp", "", "shopify_revenue desc", 10),
]

# Charts under the report's month filter, and the month column of
# those that do not use ``order_month``.
REPORT_CHARTS = (
    "combined-total-sales", "combined-orders", "primary-shopify-revenue", "primary-shopify-orders", "meta-spend",
    "primary-klaviyo-revenue", "primary-ga4-attributed-revenue", "channel-breakdown-table", "primary-ga-sessions",
    "primary-ga-users", "primary-ga-cvr", "primary-ga-rps", "primary-ga-aov", "primary-top-traffic-sources",
    "primary-top-converting-sources-by-rps", "primary-pr-media-highlights", "primary-customer-mix", "primary-aov",
    "customer-mix-aov-split", "meta-remarketing-vs-acquisition", "paid-search-shopping",
    "primary-crm-total-revenue", "primary-crm-campaign-revenue", "primary-crm-flow-revenue",
    "primary-crm-open-rate", "primary-crm-click-rate", "primary-top-performing-campaigns", "primary-top-flows",
)
REPORT_MONTH_COLUMNS = {"primary-crm-open-rate": "send_month", "primary-crm-click-rate": "send_month"}
ATTRIBUTION_CHARTS = ("primary-attribution-sankey",)


def _bind(text, settings: Settings):
    if not isinstance(text, str):
        return text
    names = {"$label": settings.primary.label, "$store": settings.primary.store_id}
    for i, sid in enumerate(settings.store_ids, start=1):
        names[f"$s{i}"] = sid
    for mark, value in names.items():
        text = text.replace(mark, value)
    return text


def _bind_filter(f: Filter, settings: Settings, months: tuple[str, ...]) -> Filter:
    if f.values == ("$months",):
        return replace(f, values=tuple(months))
    return replace(f, values=tuple(_bind(v, settings) for v in f.values))


def charts(settings: Settings, months: tuple[str, ...] = REPORT_MONTHS) -> dict[str, MetricQuery]:
    """Every chart with the deployment's store names and the report months put in."""
    return {
        name: replace(
            query,
            dims=tuple(_bind(d, settings) for d in query.dims),
            filters=tuple(_bind_filter(f, settings, months) for f in query.filters),
        )
        for name, query in CHARTS
    }


def monthly_report(settings: Settings, first_day: str, last_day: str) -> dict[str, MetricQuery]:
    """The report's charts with its month filter applied to each one's own column."""
    every = charts(settings)
    chosen = {name: every[name] for name in REPORT_CHARTS}
    return across_tiles(chosen, Filter("order_month", "inBetween", (first_day, last_day)), REPORT_MONTH_COLUMNS)


def attribution_report(settings: Settings, first_day: str, last_day: str) -> dict[str, MetricQuery]:
    every = charts(settings)
    chosen = {name: every[name] for name in ATTRIBUTION_CHARTS}
    return across_tiles(chosen, Filter("order_month", "inBetween", (first_day, last_day)), {})
