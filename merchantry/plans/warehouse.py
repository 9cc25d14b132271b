"""All tables by name, built lazily from raw exports.

Staging tables are views (lazy DataFrames).  Facts and dimensions are tables: a
``Warehouse`` can write them once and read them back, after which metric
queries and other facts scan the written columns only.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from merchantry.config import Settings
from merchantry.plans import charts, checks, facts_marketing as fm, facts_sales as fs, metrics
from merchantry.plans import staging_crm as crm, staging_email as email, staging_shop as shop
from merchantry.plans import staging_stock as stock, staging_traffic as traffic
from merchantry.plans.semantic import MetricQuery, metric_query
from merchantry.sources.catalog import Catalog
from merchantry.plans.staging_stock import LOADED_AT
from merchantry.sources import sinks
from merchantry.sources.loads import full_refresh, load_health

GA = "google_analytics"
SOURCE_MEDIUM_REPORT = "traffic_acquisition_session_source_medium_report"
CHANNEL_REPORT = "traffic_acquisition_session_default_channel_grouping_report"

Model = Callable[["Warehouse"], DataFrame]

STAGING: dict[str, Model] = {
    "stg_shopify__orders": lambda w: shop.orders(w.stores("shopify", "orders")),
    "stg_shopify__customers": lambda w: shop.customers(w.stores("shopify", "customers")),
    "stg_shopify__order_line_items": lambda w: shop.order_line_items(w.stores("shopify", "order_lines", "orders")),
    "stg_shopify__order_refunds": lambda w: shop.order_refunds(
        w.stores("shopify", "order_refunds", only=w.settings.refund_stores)
    ),
    "stg_klaviyo__events": lambda w: email.events(w.stores("klaviyo", "events")),
    "stg_klaviyo__metrics": lambda w: email.metrics(w.stores("klaviyo", "metrics")),
    "stg_klaviyo__flows": lambda w: email.flows(w.stores("klaviyo", "flows")),
    "stg_klaviyo__campaigns": lambda w: email.campaigns(w.stores("klaviyo", "campaigns")),
    "stg_klaviyo__campaign_stats": lambda w: email.campaign_stats(w.stores("klaviyo", "campaign_values_reports")),
    "stg_klaviyo__placed_orders": lambda w: email.placed_orders(
        w.table("stg_klaviyo__events"), w.table("stg_klaviyo__metrics")
    ),
    "stg_klaviyo__email_engagement": lambda w: email.email_engagement(
        w.table("stg_klaviyo__events"), w.table("stg_klaviyo__metrics")
    ),
    "stg_meta__ads_spend": lambda w: traffic.ads_spend(w.stores("meta", "ads_insights_action_type")),
    "stg_google_analytics__sessions": lambda w: traffic.web_sessions(w.web(SOURCE_MEDIUM_REPORT)),
    "stg_google_analytics__channel_sessions": lambda w: traffic.web_channel_sessions(w.web(CHANNEL_REPORT)),
    "stg_google_analytics__source_medium": lambda w: traffic.web_source_medium(w.web(SOURCE_MEDIUM_REPORT)),
    "stg_google_analytics__transactions": lambda w: traffic.web_transactions(w.web("events_report")),
    "stg_google_analytics__users": lambda w: traffic.web_users(w.web("website_overview")),
    "stg_google_ads__search_terms": lambda w: traffic.search_terms(
        w.raw("google_ads", "search_query_stats", w.settings.search_store),
        w.settings.search_store,
        w.settings.brand_terms,
    ),
    "stg_cin7__sales": lambda w: stock.sales(w.raw("cin7", "sale_list")),
    "stg_cin7__customers": lambda w: stock.customers(w.raw("cin7", "customers")),
    "stg_cin7__customer_addresses": lambda w: stock.customer_addresses(w.raw("cin7", "customers")),
    "stg_prospect_crm__addresses": lambda w: crm.addresses(w.crm("addresses")),
    "stg_prospect_crm__companies": lambda w: crm.companies(w.crm("companies")),
    "stg_prospect_crm__contacts": lambda w: crm.contacts(w.crm("contacts")),
    "stg_prospect_crm__leads": lambda w: crm.leads(w.crm("leads")),
    "stg_prospect_crm__product_items": lambda w: crm.product_items(w.crm("product_items")),
    "stg_prospect_crm__sales_invoices": lambda w: crm.sales_invoices(w.crm("sales_invoice_headers")),
    "stg_prospect_crm__sales_ledgers": lambda w: crm.sales_ledgers(w.crm("sales_ledgers")),
    "stg_prospect_crm__sales_orders": lambda w: crm.sales_orders(
        w.crm("sales_order_headers"), w.settings.demo_ledger
    ),
    "stg_prospect_crm__sales_transactions": lambda w: crm.sales_transactions(w.crm("sales_transactions")),
}

FACTS: dict[str, Model] = {
    "fct_orders": lambda w: fs.fct_orders(w.table("stg_shopify__orders"), w.table("stg_shopify__order_refunds")),
    "dim_customers": lambda w: fs.dim_customers(w.table("stg_shopify__customers"), w.table("stg_shopify__orders")),
    "dim_campaigns": lambda w: fm.dim_campaigns(w.table("stg_klaviyo__campaigns")),
    "dim_cin7_customers": lambda w: fs.dim_stock_customers(
        w.table("stg_cin7__customers"), w.table("stg_cin7__sales")
    ),
    "fct_cin7_sales": lambda w: fs.fct_stock_sales(
        w.table("stg_cin7__sales"), w.table("stg_cin7__customer_addresses")
    ),
    "dim_customer_unified": lambda w: fs.dim_customer_unified(
        w.table("stg_prospect_crm__sales_ledgers"),
        w.table("stg_prospect_crm__contacts"),
        w.table("stg_shopify__customers"),
        w.settings.store_ids,
    ),
    "fct_b2b_sales": lambda w: fs.fct_b2b_sales(
        w.table("stg_prospect_crm__sales_ledgers"),
        w.table("stg_prospect_crm__sales_transactions"),
        w.table("stg_prospect_crm__sales_orders"),
        w.table("stg_prospect_crm__product_items"),
        w.catalog.streamed("prospect_crm", "sales_transactions").select(
            F.col(crm.renames("sales_transactions")["sales_ledger_id"]).alias("sales_ledger_id")
        ),
        None
        if "stg_prospect_crm__sales_transactions" in w.held
        else lambda ledgers: crm.sales_transactions(w.crm("sales_transactions"), ledgers),
        sinks.scratch,
    ),
    "fct_product_sales": lambda w: fs.fct_product_sales(
        w.table("stg_shopify__order_line_items"), w.table("fct_orders")
    ),
    "fct_product_pairs": lambda w: fs.fct_product_pairs(w.table("stg_shopify__order_line_items")),
    "fct_product_repeat_rate": lambda w: fs.fct_product_repeat_rate(w.table("fct_product_sales")),
    "fct_ad_spend": lambda w: w.table("stg_meta__ads_spend"),
    "fct_klaviyo_revenue": lambda w: fm.fct_email_revenue(
        w.table("stg_klaviyo__placed_orders"), w.table("stg_klaviyo__events"), w.table("stg_klaviyo__metrics")
    ),
    "fct_klaviyo_campaign_revenue": lambda w: fm.fct_email_campaign_revenue(
        w.table("fct_klaviyo_revenue"), w.table("stg_klaviyo__events")
    ),
    "fct_klaviyo_flow_revenue": lambda w: fm.fct_email_flow_revenue(
        w.table("fct_klaviyo_revenue"), w.table("stg_klaviyo__flows")
    ),
    "fct_campaign_performance": lambda w: fm.fct_campaign_performance(w.table("stg_klaviyo__email_engagement")),
    "fct_klaviyo_subscriber_growth": lambda w: fm.fct_subscriber_growth(
        w.table("stg_klaviyo__events"), w.table("stg_klaviyo__metrics")
    ),
    "fct_ga_sessions": lambda w: fm.fct_web_sessions(
        w.table("stg_google_analytics__sessions"),
        w.table("stg_google_analytics__users"),
        w.table("stg_google_analytics__transactions"),
    ),
    "fct_ga_channel_sessions": lambda w: w.table("stg_google_analytics__channel_sessions"),
    "fct_ga_source_medium": lambda w: w.table("stg_google_analytics__source_medium"),
    "fct_brand_monthly_summary": lambda w: fm.fct_brand_monthly_summary(
        w.table("fct_orders"), w.table("fct_ga_sessions"), w.table("stg_google_analytics__transactions")
    ),
    "fct_marketing_kpis_daily": lambda w: fm.fct_marketing_kpis_daily(
        w.table("fct_orders"), w.table("fct_ad_spend"), w.table("fct_ga_sessions"), w.settings.primary.store_id
    ),
    "fct_google_ads_search_terms": lambda w: fm.fct_search_terms(w.table("stg_google_ads__search_terms")),
}

MODELS = {**STAGING, **FACTS}


class Warehouse:
    def __init__(self, spark: SparkSession, catalog: Catalog, settings: Settings = Settings()):
        self.spark = spark
        self.catalog = catalog
        self.settings = settings
        self._tables: dict[str, DataFrame] = {}
        self.held: set[str] = set()  # written by ``materialize``

    # raw exports -----------------------------------------------------------
    def raw(self, system: str, table: str, store: str | None = None) -> DataFrame:
        return self.catalog.source(system, table, store)

    def stores(self, system: str, table: str, fallback: str | None = None, only=None) -> dict[str, DataFrame]:
        """Raw frame of every store; ``fallback`` names the table to read where the first is absent."""
        chosen = only or self.settings.store_ids
        out = {}
        for sid in chosen:
            name = table if fallback is None or self.catalog.has(system, table, sid) else fallback
            out[sid] = self.raw(system, name, sid)
        return out

    def web(self, table: str) -> dict[str, DataFrame]:
        return self.stores(GA, table, only=self.settings.web_stores)

    def crm(self, table: str) -> DataFrame:
        return self.raw("prospect_crm", table)

    # tables ----------------------------------------------------------------
    def table(self, name: str) -> DataFrame:
        """A staging table or fact; built on first use, then shared."""
        if name not in self._tables:
            self._tables[name] = MODELS[name](self)
        return self._tables[name]

    def forget_facts(self) -> None:
        """Build facts and dimensions anew when they are next asked for; staging tables stay."""
        for name in FACTS:
            self._tables.pop(name, None)

    def view(self, name: str) -> DataFrame:
        """The table, also registered as a temporary SQL view."""
        df = self.table(name)
        df.createOrReplaceTempView(name)
        return df

    def materialize(self, name: str, folder: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
        """Write a table as a new version and let everything built later read it.

        The table is built anew from what it depends on, so it can be written
        again; readers keep the old version until the new one is complete.
        """
        path = full_refresh(MODELS[name](self), f"{folder.rstrip('/')}/{name}", partition_by=partition_by)
        self._tables[name] = self.spark.read.parquet(path)
        self.held.add(name)
        return self._tables[name]

    # queries ---------------------------------------------------------------
    def query(self, query: MetricQuery, as_of: date | None = None) -> DataFrame:
        as_of = as_of or self.spark.sql("select current_date()").first()[0]  # one clock for windows and filters
        explore = metrics.explores(self.settings, as_of)[query.explore]
        return metric_query(self.table(query.explore), explore, query, as_of)

    def chart(self, name: str, as_of: date | None = None, months: tuple[str, ...] = charts.REPORT_MONTHS) -> DataFrame:
        """A chart by name; ``months`` (as ``yyyy-MM``) are those of the charts over a report year."""
        return self.query(charts.charts(self.settings, months)[name], as_of)

    def health(self, as_of: Column, stale_after_hours: int = 48) -> DataFrame:
        """Rows and last load of every raw table of the catalogue, named ``system[_store].table``."""
        tables = {}
        for system, table, store in self.catalog.tables():
            raw = self.raw(system, table, store)
            loaded = {c.lower(): c for c in raw.columns}.get(LOADED_AT)
            raw = raw if loaded else raw.withColumn(LOADED_AT, F.lit(None).cast("timestamp"))
            tables[f"{system}_{store}.{table}" if store else f"{system}.{table}"] = (raw, loaded or LOADED_AT)
        return load_health(tables, as_of, stale_after_hours)

    def check(self, name: str) -> DataFrame:
        return checks.run_checks(self.table(name), name, checks.DECLARED[name])
