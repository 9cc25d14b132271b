"""Email attribution, engagement, traffic, spend and KPI facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from merchantry.functions import dates, scalars
from merchantry.operators import combine, ranking, touch
from merchantry.plans import staging_email as email

LOOKBACK_DAYS = 5
TOP_TERMS = 100


def dim_campaigns(campaigns: DataFrame) -> DataFrame:
    return campaigns.filter(F.col("channel") == "email").drop("audiences_included")


def fct_email_revenue(placed: DataFrame, events: DataFrame, metrics: DataFrame) -> DataFrame:
    """Orders credited to the last email opened or clicked in the five days before."""
    engaged = email.named_events(events, metrics, (email.OPENED, email.CLICKED)).filter(
        F.col("campaign_id").isNotNull() | F.col("flow_id").isNotNull()
    )
    touches = engaged.select(
        "store_id", "profile_id", F.col("occurred_at").alias("touched_at"), F.col("event_id").alias("touch_id"),
        "campaign_id", "flow_id",
    )
    orders = placed.select("event_id", "store_id", "profile_id", "occurred_at", "order_month", "revenue")
    found = touch.last_touch(
        orders, touches, ["store_id", "profile_id"], ["event_id"], "occurred_at", "touched_at", "touch_id",
        ["campaign_id", "flow_id"], LOOKBACK_DAYS,
    )
    kind = F.when(F.col("campaign_id").isNotNull(), "campaign").otherwise("flow")
    return found.select(
        "event_id", "store_id", "order_month", "occurred_at", "revenue", kind.alias("attribution_kind"),
        "campaign_id", "flow_id",
    )


def _revenue_by(attributed: DataFrame, names: DataFrame, kind: str) -> DataFrame:
    key, label = f"{kind}_id", f"{kind}_name"
    credited = attributed.filter((F.col("attribution_kind") == kind) & F.col(key).isNotNull())
    monthly = credited.groupBy(key, "store_id", "order_month").agg(F.sum("revenue").alias("revenue"))
    joined = monthly.join(names, ["store_id", key], "left").withColumn(label, F.coalesce(label, key))
    return joined.groupBy(key, label, "store_id", "order_month").agg(F.sum("revenue").alias("revenue"))


def fct_email_campaign_revenue(attributed: DataFrame, events: DataFrame) -> DataFrame:
    """Credited revenue per campaign and month, named from the events themselves.

    The names are first made distinct by hash, so that the greatest, which takes a sort,
    is looked for among few rows.
    """
    names = (
        events.filter(F.col("campaign_id").isNotNull() & F.col("campaign_name").isNotNull())
        .select("store_id", "campaign_id", "campaign_name")
        .distinct()
        .groupBy("store_id", "campaign_id")
        .agg(F.max("campaign_name").alias("campaign_name"))
    )
    return _revenue_by(attributed, names, "campaign")


def fct_email_flow_revenue(attributed: DataFrame, flows: DataFrame) -> DataFrame:
    return _revenue_by(attributed, flows.select("store_id", "flow_id", "flow_name"), "flow")


def fct_campaign_performance(engagement: DataFrame) -> DataFrame:
    delivered = F.col("delivered")
    return engagement.withColumns(
        {
            "open_rate": scalars.div0(F.col("unique_opens"), delivered),
            "click_rate": scalars.div0(F.col("unique_clicks"), delivered),
        }
    )


def fct_subscriber_growth(events: DataFrame, metrics: DataFrame) -> DataFrame:
    changes = email.named_events(
        events.select("store_id", "metric_id", "occurred_date"), metrics, (email.SUBSCRIBED, email.UNSUBSCRIBED)
    )
    monthly = changes.groupBy("store_id", dates.month_start(F.col("occurred_date")).alias("order_month")).agg(
        F.count_if(F.col("metric_name") == email.SUBSCRIBED).alias("subscribers_added"),
        F.count_if(F.col("metric_name") == email.UNSUBSCRIBED).alias("unsubscribes"),
    )
    return monthly.select(
        scalars.surrogate_key(F.col("store_id"), F.col("order_month")).alias("subscriber_growth_id"),
        *monthly.columns,
        (F.col("subscribers_added") - F.col("unsubscribes")).alias("net_subscriber_change"),
    )


def fct_web_sessions(sessions: DataFrame, users: DataFrame, transactions: DataFrame) -> DataFrame:
    day = ["session_date", "store_id"]
    joined = sessions.join(users.select(*day, "users"), day, "left").join(
        transactions.select(*day, "transactions"), day, "left"
    )
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("users", "transactions")})


def fct_brand_monthly_summary(orders: DataFrame, web: DataFrame, transactions: DataFrame) -> DataFrame:
    month = ["store_id", "order_month"]
    per_order = orders.groupBy(*month, "order_id").agg(F.sum("total_price").alias("_price"))
    sides = {
        "shop": per_order.groupBy(*month).agg(
            F.sum("_price").alias("shopify_revenue"), F.count("order_id").alias("shopify_orders")
        ),
        "web": web.groupBy(*month).agg(
            F.sum("sessions").alias("ga_sessions"), F.sum("total_revenue").alias("ga_revenue")
        ),
        "purchases": transactions.groupBy(*month).agg(F.sum("transactions").alias("ga_transactions")),
    }
    zero = ["shopify_revenue", "shopify_orders", "ga_sessions", "ga_revenue", "ga_transactions"]
    merged = combine.spine_join(sides, month, zero)
    sessions = F.col("ga_sessions")
    return merged.withColumns(
        {
            "shopify_cvr_pct": scalars.ratio(F.col("shopify_orders").cast("double"), sessions) * 100,
            "shopify_rps_gbp": scalars.ratio(F.col("shopify_revenue"), sessions),
        }
    )


def fct_marketing_kpis_daily(orders: DataFrame, spend: DataFrame, web: DataFrame, store_id: str) -> DataFrame:
    """Sales, spend and sessions of one store per day, any side may be missing."""
    day = ["date", "store_id"]
    own = F.col("store_id") == store_id
    per_order = (
        orders.filter(own)
        .groupBy(F.col("created_date").alias("date"), "store_id", "order_id")
        .agg(*[F.sum(c).alias(c) for c in ("gross_sales", "net_sales", "is_first_order")])
    )
    sides = {
        "orders": per_order.groupBy(*day).agg(
            F.sum("gross_sales").alias("gross_sales"),
            F.sum("net_sales").alias("net_sales"),
            F.count("order_id").alias("orders"),
            F.sum("is_first_order").alias("new_customer_orders"),
        ),
        "spend": spend.filter(own).groupBy(F.col("spend_date").alias("date"), "store_id").agg(
            F.sum("spend").alias("ad_spend")
        ),
        "sessions": web.filter(own).groupBy(F.col("session_date").alias("date"), "store_id").agg(
            F.sum("sessions").alias("sessions")
        ),
    }
    zero = ["gross_sales", "net_sales", "orders", "new_customer_orders", "ad_spend", "sessions"]
    return combine.spine_join(sides, day, zero)


def fct_search_terms(terms: DataFrame) -> DataFrame:
    """The month's hundred costliest terms, summed per brand intent."""
    grain = ["order_month", "order_month_label", "store_id", "brand_intent"]
    sums = [F.sum(c).alias(c) for c in ("clicks", "cost", "conversions")]
    monthly = terms.groupBy(*grain, "search_term").agg(*sums)
    costliest = ranking.top_n_per_group(
        monthly, ["order_month"], [F.col("cost").desc_nulls_last(), F.col("search_term").asc()], TOP_TERMS
    )
    return costliest.groupBy(*grain).agg(*sums)
