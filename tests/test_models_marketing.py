from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from merchantry.plans import facts_marketing as fm, staging_email as email, staging_traffic as traffic
from tests.conftest import rows

T0 = datetime(2024, 1, 31, 23)
EVENT = (
    "event_id string, store_id string, profile_id string, metric_id string, occurred_at timestamp, occurred_date date, order_id string, "
    "order_value double, order_currency string, campaign_id string, flow_id string, message_id string, campaign_name string"
)


def event(id_, metric, who="p", at=T0, order=None, value=None, camp=None, flow=None, msg=None, name=None, store="alpha"):
    return (id_, store, who, metric, at, at.date(), order, value, "GBP", camp, flow, msg, name)


def catalogue(spark):
    names = [email.RECEIVED, email.OPENED, email.CLICKED, email.PLACED_ORDER, email.SUBSCRIBED, email.UNSUBSCRIBED]
    data = [(f"m{i}", n, "alpha") for i, n in enumerate(names)] + [("m9", email.PLACED_ORDER, "alpha"), ("m3", "Other", "beta")]
    return spark.createDataFrame(data, "metric_id string, metric_name string, store_id string")


def events(spark, *items):
    return spark.createDataFrame(list(items), EVENT)


def test_placed_orders_keep_one_event_per_order(spark):
    ev = events(
        spark, event("e1", "m3", order="o1", value=5.0), event("e2", "m9", order="o1", value=5.0, at=T0 + timedelta(seconds=1)),
        event("e3", "m3", value=1.0), event("e4", "m3", value=2.0), event("e5", "m3", order="o2", store="beta"), event("e6", "m1", order="o3"),
    )
    got = email.placed_orders(ev, catalogue(spark))
    assert rows(got, "event_id", "order_month", "revenue") == [
        ("e1", date(2024, 1, 1), 5.0), ("e3", date(2024, 1, 1), 1.0), ("e4", date(2024, 1, 1), 2.0),
    ]
    merged = email.placed_orders(ev, catalogue(spark), merge_missing_ids=True)
    assert rows(merged, "event_id") == [("e1",), ("e3",)]


def test_engagement_counts_pairs_once(spark):
    ev = events(
        spark, event("a", "m0", msg="x"), event("b", "m0", msg="x"), event("c", "m1", msg="x"), event("d", "m1", msg="x"),
        event("e", "m1", msg="y"), event("f", "m1"), event("g", "m2", msg="x", who=None), event("h", "m2", msg="x", who="q"),
    )
    got = email.email_engagement(ev, catalogue(spark))
    assert rows(got) == [("alpha|2024-01", "alpha", date(2024, 1, 1), 2, 2, 1)]
    perf = fm.fct_campaign_performance(got)
    assert rows(perf, "open_rate", "click_rate") == [(1.0, 0.5)]


def attribution(spark):
    ev = events(
        spark,
        event("o1", "m3", order="1", value=10.0), event("o2", "m3", order="2", value=7.0, who="q"), event("o3", "m3", order="3", value=3.0, who="z"),
        event("t1", "m1", at=T0 - timedelta(days=5), camp="c1", name="Sale"), event("t2", "m2", at=T0 - timedelta(days=2), flow="f1"),
        event("t3", "m1", at=T0 - timedelta(days=1)), event("t4", "m1", at=T0 + timedelta(seconds=1), camp="c9"),
        event("t5", "m1", at=T0 - timedelta(days=4, hours=23), camp="c1", who="q"), event("t6", "m0", at=T0, camp="c8", who="q"),
    )
    placed = email.placed_orders(ev, catalogue(spark))
    return ev, fm.fct_email_revenue(placed, ev, catalogue(spark))


def test_last_touch_attribution(spark):
    ev, got = attribution(spark)
    assert rows(got, "event_id", "attribution_kind", "campaign_id", "flow_id", "revenue") == [
        ("o1", "flow", None, "f1", 10.0), ("o2", "campaign", "c1", None, 7.0),
    ]
    campaigns = fm.fct_email_campaign_revenue(got, ev)
    assert rows(campaigns, "campaign_id", "campaign_name", "revenue") == [("c1", "Sale", 7.0)]
    flows = spark.createDataFrame([("alpha", "f1", None), ("beta", "f1", "Wrong")], "store_id string, flow_id string, flow_name string")
    assert rows(fm.fct_email_flow_revenue(got, flows), "flow_name", "revenue") == [("f1", 10.0)]


def test_subscriber_growth(spark):
    ev = events(spark, event("a", "m4"), event("b", "m4"), event("c", "m5"), event("d", "m4", at=T0 + timedelta(days=1)))
    got = fm.fct_subscriber_growth(ev, catalogue(spark))
    assert rows(got, "order_month", "subscribers_added", "unsubscribes", "net_subscriber_change") == [
        (date(2024, 1, 1), 2, 1, 1), (date(2024, 2, 1), 1, 0, 1),
    ]
    assert got.select("subscriber_growth_id").distinct().count() == 2


def test_ads_spend_sums_inside_the_row(spark):
    schema = (
        "date_start date, campaign_name string, adset_name string, spend double, impressions bigint, clicks bigint, "
        f"actions {traffic.ACTIONS}, action_values {traffic.ACTIONS}"
    )
    day = date(2024, 1, 5)
    raw = spark.createDataFrame(
        [
            (day, "Retargeting", "Prospecting", 1.0, 10, 1, [("purchase", "2"), ("click", "9"), ("purchase", "1")], [("purchase", "50.5")]),
            (day, "retargeting", "x", 2.0, 10, 1, None, []), (day, "Lookalike", None, 4.0, 1, 1, [("purchase", None)], None),
            (None, "x", "y", 9.0, 1, 1, None, None),
        ],
        schema,
    )
    got = traffic.ads_spend({"alpha": raw})
    assert rows(got, "audience_type", "spend", "impressions", "purchases", "purchase_value", "order_month") == [
        ("other", 4.0, 1, 0.0, 0.0, date(2024, 1, 1)), ("remarketing", 3.0, 20, 3.0, 50.5, date(2024, 1, 1)),
    ]
    as_text = raw.withColumns({c: F.to_json(c) for c in ("actions", "action_values")})
    assert rows(traffic.ads_spend({"alpha": as_text})) == rows(got)


def test_web_models(spark):
    report = spark.createDataFrame(
        [("20240105", "google", "organic", 3, 2, 5.0), ("20240105", "google", "cpc", 4, 1, 0.0), (None, "x", "y", 9, 9, 9.0)],
        "date string, sessionsource string, sessionmedium string, sessions bigint, engagedsessions bigint, totalrevenue double",
    )
    day = date(2024, 1, 5)
    sessions = traffic.web_sessions({"alpha": report})
    assert rows(sessions, "session_date", "sessions", "engaged_sessions", "total_revenue") == [(day, 7, 3, 5.0)]
    assert rows(traffic.web_source_medium({"alpha": report}), "source_medium", "sessions") == [("google / cpc", 4), ("google / organic", 3)]
    counts = spark.createDataFrame([("20240106", "purchase", 2), ("20240105", "scroll", 5)], "date string, eventname string, eventcount bigint")
    bought = traffic.web_transactions({"alpha": counts})
    users = traffic.web_users({"alpha": spark.createDataFrame([("20240105", 6)], "date string, totalusers bigint")})
    assert rows(fm.fct_web_sessions(sessions, users, bought), "session_date", "users", "transactions") == [(day, 6, 0)]


def test_search_terms_top_hundred(spark):
    data = [("2024-01-05 x", f" Term {i:03d}", 1, 1_000_000 * (i // 2), 0.5) for i in range(130)] + [
        ("2024-01-06", " term 129", 1, 5_000_000, 0.5), ("bad", "t", 1, 1, 0.0), (None, "t", 1, 1, 0.0), ("2024-01-06", None, 1, 1, 0.0),
    ]
    raw = spark.createDataFrame(
        data, "segments_date string, search_term_view_search_term string, metrics_clicks bigint, metrics_cost_micros bigint, metrics_conversions double"
    )
    daily = traffic.search_terms(raw, "alpha", ("term 129", "term 0"))
    assert daily.filter("search_term = 'term 129'").count() == 2 and daily.filter("search_date is null").count() == 1
    got = fm.fct_search_terms(daily).filter("order_month is not null")
    # the cut at 100 keeps terms 30..129; terms 030-099 and 129 are branded
    assert rows(got, "brand_intent", "clicks") == [("branded", 72), ("non_branded", 29)]


def test_monthly_and_daily_spines(spark):
    orders = spark.createDataFrame(
        [(1, "alpha", 10.0, 12.0, 9.0, 1, date(2024, 1, 2)), (2, "beta", 5.0, 5.0, 5.0, 1, date(2024, 2, 2))],
        "order_id bigint, store_id string, total_price double, gross_sales double, net_sales double, is_first_order int, created_date date",
    ).withColumn("order_month", F.trunc("created_date", "MM"))
    web = spark.createDataFrame(
        [(date(2024, 1, 3), "alpha", 4, 2.0), (date(2024, 3, 1), "alpha", 0, 0.0)], "session_date date, store_id string, sessions bigint, total_revenue double"
    ).withColumn("order_month", F.trunc("session_date", "MM"))
    buys = spark.createDataFrame([(date(2024, 4, 1), "alpha", 3)], "order_month date, store_id string, transactions bigint")
    got = fm.fct_brand_monthly_summary(orders, web, buys)
    assert rows(got, "order_month", "shopify_orders", "ga_sessions", "ga_transactions", "shopify_cvr_pct", "shopify_rps_gbp") == [
        (date(2024, 1, 1), 1, 4, 0, 25.0, 2.5), (date(2024, 2, 1), 1, 0, 0, None, None), (date(2024, 3, 1), 0, 0, 0, None, None),
        (date(2024, 4, 1), 0, 0, 3, None, None),
    ]
    spend = spark.createDataFrame([(date(2024, 1, 2), "alpha", 7.0), (date(2024, 1, 9), "alpha", 1.0)], "spend_date date, store_id string, spend double")
    daily = fm.fct_marketing_kpis_daily(orders, spend, web, "alpha")
    assert rows(daily, "date", "gross_sales", "orders", "ad_spend", "sessions") == [
        (date(2024, 1, 2), 12.0, 1, 7.0, 0), (date(2024, 1, 3), 0.0, 0, 0.0, 4), (date(2024, 1, 9), 0.0, 0, 1.0, 0), (date(2024, 3, 1), 0.0, 0, 0.0, 0),
    ]


def test_campaign_catalogue(spark):
    doc = '{"name": "N", "status": "Sent", "channel": "%s", "send_time": "2024-01-01T00:00:00Z", "audiences": {"included": ["a", "b"]}}'
    raw = spark.createDataFrame([("c1", doc % "email"), ("c2", doc % "sms")], "id string, attributes string")
    got = email.campaigns({"alpha": raw})
    assert rows(got, "campaign_id", "audiences_included") == [("c1", '["a","b"]'), ("c2", '["a","b"]')]
    assert rows(fm.dim_campaigns(got), "campaign_id") == [("c1",)]
