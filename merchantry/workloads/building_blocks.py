"""The operators themselves over the benchmark tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from merchantry.functions import classify, dates, regions, scalars
from merchantry.operators import combine, ranking, touch
from merchantry.plans import semantic, staging_email
from merchantry.plans.checks import Checks, run_checks
from merchantry.plans.semantic import Calc, Explore, Filter, MetricQuery, metric_query
from merchantry.session import prepare, shared_folder
from merchantry.sources import audit, loads, purge, sinks
from merchantry.sources.catalog import Catalog
from merchantry.streaming import jobs
from merchantry.workloads.exports import DOMAINS, SETTINGS, SOURCES, ZIPS, Exports, pick
from merchantry.workloads.oracle import COLUMNS, REGION, _area, _month, _pick, with_views
from merchantry.workloads.present import present, present_sql

BLOCKS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = prepare(spark), folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def landed(self, rows: DataFrame) -> DataFrame:
        """Rows as a stream of landed files in four batches, dealt by a hash: rows of any time are in any batch."""
        folder, files = shared_folder(self.spark, "landed"), int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows.repartition(files, F.xxhash64(*rows.columns)).write.parquet(folder)
        return jobs.read_files(self.spark, folder, rows.schema, files_per_batch=-(-files // 4))


def block(name: str, sql: str | None = None, columns: str | None = None):
    def keep(build: Callable[[Tables], DataFrame]):
        BLOCKS[name] = lambda spark, folder: present(build(Tables(spark, folder)))
        if sql:
            SQL[name] = present_sql(f"({sql.strip()}) as result", columns) if columns else sql.strip()
        return build

    return keep


# keys, ranks, sequences -----------------------------------------------------------
@block(
    "latest_line_per_key",
    """
    select * from lineitem qualify row_number() over (partition by l_orderkey, l_linenumber
      order by l_shipdate desc nulls last, l_partkey desc, l_suppkey desc, l_extendedprice desc) = 1
    """,
    "n:l_orderkey n:l_linenumber n:l_partkey n:l_suppkey r:l_extendedprice t:l_shipdate",
)
def _(t):
    cut = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    ties = [F.col(c).desc() for c in ("l_partkey", "l_suppkey", "l_extendedprice")]
    return ranking.latest_per_key(cut, ["l_orderkey", "l_linenumber"], "l_shipdate", ties)


@block(
    "order_seq_per_customer",
    """
    select o_orderkey, o_custkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as seq,
      if(row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) = 1, 1, 0) as is_first from orders
    """,
    "n:o_orderkey n:o_custkey n:seq n:is_first",
)
def _(t):
    out = ranking.sequence_per_key(
        t.orders.select("o_orderkey", "o_custkey", "o_orderdate"), ["o_custkey"], "o_orderdate", ["o_orderkey"], "seq"
    )
    return out.select("o_orderkey", "o_custkey", "seq", (F.col("seq") == 1).cast("int").alias("is_first"))


@block(
    "first_order_mark",
    """
    select o_orderkey, if(row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) = 1, 1, 0) as is_first_order
    from orders
    """,
    "n:o_orderkey n:is_first_order",
)
def _(t):
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    marked = ranking.mark_first(orders, ["o_custkey"], "o_orderdate", ["o_orderkey"], "is_first_order")
    return marked.select("o_orderkey", "is_first_order")


@block(
    "first_event_per_key",
    """
    select user_id, props, event_id, ts, value from events where event_type = 'purchase'
    qualify row_number() over (partition by user_id, props order by ts, event_id) = 1
    """,
    "n:user_id props n:event_id t:ts r:value",
)
def _(t):
    bought = t.events.filter(F.col("event_type") == "purchase").select("user_id", "props", "event_id", "ts", "value")
    return ranking.top_n_per_group(bought, ["user_id", "props"], [F.col("ts").asc(), F.col("event_id").asc()])


@block(
    "top_parts_per_month",
    f"""
    with cost as (
      select {_month('l_shipdate')} as month, l_partkey, sum(l_extendedprice) as cost from lineitem group by 1, 2),
    top as (select * from cost qualify row_number() over (partition by month order by cost desc, l_partkey) <= 100)
    select month, case when p_name like '%red %' or p_name like '%ring%' then 'branded' else 'non_branded' end as intent,
      count(*) as parts, sum(cost) as cost from top join part on p_partkey = l_partkey group by 1, 2
    """,
    "d:month intent n:parts r:cost",
)
def _(t):
    monthly = t.lineitem.groupBy(dates.month_start(F.col("l_shipdate")).alias("month"), "l_partkey").agg(
        F.sum("l_extendedprice").alias("cost")
    )
    top = ranking.top_n_per_group(monthly, ["month"], [F.col("cost").desc_nulls_last(), F.col("l_partkey").asc()], 100)
    named = top.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    intent = classify.brand_intent(F.col("p_name"), ("red ", "ring"))
    return named.groupBy("month", intent.alias("intent")).agg(F.count(F.lit(1)).alias("parts"), F.sum("cost").alias("cost"))


# joins ------------------------------------------------------------------------------
TOUCH_SQL = """
    select p.event_id, p.user_id, p.value, t.event_id as touch_id, t.event_type as touch_kind
    from events p join events t on p.event_type = 'purchase' and t.event_type in ('view', 'click') and t.user_id = p.user_id
      and t.ts between p.ts - interval 5 day and p.ts
    qualify row_number() over (partition by p.event_id order by t.ts desc, t.event_id desc) = 1
"""


def _touched(t: Tables) -> DataFrame:
    orders = t.events.filter(F.col("event_type") == "purchase").select("event_id", "user_id", "ts", "value")
    touches = t.events.filter(F.col("event_type").isin("view", "click")).select(
        "user_id", F.col("ts").alias("touched_at"), F.col("event_id").alias("touch_id"), F.col("event_type").alias("touch_kind")
    )
    return touch.last_touch(
        orders, touches, ["user_id"], ["event_id"], "ts", "touched_at", "touch_id", ["touch_id", "touch_kind"]
    )


@block("last_touch_5d", TOUCH_SQL, "n:event_id n:user_id r:value n:touch_id touch_kind")
def _(t):
    return _touched(t).select("event_id", "user_id", "value", "touch_id", "touch_kind")


@block(
    "touch_revenue_by_kind",
    f"select touch_kind, count(*) as orders, sum(value) as revenue from ({TOUCH_SQL}) as x group by 1",
    "touch_kind n:orders r:revenue",
)
def _(t):
    return _touched(t).groupBy("touch_kind").agg(F.count(F.lit(1)).alias("orders"), F.sum("value").alias("revenue"))


@block(
    "part_pairs",
    """
    with items as (select distinct l_orderkey, l_partkey from lineitem)
    select a.l_partkey as part_a, b.l_partkey as part_b, count(*) as together
    from items a join items b on a.l_orderkey = b.l_orderkey and a.l_partkey < b.l_partkey group by 1, 2
    """,
    "n:part_a n:part_b n:together",
)
def _(t):
    pairs = combine.pairs_within(t.lineitem, ["l_orderkey"], "l_partkey", [])
    return pairs.select(F.col("l_partkey_a").alias("part_a"), F.col("l_partkey_b").alias("part_b"), "together")


@block(
    "order_lines_by_segment",
    """
    select l_orderkey, l_linenumber, l_partkey, l_extendedprice, c_mktsegment, coalesce(p_name, 'unknown') as p_name, o_orderstatus
    from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey
      left join part on p_partkey = l_partkey
    """,
    "n:l_orderkey n:l_linenumber n:l_partkey r:l_extendedprice c_mktsegment p_name o_orderstatus",
)
def _(t):
    buyers = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    heads = t.orders.select("o_custkey", F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus").join(buyers, "o_custkey")
    parts = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_name")
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    joined = lines.join(heads, "l_orderkey").join(parts, "l_partkey", "left")
    return joined.withColumn("p_name", F.coalesce("p_name", F.lit("unknown"))).drop("o_custkey")


@block(
    "spine_daily_kpis",
    """
    with sold as (select cast(o_orderdate as date) as day, count(*) as orders, sum(o_totalprice) as sales from orders group by 1),
    seen as (select cast(ts as date) as day, count(*) as events from events group by 1),
    sent as (select cast(l_shipdate as date) as day, sum(l_quantity) as units from lineitem group by 1),
    days as (select day from sold union select day from seen union select day from sent)
    select day, coalesce(orders, 0) as orders, coalesce(sales, 0) as sales, coalesce(events, 0) as events, coalesce(units, 0) as units
    from days left join sold using (day) left join seen using (day) left join sent using (day)
    """,
    "d:day n:orders r:sales n:events r:units",
)
def _(t):
    day = lambda c: F.to_date(c).alias("day")
    sides = {
        "orders": t.orders.groupBy(day("o_orderdate")).agg(F.count(F.lit(1)).alias("orders"), F.sum("o_totalprice").alias("sales")),
        "events": t.events.groupBy(day("ts")).agg(F.count(F.lit(1)).alias("events")),
        "units": t.lineitem.groupBy(day("l_shipdate")).agg(F.sum("l_quantity").alias("units")),
    }
    return combine.spine_join(sides, ["day"], ["orders", "sales", "events", "units"])


@block(
    "spine_nation_month",
    f"""
    with bought as (
      select c_nationkey as nation, {_month('o_orderdate')} as month, sum(o_totalprice) as bought
      from orders join customer on c_custkey = o_custkey group by 1, 2),
    sold as (
      select s_nationkey as nation, {_month('l_shipdate')} as month, sum(l_extendedprice) as sold
      from lineitem join supplier on s_suppkey = l_suppkey group by 1, 2),
    axis as (select nation, month from bought union select nation, month from sold)
    select nation, month, coalesce(bought, 0) as bought, coalesce(sold, 0) as sold,
      coalesce(bought, 0) / nullif(coalesce(sold, 0), 0) as bought_per_sold
    from axis left join bought using (nation, month) left join sold using (nation, month)
    """,
    "n:nation d:month r:bought r:sold r:bought_per_sold",
)
def _(t):
    buyers = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation"))
    sellers = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("nation"))
    # sums per entity and month come first, so the joins carry one row of each
    bought = t.orders.groupBy("o_custkey", dates.month_start(F.col("o_orderdate")).alias("month")).agg(F.sum("o_totalprice").alias("v"))
    sold = t.lineitem.groupBy("l_suppkey", dates.month_start(F.col("l_shipdate")).alias("month")).agg(F.sum("l_extendedprice").alias("v"))
    sides = {
        "bought": bought.join(buyers, "o_custkey").groupBy("nation", "month").agg(F.sum("v").alias("bought")),
        "sold": sold.join(sellers, "l_suppkey").groupBy("nation", "month").agg(F.sum("v").alias("sold")),
    }
    merged = combine.spine_join(sides, ["nation", "month"], ["bought", "sold"])
    return merged.withColumn("bought_per_sold", scalars.ratio(F.col("bought"), F.col("sold")))


@block(
    "full_outer_two_grains",
    """
    with a as (select l_orderkey, sum(l_extendedprice) as money from lineitem where l_returnflag = 'R' group by 1),
    b as (select l_orderkey, sum(l_quantity) as goods from lineitem where l_linestatus = 'O' group by 1)
    select coalesce(a.l_orderkey, b.l_orderkey) as l_orderkey, coalesce(money, 0) as money, coalesce(goods, 0) as goods
    from a full join b on a.l_orderkey = b.l_orderkey
    """,
    "n:l_orderkey r:money r:goods",
)
def _(t):
    returned, open_ = F.col("l_returnflag") == "R", F.col("l_linestatus") == "O"
    rows = t.lineitem.filter(returned | open_)
    return rows.groupBy("l_orderkey").agg(
        F.coalesce(F.sum(F.when(returned, F.col("l_extendedprice"))), F.lit(0.0)).alias("money"),
        F.coalesce(F.sum(F.when(open_, F.col("l_quantity"))), F.lit(0.0)).alias("goods"),
    )


@block(
    "customers_without_orders",
    "select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'F' and o_custkey is not null)",
    "n:c_custkey c_name",
)
def _(t):
    ordered = t.orders.filter(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("c_custkey"))
    return audit.purge(t.customer.select("c_custkey", "c_name"), ordered, "c_custkey", "c_custkey")


# aggregates ---------------------------------------------------------------------------
@block(
    "customer_lifetime",
    """
    select c_custkey, count(o_orderkey) as lifetime_orders, coalesce(sum(o_totalprice), 0) as lifetime_revenue,
      min(o_orderdate) as first_order_at, max(o_orderdate) as last_order_at, count(distinct o_orderpriority) as channels_used,
      case when count(o_orderkey) = 0 then 'no_orders' when count(o_orderkey) = 1 then 'one_time'
        when count(o_orderkey) <= 4 then 'occasional' else 'loyal' end as segment
    from customer left join orders on o_custkey = c_custkey group by 1
    """,
    "n:c_custkey n:lifetime_orders r:lifetime_revenue t:first_order_at t:last_order_at n:channels_used segment",
)
def _(t):
    per_channel = t.orders.groupBy("o_custkey", "o_orderpriority").agg(
        F.count("o_orderkey").alias("n"), F.sum("o_totalprice").alias("v"),
        F.min("o_orderdate").alias("lo"), F.max("o_orderdate").alias("hi"),
    )
    life = per_channel.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.sum("n").alias("lifetime_orders"), F.sum("v").alias("lifetime_revenue"), F.min("lo").alias("first_order_at"),
        F.max("hi").alias("last_order_at"), F.count("o_orderpriority").alias("channels_used"),
    )
    joined = t.customer.select("c_custkey").join(life, "c_custkey", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("lifetime_orders", "channels_used")}
    zero["lifetime_revenue"] = F.coalesce("lifetime_revenue", F.lit(0.0))
    return joined.withColumns(zero).withColumn("segment", classify.lifetime_segment(F.col("lifetime_orders")))


@block(
    "engagement_daily",
    """
    select cast(ts as date) as day, count(*) filter (event_type = 'signup') as delivered,
      count(distinct user_id || '|' || props) filter (event_type = 'view') as unique_opens,
      count(distinct user_id || '|' || props) filter (event_type = 'click') as unique_clicks,
      count(distinct user_id || '|' || props) filter (event_type = 'view') / nullif(count(*) filter (event_type = 'signup'), 0) as open_rate
    from events where event_type in ('signup', 'view', 'click') group by 1
    """,
    "d:day n:delivered n:unique_opens n:unique_clicks r:open_rate",
)
def _(t):
    kind = F.col("event_type")
    fine = (
        t.events.filter(kind.isin("signup", "view", "click"))
        .groupBy(F.to_date("ts").alias("day"), "event_type", "user_id", "props")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    daily = fine.groupBy("day").agg(
        F.coalesce(F.sum(F.when(kind == "signup", F.col("n"))), F.lit(0)).alias("delivered"),
        F.count_if(kind == "view").alias("unique_opens"),
        F.count_if(kind == "click").alias("unique_clicks"),
    )
    return daily.withColumn("open_rate", scalars.ratio(F.col("unique_opens"), F.col("delivered")))


@block(
    "net_signup_growth",
    """
    select md5(cast(cast(ts as date) as varchar) || '-' || 'all') as growth_id, cast(ts as date) as day,
      count(*) filter (event_type = 'signup') as added, count(*) filter (event_type = 'error') as removed,
      count(*) filter (event_type = 'signup') - count(*) filter (event_type = 'error') as net
    from events where event_type in ('signup', 'error') group by all
    """,
    "growth_id d:day n:added n:removed n:net",
)
def _(t):
    kind = F.col("event_type")
    daily = t.events.filter(kind.isin("signup", "error")).groupBy(F.to_date("ts").alias("day")).agg(
        F.count_if(kind == "signup").alias("added"), F.count_if(kind == "error").alias("removed")
    )
    key = scalars.surrogate_key(F.col("day"), F.lit("all"))
    return daily.select(key.alias("growth_id"), "day", "added", "removed", (F.col("added") - F.col("removed")).alias("net"))


@block(
    "repeat_rate_per_part",
    """
    with buys as (
      select l_partkey, o_custkey, count(distinct l_orderkey) as times from lineitem join orders on o_orderkey = l_orderkey group by 1, 2)
    select l_partkey, count(*) as buyers, count(*) filter (times > 1) as repeat_buyers,
      round(100.0 * count(*) filter (times > 1) / count(*), 1) as rate from buys group by 1
    """,
    "n:l_partkey n:buyers n:repeat_buyers r:rate",
)
def _(t):
    heads = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    bought = t.lineitem.select("l_orderkey", "l_partkey").distinct().join(heads, "l_orderkey")
    per_buyer = bought.groupBy("l_partkey", "o_custkey").agg(F.count(F.lit(1)).alias("times"))
    out = per_buyer.groupBy("l_partkey").agg(
        F.count(F.lit(1)).alias("buyers"), F.count_if(F.col("times") > 1).alias("repeat_buyers")
    )
    return out.withColumn("rate", scalars.percent(F.col("repeat_buyers"), F.col("buyers")))


@block(
    "global_totals",
    """
    select count(*) as lines, sum(l_extendedprice) as money, avg(l_quantity) as quantity, min(l_shipdate) as first_day,
      max(l_shipdate) as last_day, sum(if(l_returnflag = 'R', l_extendedprice, 0)) as returned,
      sum(l_tax) / nullif(sum(l_discount), 0) as tax_per_discount, bool_or(l_quantity = 50) as any_full from lineitem
    """,
    "n:lines r:money r:quantity t:first_day t:last_day r:returned r:tax_per_discount any_full",
)
def _(t):
    price = F.col("l_extendedprice")
    return t.lineitem.agg(
        F.count(F.lit(1)).alias("lines"), F.sum(price).alias("money"), F.avg("l_quantity").alias("quantity"),
        F.min("l_shipdate").alias("first_day"), F.max("l_shipdate").alias("last_day"),
        F.sum(F.when(F.col("l_returnflag") == "R", price).otherwise(0)).alias("returned"),
        scalars.ratio(F.sum("l_tax"), F.sum("l_discount")).alias("tax_per_discount"),
        F.bool_or(F.col("l_quantity") == 50).alias("any_full"),
    )


# metric queries -------------------------------------------------------------------------
ORDERS = Explore(
    "orders",
    {
        "order_count": "count(distinct o_orderkey)",
        "revenue": "sum(o_totalprice)",
        "aov": "avg(o_totalprice)",
        "open_orders": "sum(case when o_orderstatus = 'O' then 1 else 0 end)",
        "recent": "sum(case when o_orderdate >= date '2001-07-01' then o_totalprice else 0 end)",
        "before": "sum(case when o_orderdate >= date '2001-06-01' and o_orderdate < date '2001-07-01' then o_totalprice else 0 end)",
    },
    {
        "month": lambda: dates.month_start(F.col("o_orderdate")),
        "month_label": lambda: dates.month_label(F.col("o_orderdate")),
        "month_name": lambda: dates.month_name(F.col("o_orderdate")),
        "priority": lambda: F.col("o_orderpriority"),
        "status": lambda: F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")),
    },
)
AS_OF = date(2001, 7, 31)


def _ask(t: Tables, *args, **kw) -> DataFrame:
    return metric_query(t.orders, ORDERS, MetricQuery("orders", *args, **kw), AS_OF)


@block(
    "share_of_total",
    "select o_orderpriority as priority, sum(o_totalprice) as revenue, sum(o_totalprice) / sum(sum(o_totalprice)) over () as pct from orders group by 1",
    "priority r:revenue r:pct",
)
def _(t):
    return _ask(t, ("priority",), ("revenue",), calcs=(Calc("pct", "share", "revenue"),))


@block(
    "complement_ratio",
    f"""
    select {_month('o_orderdate')} as month, count(*) as order_count, sum(if(o_orderstatus = 'O', 1, 0)) as open_orders,
      1 - sum(if(o_orderstatus = 'O', 1, 0)) / count(*) as closed_share, sum(o_totalprice) / count(*) as per_order,
      sum(o_totalprice) as revenue from orders group by 1
    """,
    "d:month n:order_count n:open_orders r:closed_share r:per_order r:revenue",
)
def _(t):
    calcs = (Calc("closed_share", "complement", "open_orders", "order_count"), Calc("per_order", "ratio", "revenue", "order_count"))
    return _ask(t, ("month",), ("order_count", "open_orders", "revenue"), sort=("month", False), calcs=calcs)


@block(
    "pivot_month_status",
    f"""
    select {_month('o_orderdate')} as month, sum(o_totalprice) filter (o_orderstatus = 'F') as "F",
      sum(o_totalprice) filter (o_orderstatus = 'O') as "O", sum(o_totalprice) filter (o_orderstatus = 'P') as no_status from orders group by 1
    """,
    "d:month r:F r:O r:no_status",
)
def _(t):
    return _ask(t, ("month", "status"), ("revenue",), sort=("month", False), pivot=("status", ("O",)))


@block(
    "period_comparison",
    """
    select sum(if(o_orderdate >= '2001-07-01', o_totalprice, 0)) as recent,
      sum(if(o_orderdate >= '2001-06-01' and o_orderdate < '2001-07-01', o_totalprice, 0)) as before,
      sum(if(o_orderdate >= '2001-07-01', o_totalprice, 0)) /
        nullif(sum(if(o_orderdate >= '2001-06-01' and o_orderdate < '2001-07-01', o_totalprice, 0)), 0) - 1 as change
    from orders
    """,
    "r:recent r:before r:change",
)
def _(t):
    return _ask(t, (), ("recent", "before"), limit=1, calcs=(Calc("change", "change", "recent", "before"),))


@block(
    "filters_in_notin_between_past",
    f"""
    with base as (select *, if(o_orderstatus = 'P', null, o_orderstatus) as status from orders)
    select 'in' as kind, count(*) as n, sum(o_totalprice) as v from base where o_orderpriority in ('1-URGENT', '5-LOW')
    union all select 'not_in', count(*), sum(o_totalprice) from base where status <> 'F' or status is null
    union all select 'null', count(*), sum(o_totalprice) from base where status is null
    union all select 'not_null', count(*), sum(o_totalprice) from base where status is not null
    union all select 'between', count(*), sum(o_totalprice) from base where {_month('o_orderdate')} between '1996-02-01' and '1996-04-30'
    union all select 'past', count(*), sum(o_totalprice) from base where {_month('o_orderdate')} >= '2001-06-01'
    """,
    "kind n:n r:v",
)
def _(t):
    kinds = {
        "in": Filter("priority", "equals", ("1-URGENT", "5-LOW")),
        "not_in": Filter("status", "notEquals", ("F",)),
        "null": Filter("status", "isNull"),
        "not_null": Filter("status", "isNotNull"),
        "between": Filter("month", "inBetween", ("1996-02-01", "1996-04-30")),
        "past": Filter("month", "inThePast", (2,)),
    }
    # one pass over the table: every filter becomes a conditional pair of sums
    tests = {k: semantic.condition(ORDERS, f, F.lit(AS_OF)) for k, f in kinds.items()}
    sums = [x for k, c in tests.items() for x in (F.count_if(c).alias(f"n_{k}"), F.sum(F.when(c, F.col("o_totalprice"))).alias(f"v_{k}"))]
    one = t.orders.agg(*sums)
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"n_{k}").alias("n"), F.col(f"v_{k}").alias("v")) for k in kinds])
    return one.select(F.inline(rows))


@block(
    "dashboard_filter_remap",
    f"""
    select 'order' as tile, sum(o_totalprice) as revenue from orders where {_month('o_orderdate')} between '1997-01-01' and '1997-03-31'
    union all
    select 'ship', sum(l_extendedprice) from lineitem where {_month('l_shipdate')} between '1997-01-01' and '1997-03-31'
    """,
    "tile r:revenue",
)
def _(t):
    ship = Explore("lineitem", {"revenue": "sum(l_extendedprice)"}, {"ship_month": lambda: dates.month_start(F.col("l_shipdate"))})
    tiles = {"order": MetricQuery("orders", (), ("revenue",)), "ship": MetricQuery("lineitem", (), ("revenue",))}
    moved = semantic.across_tiles(tiles, Filter("month", "inBetween", ("1997-01-01", "1997-03-31")), {"ship": "ship_month"})
    parts = [
        metric_query(t.orders, ORDERS, moved["order"]).withColumn("tile", F.lit("order")),
        metric_query(t.lineitem, ship, moved["ship"]).withColumn("tile", F.lit("ship")),
    ]
    return combine.union_all(parts)


@block("distinct_dimensions", "select distinct o_orderstatus as raw, o_orderpriority as priority from orders", "raw priority")
def _(t):
    explore = Explore("orders", {}, {"raw": lambda: F.col("o_orderstatus"), "priority": lambda: F.col("o_orderpriority")})
    return metric_query(t.orders, explore, MetricQuery("orders", ("raw", "priority")))


@block(
    "topk_customers",
    """
    select o_custkey, sum(o_totalprice) as revenue, count(distinct o_orderkey) as order_count, avg(o_totalprice) as aov
    from orders group by 1 order by revenue desc, o_custkey limit 25
    """,
    "n:o_custkey r:revenue n:order_count r:aov",
)
def _(t):
    return _ask(t, ("o_custkey",), ("revenue", "order_count", "aov"), sort=("revenue", True), limit=25)


# semi-structured and scalar functions --------------------------------------------------------
@block(
    "json_path_props",
    "select event_id, cast(regexp_extract(props, '[0-9]+') as bigint) as k, cast(null as varchar) as missing from events",
    "n:event_id n:k missing",
)
def _(t):
    doc = F.try_parse_json("props")
    return t.events.select(
        "event_id", F.try_variant_get(doc, "$.k", "bigint").alias("k"),
        F.try_variant_get(doc, '$["$campaign"].name', "string").alias("missing"),
    )


@block("campaigns_from_variants", with_views("select * from stg_klaviyo__campaigns"), COLUMNS["stg_klaviyo__campaigns"])
def _(t):
    exports = Exports(t.spark, t.folder)
    landed = {sid: exports.email_campaigns(sid) for sid in SETTINGS.store_ids}
    return staging_email.campaigns({sid: df.withColumn("attributes", F.parse_json(F.to_json("attributes"))) for sid, df in landed.items()})


@block(
    "flatten_outer_sum",
    """
    select l_orderkey, l_linenumber, l_partkey, l_extendedprice, case when l_linenumber in (1, 2) then null when l_returnflag = 'R' then 2 else 1 end as elements,
      case when l_linenumber in (1, 2) then 0 when l_returnflag = 'R' then l_extendedprice + l_quantity else l_extendedprice end as total
    from lineitem
    """,
    "n:l_orderkey n:l_linenumber n:l_partkey r:l_extendedprice n:elements r:total",
)
def _(t):
    item = lambda kind, v: F.struct(F.lit(kind).alias("kind"), F.col(v).alias("v"))
    both, one = F.array(item("sale", "l_extendedprice"), item("fee", "l_quantity")), F.array(item("sale", "l_extendedprice"))
    items = F.when(F.col("l_linenumber") == 1, None).when(F.col("l_linenumber") == 2, F.filter(one, lambda _: F.lit(False)))
    doc = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
        items.when(F.col("l_returnflag") == "R", both).otherwise(one).alias("items"),
    )
    size = F.nullif(F.array_size("items"), F.lit(0))
    total = combine.sum_elements(F.col("items"), lambda e: e.kind.isin("sale", "fee"), lambda e: e.v)
    return doc.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", size.alias("elements"), total.alias("total"))


@block(
    "flatten_explode",
    """
    select l_orderkey, l_linenumber, l_partkey, 'sale' as kind, l_extendedprice as v from lineitem where l_linenumber > 2
    union all select l_orderkey, l_linenumber, l_partkey, 'fee', l_quantity from lineitem where l_linenumber > 2 and l_returnflag = 'R'
    union all select l_orderkey, l_linenumber, l_partkey, null, null from lineitem where l_linenumber <= 2
    """,
    "n:l_orderkey n:l_linenumber n:l_partkey kind r:v",
)
def _(t):
    item = lambda kind, v: F.struct(F.lit(kind).alias("kind"), F.col(v).alias("v"))
    one = F.array(item("sale", "l_extendedprice"))
    both = F.array(item("sale", "l_extendedprice"), item("fee", "l_quantity"))
    items = F.when(F.col("l_linenumber") <= 2, None).when(F.col("l_returnflag") == "R", both).otherwise(one)
    doc = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", items.alias("items"))
    flat = combine.flatten(doc, "items", "item", outer=True)
    return flat.select("l_orderkey", "l_linenumber", "l_partkey", "item.kind", "item.v")


@block(
    "scalar_text",
    f"""
    select c_custkey, lower(trim('  ' || c_name || ' ')) as email, nullif(trim(if(c_custkey % 3 = 0, '  ', c_name)), '') as crm_email_text,
      trim(coalesce(if(c_custkey % 2 = 0, null, c_mktsegment), '') || ' ' || coalesce(if(c_custkey % 5 = 0, null, c_name), '')) as full_name,
      {_pick(DOMAINS, 'c_custkey')} as domain, {_area(_pick(ZIPS, 'c_custkey'))} as area,
      {REGION.format(a=_area(_pick(ZIPS, 'c_custkey')))} as region, c_mktsegment || '|' || c_name as readable,
      md5(c_custkey || '-' || coalesce(if(c_custkey % 2 = 0, null, c_mktsegment), '_dbt_utils_surrogate_key_null_')) as hashed,
      {_pick(DOMAINS, 'c_custkey')} in ('acme.co.uk', 'salon.com') as business from customer
    """,
    "n:c_custkey email crm_email_text full_name domain area region readable hashed business",
)
def _(t):
    key, odd = F.col("c_custkey"), F.when(F.pmod("c_custkey", F.lit(2)) != 0, F.col("c_mktsegment"))
    mail = F.concat(F.col("c_name"), F.lit("@"), pick(DOMAINS, key))
    domain, area = scalars.email_domain(mail), scalars.postcode_area(pick(ZIPS, key))
    blank = F.when(F.pmod(key, F.lit(3)) == 0, "  ").otherwise(F.col("c_name"))
    return t.customer.select(
        "c_custkey", scalars.email(F.concat(F.lit("  "), "c_name", F.lit(" "))).alias("email"),
        F.nullif(F.trim(blank), F.lit("")).alias("crm_email_text"),
        scalars.full_name(odd, F.when(F.pmod(key, F.lit(5)) != 0, F.col("c_name"))).alias("full_name"),
        domain.alias("domain"), area.alias("area"), regions.uk_region(area).alias("region"),
        scalars.readable_key(F.col("c_mktsegment"), F.col("c_name")).alias("readable"),
        scalars.surrogate_key(key, odd).alias("hashed"), classify.business_email(domain).alias("business"),
    )


@block(
    "scalar_dates_numbers",
    f"""
    select o_orderkey, {_month('o_orderdate')} as month, strftime(o_orderdate, '%Y-%m') as label, strftime(o_orderdate, '%B %Y') as name,
      cast(o_orderdate as date) as compact, if(o_orderstatus = 'P', null, cast(o_orderdate as date)) as iso,
      o_orderdate - interval 5 day as before5, if(o_orderstatus = 'F', 0, o_totalprice / 2) as safe_ratio,
      o_totalprice / nullif(if(o_orderstatus = 'F', 0, 2), 0) as null_ratio, round(o_totalprice * 10000) / 1000000 as money,
      if(o_orderdate >= '1998-01-01', 1, 0) as recent, if(o_orderstatus = 'P', null, o_totalprice) as parsed from orders
    """,
    "n:o_orderkey d:month label name d:compact d:iso t:before5 r:safe_ratio r:null_ratio r:money n:recent r:parsed",
)
def _(t):
    at, price = F.col("o_orderdate"), F.col("o_totalprice")
    divisor = F.when(F.col("o_orderstatus") == "F", 0).otherwise(2)
    text = F.when(F.col("o_orderstatus") == "P", "soon").otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm"))
    return t.orders.select(
        "o_orderkey", dates.month_start(at).alias("month"), dates.month_label(at).alias("label"), dates.month_name(at).alias("name"),
        dates.compact_date(F.date_format(at, "yyyyMMdd")).alias("compact"), dates.iso_date(text).alias("iso"),
        (at - F.make_dt_interval(F.lit(5))).alias("before5"), scalars.div0(price, divisor).alias("safe_ratio"),
        scalars.ratio(price, divisor).alias("null_ratio"), scalars.from_micros(F.round(price * 10000)).alias("money"),
        (at >= dates.days_before(F.lit(date(1998, 1, 31)), 30)).cast("int").alias("recent"),
        F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(price.cast("string")).try_cast("double").alias("parsed"),
    )


CHANNEL_OF_SOURCE = ("Organic Search", "Paid Search", "Email / CRM", "Paid Social", "Direct", "Paid Social",
                     "Referral / Affiliates", "Paid Search", "Email / CRM", "Other")


@block(
    "source_medium_channel",
    f"""
    select {_pick(CHANNEL_OF_SOURCE, 'user_id')} as channel, {_pick([f'{s} / {m}' for s, m in SOURCES], 'user_id')} as source_medium,
      count(*) as n, sum(value) as v from events group by 1, 2 order by v desc limit 25
    """,
    "channel source_medium n:n r:v",
)
def _(t):
    source, medium = pick([s for s, _ in SOURCES], F.col("user_id")), pick([m for _, m in SOURCES], F.col("user_id"))
    explore = Explore(
        "events", {"n": "count(1)", "v": "sum(value)"},
        {
            "channel": lambda: classify.source_medium_channel(F.col("source"), F.col("medium")),
            "source_medium": lambda: F.concat("source", F.lit(" / "), "medium"),
        },
    )
    rows = t.events.withColumns({"source": source, "medium": medium})
    query = MetricQuery("events", ("channel", "source_medium"), ("n", "v"), sort=("v", True), limit=25)
    return metric_query(rows, explore, query)


@block(
    "classifiers",
    """
    select l_returnflag, l_linestatus, case when l_returnflag = 'N' then 'remarketing' when l_returnflag = 'A' then 'acquisition'
        else 'other' end as audience,
      if(l_returnflag = 'A', 'Referral / Affiliates', if(l_returnflag = 'N', 'Email / CRM', 'Other')) as folded,
      if(l_linestatus = 'F', 'shopify_dtc', 'other') as channel, count(*) as n from lineitem group by all
    """,
    "l_returnflag l_linestatus audience folded channel n:n",
)
def _(t):
    flag = F.col("l_returnflag")
    campaign = F.when(flag == "N", "Retargeting lookalike").when(flag == "A", "acquisition")
    group = F.when(flag == "A", "Affiliates").when(flag == "N", "Email").otherwise("Display")
    code = F.when(F.col("l_linestatus") == "F", "Shopify").otherwise("Kiosk")
    rows = t.lineitem.select(
        "l_returnflag", "l_linestatus", classify.audience_type(campaign, F.lit("x")).alias("audience"),
        classify.fold_channel(group).alias("folded"), classify.order_channel(code).alias("channel"),
    )
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))


# unions, audits, loads, checks ---------------------------------------------------------------
@block(
    "tenant_union",
    "select if(o_orderstatus = 'P', 'partner', 'own') as store_id, o_orderpriority, count(*) as n, sum(o_totalprice) as v from orders group by 1, 2",
    "store_id o_orderpriority n:n r:v",
)
def _(t):
    partner = F.col("o_orderstatus") == "P"
    stacked = combine.union_tenants({"own": t.orders.filter(~partner), "partner": t.orders.filter(partner)}, lambda df: df)
    return stacked.groupBy("store_id", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("v"))


@block(
    "contamination_audit",
    """
    with a as (select * from orders where o_orderstatus <> 'P'), b as (select * from orders where o_orderstatus <> 'F')
    select 'overlapping_order_ids' as check_name, cast(count(*) as varchar) as value from a join b on a.o_orderkey = b.o_orderkey
    union all select 'own_earliest', cast(min(cast(o_orderdate as date)) as varchar) from a
    union all select 'own_latest', cast(max(cast(o_orderdate as date)) as varchar) from a
    union all select 'own_count', cast(count(*) as varchar) from a
    union all select 'other_earliest', cast(min(cast(o_orderdate as date)) as varchar) from b
    union all select 'other_latest', cast(max(cast(o_orderdate as date)) as varchar) from b
    union all select 'other_count', cast(count(*) as varchar) from b
    """,
    "check_name value",
)
def _(t):
    own, other = t.orders.filter(F.col("o_orderstatus") != "P"), t.orders.filter(F.col("o_orderstatus") != "F")
    return audit.contamination_audit(own, other, "own", "other", "o_orderkey", "o_orderdate")


@block(
    "contamination_purge",
    "select o_orderkey, o_totalprice from orders where o_orderstatus = 'F'",
    "n:o_orderkey r:o_totalprice",
)
def _(t):
    own, other = t.orders.filter(F.col("o_orderstatus") != "P"), t.orders.filter(F.col("o_orderstatus") != "F")
    return audit.purge(own, other, "o_orderkey", "o_orderkey").select("o_orderkey", "o_totalprice")


@block(
    "contamination_purge_lines",
    "select l_orderkey, l_linenumber, l_partkey from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus <> 'F')",
    "n:l_orderkey n:l_linenumber n:l_partkey",
)
def _(t):
    other = t.orders.filter(F.col("o_orderstatus") != "F")
    return audit.purge(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), other, "l_orderkey", "o_orderkey")


@block(
    "contamination_purge_store",
    """
    with foreign_orders as (select o_orderkey from orders where o_orderstatus <> 'F')
    select 'orders' as table_name, o_orderkey as id, null as line from orders where o_orderstatus <> 'P' and o_orderkey not in (from foreign_orders)
    union all select 'customers', c_custkey, null from customer where c_nationkey % 5 <> 0
    union all select 'order_line_items', l_orderkey, l_linenumber from lineitem where l_orderkey not in (from foreign_orders)
    union all select 'products', p_partkey, null from part where p_partkey not between 40 and 60
    union all select 'product_variants', s_suppkey, null from supplier where s_suppkey >= 0
    """,
    "table_name n:id n:line",
)
def _(t):
    own = {
        "orders": t.orders.filter(F.col("o_orderstatus") != "P").select(F.col("o_orderkey").alias("id")),
        "customers": t.customer.select(F.col("c_custkey").alias("id")),
        "order_line_items": t.lineitem.select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line")),
        "products": t.part.select(F.col("p_partkey").alias("id")),
        "product_variants": t.supplier.select(F.col("s_suppkey").alias("id")),
    }
    other = {
        "orders": t.orders.filter(F.col("o_orderstatus") != "F").select(F.col("o_orderkey").alias("id")),
        "customers": t.customer.filter(F.col("c_nationkey") % 5 == 0).select(F.col("c_custkey").alias("id")),
        "products": t.part.filter(F.col("p_partkey").between(40, 60)).select(F.col("p_partkey").alias("id")),
        "product_variants": t.supplier.filter(F.col("s_suppkey") < 0).select(F.col("s_suppkey").alias("id")),
    }
    root, target, left = shared_folder(t.spark, "store"), shared_folder(t.spark, "purged"), []
    for name, rows in own.items():
        rows.repartitionByRange(rows.columns[0]).write.parquet(f"{root}/{name}")
    purge.purge_store(t.spark, {name: f"{root}/{name}" for name in own}, other, target)
    for name, rows in own.items():
        line = F.col("line") if "line" in rows.columns else F.lit(None)
        kept = purge.read_purged(t.spark, target, name, rows.schema)
        left.append(kept.select(F.lit(name).alias("table_name"), F.col(rows.columns[0]).alias("id"), line.cast("long").alias("line")))
    return combine.union_all(left)


@block(
    "quality_report",
    """
    select 'orders' as table_name, 'not_null' as check_name, 'o_orderkey' as column_name, count(*) filter (o_orderkey is null) as failures from orders
    union all select 'orders', 'accepted_values', 'o_orderstatus', count(*) filter (o_orderstatus not in ('F', 'O')) from orders
    union all select 'orders', 'unique', 'o_orderkey', (select count(*) from (select 1 from orders group by o_orderkey having count(*) > 1)) from (select 1)
    union all select 'customer', 'accepted_range', 'c_acctbal', count(*) filter (c_acctbal < 0) from customer
    union all select 'lineitem', 'unique_combination', 'l_orderkey,l_linenumber',
      (select count(*) from (select 1 from lineitem group by l_orderkey, l_linenumber having count(*) > 1)) from (select 1)
    """,
    "table_name check_name column_name n:failures",
)
def _(t):
    return combine.union_all(
        [
            run_checks(t.orders, "orders", Checks("o_orderkey", "o_orderkey", "", {"o_orderstatus": ("F", "O")})),
            run_checks(t.customer, "customer", Checks("", "", "c_acctbal")),
            run_checks(t.lineitem, "lineitem", Checks(unique_together=("l_orderkey", "l_linenumber"))),
        ]
    )


@block(
    "load_health",
    """
    select 'orders' as table_name, count(*) as row_count, max(o_orderdate) as last_loaded_at,
      if(max(o_orderdate) < timestamp '2001-11-04' - interval 48 hour, 'stale', 'ok') as status from orders
    union all select 'lineitem', count(*), max(l_shipdate), if(max(l_shipdate) < timestamp '2001-11-04' - interval 48 hour, 'stale', 'ok') from lineitem
    union all select 'nothing', 0, null, 'empty'
    """,
    "table_name n:row_count t:last_loaded_at status",
)
def _(t):
    tables = {
        "orders": (t.orders, "o_orderdate"),
        "lineitem": (t.lineitem, "l_shipdate"),
        "nothing": (t.orders.filter(F.col("o_orderkey").isNull()), "o_orderdate"),
    }
    return loads.load_health(tables, F.lit("2001-11-04"))


@block(
    "incremental_append",
    f"select o_orderkey, if(o_orderkey % 11 = 0, null, {_month('o_orderdate')}) as landed_at, o_totalprice from orders",
    "n:o_orderkey d:landed_at r:o_totalprice",
)
def _(t):
    path = shared_folder(t.spark, "increment")
    cursor = F.when(F.pmod("o_orderkey", F.lit(11)) != 0, dates.month_start(F.col("o_orderdate")))
    orders = t.orders.select("o_orderkey", cursor.alias("landed_at"), "o_totalprice")
    # first the older months and half of the next one, half of those without a cursor too; then all rows, twice
    half = F.pmod(F.xxhash64("o_orderkey"), F.lit(2)) == 0
    older = (F.col("landed_at") < "1999-01-01") | half & F.coalesce(F.col("landed_at") == "1999-01-01", F.lit(True))
    for part in (orders.filter(older), orders, orders):
        loads.append_increment(part, path, "landed_at", "1900-01-01")
    return loads.read_increments(t.spark, path)


@block("alias_scan", "select c_custkey, c_name, c_acctbal from customer", "n:c_custkey c_name r:c_acctbal")
def _(t):
    root = shared_folder(t.spark, "raw")
    t.customer.write.parquet(f"{root}/shop_alpha/CUSTOMERS_V2")
    catalog = Catalog(t.spark, root, aliases={("shop", "customers", "alpha"): "CUSTOMERS_V2"})
    return catalog.source("shop", "customers", "alpha").select("c_custkey", "c_name", "c_acctbal")


@block(
    "registered_views",
    "select c_custkey, upper(c_mktsegment) as segment, count(o_orderkey) as n from customer left join orders on o_custkey = c_custkey group by all",
    "n:c_custkey segment n:n",
)
def _(t):
    shaped = t.customer.select("c_custkey", F.upper("c_mktsegment").alias("segment"))
    sinks.register_views(t.spark, {"shaped_customers": shaped, "shaped_orders": t.orders.select("o_custkey", "o_orderkey")})
    return t.spark.sql(
        "select c_custkey, segment, count(o_orderkey) as n from shaped_customers left join shaped_orders on o_custkey = c_custkey group by all"
    )


@block("full_refresh", "select p_partkey, p_name, p_retailprice * 2 as price from part", "n:p_partkey p_name r:price")
def _(t):
    root = shared_folder(t.spark, "refresh")
    loads.full_refresh(t.part.select("p_partkey", "p_name", F.col("p_retailprice").alias("price")), root, "1")
    loads.full_refresh(t.part.select("p_partkey", "p_name", (F.col("p_retailprice") * 2).alias("price")), root, "2")
    return loads.read_current(t.spark, root)


# streams ---------------------------------------------------------------------------------------
def _finish(writer) -> None:
    query = writer.start()
    query.awaitTermination()


@block("stream_append", "select event_id, user_id, event_type, ts, value from events", "n:event_id n:user_id event_type t:ts r:value")
def _(t):
    target = shared_folder(t.spark, "appended")
    rows = t.landed(t.events.select("event_id", "user_id", "event_type", "ts", "value"))
    _finish(jobs.append_files(rows, target, shared_folder(t.spark, "progress")))
    return t.spark.read.parquet(target)


@block(
    "stream_daily_counts",
    "select cast(ts as date) as day, event_type, count(*) as n from events group by 1, 2",
    "d:day event_type n:n",
)
def _(t):
    target = shared_folder(t.spark, "daily")
    rows = t.landed(t.events.select("event_id", "event_type", "ts"))
    _finish(jobs.daily_counts(rows, "ts", ["event_type"], target, shared_folder(t.spark, "progress"), fan=2))
    return jobs.read_daily_counts(t.spark, target, ["event_type"])


@block(
    "stream_first_per_order",
    "select event_id, user_id from events where event_type = 'purchase'",
    "n:event_id n:user_id",
)
def _(t):
    target = shared_folder(t.spark, "first")
    bought = t.events.filter(F.col("event_type") == "purchase")
    # every order lands three times, mostly in different batches
    sent = bought.withColumn("late", F.explode(F.array(F.lit(0), F.lit(2), F.lit(900_000)))).select(
        "event_id", "user_id", (F.col("ts").cast("timestamp") + F.make_dt_interval(secs=F.col("late"))).alias("sent_at")
    )
    _finish(jobs.first_per_order(t.landed(sent), "sent_at", ["event_id"], target, shared_folder(t.spark, "progress"), leaf_rows=10_000))
    return jobs.read_first(t.spark, target).select("event_id", "user_id")


@block(
    "stream_latest_per_key",
    """
    select user_id, event_type, event_id, value from events
    qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1
    """,
    "n:user_id event_type n:event_id r:value",
)
def _(t):
    target = shared_folder(t.spark, "latest")
    rows = t.landed(t.events.select("event_id", "user_id", "event_type", "ts", "value"))
    _finish(jobs.latest_per_key(rows, ["user_id", "event_type"], "ts", ["event_id"], target, shared_folder(t.spark, "progress"), leaf_rows=10_000))
    return jobs.read_latest(t.spark, target).select("user_id", "event_type", "event_id", "value")


@block("stream_last_touch", TOUCH_SQL, "n:event_id n:user_id r:value n:touch_id touch_kind")
def _(t):
    target = shared_folder(t.spark, "touched")
    rows = t.landed(t.events.select("event_id", "user_id", "event_type", "ts", "value")).filter(F.col("event_type").isin("purchase", "view", "click"))
    carry = {"touch_id": "event_id", "touch_kind": "event_type"}
    bought = F.col("event_type") == "purchase"
    _finish(jobs.attribute_orders(rows, bought, ["user_id"], ["event_id"], "ts", "event_id", carry, target, shared_folder(t.spark, "progress")))
    return jobs.read_credits(t.spark, target).select("event_id", "user_id", "value", "touch_id", "touch_kind")
