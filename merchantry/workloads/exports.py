"""Raw exports of every system, derived by Spark from the benchmark tables.

Each raw table is computed row by row from one benchmark table, so it grows
with it and no row is left out.  Messy cases are put in on purpose: amounts as
text, offsets in times, blank and shared emails, null and empty arrays, repeated
loads of one key, rows with cast problems, and orders reported by two senders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from merchantry.config import Settings, Store
from merchantry.sources.catalog import Catalog

SETTINGS = Settings(
    stores=(Store("alpha", "Alpha Store"), Store("beta", "Beta Store")),
    refund_stores=("alpha", "beta"),
    brand_terms=("red ", "ring"),
)
ISO = "yyyy-MM-dd'T'HH:mm:ss"
ISO_MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
ZIPS = ("sw1a 1aa", " m1 2ab", "EH3 9DR", "123", "zz9 9zz", "bt1 5gs ", "B1 1AA", None)
DOMAINS = ("gmail.com", "acme.co.uk", "beauty.fun", "x.in.net", "salon.com", "qq.com")
SOURCES = (
    ("google", "organic"), ("Google", "cpc"), ("klaviyo", "email"), ("facebook", "paid"), ("(direct)", "(none)"),
    ("fb", "cpc"), ("partner.com", "referral"), ("bing", "ppc"), ("newsletter", "e-mail"), ("quizsite", "quiz"),
)
TERMS = ("Red Widget", "serum", "Best Ring", "cleanser", "Blue gizmo")


def pick(values, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(index, F.lit(len(values))) + 1).cast("int"))


def text(col: Column | str) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("string")


def join_text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def cents(col: str, factor: float) -> Column:
    return F.round(F.col(col) * F.lit(factor), 2)


def home_store(key: str) -> Column:
    """Every order (and its lines) belongs to one of the two stores; both are always read."""
    return F.when(F.pmod(F.col(key), F.lit(2)) == 0, "alpha").otherwise("beta")


def problems(bad: Column, unknown: Column) -> Column:
    """Load metadata: a cast problem on bad rows, none or no list on others."""
    none = F.array().cast("array<string>")
    changes = F.when(bad, F.array(F.lit("cast"))).when(~unknown, none)
    return F.struct(changes.alias("changes")).alias("_airbyte_meta")


def versions(df: DataFrame, stale: dict[str, Column]) -> DataFrame:
    """Three loads of every row: one undated, one old, one new; only the new is right."""
    loads = F.array(
        *[
            F.struct(F.lit(i).alias("n"), F.lit(at).cast("timestamp").alias("at"))
            for i, at in enumerate((None, "2024-01-01 00:00:00", "2024-02-01 00:00:00"))
        ]
    )
    out = df.withColumn("_load", F.explode(loads))
    changed = {c: F.when(F.col("_load.n") == 2, F.col(c)).otherwise(v) for c, v in stale.items()}
    return out.withColumns({**changed, "_airbyte_extracted_at": F.col("_load.at")}).drop("_load")


#: Rows of a table that one task gets at most: with three loads of each, wide rows of some hundred MB to sort.
PIECE_ROWS = 200_000
_HELD: dict[tuple[str, str, int], tuple[int, int, int]] = {}


def rows_held(df: DataFrame) -> tuple[int, int, int]:
    """Rows of the largest piece, rows of all pieces, and the pieces that hold any."""
    held = df.groupBy(F.spark_partition_id().alias("piece")).count().agg(F.max("count"), F.sum("count"), F.count("piece"))
    most, rows, pieces = held.first()
    return most or 0, rows or 0, pieces


def pieces_needed(held: tuple[int, int, int], cores: int, streamed: bool = False) -> int | None:
    """Pieces to spread a table over; None if it comes in enough of them, and none holds too many rows.

    Rows that a task streams, rather than sorts, may be any number: a piece then holds too
    many if it has over twice a core's share.
    """
    most, rows, pieces = held
    allowed = max(PIECE_ROWS, 2 * rows // cores) if streamed else PIECE_ROWS
    if most <= allowed and pieces >= cores:
        return None
    return max(cores, -(-rows // PIECE_ROWS))


def read_spread(spark: SparkSession, path: str, streamed: bool = False) -> DataFrame:
    """A parquet table; one that comes in fewer pieces than there are cores, or in larger ones than a task can take, is spread.

    A small file with a single row group would leave one task with all the work
    up to the first shuffle, and row groups cannot be split, so the number of pieces
    follows from the rows.  They are counted once per table and session.  Where each row
    is worked on by itself (``streamed``), large pieces stay as they are and no row moves.
    """
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    key = (spark.sparkContext.applicationId, path, cores)
    if key not in _HELD:
        _HELD[key] = rows_held(df)
    pieces = pieces_needed(_HELD[key], cores, streamed)
    return df.repartition(pieces, df.columns[0]) if pieces else df


# Raw columns that carry made-up values of their own, by type: text, numbers, flags and times that follow from a key.
REST = {
    "addresses": {
        "text": "outcode postcoderegion postcodetype addressline2 addressline3 addressline4 addressline5",
        "number": "latitude longitude",
        "time": "lastupdatedtimestamp",
    },
    "companies": {
        "text": "typeid alternatereference",
        "time": "firstorder lapsed unlapsed lastupdatedtimestamp",
    },
    "contacts": {
        "text": "title jobtitle department phonenumber mobilephonenumber addressid mainaddressid deliveryaddressid divisionid",
        "flag": "emailbounced",
        "time": "created",
    },
    "leads": {
        "text": "ownerid salespersonid responsibleuser pipelineid statusid statusdetailid statusflag sourceid sourceother typeid sizeid objectiveid addressid divisionid guttometer utmmedium utmname utmcontent",
        "number": "worstvalue likelyvalue weightedvalue marginvalue",
        "time": "closedate estimatedclose statuschanged lastactiveengagement firstactiveengagement lastupdatedtimestamp",
    },
    "product_items": {
        "text": "barcode extendeddescription webdescription webproductreference cataloguecode cataloguereference alternatereference1 alternatereference2 manufacturerreference",
        "number": "costprice saleprice nextprice decimalcostprice decimalsellingprice",
        "flag": "sellable stocked",
        "time": "created lastupdatedtimestamp",
    },
    "sales_invoice_headers": {
        "text": "creditnotenumber platform statusflag transactiontypeid",
        "number": "basenetvalue basetaxvalue basegrossvalue",
        "time": "duedate",
    },
    "sales_ledgers": {
        "text": "postcode customertypeid customercode",
        "flag": "iscashaccount",
        "time": "created lastinvoice lastreceipt",
    },
    "sales_order_headers": {
        "text": "salespersonid divisionid statusflag customerreference alternatereference deliveryname salesordergroupcode",
        "number": "basenetvalue basetaxvalue basegrossvalue",
        "time": "shippeddate duedate",
    },
    "sales_transactions": {
        "number": "price grossvalue basevalue basegrossvalue costprice",
        "text": "statusflag warehousecode departmentcode",
        "time": "invoicedate deliverydate",
    },
}


def rest(table: str, key: str) -> list[Column]:
    made = {
        "text": lambda c, i: F.concat(F.lit(f"{c}-"), F.pmod(key, F.lit(97)).cast("string")),
        "number": lambda c, i: F.pmod(key, F.lit(1000)) + F.lit(i + 0.25),
        "flag": lambda c, i: F.pmod(F.col(key) + i, F.lit(3)) == 1,
        "time": lambda c, i: F.timestamp_seconds(F.lit(1600000000 + 86400 * i) + F.pmod(key, F.lit(5000000))),
    }
    return [made[kind](c, i).alias(c) for kind, names in REST[table].items() for i, c in enumerate(names.split())]


class Exports:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, table: str, streamed: bool = False) -> DataFrame:
        return read_spread(self.spark, f"{self.folder.rstrip('/')}/{table}.parquet", streamed)

    # shop --------------------------------------------------------------------
    def shop_orders(self, sid: str) -> DataFrame:
        o = self.read("orders").filter(home_store("o_orderkey") == sid)
        offset = "+01:00" if sid == "alpha" else "Z"
        when = F.date_format("o_orderdate", ISO)
        guest = F.col("o_orderstatus") == "P"
        return o.select(
            F.col("o_orderkey").alias("id"),
            join_text("#", F.col("o_orderkey")).alias("name"),
            join_text("  Buyer", F.col("o_custkey"), "@Shop", F.pmod("o_custkey", F.lit(7)), ".com ").alias("email"),
            join_text(when, offset).alias("created_at"),
            F.when(guest, "n/a").otherwise(when).alias("processed_at"),
            join_text(when, "Z").alias("updated_at"),
            text("o_totalprice").alias("total_price"),
            text(cents("o_totalprice", 0.8)).alias("subtotal_price"),
            text(cents("o_totalprice", 0.04)).alias("total_tax"),
            cents("o_totalprice", 0.2).alias("total_discounts"),
            F.lit("GBP").alias("currency"),
            F.when(F.col("o_orderstatus") == "F", "paid").otherwise("pending").alias("financial_status"),
            F.when(F.col("o_orderstatus") != "O", "fulfilled").alias("fulfillment_status"),
            F.when(~guest, F.struct(F.col("o_custkey").alias("id"))).alias("customer"),
            F.lit("web").alias("source_name"),
            F.col("o_orderpriority").alias("tags"),
            F.struct(
                join_text("City ", F.pmod("o_custkey", F.lit(25))).alias("city"),
                F.lit("GB").alias("country_code"),
                F.lit(None).cast("string").alias("province"),
                pick(ZIPS, F.col("o_custkey")).alias("zip"),
            ).alias("shipping_address"),
            problems(F.col("o_totalprice") < 5000, F.col("o_orderpriority") == "1-URGENT"),
        )

    def shop_lines(self, sid: str) -> DataFrame:
        li = self.read("lineitem", streamed=True).filter(home_store("l_orderkey") == sid)
        line_id = F.col("l_orderkey") * 10 + F.col("l_linenumber")

        def line(id_, product, variant, title, sku, quantity, amount, gift):
            money = F.struct(F.struct(amount.cast("string").alias("amount")).alias("shop_money"))
            return F.struct(
                id_.cast("bigint").alias("id"), product.cast("bigint").alias("product_id"),
                variant.cast("bigint").alias("variant_id"), title.alias("title"), sku.cast("string").alias("sku"),
                quantity.cast("bigint").alias("quantity"), money.alias("price_set"), gift.alias("gift_card"),
            )

        mini = F.when(F.col("l_linenumber") == 7, " mini").otherwise("")
        gift = F.when(F.col("l_discount") >= 0.1, True).when(F.col("l_tax") > 0, False)
        main = line(
            line_id, F.col("l_partkey"), F.col("l_suppkey"), join_text("Part ", F.col("l_partkey"), mini),
            join_text("SKU-", F.col("l_partkey")), F.col("l_quantity"), F.col("l_extendedprice"), gift,
        )
        none = F.lit(None)
        wrap = line(-line_id, none, none, F.lit("Gift wrap"), none, F.lit(1), F.lit(2.5), none.cast("boolean"))
        items = (
            F.when(F.col("l_quantity") == 50, None)
            .when(F.col("l_quantity") == 49, F.filter(F.array(main), lambda _: F.lit(False)))
            .when(F.col("l_returnflag") == "R", F.array(main, wrap))
            .otherwise(F.array(main))
        )
        return li.select(
            F.col("l_orderkey").alias("id"), items.alias("line_items"),
            problems(F.col("l_extendedprice") < 1000, F.col("l_linenumber") == 2),
        )

    def shop_refunds(self, sid: str) -> DataFrame:
        li = self.read("lineitem", streamed=True).filter(home_store("l_orderkey") == sid)
        back = F.col("l_returnflag") == "R"

        def txn(amount, kind, status):
            return F.struct(
                amount.cast("string").alias("amount"), F.lit(kind).alias("kind"), status.alias("status")
            )

        done = F.when(F.col("l_linestatus") == "F", "SUCCESS").otherwise("pending")
        txns = F.array(txn(F.col("l_extendedprice"), "Refund", done), txn(F.lit(1), "sale", F.lit("success")))
        goods = F.array(
            F.struct(
                F.struct(F.struct(cents("l_extendedprice", 0.8).alias("amount")).alias("shop_money")).alias("subtotal_set")
            )
        )
        empty = lambda a: F.filter(a, lambda _: F.lit(False))
        return li.select(
            F.col("l_orderkey").alias("order_id"),
            F.date_format("l_shipdate", ISO).alias("created_at"),
            F.when(back, txns).otherwise(empty(txns)).alias("transactions"),
            F.when(back & (F.col("l_tax") > 0), goods).when(back, empty(goods)).alias("refund_line_items"),
        )

    def shared_email(self, key: str) -> Column:
        half = F.expr(f"{key} div 2")
        return join_text(" C", half, "@", pick(DOMAINS, half), " ")

    def shop_customers(self, sid: str) -> DataFrame:
        nation = F.col("c_nationkey")
        here = nation < 15 if sid == "alpha" else nation >= 10
        blank = F.pmod("c_custkey", F.lit(20))
        at = F.timestamp_seconds(F.lit(1672531200) + F.col("c_custkey"))
        return self.read("customer").filter(here).select(
            F.col("c_custkey").alias("id"),
            F.when(blank == 0, "").when(blank != 1, self.shared_email("c_custkey")).alias("email"),
            F.col("c_mktsegment").alias("first_name"),
            F.when(F.pmod("c_custkey", F.lit(3)) != 0, F.col("c_name")).alias("last_name"),
            at.alias("created_at"),
            at.alias("updated_at"),
            nation.cast("bigint").alias("orders_count"),
            text(F.greatest("c_acctbal", F.lit(0.0))).alias("total_spent"),
            F.col("c_mktsegment").isin("BUILDING", "MACHINERY").alias("accepts_marketing"),
            problems(F.col("c_acctbal") < -900, nation == 1),
        )

    # email ---------------------------------------------------------------------
    def email_events(self, sid: str) -> DataFrame:
        ev = self.read("events").filter(home_store("user_id") == sid)
        offset = "Z" if sid == "alpha" else "+02:00"
        kind = F.col("event_type")
        send = lambda mark, metric, late=0: F.struct(
            F.lit(mark).alias("mark"), F.lit(metric).alias("metric"), F.lit(late).alias("late")
        )
        sends = (
            F.when(kind == "view", F.array(send("e", "open"), send("r", "recv")))
            .when(kind == "click", F.array(send("e", "click")))
            .when(kind == "purchase", F.array(send("e", "order_shop"), send("d", "order_api", 2)))
            .when(kind == "signup", F.array(send("e", "sub")))
            .otherwise(F.array(send("e", "unsub")))
        )
        k = F.get_json_object("props", "$.k").cast("bigint")
        rows = ev.withColumn("k", k).withColumn("s", F.explode(sends))
        touch = kind.isin("view", "click") & (F.pmod("k", F.lit(11)) != 0)
        even, ten = F.pmod("k", F.lit(2)) == 0, F.pmod("k", F.lit(10))
        bought = kind == "purchase"
        props = F.struct(
            F.when(touch & even, join_text("c", ten)).alias("$campaign"),
            F.when(touch & ~even, join_text("f", F.pmod("k", F.lit(7)))).alias("$flow"),
            F.when(kind.isin("view", "click") & (F.col("k") != 13), join_text("m", F.col("k"))).alias("$message"),
            F.when(touch & even & (ten != 4), join_text("Send ", ten)).alias("Campaign Name"),
            F.when(bought, F.col("value")).alias("$value"),
            F.when(bought, "GBP").alias("$value_currency"),
            F.when(bought & (F.col("k") >= 10), join_text("o", F.col("event_id"))).alias("OrderID"),
        )
        attributes = F.struct(
            "value", F.lit("GBP").alias("value_currency"), join_text("x", F.col("event_id")).alias("unique_id"),
            props.alias("event_properties"),
        )
        link = lambda col: F.struct(F.struct(col.alias("id")).alias("data"))
        at = F.col("ts") + F.make_dt_interval(secs=F.col("s.late"))
        return rows.select(
            join_text(F.col("s.mark"), F.col("event_id")).alias("id"),
            F.lit("event").alias("type"),
            join_text(F.date_format(at, ISO_MICROS), offset).alias("datetime"),
            F.to_json(attributes).alias("attributes"),
            F.struct(
                link(join_text("u", F.col("user_id"))).alias("profile"), link(F.col("s.metric")).alias("metric")
            ).alias("relationships"),
            problems(F.col("value") >= 300, kind == "click"),
        )

    def email_metrics(self, sid: str) -> DataFrame:
        entry = lambda i, name, via: F.struct(
            F.lit(i).alias("id"),
            F.struct(F.lit(name).alias("name"), F.struct(F.lit(via).alias("name")).alias("integration")).alias("attributes"),
        )
        kind = F.col("event_type")
        entries = (
            F.when(kind == "view", F.array(entry("recv", "Received Email", "mail"), entry("open", "Opened Email", "mail")))
            .when(kind == "click", F.array(entry("click", "Clicked Email", "mail")))
            .when(kind == "purchase", F.array(entry("order_shop", "Placed Order", "shop"), entry("order_api", "Placed Order", "api")))
            .when(kind == "signup", F.array(entry("sub", "Subscribed to Email Marketing", "mail")))
            .otherwise(F.array(entry("unsub", "Unsubscribed from Email Marketing", "mail")))
        )
        return self.read("events").select("event_type").distinct().select(F.inline(entries)).distinct()

    def email_flows(self, sid: str) -> DataFrame:
        key = F.col("n_nationkey")
        name = F.when(key != 3, join_text(F.col("n_name"), " flow"))
        return self.read("nation").select(
            join_text("f", key).alias("id"),
            F.struct(name.alias("name"), F.lit("live").alias("status")).alias("attributes"),
        )

    def email_campaigns(self, sid: str) -> DataFrame:
        p = self.read("part").filter(home_store("p_partkey") == sid)
        at = F.timestamp_seconds(F.lit(1704067200) + F.col("p_partkey") * 60)
        return p.select(
            join_text("c", F.col("p_partkey")).alias("id"),
            F.struct(
                F.col("p_name").alias("name"), F.col("p_type").alias("status"),
                F.when(F.pmod("p_size", F.lit(2)) == 0, "email").otherwise("sms").alias("channel"),
                F.date_format(at, ISO + "'Z'").alias("send_time"), at.alias("created_at"), at.alias("updated_at"),
                F.struct(F.array("p_brand").alias("included")).alias("audiences"),
            ).alias("attributes"),
            problems(F.col("p_size") == 50, F.col("p_size") == 7),
        )

    def email_campaign_stats(self, sid: str) -> DataFrame:
        p = self.read("part").filter(home_store("p_partkey") == sid)
        size = F.col("p_size").cast("bigint")
        parts = {"opens": 9, "unique_opens": 7, "clicks": 5, "unique_clicks": 4, "delivered": 20, "bounced": 2,
                 "unsubscribed": 1, "spam_complaints": 0}
        stats = F.to_json(F.struct(*[(size * n).alias(c) for c, n in parts.items()], F.col("p_retailprice").alias("revenue")))
        return p.select(
            join_text("c", F.col("p_partkey")).alias("campaign_id"),
            join_text("m", F.col("p_partkey")).alias("campaign_message_id"),
            F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size")).cast("string").alias("date"),
            F.lit("email").alias("send_channel"),
            stats.alias("statistics"),
            problems(F.col("p_size") == 50, F.col("p_size") == 7),
        )

    # advertising and web ---------------------------------------------------------
    def ads_insights(self, sid: str) -> DataFrame:
        li = self.read("lineitem", streamed=True).filter(home_store("l_orderkey") == sid)
        flag, line = F.col("l_returnflag"), F.col("l_linenumber")
        action = lambda name, v: F.struct(F.lit(name).alias("action_type"), v.cast("string").alias("value"))
        bought = F.array(action("purchase", F.col("l_quantity")), action("link_click", F.lit(3)), action("purchase", F.lit(None)))
        worth = F.array(action("purchase", F.col("l_extendedprice")))
        return li.select(
            F.to_date("l_shipdate").alias("date_start"),
            F.when(flag == "A", "Spring Prospecting").when(flag == "N", "Existing Customers RETARGETING").otherwise("Brand").alias("campaign_name"),
            F.when(F.col("l_linestatus") == "F", "Lookalike 1%").when(flag != "R", "Broad").alias("adset_name"),
            cents("l_extendedprice", 0.04).alias("spend"),
            F.col("l_partkey").alias("impressions"),
            F.col("l_quantity").cast("bigint").alias("clicks"),
            F.when(line == 1, None).when(line == 2, F.filter(bought, lambda _: F.lit(False))).otherwise(bought).alias("actions"),
            F.when(~line.isin(1, 3), worth).alias("action_values"),
        )

    def _web_events(self) -> DataFrame:
        return self.read("events", streamed=True).withColumns(
            {
                "k": F.get_json_object("props", "$.k").cast("bigint"),
                "date": F.date_format("ts", "yyyyMMdd"),
                "paid": F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(0.0),
            }
        )

    def web_source_medium(self) -> DataFrame:
        who = F.col("user_id")
        return self._web_events().select(
            "date", pick([s for s, _ in SOURCES], who).alias("sessionsource"),
            pick([m for _, m in SOURCES], who).alias("sessionmedium"),
            (F.col("k") + 1).alias("sessions"), F.expr("k div 2").alias("engagedsessions"), F.col("paid").alias("totalrevenue"),
        )

    def web_channels(self) -> DataFrame:
        group = {"view": "Direct", "click": "Paid Search", "purchase": "Email", "signup": "Affiliates"}
        kind = F.lit("Cross-network")
        for event, name in group.items():
            kind = F.when(F.col("event_type") == event, name).otherwise(kind)
        return self._web_events().select(
            "date", kind.alias("sessiondefaultchannelgrouping"), (F.col("k") + 1).alias("sessions"),
            F.col("paid").alias("totalrevenue"),
        )

    def web_event_counts(self) -> DataFrame:
        return self._web_events().select(
            "date", F.col("event_type").alias("eventname"), (F.pmod("k", F.lit(3)) + 1).alias("eventcount")
        )

    def web_overview(self) -> DataFrame:
        known = F.when(F.col("event_type") != "error", F.col("date"))
        return self._web_events().select(known.alias("date"), F.col("user_id").alias("totalusers"))

    def search_queries(self) -> DataFrame:
        part = F.col("l_partkey")
        day = F.when(F.col("l_linenumber") == 7, "bad-date").otherwise(F.date_format("l_shipdate", ISO))
        return self.read("lineitem", streamed=True).select(
            day.alias("segments_date"),
            join_text(" ", pick(TERMS, part), " ", F.expr("l_partkey div 5"), " ").alias("search_term_view_search_term"),
            F.col("l_quantity").cast("bigint").alias("metrics_clicks"),
            (F.round(F.col("l_extendedprice") * 100).cast("bigint") * 10000).alias("metrics_cost_micros"),
            F.col("l_tax").alias("metrics_conversions"),
        )

    # stock -------------------------------------------------------------------------
    def stock_sales(self) -> DataFrame:
        status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
        both = lambda s, p: (status == s) & (priority == p)
        channels = {"1-URGENT": "Shopify", "2-HIGH": "B2B", "3-MEDIUM": "WooCommerce", "5-LOW": "eBay"}
        channel = F.lit("Amazon_UK")
        for p, name in channels.items():
            channel = F.when(priority == p, name).otherwise(channel)
        rows = self.read("orders").select(
            join_text("S", F.col("o_orderkey")).alias("saleid"),
            F.when(~both("F", "5-LOW"), join_text("C", F.col("o_custkey"))).alias("customerid"),
            join_text("Customer ", F.col("o_custkey")).alias("customer"),
            F.when(both("O", "1-URGENT"), "unknown").otherwise(F.date_format("o_orderdate", ISO)).alias("orderdate"),
            F.col("o_totalprice").alias("paidamount"),
            cents("o_totalprice", 0.8).alias("invoiceamount"),
            F.lit("GBP").alias("basecurrency"),
            F.lit("EUR").alias("customercurrency"),
            F.when(both("P", "2-HIGH"), "VOIDED").when(~both("P", "3-MEDIUM"), "COMPLETED").alias("status"),
            status.alias("orderstatus"),
            F.lit("DONE").alias("fulfilmentstatus"),
            channel.alias("sourcechannel"),
        )
        return versions(rows, {"paidamount": F.lit(-1.0), "status": F.lit("STALE")})

    def stock_customers(self) -> DataFrame:
        key, nation = F.col("c_custkey"), F.col("c_nationkey")

        def address(id_, kind, zip_, default=True):
            return F.struct(
                join_text(id_, key).alias("ID"), join_text("City ", nation).alias("City"), F.lit("UK").alias("Country"),
                zip_.alias("Postcode"), F.lit(None).cast("string").alias("State"), F.lit(kind).alias("Type"),
                F.lit(default).alias("DefaultForType"),
            )

        home = address("b", "Shipping", pick(ZIPS, key))
        bill = address("c", "Billing", F.lit("M1 1AA"))
        old = address("a", "Shipping", F.lit("LS1 4AB"))
        off = address("a", "Shipping", F.lit("CF1 1AA"), False)
        places = (
            F.when(nation == 6, None)
            .when(nation == 5, F.filter(F.array(home), lambda _: F.lit(False)))
            .when(F.pmod(key, F.lit(4)) == 0, F.array(home, bill, old))
            .otherwise(F.array(home, bill, off))
        )
        mail = F.array(F.struct(join_text(" Buyer", key, "@Mail.com").alias("Email")))
        contacts = F.when(nation == 4, None).when(nation == 3, F.filter(mail, lambda _: F.lit(False))).otherwise(mail)
        rows = self.read("customer").select(
            join_text("C", key).alias("id"), F.col("c_name").alias("name"), contacts.alias("contacts"),
            places.alias("addresses"), F.lit("Active").alias("status"), F.lit("GBP").alias("currency"),
            F.col("c_mktsegment").alias("pricetier"), F.col("c_acctbal").alias("creditlimit"),
            F.when(nation == 2, "soon").otherwise("2024-03-01T10:00:00").alias("lastmodifiedon"),
        )
        return versions(rows, {"name": F.lit("stale"), "pricetier": F.lit("stale")})

    # CRM -----------------------------------------------------------------------------
    def crm_sales_ledgers(self) -> DataFrame:
        key, nation, segment = F.col("c_custkey"), F.col("c_nationkey"), F.col("c_mktsegment")
        own = F.when(segment == "AUTOMOBILE", join_text("K", key, "@salon.com")).otherwise(self.shared_email("c_custkey"))
        rows = self.read("customer").select(
            join_text("L", key).alias("salesledgerid"),
            F.when(F.pmod(nation, F.lit(4)) == 0, "  ").otherwise(own).alias("email"),
            F.col("c_name").alias("name"), join_text("N", nation).alias("country"), F.lit("GB").alias("countrycode"),
            F.lit("GBP").alias("currencycode"),
            F.when(segment == "HOUSEHOLD", True).when(segment != "MACHINERY", False).alias("isb2c"),
            F.col("c_acctbal").alias("balance"), (F.col("c_acctbal") + 1000).alias("creditlimit"),
            F.when(F.pmod(key, F.lit(5)) != 0, F.timestamp_seconds(F.lit(1700000000) + key)).alias("lastupdatedtimestamp"),
            *rest("sales_ledgers", "c_custkey"),
        )
        return versions(rows, {"name": F.lit("stale"), "isb2c": F.lit(True)})

    def crm_contacts(self) -> DataFrame:
        key, nation = F.col("c_custkey"), F.col("c_nationkey")
        rows = self.read("customer").select(
            join_text("K", key).alias("contactid"),
            F.when(nation < 8, self.shared_email("c_custkey")).when(nation < 20, join_text("K", key, "@Salon.com")).otherwise("").alias("email"),
            F.when(F.pmod(key, F.lit(7)) != 0, F.col("c_mktsegment")).alias("forename"),
            F.when(F.pmod(key, F.lit(6)) != 0, F.col("c_name")).alias("surname"),
            F.when(F.pmod(key, F.lit(2)) == 0, join_text("kl", key)).alias("klaviyoid"),
            (F.pmod(key, F.lit(3)) == 0).alias("optin"),
            F.timestamp_seconds(F.lit(1700000000) - key).alias("lastupdatedtimestamp"),
            *rest("contacts", "c_custkey"),
        )
        return versions(rows, {"surname": F.lit("stale")})

    def crm_companies(self) -> DataFrame:
        rows = self.read("supplier").select(
            F.col("s_suppkey").alias("companyid"), F.col("s_name").alias("name"),
            F.col("s_nationkey").alias("accountmanagerid"), F.lit("A").alias("statusflag"), F.lit("web").alias("source"),
            F.timestamp_seconds(F.lit(1700000000) + F.col("s_suppkey")).alias("created"),
            *rest("companies", "s_suppkey"),
        )
        return versions(rows, {"name": F.lit("stale")})

    def crm_leads(self) -> DataFrame:
        rows = self.read("events").select(
            F.col("event_id").alias("leadid"), join_text("K", F.col("user_id")).alias("contactid"),
            F.col("value").alias("value"), (F.col("value") * 2).alias("bestvalue"),
            F.col("event_type").alias("utmsource"), F.get_json_object("props", "$.k").alias("utmterm"),
            F.col("ts").alias("created"),
            *rest("leads", "event_id"),
        )
        return versions(rows, {"value": F.lit(-1.0)})

    def crm_product_items(self) -> DataFrame:
        rows = self.read("part").select(
            join_text("P", F.col("p_partkey")).alias("productitemid"), join_text("SKU-", F.col("p_partkey")).alias("sku"),
            F.when(F.col("p_size") != 1, F.col("p_name")).alias("description"), F.col("p_brand").alias("manufacturer"),
            F.col("p_type").alias("categoryid"), F.col("p_size").alias("productfamilyid"), F.lit("stock").alias("type"),
            F.col("p_retailprice").alias("sellingprice"), (F.col("p_size") == 50).alias("obsolete"),
            *rest("product_items", "p_partkey"),
        )
        return versions(rows, {"sellingprice": F.lit(-1.0), "manufacturer": F.lit("stale")})

    def crm_addresses(self) -> DataFrame:
        key = F.col("c_custkey")
        rows = self.read("customer").select(
            join_text("A", key).alias("addressid"), join_text("N", F.col("c_nationkey")).alias("country"),
            pick(ZIPS, key).alias("postcode"), F.col("c_nationkey").alias("regionnumber"),
            F.col("c_name").alias("addressline1"), F.timestamp_seconds(F.lit(1700000000) + key).alias("created"),
            *rest("addresses", "c_custkey"),
        )
        return versions(rows, {"addressline1": F.lit("stale")})

    def crm_sales_orders(self) -> DataFrame:
        status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
        ledger = (
            F.when((status == "O") & (priority == "5-LOW"), "CRMPRODTOUR")
            .when((status == "O") & (priority == "4-NOT SPECIFIED"), None)
            .otherwise(join_text("L", F.col("o_custkey")))
        )
        rows = self.read("orders").select(
            F.when(F.col("o_totalprice") >= 3000, join_text("O", F.col("o_orderkey"))).alias("ordernumber"),
            ledger.alias("salesledgerid"), cents("o_totalprice", 0.8).alias("netvalue"),
            cents("o_totalprice", 0.2).alias("taxvalue"), F.col("o_totalprice").alias("grossvalue"),
            F.lit("GBP").alias("currencycode"), F.lit("web").alias("platform"), priority.alias("source"),
            status.alias("orderstatus"), F.lit("GB").alias("deliverycountry"),
            pick(ZIPS, F.col("o_custkey")).alias("deliverypostcode"), F.col("o_orderdate").alias("orderdate"),
            *rest("sales_order_headers", "o_orderkey"),
        )
        return versions(rows, {"orderstatus": F.lit("stale"), "netvalue": F.lit(-1.0)})

    def crm_sales_invoices(self) -> DataFrame:
        rows = self.read("orders").select(
            F.when(F.col("o_totalprice") >= 3000, F.col("o_orderkey")).alias("invoicenumber"),
            join_text("O", F.col("o_orderkey")).alias("salesorderheaderid"),
            join_text("L", F.col("o_custkey")).alias("salesledgerid"), cents("o_totalprice", 0.8).alias("netvalue"),
            cents("o_totalprice", 0.2).alias("taxvalue"), F.col("o_totalprice").alias("grossvalue"),
            F.lit("GBP").alias("currencycode"), F.col("o_orderdate").alias("invoicedate"),
            *rest("sales_invoice_headers", "o_orderkey"),
        )
        return versions(rows, {"grossvalue": F.lit(-1.0)})

    def crm_sales_transactions(self, streamed: bool = False) -> DataFrame:
        pence = F.round(F.col("l_extendedprice") * 100).cast("bigint")
        rows = self.read("lineitem", streamed).select(
            join_text("T", F.col("l_orderkey"), "-", F.col("l_linenumber"), "-", F.col("l_partkey"), "-", pence).alias("id"),
            join_text("L", F.col("l_suppkey")).alias("ledger"), join_text("O", F.col("l_orderkey")).alias("ordernumber"),
            F.col("l_orderkey").alias("invoicenumber"), join_text("P", F.col("l_partkey")).alias("productitemid"),
            F.col("l_linenumber").alias("linenumber"), F.col("l_quantity").alias("orderquantity"),
            F.col("l_quantity").alias("invoicequantity"), F.col("l_quantity").alias("quantitydelivered"),
            F.col("l_extendedprice").alias("linevalue"), cents("l_extendedprice", 0.8).alias("costvalue"),
            cents("l_extendedprice", 0.2).alias("marginvalue"), F.col("l_discount").alias("marginpercent"),
            F.col("l_discount").alias("discountrate"), F.lit("GBP").alias("currencycode"),
            F.col("l_returnflag").alias("transactiontype"), F.lit("line text").alias("productdescription"),
            F.col("l_shipdate").alias("transactiondate"), F.when(F.col("l_tax") > 0, F.col("l_shipdate")).alias("orderdate"),
            *rest("sales_transactions", "l_orderkey"),
        )
        return versions(rows, {"linevalue": F.lit(-1.0)})


def catalog(spark: SparkSession, folder: str) -> Catalog:
    x = Exports(spark, folder)
    frames: dict = {}
    for sid in SETTINGS.store_ids:
        bound = {
            ("shopify", "orders"): x.shop_orders,
            ("shopify", "order_lines"): x.shop_lines,
            ("shopify", "order_refunds"): x.shop_refunds,
            ("shopify", "customers"): x.shop_customers,
            ("klaviyo", "events"): x.email_events,
            ("klaviyo", "metrics"): x.email_metrics,
            ("klaviyo", "flows"): x.email_flows,
            ("klaviyo", "campaigns"): x.email_campaigns,
            ("klaviyo", "campaign_values_reports"): x.email_campaign_stats,
            ("meta", "ads_insights_action_type"): x.ads_insights,
        }
        for (system, table), make in bound.items():
            frames[(system, table, sid)] = lambda make=make, sid=sid: make(sid)
    ga = "google_analytics"
    frames |= {
        (ga, "traffic_acquisition_session_source_medium_report", "alpha"): x.web_source_medium,
        (ga, "traffic_acquisition_session_default_channel_grouping_report", "alpha"): x.web_channels,
        (ga, "events_report", "alpha"): x.web_event_counts,
        (ga, "website_overview", "alpha"): x.web_overview,
        ("google_ads", "search_query_stats", "alpha"): x.search_queries,
        ("cin7", "sale_list", None): x.stock_sales,
        ("cin7", "customers", None): x.stock_customers,
        ("prospect_crm", "sales_ledgers", None): x.crm_sales_ledgers,
        ("prospect_crm", "contacts", None): x.crm_contacts,
        ("prospect_crm", "companies", None): x.crm_companies,
        ("prospect_crm", "leads", None): x.crm_leads,
        ("prospect_crm", "product_items", None): x.crm_product_items,
        ("prospect_crm", "addresses", None): x.crm_addresses,
        ("prospect_crm", "sales_order_headers", None): x.crm_sales_orders,
        ("prospect_crm", "sales_invoice_headers", None): x.crm_sales_invoices,
        ("prospect_crm", "sales_transactions", None): x.crm_sales_transactions,
    }
    streams = {("prospect_crm", "sales_transactions", None): lambda: x.crm_sales_transactions(streamed=True)}
    return Catalog(spark, frames=frames, streams=streams)
