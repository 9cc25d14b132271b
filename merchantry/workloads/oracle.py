"""Plain SQL for every table over the flat benchmark tables.

Each entry is one named subquery in the textbook form (joins and windows), with
the raw exports already unpacked: the Spark models must arrive at the same rows
by their own way.
"""

from __future__ import annotations

import re

from merchantry.workloads.exports import DOMAINS, SOURCES, TERMS, ZIPS
from merchantry.workloads.present import present_sql


def _list(values) -> str:
    return "[" + ", ".join("null" if v is None else f"'{v}'" for v in values) + "]"


def _pick(values, index: str) -> str:
    return f"({_list(values)})[1 + ({index}) % {len(values)}]"


def _store(key: str) -> str:
    return f"case when {key} % 2 = 0 then 'alpha' else 'beta' end"


def _area(zip_: str) -> str:
    return f"nullif(regexp_extract(upper(trim({zip_})), '^[A-Z]+'), '')"


def _month(col: str) -> str:
    return f"cast(date_trunc('month', {col}) as date)"


REGION = (
    "case {a} when 'SW' then 'London' when 'M' then 'North West' when 'EH' then 'Scotland' when 'LS' then 'Yorkshire' "
    "when 'BT' then 'Northern Ireland' when 'B' then 'West Midlands' when 'CF' then 'Wales' else 'International' end"
)
ZIP = _pick(ZIPS, "o_custkey")
CZIP = _pick(ZIPS, "c_custkey")
SHARED = f"lower(trim(' C' || (c_custkey // 2) || '@' || {_pick(DOMAINS, '(c_custkey // 2)')} || ' '))"
EPOCH = "timestamp '1970-01-01 00:00:00' + to_seconds({s})"

VIEWS: dict[str, str] = {}
COLUMNS: dict[str, str] = {}


def view(name: str, sql: str, columns: str = "") -> None:
    VIEWS[name] = sql.strip()
    if columns:
        COLUMNS[name] = columns


view(
    "stg_shopify__orders",
    f"""
    select o_orderkey as order_id, '#' || o_orderkey as order_name,
      lower('buyer' || o_custkey || '@shop' || (o_custkey % 7) || '.com') as email,
      o_orderdate - case when o_orderkey % 2 = 0 then interval 1 hour else interval 0 hour end as created_at,
      cast(o_orderdate as date) as created_date,
      case when o_orderstatus <> 'P' then o_orderdate end as processed_at, o_orderdate as updated_at,
      o_totalprice as total_price, round(o_totalprice * 0.8, 2) as subtotal_price,
      round(o_totalprice * 0.04, 2) as total_tax, round(o_totalprice * 0.2, 2) as total_discounts, 'GBP' as currency,
      if(o_orderstatus = 'F', 'paid', 'pending') as financial_status,
      if(o_orderstatus = 'O', null, 'fulfilled') as fulfillment_status,
      if(o_orderstatus = 'P', null, o_custkey) as customer_id, 'web' as source_name, o_orderpriority as tags,
      'City ' || (o_custkey % 25) as shipping_city, 'GB' as shipping_country_code,
      cast(null as varchar) as shipping_province, {ZIP} as shipping_postcode, {_area(ZIP)} as postcode_area,
      {REGION.format(a=_area(ZIP))} as uk_region, {_store('o_orderkey')} as store_id
    from orders where o_totalprice >= 5000
    """,
    "n:order_id order_name email t:created_at d:created_date t:processed_at t:updated_at r:total_price r:subtotal_price "
    "r:total_tax r:total_discounts currency financial_status fulfillment_status n:customer_id source_name tags "
    "shipping_city shipping_country_code shipping_province shipping_postcode postcode_area uk_region store_id",
)
view(
    "shop_people",
    f"""
    select c_custkey as customer_id,
      case c_custkey % 20 when 0 then '' when 1 then null else {SHARED} end as email,
      c_mktsegment as first_name, if(c_custkey % 3 = 0, null, c_name) as last_name,
      {EPOCH.format(s='1672531200 + c_custkey')} as created_at, {EPOCH.format(s='1672531200 + c_custkey')} as updated_at,
      c_nationkey as orders_count, greatest(c_acctbal, 0) as total_spent,
      c_mktsegment in ('BUILDING', 'MACHINERY') as accepts_marketing, c_nationkey
    from customer where c_acctbal >= -900
    """,
)
view(
    "stg_shopify__customers",
    """
    select * exclude c_nationkey, 'alpha' as store_id from shop_people where c_nationkey < 15
    union all select * exclude c_nationkey, 'beta' from shop_people where c_nationkey >= 10
    """,
    "n:customer_id email first_name last_name t:created_at t:updated_at n:orders_count r:total_spent accepts_marketing store_id",
)
view(
    "stg_shopify__order_line_items",
    f"""
    with kept as (
      select * from lineitem where l_extendedprice >= 1000 and l_quantity < 49)
    select l_orderkey as order_id, l_orderkey * 10 + l_linenumber as line_item_id, l_partkey as product_id,
      l_suppkey as variant_id, 'Part ' || l_partkey || if(l_linenumber = 7, ' mini', '') as product_title,
      'SKU-' || l_partkey as sku, l_quantity as quantity, l_extendedprice as unit_price_gbp,
      case when l_discount >= 0.1 then true when l_tax > 0 then false end as is_gift_card, {_store('l_orderkey')} as store_id
    from kept
    union all
    select l_orderkey, -(l_orderkey * 10 + l_linenumber), null, null, 'Gift wrap', null, 1, 2.5, null, {_store('l_orderkey')}
    from kept where l_returnflag = 'R'
    """,
    "n:order_id n:line_item_id n:product_id n:variant_id product_title sku n:quantity r:unit_price_gbp is_gift_card store_id",
)
view(
    "stg_shopify__order_refunds",
    f"""
    with back as (select * from lineitem where l_returnflag = 'R'),
    paid as (
      select l_orderkey as order_id, sum(l_extendedprice) as refund_amount, max(l_shipdate) as last_refunded_at
      from back where l_linestatus = 'F' group by 1),
    goods as (
      select l_orderkey as order_id, sum(round(l_extendedprice * 0.8, 2)) as refund_subtotal from back where l_tax > 0 group by 1)
    select coalesce(paid.order_id, goods.order_id) as order_id, {_store('coalesce(paid.order_id, goods.order_id)')} as store_id,
      coalesce(refund_amount, 0) as refund_amount, coalesce(refund_subtotal, 0) as refund_subtotal, last_refunded_at
    from paid full join goods on paid.order_id = goods.order_id
    """,
    "n:order_id store_id r:refund_amount r:refund_subtotal t:last_refunded_at",
)
view(
    "mail_rows",
    f"""
    with ev as (
      select *, cast(regexp_extract(props, '[0-9]+') as bigint) as k, {_store('user_id')} as store_id from events where value < 300),
    sent as (
      select 'e' || event_id as id, ts as sent_at, case event_type when 'view' then 'open' when 'click' then 'click'
        when 'purchase' then 'order_shop' when 'signup' then 'sub' else 'unsub' end as metric_id, * from ev
      union all select 'r' || event_id, ts, 'recv', * from ev where event_type = 'view'
      union all select 'd' || event_id, ts + interval 2 second, 'order_api', * from ev where event_type = 'purchase')
    select *, event_type in ('view', 'click') as mail, event_type in ('view', 'click') and k % 11 <> 0 as touch from sent
    """,
)
view(
    "stg_klaviyo__events",
    """
    select id as event_id, 'event' as event_type,
      sent_at - case store_id when 'beta' then interval 2 hour else interval 0 hour end as occurred_at,
      cast(sent_at as date) as occurred_date, value, 'GBP' as value_currency, 'x' || mail_rows.event_id as unique_id,
      case when touch and k % 2 = 0 then 'c' || (k % 10) end as campaign_id,
      case when touch and k % 2 = 1 then 'f' || (k % 7) end as flow_id,
      case when mail and k <> 13 then 'm' || k end as message_id,
      case when touch and k % 2 = 0 and k % 10 <> 4 then 'Send ' || (k % 10) end as campaign_name,
      case when event_type = 'purchase' then value end as order_value,
      case when event_type = 'purchase' then 'GBP' end as order_currency,
      case when event_type = 'purchase' and k >= 10 then 'o' || mail_rows.event_id end as order_id,
      'u' || user_id as profile_id, metric_id, store_id
    from mail_rows
    """,
    "event_id event_type t:occurred_at d:occurred_date r:value value_currency unique_id campaign_id flow_id message_id "
    "campaign_name r:order_value order_currency order_id profile_id metric_id store_id",
)
view(
    "stg_klaviyo__metrics",
    """
    select metric_id, metric_name, integration_name, store_id from (values
      ('view', 'recv', 'Received Email', 'mail'), ('view', 'open', 'Opened Email', 'mail'), ('click', 'click', 'Clicked Email', 'mail'),
      ('purchase', 'order_shop', 'Placed Order', 'shop'), ('purchase', 'order_api', 'Placed Order', 'api'),
      ('signup', 'sub', 'Subscribed to Email Marketing', 'mail'), (null, 'unsub', 'Unsubscribed from Email Marketing', 'mail'))
      as m(kind, metric_id, metric_name, integration_name)
    cross join (values ('alpha'), ('beta')) as s(store_id)
    where kind in (select event_type from events)
      or (kind is null and exists (select 1 from events where event_type not in ('view', 'click', 'purchase', 'signup')))
    """,
    "metric_id metric_name integration_name store_id",
)
view(
    "stg_klaviyo__flows",
    """
    select 'f' || n_nationkey as flow_id, if(n_nationkey = 3, null, n_name || ' flow') as flow_name, 'live' as flow_status, store_id
    from nation cross join (values ('alpha'), ('beta')) as s(store_id)
    """,
    "flow_id flow_name flow_status store_id",
)
view(
    "stg_klaviyo__campaigns",
    f"""
    select 'c' || p_partkey as campaign_id, p_name as campaign_name, p_type as status,
      if(p_size % 2 = 0, 'email', 'sms') as channel, {EPOCH.format(s='1704067200 + p_partkey * 60')} as send_time,
      {EPOCH.format(s='1704067200 + p_partkey * 60')} as created_at, {EPOCH.format(s='1704067200 + p_partkey * 60')} as updated_at,
      '["' || p_brand || '"]' as audiences_included, {_store('p_partkey')} as store_id
    from part where p_size <> 50
    """,
    "campaign_id campaign_name status channel t:send_time t:created_at t:updated_at audiences_included store_id",
)
view(
    "stg_klaviyo__campaign_stats",
    f"""
    select 'c' || p_partkey as campaign_id, 'm' || p_partkey as campaign_message_id,
      date '2024-01-01' + p_size as stat_date, 'email' as send_channel, p_size * 9 as opens, p_size * 7 as unique_opens,
      p_size * 5 as clicks, p_size * 4 as unique_clicks, p_size * 20 as delivered, p_size * 2 as bounced,
      p_size as unsubscribed, 0 as spam_complaints, p_retailprice as revenue, {_store('p_partkey')} as store_id
    from part where p_size <> 50
    """,
    "campaign_id campaign_message_id d:stat_date send_channel n:opens n:unique_opens n:clicks n:unique_clicks n:delivered "
    "n:bounced n:unsubscribed n:spam_complaints r:revenue store_id",
)
view(
    "mail_named",
    "select e.*, m.metric_name from stg_klaviyo__events e join stg_klaviyo__metrics m on e.store_id = m.store_id and e.metric_id = m.metric_id",
)
view(
    "stg_klaviyo__placed_orders",
    f"""
    select event_id, store_id, profile_id, occurred_at, {_month('occurred_date')} as order_month, order_id,
      order_value as revenue, order_currency as currency
    from mail_named where metric_name = 'Placed Order'
    qualify row_number() over (partition by store_id, coalesce('o:' || order_id, 'e:' || event_id) order by occurred_at, event_id) = 1
    """,
    "event_id store_id profile_id t:occurred_at d:order_month order_id r:revenue currency",
)
view(
    "stg_klaviyo__email_engagement",
    f"""
    select store_id || '|' || strftime({_month('occurred_date')}, '%Y-%m') as engagement_id, store_id,
      {_month('occurred_date')} as send_month, count(*) filter (metric_name = 'Received Email') as delivered,
      count(distinct message_id || '|' || profile_id) filter (metric_name = 'Opened Email') as unique_opens,
      count(distinct message_id || '|' || profile_id) filter (metric_name = 'Clicked Email') as unique_clicks
    from mail_named where metric_name in ('Received Email', 'Opened Email', 'Clicked Email') group by 1, 2, 3
    """,
    "engagement_id store_id d:send_month n:delivered n:unique_opens n:unique_clicks",
)
view(
    "stg_meta__ads_spend",
    f"""
    with raw as (
      select cast(l_shipdate as date) as spend_date, {_store('l_orderkey')} as store_id,
        case when l_returnflag = 'N' then 'remarketing' when l_returnflag = 'A' or l_linestatus = 'F' then 'acquisition'
          else 'other' end as audience_type, * from lineitem)
    select spend_date, {_month('spend_date')} as order_month, store_id, audience_type, sum(round(l_extendedprice * 0.04, 2)) as spend,
      sum(l_partkey) as impressions, sum(l_quantity) as clicks, sum(if(l_linenumber > 2, l_quantity, 0)) as purchases,
      sum(if(l_linenumber in (1, 3), 0, l_extendedprice)) as purchase_value
    from raw group by 1, 2, 3, 4
    """,
    "d:spend_date d:order_month store_id audience_type r:spend n:impressions n:clicks r:purchases r:purchase_value",
)
view(
    "web_rows",
    """
    select cast(ts as date) as session_date, 'alpha' as store_id, cast(regexp_extract(props, '[0-9]+') as bigint) as k,
      if(event_type = 'purchase', value, 0) as paid, event_type, user_id from events
    """,
)
view(
    "stg_google_analytics__sessions",
    f"""
    select session_date, {_month('session_date')} as order_month, store_id, sum(k + 1) as sessions, sum(k // 2) as engaged_sessions,
      sum(paid) as total_revenue from web_rows group by 1, 2, 3
    """,
    "d:session_date d:order_month store_id n:sessions n:engaged_sessions r:total_revenue",
)
view(
    "stg_google_analytics__channel_sessions",
    f"""
    select session_date, {_month('session_date')} as order_month, store_id, case event_type when 'view' then 'Direct'
      when 'click' then 'Paid Search' when 'purchase' then 'Email / CRM' when 'signup' then 'Referral / Affiliates' else 'Other' end as channel,
      sum(k + 1) as sessions, sum(paid) as channel_revenue from web_rows group by 1, 2, 3, 4
    """,
    "d:session_date d:order_month store_id channel n:sessions r:channel_revenue",
)
view(
    "stg_google_analytics__source_medium",
    f"""
    select session_date, {_month('session_date')} as order_month, store_id, {_pick([s for s, _ in SOURCES], 'user_id')} as session_source,
      {_pick([m for _, m in SOURCES], 'user_id')} as session_medium,
      {_pick([s for s, _ in SOURCES], 'user_id')} || ' / ' || {_pick([m for _, m in SOURCES], 'user_id')} as source_medium,
      sum(k + 1) as sessions, sum(paid) as revenue from web_rows group by all
    """,
    "d:session_date d:order_month store_id session_source session_medium source_medium n:sessions r:revenue",
)
view(
    "stg_google_analytics__transactions",
    f"""
    select session_date, {_month('session_date')} as order_month, store_id, sum(1 + k % 3) as transactions
    from web_rows where event_type = 'purchase' group by 1, 2, 3
    """,
    "d:session_date d:order_month store_id n:transactions",
)
view(
    "stg_google_analytics__users",
    f"""
    select session_date, {_month('session_date')} as order_month, store_id, sum(user_id) as users
    from web_rows where event_type <> 'error' group by 1, 2, 3
    """,
    "d:session_date d:order_month store_id n:users",
)
view(
    "stg_google_ads__search_terms",
    f"""
    with raw as (
      select if(l_linenumber = 7, null, cast(l_shipdate as date)) as search_date,
        lower({_pick(TERMS, 'l_partkey')} || ' ' || (l_partkey // 5)) as search_term, * from lineitem)
    select search_date, search_term, {_month('search_date')} as order_month, strftime({_month('search_date')}, '%Y-%m') as order_month_label,
      'alpha' as store_id, if(search_term like '%red %' or search_term like '%ring%', 'branded', 'non_branded') as brand_intent,
      sum(l_quantity) as clicks, sum(round(l_extendedprice * 100) / 100) as cost, sum(l_tax) as conversions
    from raw group by all
    """,
    "d:search_date search_term d:order_month order_month_label store_id brand_intent n:clicks r:cost r:conversions",
)
view(
    "stg_cin7__sales",
    f"""
    with raw as (
      select *, case when o_orderstatus = 'P' and o_orderpriority = '2-HIGH' then 'VOIDED'
          when o_orderstatus = 'P' and o_orderpriority = '3-MEDIUM' then null else 'COMPLETED' end as status,
        case when o_orderstatus = 'O' and o_orderpriority = '1-URGENT' then null else o_orderdate end as ordered_at from orders)
    select 'S' || o_orderkey as sale_id,
      case when o_orderstatus = 'F' and o_orderpriority = '5-LOW' then null else 'C' || o_custkey end as customer_id,
      'Customer ' || o_custkey as customer_name, ordered_at, {_month('ordered_at')} as order_month, o_totalprice as paid_amount,
      round(o_totalprice * 0.8, 2) as invoice_amount, 'GBP' as base_currency, 'EUR' as customer_currency, status,
      o_orderstatus as order_status, 'DONE' as fulfilment_status,
      case o_orderpriority when '1-URGENT' then 'Shopify' when '2-HIGH' then 'B2B' when '3-MEDIUM' then 'WooCommerce'
        when '5-LOW' then 'eBay' else 'Amazon_UK' end as source_channel,
      case o_orderpriority when '1-URGENT' then 'shopify_dtc' when '2-HIGH' then 'b2b' when '3-MEDIUM' then 'woocommerce'
        when '5-LOW' then 'other' else 'amazon_uk' end as channel_group
    from raw where status <> 'VOIDED' and ordered_at is not null
    """,
    "sale_id customer_id customer_name t:ordered_at d:order_month r:paid_amount r:invoice_amount base_currency customer_currency "
    "status order_status fulfilment_status source_channel channel_group",
)
view(
    "stg_cin7__customers",
    """
    select 'C' || c_custkey as customer_id, c_name as customer_name,
      if(c_nationkey in (3, 4), null, 'buyer' || c_custkey || '@mail.com') as email, 'Active' as status, 'GBP' as currency,
      c_mktsegment as price_tier, c_acctbal as credit_limit,
      if(c_nationkey = 2, null, timestamp '2024-03-01 10:00:00') as last_modified_at from customer
    """,
    "customer_id customer_name email status currency price_tier r:credit_limit t:last_modified_at",
)
view(
    "stg_cin7__customer_addresses",
    f"""
    with base as (select * from customer where c_nationkey not in (5, 6)),
    flat as (
      select c_custkey, c_nationkey, 'b' || c_custkey as address_id, trim({CZIP}) as postcode, 'Shipping' as address_type, true as is_default from base
      union all select c_custkey, c_nationkey, 'c' || c_custkey, 'M1 1AA', 'Billing', true from base
      union all select c_custkey, c_nationkey, 'a' || c_custkey, if(c_custkey % 4 = 0, 'LS1 4AB', 'CF1 1AA'), 'Shipping', c_custkey % 4 = 0 from base)
    select 'C' || c_custkey as customer_id, address_id, 'City ' || c_nationkey as city, 'UK' as country, postcode,
      cast(null as varchar) as state, address_type, is_default, {_area('postcode')} as postcode_area from flat
    """,
    "customer_id address_id city country postcode state address_type is_default postcode_area",
)

# CRM: columns that follow from a key by their type, as "name=raw name".
_REST = {
    "addresses": {
        "text": "outcode=outcode postcode_region=postcoderegion postcode_type=postcodetype address_line2=addressline2 address_line3=addressline3 address_line4=addressline4 address_line5=addressline5",
        "number": "latitude=latitude longitude=longitude",
        "time": "last_updated_at=lastupdatedtimestamp",
    },
    "companies": {
        "text": "type_id=typeid alternate_reference=alternatereference",
        "time": "first_order_at=firstorder lapsed_at=lapsed unlapsed_at=unlapsed last_updated_at=lastupdatedtimestamp",
    },
    "contacts": {
        "text": "title=title job_title=jobtitle department=department phone_number=phonenumber mobile_phone=mobilephonenumber address_id=addressid main_address_id=mainaddressid delivery_address_id=deliveryaddressid division_id=divisionid",
        "flag": "email_bounced=emailbounced",
        "time": "created_at=created",
    },
    "leads": {
        "text": "owner_id=ownerid salesperson_id=salespersonid responsible_user=responsibleuser pipeline_id=pipelineid status_id=statusid status_detail_id=statusdetailid status_flag=statusflag source_id=sourceid source_other=sourceother type_id=typeid size_id=sizeid objective_id=objectiveid address_id=addressid division_id=divisionid gut_o_meter=guttometer utm_medium=utmmedium utm_campaign=utmname utm_content=utmcontent",
        "number": "worst_value=worstvalue likely_value=likelyvalue weighted_value=weightedvalue margin_value=marginvalue",
        "time": "closed_at=closedate estimated_close_at=estimatedclose status_changed_at=statuschanged last_active_engagement_at=lastactiveengagement first_active_engagement_at=firstactiveengagement last_updated_at=lastupdatedtimestamp",
    },
    "product_items": {
        "text": "barcode=barcode extended_description=extendeddescription web_description=webdescription web_product_reference=webproductreference catalogue_code=cataloguecode catalogue_reference=cataloguereference alternate_reference1=alternatereference1 alternate_reference2=alternatereference2 manufacturer_reference=manufacturerreference",
        "number": "cost_price=costprice sale_price=saleprice next_price=nextprice decimal_cost_price=decimalcostprice decimal_selling_price=decimalsellingprice",
        "flag": "is_sellable=sellable is_stocked=stocked",
        "time": "created_at=created last_updated_at=lastupdatedtimestamp",
    },
    "sales_invoices": {
        "text": "credit_note_number=creditnotenumber platform=platform status_flag=statusflag transaction_type_id=transactiontypeid",
        "number": "base_net_value=basenetvalue base_tax_value=basetaxvalue base_gross_value=basegrossvalue",
        "time": "due_at=duedate",
    },
    "sales_ledgers": {
        "text": "postcode=postcode customer_type_id=customertypeid customer_code=customercode",
        "flag": "is_cash_account=iscashaccount",
        "time": "created_at=created last_invoice_at=lastinvoice last_receipt_at=lastreceipt",
    },
    "sales_orders": {
        "text": "salesperson_id=salespersonid division_id=divisionid status_flag=statusflag customer_reference=customerreference alternate_reference=alternatereference delivery_name=deliveryname sales_order_group_code=salesordergroupcode",
        "number": "base_net_value=basenetvalue base_tax_value=basetaxvalue base_gross_value=basegrossvalue",
        "time": "shipped_at=shippeddate due_at=duedate",
    },
    "sales_transactions": {
        "number": "price=price gross_value=grossvalue base_value=basevalue base_gross_value=basegrossvalue cost_price=costprice",
        "text": "status_flag=statusflag warehouse_code=warehousecode department_code=departmentcode",
        "time": "invoiced_at=invoicedate delivered_at=deliverydate",
    },
}


def _rest(view_name: str, key: str) -> str:
    form = {
        "text": "'{raw}-' || ({key} % 97)",
        "number": "{key} % 1000 + {i} + 0.25",
        "flag": "({key} + {i}) % 3 = 1",
        "time": EPOCH.format(s="1600000000 + 86400 * {i} + {key} % 5000000"),
    }
    return "".join(
        f", {form[kind].format(raw=pair.partition('=')[2], key=key, i=i)} as {pair.partition('=')[0]}"
        for kind, pairs in _REST[view_name].items()
        for i, pair in enumerate(pairs.split())
    )


def _rest_columns(view_name: str) -> str:
    tag = {"text": "", "number": "r:", "flag": "", "time": "t:"}
    return "".join(f" {tag[kind]}{pair.partition('=')[0]}" for kind, pairs in _REST[view_name].items() for pair in pairs.split())


view(
    "stg_prospect_crm__sales_ledgers",
    f"""
    select 'L' || c_custkey as sales_ledger_id,
      case when c_nationkey % 4 = 0 then null when c_mktsegment = 'AUTOMOBILE' then 'k' || c_custkey || '@salon.com' else {SHARED} end as email,
      c_name as customer_name, 'N' || c_nationkey as country, 'GB' as country_code, 'GBP' as currency_code,
      case c_mktsegment when 'HOUSEHOLD' then true when 'MACHINERY' then null else false end as is_b2c, c_acctbal as balance,
      c_acctbal + 1000 as credit_limit,
      case when c_custkey % 5 <> 0 then {EPOCH.format(s='1700000000 + c_custkey')} end as last_updated_at{_rest('sales_ledgers', 'c_custkey')} from customer
    """,
    "sales_ledger_id email customer_name country country_code currency_code is_b2c r:balance r:credit_limit t:last_updated_at" + _rest_columns("sales_ledgers"),
)
view(
    "stg_prospect_crm__contacts",
    f"""
    select 'K' || c_custkey as contact_id,
      case when c_nationkey < 8 then {SHARED} when c_nationkey < 20 then 'k' || c_custkey || '@salon.com' end as email,
      if(c_custkey % 7 = 0, null, c_mktsegment) as first_name, if(c_custkey % 6 = 0, null, c_name) as last_name,
      trim(coalesce(if(c_custkey % 7 = 0, null, c_mktsegment), '') || ' ' || coalesce(if(c_custkey % 6 = 0, null, c_name), '')) as full_name,
      if(c_custkey % 2 = 0, 'kl' || c_custkey, null) as klaviyo_id, c_custkey % 3 = 0 as opt_in,
      {EPOCH.format(s='1700000000 - c_custkey')} as last_updated_at{_rest('contacts', 'c_custkey')} from customer
    """,
    "contact_id email first_name last_name full_name klaviyo_id opt_in t:last_updated_at" + _rest_columns("contacts"),
)
view(
    "stg_prospect_crm__companies",
    f"""
    select s_suppkey as company_id, s_name as company_name, s_nationkey as account_manager_id, 'A' as status_flag,
      'web' as source_channel, {EPOCH.format(s='1700000000 + s_suppkey')} as created_at{_rest('companies', 's_suppkey')} from supplier
    """,
    "n:company_id company_name n:account_manager_id status_flag source_channel t:created_at" + _rest_columns("companies"),
)
view(
    "stg_prospect_crm__leads",
    f"""
    select event_id as lead_id, 'K' || user_id as contact_id, value as deal_value, value * 2 as best_value, event_type as utm_source,
      regexp_extract(props, '[0-9]+') as utm_term, ts as created_at{_rest('leads', 'event_id')} from events
    """,
    "n:lead_id contact_id r:deal_value r:best_value utm_source utm_term t:created_at" + _rest_columns("leads"),
)
view(
    "stg_prospect_crm__product_items",
    f"""
    select 'P' || p_partkey as product_item_id, 'SKU-' || p_partkey as sku, if(p_size = 1, null, p_name) as description,
      p_brand as manufacturer, p_type as category_id, p_size as product_family_id, 'stock' as product_type,
      p_retailprice as selling_price, p_size = 50 as is_obsolete{_rest('product_items', 'p_partkey')} from part
    """,
    "product_item_id sku description manufacturer category_id n:product_family_id product_type r:selling_price is_obsolete" + _rest_columns("product_items"),
)
view(
    "stg_prospect_crm__addresses",
    f"""
    select 'A' || c_custkey as address_id, 'N' || c_nationkey as country, {CZIP} as postcode, c_nationkey as region_number,
      c_name as address_line1, {EPOCH.format(s='1700000000 + c_custkey')} as created_at{_rest('addresses', 'c_custkey')} from customer
    """,
    "address_id country postcode n:region_number address_line1 t:created_at" + _rest_columns("addresses"),
)
view(
    "stg_prospect_crm__sales_orders",
    f"""
    select 'O' || o_orderkey as order_number, 'L' || o_custkey as sales_ledger_id, round(o_totalprice * 0.8, 2) as net_value,
      round(o_totalprice * 0.2, 2) as tax_value, o_totalprice as gross_value, 'GBP' as currency_code, 'web' as platform,
      o_orderpriority as source_channel, o_orderstatus as order_status, 'GB' as delivery_country, {ZIP} as delivery_postcode,
      o_orderdate as ordered_at, {_month('o_orderdate')} as order_month
   {_rest('sales_orders', 'o_orderkey')} from orders where o_totalprice >= 3000 and not (o_orderstatus = 'O' and o_orderpriority in ('5-LOW', '4-NOT SPECIFIED'))
    """,
    "order_number sales_ledger_id r:net_value r:tax_value r:gross_value currency_code platform source_channel order_status "
    "delivery_country delivery_postcode t:ordered_at d:order_month" + _rest_columns("sales_orders"),
)
view(
    "stg_prospect_crm__sales_invoices",
    f"""
    select o_orderkey as invoice_number, 'O' || o_orderkey as sales_order_header_id, 'L' || o_custkey as sales_ledger_id,
      round(o_totalprice * 0.8, 2) as net_value, round(o_totalprice * 0.2, 2) as tax_value, o_totalprice as gross_value,
      'GBP' as currency_code, o_orderdate as invoiced_at, {_month('o_orderdate')} as invoice_month
   {_rest('sales_invoices', 'o_orderkey')} from orders where o_totalprice >= 3000
    """,
    "n:invoice_number sales_order_header_id sales_ledger_id r:net_value r:tax_value r:gross_value currency_code t:invoiced_at d:invoice_month" + _rest_columns("sales_invoices"),
)
view(
    "stg_prospect_crm__sales_transactions",
    f"""
    select distinct 'T' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || cast(round(l_extendedprice * 100) as bigint) as transaction_id,
      'L' || l_suppkey as sales_ledger_id, 'O' || l_orderkey as order_number, l_orderkey as invoice_number,
      'P' || l_partkey as product_item_id, l_linenumber as line_number, l_quantity as qty_ordered, l_quantity as qty_invoiced,
      l_quantity as qty_delivered, l_extendedprice as line_value, round(l_extendedprice * 0.8, 2) as cost_value,
      round(l_extendedprice * 0.2, 2) as margin_value, l_discount as margin_percent, l_discount as discount_rate,
      'GBP' as currency_code, l_returnflag as transaction_type, 'line text' as product_description, l_shipdate as transacted_at,
      {_month('l_shipdate')} as transaction_month, if(l_tax > 0, l_shipdate, null) as ordered_at{_rest('sales_transactions', 'l_orderkey')} from lineitem
    """,
    "transaction_id sales_ledger_id order_number n:invoice_number product_item_id n:line_number r:qty_ordered r:qty_invoiced "
    "r:qty_delivered r:line_value r:cost_value r:margin_value r:margin_percent r:discount_rate currency_code transaction_type "
    "product_description t:transacted_at d:transaction_month t:ordered_at" + _rest_columns("sales_transactions"),
)

# facts and dimensions ------------------------------------------------------------
view(
    "fct_orders",
    f"""
    select o.*, coalesce(r.refund_amount, 0) as refund_amount, coalesce(r.refund_subtotal, 0) as refund_subtotal,
      subtotal_price + total_discounts as gross_sales, subtotal_price - coalesce(r.refund_subtotal, 0) as net_sales,
      total_price - coalesce(r.refund_amount, 0) as total_sales_after_returns, {_month('created_date')} as order_month,
      if(row_number() over (partition by customer_id order by created_at, o.order_id) = 1, 1, 0) as is_first_order
    from stg_shopify__orders o left join stg_shopify__order_refunds r on r.order_id = o.order_id and r.store_id = o.store_id
    """,
    COLUMNS["stg_shopify__orders"]
    + " r:refund_amount r:refund_subtotal r:gross_sales r:net_sales r:total_sales_after_returns d:order_month n:is_first_order",
)
view(
    "dim_customers",
    """
    select c.*, o.first_order_at, o.last_order_at, o.lifetime_orders, o.lifetime_revenue from stg_shopify__customers c
    left join (select customer_id, min(created_at) as first_order_at, max(created_at) as last_order_at, count(*) as lifetime_orders,
      sum(total_price) as lifetime_revenue from stg_shopify__orders group by 1) o on o.customer_id = c.customer_id
    """,
    COLUMNS["stg_shopify__customers"] + " t:first_order_at t:last_order_at n:lifetime_orders r:lifetime_revenue",
)
view(
    "dim_campaigns",
    "select * from stg_klaviyo__campaigns where channel = 'email'",
    "campaign_id campaign_name status channel t:send_time t:created_at t:updated_at store_id",
)
view(
    "dim_cin7_customers",
    """
    with life as (
      select customer_id, count(*) as n, sum(paid_amount) as paid, min(ordered_at) as first_at, max(ordered_at) as last_at,
        count(distinct channel_group) as channels from stg_cin7__sales group by 1)
    select c.customer_id, customer_name, email, status, currency, price_tier, coalesce(n, 0) as lifetime_orders,
      coalesce(paid, 0) as lifetime_revenue, first_at as first_order_at, last_at as last_order_at, coalesce(channels, 0) as channels_used,
      case when n is null then 'no_orders' when n = 1 then 'one_time' when n < 5 then 'occasional' else 'loyal' end as customer_segment
    from stg_cin7__customers c left join life on life.customer_id = c.customer_id
    """,
    "customer_id customer_name email status currency price_tier n:lifetime_orders r:lifetime_revenue t:first_order_at "
    "t:last_order_at n:channels_used customer_segment",
)
view(
    "fct_cin7_sales",
    f"""
    with home as (
      select customer_id, city as shipping_city, country as shipping_country, postcode as shipping_postcode, postcode_area
      from stg_cin7__customer_addresses where address_type = 'Shipping' and is_default
      qualify row_number() over (partition by customer_id order by address_id) = 1),
    numbered as (
      select *, row_number() over (partition by customer_id order by ordered_at, sale_id) as customer_order_number from stg_cin7__sales)
    select n.*, shipping_city, shipping_country, shipping_postcode, postcode_area, {REGION.format(a='postcode_area')} as uk_region,
      if(customer_order_number = 1, 1, 0) as is_first_order
    from numbered n left join home on home.customer_id = n.customer_id
    """,
    COLUMNS["stg_cin7__sales"]
    + " n:customer_order_number shipping_city shipping_country shipping_postcode postcode_area uk_region n:is_first_order",
)
view(
    "dim_customer_unified",
    """
    with shop as (
      select store_id, email, sum(total_spent) as spent, sum(orders_count) as n, bool_or(accepts_marketing) as marketing,
        max(first_name) as first_name, max(last_name) as last_name
      from stg_shopify__customers where email is not null group by 1, 2),
    ledger as (
      select * from stg_prospect_crm__sales_ledgers where email is not null
      qualify row_number() over (partition by email order by last_updated_at desc nulls last, sales_ledger_id) = 1),
    contact as (
      select * from stg_prospect_crm__contacts where email is not null
      qualify row_number() over (partition by email order by last_updated_at desc nulls last, contact_id) = 1),
    people as (select email from ledger union select email from contact union select email from shop),
    wide as (
      select p.email, coalesce(l.customer_name, k.full_name,
          trim(coalesce(a.first_name, b.first_name, '') || ' ' || coalesce(a.last_name, b.last_name, ''))) as display_name,
        l.country, l.sales_ledger_id as crm_sales_ledger_id, k.contact_id as crm_contact_id, k.klaviyo_id, l.balance as crm_balance,
        l.credit_limit as crm_credit_limit, l.currency_code as crm_currency_code, l.last_invoice_at as crm_last_invoice_at,
        k.opt_in as crm_opt_in, case when l.email is null then null when l.is_b2c then 'b2c' else 'b2b' end as seen_in_crm,
        a.email is not null as seen_in_shopify_alpha, b.email is not null as seen_in_shopify_beta,
        coalesce(a.spent, 0) as shopify_alpha_total_spent, coalesce(a.n, 0) as shopify_alpha_orders_count,
        coalesce(b.spent, 0) as shopify_beta_total_spent, coalesce(b.n, 0) as shopify_beta_orders_count,
        coalesce(a.marketing, false) or coalesce(b.marketing, false) as accepts_marketing,
        case when position('@' in p.email) = 0 then '' else split_part(p.email, '@', 2) end as email_domain
      from people p left join ledger l on l.email = p.email left join contact k on k.email = p.email
      left join shop a on a.email = p.email and a.store_id = 'alpha' left join shop b on b.email = p.email and b.store_id = 'beta')
    select *, shopify_alpha_total_spent + shopify_beta_total_spent as total_shopify_spend,
      shopify_alpha_orders_count + shopify_beta_orders_count as total_shopify_orders,
      case when seen_in_crm is not null and (seen_in_shopify_alpha or seen_in_shopify_beta) then 'crm_and_shopify'
        when seen_in_crm is not null then 'crm_only' when seen_in_shopify_alpha and seen_in_shopify_beta then 'both_shopify_stores'
        when seen_in_shopify_alpha then 'shopify_alpha_only' when seen_in_shopify_beta then 'shopify_beta_only' else 'unknown' end as customer_universe,
      email_domain in ('acme.co.uk', 'salon.com') as is_likely_business_email,
      email_domain in ('acme.co.uk', 'salon.com') and seen_in_crm is null and (seen_in_shopify_alpha or seen_in_shopify_beta)
        and shopify_alpha_total_spent + shopify_beta_total_spent > 0 as is_dtc_b2b_lead
    from wide
    """,
    "email display_name country crm_sales_ledger_id crm_contact_id klaviyo_id r:crm_balance r:crm_credit_limit crm_currency_code "
    "t:crm_last_invoice_at crm_opt_in seen_in_crm seen_in_shopify_alpha seen_in_shopify_beta r:shopify_alpha_total_spent "
    "n:shopify_alpha_orders_count r:shopify_beta_total_spent n:shopify_beta_orders_count r:total_shopify_spend n:total_shopify_orders "
    "accepts_marketing customer_universe email_domain is_likely_business_email is_dtc_b2b_lead",
)
view(
    "fct_b2b_sales",
    f"""
    select t.* exclude (sales_ledger_id, ordered_at, product_description), l.sales_ledger_id, l.customer_name, l.country, l.credit_limit,
      coalesce(o.ordered_at, t.ordered_at) as ordered_at, coalesce(o.order_month, {_month('t.ordered_at')}) as order_month, o.platform,
      o.source_channel, o.order_status, o.delivery_country, o.delivery_postcode, p.sku,
      coalesce(p.description, t.product_description) as product_description, p.manufacturer, p.category_id, p.product_family_id, p.product_type
    from stg_prospect_crm__sales_transactions t
    join stg_prospect_crm__sales_ledgers l on l.sales_ledger_id = t.sales_ledger_id and l.is_b2c = false
    left join stg_prospect_crm__sales_orders o on o.order_number = t.order_number
    left join stg_prospect_crm__product_items p on p.product_item_id = t.product_item_id
    """,
    "transaction_id sales_ledger_id customer_name country r:credit_limit order_number t:ordered_at d:order_month platform source_channel "
    "order_status delivery_country delivery_postcode n:invoice_number product_item_id sku product_description manufacturer category_id "
    "n:product_family_id product_type r:qty_ordered r:qty_invoiced r:qty_delivered r:line_value r:cost_value r:margin_value "
    "r:margin_percent r:discount_rate currency_code transaction_type t:transacted_at d:transaction_month r:gross_value r:cost_price "
    "warehouse_code t:invoiced_at t:delivered_at",
)
view(
    "fct_product_sales",
    """
    select i.* exclude is_gift_card, i.quantity * i.unit_price_gbp as line_revenue_gbp, o.customer_id, o.order_month, o.created_at,
      o.financial_status, o.is_first_order, o.uk_region, o.shipping_country_code
    from stg_shopify__order_line_items i left join fct_orders o on o.order_id = i.order_id and o.store_id = i.store_id
    where is_gift_card is distinct from true
    """,
    "n:line_item_id n:order_id n:product_id n:variant_id product_title sku n:quantity r:unit_price_gbp r:line_revenue_gbp store_id "
    "n:customer_id d:order_month t:created_at financial_status n:is_first_order uk_region shipping_country_code",
)
view(
    "fct_product_pairs",
    """
    with sold as (select distinct order_id, product_id, product_title from stg_shopify__order_line_items where is_gift_card is distinct from true)
    select x.product_id as product_a_id, x.product_title as product_a, y.product_id as product_b_id, y.product_title as product_b,
      count(distinct x.order_id) as orders_together
    from sold x join sold y on x.order_id = y.order_id and x.product_id < y.product_id group by 1, 2, 3, 4
    """,
    "n:product_a_id product_a n:product_b_id product_b n:orders_together",
)
view(
    "fct_product_repeat_rate",
    """
    with buys as (
      select customer_id, product_id, store_id, count(distinct order_id) as times from fct_product_sales
      where customer_id is not null and product_id is not null group by all),
    titles as (select product_id, store_id, max(product_title) as product_title from fct_product_sales where product_id is not null group by all)
    select b.product_id, b.store_id, product_title, count(*) as unique_buyers, count(*) filter (times > 1) as repeat_buyers,
      round(100.0 * (count(*) filter (times > 1)) / count(*), 1) as repeat_rate_pct
    from buys b join titles t on t.product_id = b.product_id and t.store_id = b.store_id group by 1, 2, 3
    """,
    "n:product_id store_id product_title n:unique_buyers n:repeat_buyers r:repeat_rate_pct",
)
view("fct_ad_spend", "select * from stg_meta__ads_spend", COLUMNS["stg_meta__ads_spend"])
view(
    "fct_klaviyo_revenue",
    """
    select o.event_id, o.store_id, o.order_month, o.occurred_at, o.revenue,
      if(e.campaign_id is null, 'flow', 'campaign') as attribution_kind, e.campaign_id, e.flow_id
    from stg_klaviyo__placed_orders o join mail_named e on e.store_id = o.store_id and e.profile_id = o.profile_id
      and e.metric_name in ('Opened Email', 'Clicked Email') and coalesce(e.campaign_id, e.flow_id) is not null
      and e.occurred_at between o.occurred_at - interval 5 day and o.occurred_at
    qualify row_number() over (partition by o.event_id order by e.occurred_at desc, e.event_id desc) = 1
    """,
    "event_id store_id d:order_month t:occurred_at r:revenue attribution_kind campaign_id flow_id",
)
view(
    "fct_klaviyo_campaign_revenue",
    """
    with names as (select store_id, campaign_id, max(campaign_name) as name from stg_klaviyo__events where campaign_id is not null group by 1, 2)
    select r.campaign_id, coalesce(name, r.campaign_id) as campaign_name, r.store_id, order_month, sum(revenue) as revenue
    from fct_klaviyo_revenue r left join names n on n.store_id = r.store_id and n.campaign_id = r.campaign_id
    where attribution_kind = 'campaign' group by 1, 2, 3, 4
    """,
    "campaign_id campaign_name store_id d:order_month r:revenue",
)
view(
    "fct_klaviyo_flow_revenue",
    """
    select r.flow_id, coalesce(flow_name, r.flow_id) as flow_name, r.store_id, order_month, sum(revenue) as revenue
    from fct_klaviyo_revenue r left join stg_klaviyo__flows f on f.store_id = r.store_id and f.flow_id = r.flow_id
    where attribution_kind = 'flow' group by 1, 2, 3, 4
    """,
    "flow_id flow_name store_id d:order_month r:revenue",
)
view(
    "fct_campaign_performance",
    """
    select *, if(delivered = 0, 0, unique_opens / delivered) as open_rate, if(delivered = 0, 0, unique_clicks / delivered) as click_rate
    from stg_klaviyo__email_engagement
    """,
    COLUMNS["stg_klaviyo__email_engagement"] + " r:open_rate r:click_rate",
)
view(
    "fct_klaviyo_subscriber_growth",
    f"""
    with monthly as (
      select store_id, {_month('occurred_date')} as order_month, count(*) filter (metric_name like 'Sub%') as subscribers_added,
        count(*) filter (metric_name like 'Unsub%') as unsubscribes
      from mail_named where metric_name like '%ubscribed%' group by 1, 2)
    select md5(store_id || '-' || cast(order_month as varchar)) as subscriber_growth_id, *,
      subscribers_added - unsubscribes as net_subscriber_change from monthly
    """,
    "subscriber_growth_id store_id d:order_month n:subscribers_added n:unsubscribes n:net_subscriber_change",
)
view(
    "fct_ga_sessions",
    """
    select s.*, coalesce(u.users, 0) as users, coalesce(t.transactions, 0) as transactions from stg_google_analytics__sessions s
    left join stg_google_analytics__users u on u.session_date = s.session_date and u.store_id = s.store_id
    left join stg_google_analytics__transactions t on t.session_date = s.session_date and t.store_id = s.store_id
    """,
    COLUMNS["stg_google_analytics__sessions"] + " n:users n:transactions",
)
view("fct_ga_channel_sessions", "select * from stg_google_analytics__channel_sessions", COLUMNS["stg_google_analytics__channel_sessions"])
view("fct_ga_source_medium", "select * from stg_google_analytics__source_medium", COLUMNS["stg_google_analytics__source_medium"])
view(
    "fct_brand_monthly_summary",
    """
    with shop as (select store_id, order_month, sum(total_price) as rev, count(distinct order_id) as n from fct_orders group by 1, 2),
    web as (select store_id, order_month, sum(sessions) as n, sum(total_revenue) as rev from fct_ga_sessions group by 1, 2),
    buys as (select store_id, order_month, sum(transactions) as n from stg_google_analytics__transactions group by 1, 2),
    axis as (select store_id, order_month from shop union select store_id, order_month from web union select store_id, order_month from buys)
    select a.store_id, a.order_month, coalesce(s.rev, 0) as shopify_revenue, coalesce(s.n, 0) as shopify_orders,
      coalesce(w.n, 0) as ga_sessions, coalesce(w.rev, 0) as ga_revenue, coalesce(b.n, 0) as ga_transactions,
      100.0 * coalesce(s.n, 0) / nullif(w.n, 0) as shopify_cvr_pct, coalesce(s.rev, 0) / nullif(w.n, 0) as shopify_rps_gbp
    from axis a left join shop s using (store_id, order_month) left join web w using (store_id, order_month)
    left join buys b using (store_id, order_month)
    """,
    "store_id d:order_month r:shopify_revenue n:shopify_orders n:ga_sessions r:ga_revenue n:ga_transactions r:shopify_cvr_pct r:shopify_rps_gbp",
)
view(
    "fct_marketing_kpis_daily",
    """
    with sold as (
      select created_date as date, sum(gross_sales) as gross, sum(net_sales) as net, count(distinct order_id) as n, sum(is_first_order) as fresh
      from fct_orders where store_id = 'alpha' group by 1),
    spent as (select spend_date as date, sum(spend) as spend from fct_ad_spend where store_id = 'alpha' group by 1),
    seen as (select session_date as date, sum(sessions) as n from fct_ga_sessions where store_id = 'alpha' group by 1),
    days as (select date from sold union select date from spent union select date from seen)
    select date, 'alpha' as store_id, coalesce(gross, 0) as gross_sales, coalesce(net, 0) as net_sales, coalesce(sold.n, 0) as orders,
      coalesce(fresh, 0) as new_customer_orders, coalesce(spend, 0) as ad_spend, coalesce(seen.n, 0) as sessions
    from days left join sold using (date) left join spent using (date) left join seen using (date)
    """,
    "d:date store_id r:gross_sales r:net_sales n:orders n:new_customer_orders r:ad_spend n:sessions",
)
view(
    "fct_google_ads_search_terms",
    """
    with monthly as (
      select order_month, order_month_label, store_id, brand_intent, search_term, sum(clicks) as clicks, sum(cost) as cost,
        sum(conversions) as conversions from stg_google_ads__search_terms group by 1, 2, 3, 4, 5),
    top as (select * from monthly qualify row_number() over (partition by order_month order by cost desc, search_term) <= 100)
    select order_month, order_month_label, store_id, brand_intent, sum(clicks) as clicks, sum(cost) as cost, sum(conversions) as conversions
    from top group by 1, 2, 3, 4
    """,
    "d:order_month order_month_label store_id brand_intent n:clicks r:cost r:conversions",
)


def with_views(body: str) -> str:
    """``body`` behind the named subqueries it needs, in their order."""
    needed: set[str] = set()
    todo = [body]
    while todo:
        sql = todo.pop()
        found = {name for name in VIEWS if name not in needed and re.search(rf"\b{name}\b", sql)}
        needed |= found
        todo += [VIEWS[name] for name in found]
    named = ",\n".join(f"{name} as (\n{sql}\n)" for name, sql in VIEWS.items() if name in needed)
    return f"with {named}\n{body}" if named else body


def table_sql(name: str) -> str:
    return with_views(present_sql(name, COLUMNS[name]))
