"""Charts, metric sets and declared checks over the written fact tables."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from merchantry.operators.combine import union_all
from merchantry.plans import checks, metrics
from merchantry.plans.charts import attribution_report, charts, monthly_report
from merchantry.plans.semantic import Filter, MetricQuery
from merchantry.plans.warehouse import FACTS, STAGING, Warehouse
from merchantry.session import prepare, shared_folder
from merchantry.workloads import exports, oracle
from merchantry.workloads.present import present, present_sql

SETTINGS = exports.SETTINGS
# Orders end in 2001, web events are of January 2024.
AS_OF = date(2001, 7, 31)
MONTHS = ("2023-12", "2024-01")
REPORT = ("2024-01-01", "2024-01-31")
SHOP_REPORT = ("2001-03-01", "2001-05-31")
# Tables dated by web events; all others by orders.
EVENT_DATED = ("fct_ga", "fct_klaviyo", "fct_campaign")

# Staging tables whose rows are parsed from JSON and read by several models of one fact.
PARSED = ("stg_klaviyo__events",)

_WRITTEN: dict[tuple[str, int, str], "Written"] = {}


class Written(Warehouse):
    """A warehouse whose facts are written when first asked for, then scanned.

    Parsed staging tables are written too: as views each reader would parse them anew,
    and once more for every filter that Spark moves below the parsing.
    """

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__(prepare(spark), exports.catalog(spark, folder), SETTINGS)
        self.target = shared_folder(spark, "facts")
        self._done: set[str] = set()

    def table(self, name: str) -> DataFrame:
        if name not in self._done and (name in FACTS or name in PARSED):
            self.materialize(name, self.target)
            self._done.add(name)
        return super().table(name)


def written(spark: SparkSession, folder: str) -> Written:
    key = (spark.sparkContext.applicationId, id(spark), folder)
    if key not in _WRITTEN:
        _WRITTEN[key] = Written(spark, folder)
    return _WRITTEN[key]


# SQL for a metric query -----------------------------------------------------------
def _label_case(column: str, labels: dict[str, str]) -> str:
    arms = " ".join(f"when '{k}' then '{v}'" for k, v in labels.items())
    return f"case {column} {arms} else {column} end"


CHANNEL = (
    "case when session_source = 'klaviyo' or session_medium = 'e-mail' then 'Email / CRM' "
    "when session_source in ('Google', 'bing') then 'Paid Search' when session_source in ('facebook', 'fb') then 'Paid Social' "
    "when session_medium = 'organic' then 'Organic Search' when session_medium = 'referral' then 'Referral / Affiliates' "
    "when session_source = '(direct)' then 'Direct' else 'Other' end"
)


def _dimension_sql(table: str, name: str) -> str:
    if name == "store_id" and table in metrics.STORE_LABELLED:
        return _label_case("store_id", SETTINGS.display_labels())
    if name == "order_month_label" and table in metrics.MONTH_LABELLED:
        return f"strftime({metrics.MONTH_LABELLED[table]}, '%Y-%m')"
    special = {
        ("fct_orders", "customer_type"): "if(is_first_order = 1, 'New customers', 'Returning customers')",
        ("fct_ad_spend", "audience_type"): _label_case("audience_type", metrics.AUDIENCE_LABELS),
        ("fct_google_ads_search_terms", "brand_intent"): _label_case("brand_intent", metrics.INTENT_LABELS),
        ("fct_ga_source_medium", "channel"): CHANNEL,
        ("fct_klaviyo_subscriber_growth", "order_month_name"): "strftime(order_month, '%B %Y')",
    }
    return special.get((table, name), name)


def _condition_sql(table: str, f: Filter, as_of: date) -> str:
    col = _dimension_sql(table, f.field)
    values = ", ".join(str(v).lower() if isinstance(v, bool) else f"'{v}'" for v in f.values)
    if f.op == "inThePast":
        return f"{col} >= date_trunc('month', date '{as_of}') - interval {f.values[0] - 1} month"
    return {
        "equals": f"{col} in ({values})",
        "notEquals": f"coalesce({col} not in ({values}), true)",
        "isNull": f"{col} is null",
        "isNotNull": f"{col} is not null",
        "inBetween": f"{col} between date {values.replace(', ', ' and date ')}",
    }[f.op]


def _tag(table: str, dim: str) -> str:
    for item in oracle.COLUMNS[table].split():
        tag, _, name = item.rpartition(":")
        if name == dim and _dimension_sql(table, dim) == dim:
            return f"{tag}:{dim}" if tag else dim
    return dim


def _metric_tag(name: str, sql: str) -> str:
    return f"n:{name}" if sql.startswith("count(") else f"r:{name}"


def query_sql(query: MetricQuery, as_of: date) -> str:
    defs = metrics.explores(SETTINGS, as_of)[query.explore].metrics
    dims = [f"{_dimension_sql(query.explore, d)} as {d}" for d in query.dims]
    sums = [f"{defs[m]} as {m}" for m in query.metrics]
    where = " and ".join(_condition_sql(query.explore, f, as_of) for f in query.filters)
    sql = f"select {'distinct ' if not sums else ''}{', '.join(dims + sums)} from {query.explore}"
    sql += f" where {where}" if where else ""
    if dims and sums:
        sql += " group by " + ", ".join(str(i + 1) for i in range(len(dims)))
    form = {
        "share": "{a} / nullif(sum({a}) over (), 0)",
        "ratio": "{a} / nullif({b}, 0)",
        "complement": "1 - {a} / nullif({b}, 0)",
        "change": "{a} / nullif({b}, 0) - 1",
    }
    calcs = [f"{form[c.kind].format(a=c.a, b=c.b)} as {c.name}" for c in query.calcs]
    sql = f"select *{''.join(', ' + c for c in calcs)} from ({sql}) as grouped"
    if query.sort:
        name, down = query.sort
        order = f"{name} desc nulls first" if down else f"{name} asc nulls last"
        order += "".join(f", {d} asc nulls last" for d in query.dims if d != name)
        sql += f" order by {order}"
    if query.limit and dims:
        sql += f" limit {query.limit}"
    columns = [_tag(query.explore, d) for d in query.dims]
    columns += [_metric_tag(m, defs[m]) for m in query.metrics] + [f"r:{c.name}" for c in query.calcs]
    if query.pivot:
        on, values = query.pivot
        rest = [d for d in query.dims if d != on]
        cells, columns = [], [_tag(query.explore, d) for d in rest]
        for v in values:
            for m in (*query.metrics, *[c.name for c in query.calcs]):
                cells.append(f"max({m}) filter ({on} = '{v}') as {v}_{m}")
                columns.append((_metric_tag(m, defs[m]) if m in defs else f"r:{m}").replace(m, f"{v}_{m}"))
        sql = f"select {', '.join(rest)}, {', '.join(cells)} from ({sql}) as long group by {', '.join(rest)}"
    return oracle.with_views(present_sql(f"({sql}) as result", " ".join(columns)))


def _double_sums(df: DataFrame, query: MetricQuery) -> DataFrame:
    """Sums and ratios as doubles, so their form does not depend on the summed type."""
    counted = {m for m in query.metrics if metrics.explores(SETTINGS)[query.explore].metrics[m].startswith("count(")}
    whole = {*query.dims, *counted}
    if query.pivot:
        keep = {d for d in query.dims}
        counts = {f"{v}_{m}" for v in query.pivot[1] for m in counted}
        whole = keep | counts
    casts = {c: F.col(c).cast("double") for c in df.columns if c not in whole}
    return df.withColumns(casts) if casts else df


def _chart(query: MetricQuery, as_of: date) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: present(_double_sums(written(spark, folder).query(query, as_of), query))


def _key(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", name)


# Main dimensions for a full set of metrics per table.
METRIC_DIMS = {
    "fct_orders": "store_id customer_type order_month_label", "dim_customers": "store_id accepts_marketing",
    "fct_campaign_performance": "store_id order_month_label", "fct_cin7_sales": "channel_group uk_region",
    "dim_cin7_customers": "customer_segment", "fct_product_sales": "store_id uk_region",
    "fct_product_pairs": "product_a", "fct_product_repeat_rate": "store_id",
    "dim_customer_unified": "customer_universe seen_in_crm", "fct_b2b_sales": "country manufacturer",
    "fct_ad_spend": "store_id audience_type order_month_label", "fct_klaviyo_revenue": "store_id attribution_kind order_month_label",
    "fct_klaviyo_campaign_revenue": "store_id campaign_name order_month_label",
    "fct_klaviyo_flow_revenue": "store_id flow_name order_month_label", "fct_ga_sessions": "store_id order_month_label",
    "fct_ga_channel_sessions": "channel store_id order_month_label", "fct_ga_source_medium": "channel store_id order_month_label",
    "fct_brand_monthly_summary": "store_id order_month_label", "fct_marketing_kpis_daily": "store_id",
    "fct_google_ads_search_terms": "brand_intent order_month_label",
    "fct_klaviyo_subscriber_growth": "store_id order_month_label order_month_name",
}


def report_queries() -> dict[str, tuple[MetricQuery, date]]:
    out = {}
    explores = metrics.explores(SETTINGS, AS_OF)
    for table, dims in METRIC_DIMS.items():
        out[f"metrics_{table}"] = (MetricQuery(table, tuple(dims.split()), tuple(explores[table].metrics)), AS_OF)
    for name, query in charts(SETTINGS, MONTHS).items():
        out[f"chart_{_key(name)}"] = (query, AS_OF)
    for report in (monthly_report, attribution_report):
        of_events, of_orders = report(SETTINGS, *REPORT), report(SETTINGS, *SHOP_REPORT)
        for name, query in of_events.items():
            chosen = query if query.explore.startswith(EVENT_DATED) else of_orders[name]
            out[f"report_{_key(name)}"] = (chosen, AS_OF)
    return out


# declared checks --------------------------------------------------------------------
def _checks_sql(table: str, declared: checks.Checks) -> str:
    tests = [("not_null", c, f"count(*) filter ({c} is null)") for c in declared.required.split()]
    tests += [
        ("accepted_values", c, f"count(*) filter ({c} not in ({', '.join(repr(x) for x in v)}))") for c, v in declared.accepted.items()
    ]
    tests += [("accepted_range", c, f"count(*) filter ({c} < 0)") for c in declared.not_negative.split()]
    parts = []
    if tests:
        rows = ", ".join(f"{{'k': '{k}', 'c': '{c}', 'n': {sql}}}" for k, c, sql in tests)
        parts.append(f"select unnest([{rows}]) as r from {table}")
    keys = [("unique", [c]) for c in declared.unique.split()]
    keys += [("unique_combination", list(declared.unique_together))] if declared.unique_together else []
    for kind, cols in keys:
        known = " and ".join(f"{c} is not null" for c in cols)
        parts.append(
            f"select {{'k': '{kind}', 'c': '{','.join(cols)}', 'n': count(*)}} as r from "
            f"(select 1 from {table} where {known} group by {', '.join(cols)} having count(*) > 1) as repeated"
        )
    stacked = " union all ".join(parts)
    return f"select '{table}' as table_name, r.k as check_name, r.c as column_name, r.n as failures from ({stacked}) as t"


CHECK_GROUPS = {
    "checks_shop": [t for t in STAGING if t.startswith("stg_shopify")],
    "checks_email": [t for t in STAGING if t.startswith("stg_klaviyo")],
    "checks_traffic": [t for t in STAGING if t.startswith(("stg_meta", "stg_google"))],
    "checks_stock": [t for t in STAGING if t.startswith("stg_cin7")],
    "checks_crm": [t for t in STAGING if t.startswith("stg_prospect")],
    "checks_facts_sales": [t for t in FACTS if t in checks.DECLARED and not t.startswith(("fct_k", "fct_g", "fct_m", "fct_c", "fct_br", "fct_ad"))],
    "checks_facts_marketing": [t for t in FACTS if t in checks.DECLARED and t.startswith(("fct_k", "fct_g", "fct_m", "fct_c", "fct_br", "fct_ad"))],
}


def _check_group(tables: list[str]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        house = written(spark, folder)
        return present(union_all(house.check(t) for t in tables))

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {name: _chart(query, as_of) for name, (query, as_of) in report_queries().items()}
    return {**out, **{name: _check_group(tables) for name, tables in CHECK_GROUPS.items()}}


def oracle_sql() -> dict[str, str]:
    out = {name: query_sql(query, as_of) for name, (query, as_of) in report_queries().items()}
    for name, tables in CHECK_GROUPS.items():
        body = " union all ".join(_checks_sql(t, checks.DECLARED[t]) for t in tables)
        out[name] = oracle.with_views(present_sql(f"({body}) as result", "table_name check_name column_name n:failures"))
    return out


