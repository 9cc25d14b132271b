"""Stock-system exports: sales, customers and customer addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from merchantry.functions import classify, dates, payload, scalars
from merchantry.operators import combine, ranking

LOADED_AT = "_airbyte_extracted_at"
CONTACTS = "array<struct<Email: string>>"
ADDRESSES = (
    "array<struct<ID: string, City: string, Country: string, Postcode: string, State: string, Type: string, "
    "DefaultForType: string>>"
)


def newest(raw: DataFrame, key: str, needed: list[str], only: tuple[str, DataFrame] | None = None) -> DataFrame:
    """Needed raw columns of the newest load of each key.

    Columns are cut before ranking, so the shuffle carries no unused ones; rows
    loaded at the same instant are told apart by a digest of the kept columns.

    ``only`` (a raw column, and a frame of one column with its distinct values, few enough
    for every task) leaves out the keys whose newest load has another value there.  Such
    loads are still ranked, since an older one may name a wanted value, but move as key,
    load time and digest alone.
    """
    present = {c.lower(): c for c in raw.columns}
    kept = [present[c.lower()] for c in dict.fromkeys([key, *needed]) if c.lower() in present]
    load = [F.col(LOADED_AT)] if LOADED_AT.lower() in present else [F.lit(None).cast("timestamp").alias(LOADED_AT)]
    cut = raw.select(*[F.col(f"`{c}`") for c in kept], *load)
    keys = [present[key.lower()]]
    if only is None:
        return ranking.latest_per_key(cut, keys, LOADED_AT, [ranking.row_digest(cut)])
    column, values = only
    wanted = F.broadcast(values.toDF("_value").withColumn("_wanted", F.lit(True)))
    met = cut.withColumn("_digest", ranking.row_digest(cut)).join(wanted, F.col(f"`{present[column.lower()]}`") == F.col("_value"), "left")
    carried = [F.when(F.col("_wanted"), F.col(f"`{c}`")).alias(c) for c in kept if c not in keys]
    slim = met.select(*[F.col(f"`{c}`") for c in keys], *carried, LOADED_AT, "_digest", "_wanted")
    return ranking.latest_per_key(slim, keys, LOADED_AT, [F.col("_digest")]).filter("_wanted").drop("_digest", "_wanted")


def _try_ts(df: DataFrame, column: str) -> Column:
    return payload.field(df, column, "timestamp_ntz")


def sales(raw: DataFrame) -> DataFrame:
    # Output name of each raw column, in output order.
    names = {
        "sale_id": "saleid",
        "customer_id": "customerid",
        "customer_name": "customer",
        "paid_amount": "paidamount",
        "invoice_amount": "invoiceamount",
        "base_currency": "basecurrency",
        "customer_currency": "customercurrency",
        "status": "status",
        "order_status": "orderstatus",
        "fulfilment_status": "fulfilmentstatus",
        "source_channel": "sourcechannel",
    }
    df = newest(raw, "saleid", [*names.values(), "orderdate"])
    ordered = _try_ts(df, "orderdate")
    return df.filter((F.col("status") != "VOIDED") & ordered.isNotNull()).select(
        *[F.col(src).alias(out) for out, src in names.items()],
        ordered.alias("ordered_at"),
        dates.month_start(ordered).alias("order_month"),
        classify.order_channel(F.col("sourcechannel")).alias("channel_group"),
    )


def customers(raw: DataFrame) -> DataFrame:
    needed = ["name", "contacts", "status", "currency", "pricetier", "creditlimit", "lastmodifiedon"]
    df = payload.unpack(newest(raw, "id", needed), {"contacts": CONTACTS})
    kind = payload.element_type(df, "contacts")
    first = payload.dig(F.get("contacts", F.lit(0)), kind, ("Email",), "string")
    return df.select(
        F.col("id").alias("customer_id"),
        F.col("name").alias("customer_name"),
        scalars.email(first).alias("email"),
        "status",
        "currency",
        F.col("pricetier").alias("price_tier"),
        F.col("creditlimit").alias("credit_limit"),
        _try_ts(df, "lastmodifiedon").alias("last_modified_at"),
    )


def customer_addresses(raw: DataFrame) -> DataFrame:
    df = payload.unpack(newest(raw, "id", ["addresses"]), {"addresses": ADDRESSES})
    kind = payload.element_type(df, "addresses")
    flat = combine.flatten(df.select(F.col("id").alias("customer_id"), "addresses"), "addresses", "a")
    get = lambda key, to="string": payload.dig(F.col("a"), kind, (key,), to)
    return flat.select(
        "customer_id",
        get("ID").alias("address_id"),
        get("City").alias("city"),
        get("Country").alias("country"),
        F.trim(get("Postcode")).alias("postcode"),
        get("State").alias("state"),
        get("Type").alias("address_type"),
        get("DefaultForType", "boolean").alias("is_default"),
        scalars.postcode_area(get("Postcode")).alias("postcode_area"),
    )
