"""CRM exports: newest row per key under readable column names."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from merchantry.functions import dates, scalars
from merchantry.plans.staging_stock import newest

# Raw key of each table.
KEYS = {
    "addresses": "addressid",
    "companies": "companyid",
    "contacts": "contactid",
    "leads": "leadid",
    "product_items": "productitemid",
    "sales_invoice_headers": "invoicenumber",
    "sales_ledgers": "salesledgerid",
    "sales_order_headers": "ordernumber",
    "sales_transactions": "id",
}

# Output name and raw name of each column of each table.
COLUMNS = {
    "addresses": {
        "address_id": "addressid",
        "country": "country",
        "postcode": "postcode",
        "outcode": "outcode",
        "postcode_region": "postcoderegion",
        "postcode_type": "postcodetype",
        "region_number": "regionnumber",
        "address_line1": "addressline1",
        "address_line2": "addressline2",
        "address_line3": "addressline3",
        "address_line4": "addressline4",
        "address_line5": "addressline5",
        "latitude": "latitude",
        "longitude": "longitude",
        "created_at": "created",
        "last_updated_at": "lastupdatedtimestamp",
    },
    "companies": {
        "company_id": "companyid",
        "company_name": "name",
        "account_manager_id": "accountmanagerid",
        "status_flag": "statusflag",
        "source_channel": "source",
        "type_id": "typeid",
        "alternate_reference": "alternatereference",
        "created_at": "created",
        "first_order_at": "firstorder",
        "lapsed_at": "lapsed",
        "unlapsed_at": "unlapsed",
        "last_updated_at": "lastupdatedtimestamp",
    },
    "contacts": {
        "contact_id": "contactid",
        "email": "email",
        "first_name": "forename",
        "last_name": "surname",
        "title": "title",
        "job_title": "jobtitle",
        "department": "department",
        "klaviyo_id": "klaviyoid",
        "phone_number": "phonenumber",
        "mobile_phone": "mobilephonenumber",
        "address_id": "addressid",
        "main_address_id": "mainaddressid",
        "delivery_address_id": "deliveryaddressid",
        "division_id": "divisionid",
        "opt_in": "optin",
        "email_bounced": "emailbounced",
        "created_at": "created",
        "last_updated_at": "lastupdatedtimestamp",
    },
    "leads": {
        "lead_id": "leadid",
        "contact_id": "contactid",
        "owner_id": "ownerid",
        "salesperson_id": "salespersonid",
        "responsible_user": "responsibleuser",
        "pipeline_id": "pipelineid",
        "status_id": "statusid",
        "status_detail_id": "statusdetailid",
        "status_flag": "statusflag",
        "source_id": "sourceid",
        "source_other": "sourceother",
        "type_id": "typeid",
        "size_id": "sizeid",
        "objective_id": "objectiveid",
        "address_id": "addressid",
        "division_id": "divisionid",
        "deal_value": "value",
        "best_value": "bestvalue",
        "worst_value": "worstvalue",
        "likely_value": "likelyvalue",
        "weighted_value": "weightedvalue",
        "margin_value": "marginvalue",
        "gut_o_meter": "guttometer",
        "utm_source": "utmsource",
        "utm_medium": "utmmedium",
        "utm_campaign": "utmname",
        "utm_term": "utmterm",
        "utm_content": "utmcontent",
        "created_at": "created",
        "closed_at": "closedate",
        "estimated_close_at": "estimatedclose",
        "status_changed_at": "statuschanged",
        "last_active_engagement_at": "lastactiveengagement",
        "first_active_engagement_at": "firstactiveengagement",
        "last_updated_at": "lastupdatedtimestamp",
    },
    "product_items": {
        "product_item_id": "productitemid",
        "sku": "sku",
        "barcode": "barcode",
        "description": "description",
        "extended_description": "extendeddescription",
        "web_description": "webdescription",
        "web_product_reference": "webproductreference",
        "catalogue_code": "cataloguecode",
        "catalogue_reference": "cataloguereference",
        "alternate_reference1": "alternatereference1",
        "alternate_reference2": "alternatereference2",
        "manufacturer": "manufacturer",
        "manufacturer_reference": "manufacturerreference",
        "category_id": "categoryid",
        "product_family_id": "productfamilyid",
        "product_type": "type",
        "cost_price": "costprice",
        "selling_price": "sellingprice",
        "sale_price": "saleprice",
        "next_price": "nextprice",
        "decimal_cost_price": "decimalcostprice",
        "decimal_selling_price": "decimalsellingprice",
        "is_obsolete": "obsolete",
        "is_sellable": "sellable",
        "is_stocked": "stocked",
        "created_at": "created",
        "last_updated_at": "lastupdatedtimestamp",
    },
    "sales_invoice_headers": {
        "invoice_number": "invoicenumber",
        "sales_order_header_id": "salesorderheaderid",
        "sales_ledger_id": "salesledgerid",
        "credit_note_number": "creditnotenumber",
        "net_value": "netvalue",
        "tax_value": "taxvalue",
        "gross_value": "grossvalue",
        "base_net_value": "basenetvalue",
        "base_tax_value": "basetaxvalue",
        "base_gross_value": "basegrossvalue",
        "currency_code": "currencycode",
        "platform": "platform",
        "status_flag": "statusflag",
        "transaction_type_id": "transactiontypeid",
        "invoiced_at": "invoicedate",
        "due_at": "duedate",
    },
    "sales_ledgers": {
        "sales_ledger_id": "salesledgerid",
        "email": "email",
        "customer_name": "name",
        "country": "country",
        "country_code": "countrycode",
        "postcode": "postcode",
        "currency_code": "currencycode",
        "is_b2c": "isb2c",
        "is_cash_account": "iscashaccount",
        "customer_type_id": "customertypeid",
        "customer_code": "customercode",
        "balance": "balance",
        "credit_limit": "creditlimit",
        "created_at": "created",
        "last_invoice_at": "lastinvoice",
        "last_receipt_at": "lastreceipt",
        "last_updated_at": "lastupdatedtimestamp",
    },
    "sales_order_headers": {
        "order_number": "ordernumber",
        "sales_ledger_id": "salesledgerid",
        "salesperson_id": "salespersonid",
        "division_id": "divisionid",
        "net_value": "netvalue",
        "tax_value": "taxvalue",
        "gross_value": "grossvalue",
        "base_net_value": "basenetvalue",
        "base_tax_value": "basetaxvalue",
        "base_gross_value": "basegrossvalue",
        "currency_code": "currencycode",
        "platform": "platform",
        "source_channel": "source",
        "order_status": "orderstatus",
        "status_flag": "statusflag",
        "customer_reference": "customerreference",
        "alternate_reference": "alternatereference",
        "delivery_name": "deliveryname",
        "delivery_country": "deliverycountry",
        "delivery_postcode": "deliverypostcode",
        "sales_order_group_code": "salesordergroupcode",
        "ordered_at": "orderdate",
        "shipped_at": "shippeddate",
        "due_at": "duedate",
    },
    "sales_transactions": {
        "transaction_id": "id",
        "sales_ledger_id": "ledger",
        "order_number": "ordernumber",
        "invoice_number": "invoicenumber",
        "product_item_id": "productitemid",
        "line_number": "linenumber",
        "qty_ordered": "orderquantity",
        "qty_invoiced": "invoicequantity",
        "qty_delivered": "quantitydelivered",
        "price": "price",
        "line_value": "linevalue",
        "gross_value": "grossvalue",
        "base_value": "basevalue",
        "base_gross_value": "basegrossvalue",
        "cost_value": "costvalue",
        "cost_price": "costprice",
        "margin_value": "marginvalue",
        "margin_percent": "marginpercent",
        "discount_rate": "discountrate",
        "currency_code": "currencycode",
        "transaction_type": "transactiontype",
        "status_flag": "statusflag",
        "warehouse_code": "warehousecode",
        "department_code": "departmentcode",
        "product_description": "productdescription",
        "transacted_at": "transactiondate",
        "ordered_at": "orderdate",
        "invoiced_at": "invoicedate",
        "delivered_at": "deliverydate",
    },
}


def renames(table: str) -> dict[str, str]:
    return COLUMNS[table]


def _named(table: str, raw: DataFrame, only: tuple[str, DataFrame] | None = None) -> DataFrame:
    """The newest rows under their readable names; a column that the export lacks is an error."""
    names = renames(table)
    df = newest(raw, KEYS[table], list(names.values()), only)
    present = {c.lower(): c for c in df.columns}
    missing = [src for src in names.values() if src not in present]
    if missing:
        raise KeyError(f"the export {table} has no column {', '.join(missing)}")
    return df.select(*[F.col(f"`{present[src]}`").alias(out) for out, src in names.items()])


def addresses(raw: DataFrame) -> DataFrame:
    return _named("addresses", raw)


def companies(raw: DataFrame) -> DataFrame:
    return _named("companies", raw)


def contacts(raw: DataFrame) -> DataFrame:
    df = _named("contacts", raw)
    return df.withColumns(
        {
            "email": scalars.crm_email(F.col("email")),
            "full_name": scalars.full_name(F.col("first_name"), F.col("last_name")),
        }
    )


def leads(raw: DataFrame) -> DataFrame:
    return _named("leads", raw)


def product_items(raw: DataFrame) -> DataFrame:
    return _named("product_items", raw)


def sales_invoices(raw: DataFrame) -> DataFrame:
    df = _named("sales_invoice_headers", raw).filter(F.col("invoice_number").isNotNull())
    return df.withColumn("invoice_month", dates.month_start(F.col("invoiced_at")))


def sales_ledgers(raw: DataFrame) -> DataFrame:
    return _named("sales_ledgers", raw).withColumn("email", scalars.crm_email(F.col("email")))


def sales_orders(raw: DataFrame, demo_ledger: str) -> DataFrame:
    """The newest row decides; a null ledger drops like the demo ledger does."""
    df = _named("sales_order_headers", raw)
    kept = df.filter((F.col("sales_ledger_id") != demo_ledger) & F.col("order_number").isNotNull())
    return kept.withColumn("order_month", dates.month_start(F.col("ordered_at")))


def sales_transactions(raw: DataFrame, ledgers: DataFrame | None = None) -> DataFrame:
    """The newest load of each line; with ``ledgers`` (distinct ids, few) the lines alone whose newest load names one of them."""
    only = None if ledgers is None else (renames("sales_transactions")["sales_ledger_id"], ledgers)
    df = _named("sales_transactions", raw, only)
    return df.withColumn("transaction_month", dates.month_start(F.col("transacted_at")))
