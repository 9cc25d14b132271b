from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from merchantry.functions import classify, dates, payload, regions, scalars
from tests.conftest import rows


def one(spark, col, **values):
    names = list(values)
    schema = ", ".join(f"{n} {t}" for n, (t, _) in values.items())
    df = spark.createDataFrame([tuple(v for _, v in values.values())], schema) if names else spark.range(1)
    return df.select(col.alias("x")).collect()[0].x


@pytest.mark.parametrize("raw, plain, crm", [(" A@B.com ", "a@b.com", "a@b.com"), ("  ", "", None), (None, None, None)])
def test_emails(spark, raw, plain, crm):
    assert one(spark, scalars.email(F.col("e")), e=("string", raw)) == plain
    assert one(spark, scalars.crm_email(F.col("e")), e=("string", raw)) == crm


@pytest.mark.parametrize("mail, domain", [("a@b.co", "b.co"), ("plain", ""), (None, None)])
def test_domain(spark, mail, domain):
    assert one(spark, scalars.email_domain(F.col("e")), e=("string", mail)) == domain


@pytest.mark.parametrize(
    "zip_, area, region",
    [(" sw1a 1aa", "SW", "London"), ("123", None, "International"), (None, None, "International"),
     ("zz1", "ZZ", "International"), ("b1 1aa", "B", "West Midlands"), ("BT1", "BT", "Northern Ireland")],
)
def test_postcodes(spark, zip_, area, region):
    assert one(spark, scalars.postcode_area(F.col("z")), z=("string", zip_)) == area
    assert one(spark, regions.uk_region(scalars.postcode_area(F.col("z"))), z=("string", zip_)) == region


def test_region_areas_are_unique():
    areas = [a for own in regions.REGION_AREAS.values() for a in own]
    assert len(areas) == len(set(areas)) and len(regions.REGION_AREAS) == 12


@pytest.mark.parametrize("a, b, want", [(1, 0, 0.0), (1, 2, 0.5), (None, 0, None), (1, None, None)])
def test_div0(spark, a, b, want):
    assert one(spark, scalars.div0(F.col("a"), F.col("b")), a=("bigint", a), b=("bigint", b)) == want


def test_keys(spark):
    import hashlib

    got = one(spark, scalars.surrogate_key(F.col("a"), F.col("b")), a=("string", "s"), b=("date", date(2024, 1, 1)))
    assert got == hashlib.md5(b"s-2024-01-01").hexdigest()
    with_null = one(spark, scalars.surrogate_key(F.col("a"), F.lit(1)), a=("string", None))
    assert with_null == hashlib.md5(f"{scalars.NULL_KEY_PART}-1".encode()).hexdigest()
    assert one(spark, scalars.readable_key(F.col("a"), F.lit("b")), a=("string", None)) is None
    assert one(spark, scalars.full_name(F.col("a"), F.lit("Z")), a=("string", None)) == "Z"


def test_constant_map_quotes(spark):
    got = one(spark, scalars.lookup(F.lit("it's"), {"it's": "a\\b'c"}, F.lit("-")))
    assert got == "a\\b'c"


def test_dates(spark):
    assert one(spark, dates.iso_date(F.col("s")), s=("string", "2024-02-30")) is None
    assert one(spark, dates.iso_date(F.col("s")), s=("string", "2024-02-28T11:00")) == date(2024, 2, 28)
    assert one(spark, dates.compact_date(F.lit("20240131"))) == date(2024, 1, 31)
    assert one(spark, dates.month_name(F.lit(date(2025, 5, 9)))) == "May 2025"
    assert one(spark, dates.month_label(F.lit(date(2025, 5, 9)))) == "2025-05"


def test_local_date_is_the_written_one(spark):
    df = spark.createDataFrame([("2024-03-31T23:30:00-05:00",)], "t string")
    got = df.select(dates.local_date(df, "t").alias("d"), dates.instant(df, "t").cast("string").alias("i")).collect()[0]
    assert got.d == date(2024, 3, 31) and got.i == "2024-04-01 04:30:00"


@pytest.mark.parametrize(
    "campaign, adset, want",
    [("Lookalike", "retargeting", "remarketing"), ("prospecting", "x", "acquisition"), ("x", "y", "other"), ("remarketing", None, "other")],
)
def test_audience(spark, campaign, adset, want):
    assert one(spark, classify.audience_type(F.col("c"), F.col("a")), c=("string", campaign), a=("string", adset)) == want


@pytest.mark.parametrize(
    "source, medium, want",
    [("Klaviyo mail", None, "Email / CRM"), ("x", "E-Mail", "Email / CRM"), ("google", "cpc", "Paid Search"),
     ("google", "paid", "Paid Search"), ("shop", "paid", "Paid Social"), ("fb", "cpc", "Paid Social"), ("ads", "cpc", "Other"),
     ("google", "organic", "Organic Search"), ("x", "affiliates", "Referral / Affiliates"), ("(direct)", "(none)", "Direct"),
     (None, None, "Other")],
)
def test_channels(spark, source, medium, want):
    col = classify.source_medium_channel(F.col("s"), F.col("m"))
    assert one(spark, col, s=("string", source), m=("string", medium)) == want


@pytest.mark.parametrize(
    "domain, want", [("gmail.com", False), ("salon.fun", False), ("a.in.net", False), ("", False), (None, False), ("salon.com", True)]
)
def test_business_email(spark, domain, want):
    assert one(spark, classify.business_email(F.col("d")), d=("string", domain)) is want


@pytest.mark.parametrize("n, want", [(None, "no_orders"), (0, "no_orders"), (1, "one_time"), (2, "occasional"), (4, "occasional"), (5, "loyal")])
def test_segment(spark, n, want):
    assert one(spark, classify.lifetime_segment(F.col("n")), n=("bigint", n)) == want


def test_brand_intent(spark):
    assert one(spark, classify.brand_intent(F.lit("buy acme serum"), ("acme",))) == "branded"
    assert one(spark, classify.brand_intent(F.lit("buy serum"), ("acme",))) == "non_branded"
    assert one(spark, classify.brand_intent(F.lit("x"), ())) == "non_branded"


@pytest.mark.parametrize("form", ["struct", "text", "variant"])
def test_payload_forms_agree(spark, form):
    text = '{"a": {"$b": 5, "C d": "x", "n": "1.5", "bad": "q"}}'
    df = spark.createDataFrame([(text,), (None,)], "doc string")
    shape = "struct<a: struct<`$b`: string, `C d`: string, n: string, bad: string>>"
    if form == "variant":
        df = df.select(F.parse_json("doc").alias("doc"))
    elif form == "struct":
        df = df.select(F.from_json("doc", shape).alias("doc"))
    df = payload.unpack(df, {"doc": shape})
    get = lambda *path, to: payload.field(df, ("doc", *path), to)
    out = df.select(
        get("a", "$b", to="bigint"), get("a", "C d", to="string"), get("a", "n", to="double"),
        get("a", "bad", to="double"), get("a", "gone", to="string"), payload.field(df, "nowhere", "bigint", optional=True),
    )
    with pytest.raises(KeyError):
        payload.field(df, "nowhere", "bigint")
    assert rows(out) == [(5, "x", 1.5, None, None, None), (None,) * 6]


def test_whole_numbers_with_a_point(spark):
    df = spark.createDataFrame([("12",), ("12.0",), ("1.2e1",), ("9007199254740993",), ("9007199254740993.0",), ("-12.5",), ("x",), (None,)], "q string")
    assert [r[0] for r in df.select(payload.field(df, "q", "bigint")).collect()] == [12, 12, 12, 9007199254740993, 9007199254740993, -13, None, None]


def test_clean_rows(spark):
    df = spark.createDataFrame(
        [(1, (["x"],)), (2, ([],)), (3, (None,)), (4, None)], "id int, _airbyte_meta struct<changes: array<string>>"
    )
    assert rows(payload.clean_rows(df), "id") == [(2,), (3,), (4,)]


def test_instant_of_plain_timestamps(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1, 5),)], "t timestamp_ntz")
    assert df.select(dates.local_date(df, "t")).collect()[0][0] == date(2024, 1, 1)
