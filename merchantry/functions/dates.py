"""Instants, row-local dates and month labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from merchantry.functions import payload


def instant(df: DataFrame, path) -> Column:
    """Point in time of a text, timestamp or zone-less timestamp column."""
    return payload.field(df, path, "timestamp")


def local_date(df: DataFrame, path) -> Column:
    """Calendar date in the row's own offset.

    Exports write times as text with an offset.  The warehouse date of such a
    value is the written one, so the first ten characters are the date; a
    column that already is a timestamp has no offset left and uses UTC.
    """
    steps = [path] if isinstance(path, str) else list(path)
    kind = df.schema[steps[0]].dataType if steps[0] in df.columns else T.NullType()
    for name in steps[1:]:
        kind = next((f.dataType for f in getattr(kind, "fields", []) if f.name == name), T.NullType())
    if isinstance(kind, T.StringType):
        return F.left(payload.field(df, path, "string"), F.lit(10)).try_cast("date")
    return payload.field(df, path, "timestamp").cast("date")


def month_start(col: Column) -> Column:
    """First day of the month as a date."""
    return F.trunc(col.cast("date"), "MM")


def month_label(col: Column) -> Column:
    return F.date_format(col, "yyyy-MM")


def month_name(col: Column) -> Column:
    return F.date_format(col, "MMMM yyyy")


def compact_date(col: Column) -> Column:
    """Date out of ``yyyyMMdd`` text."""
    return F.to_date(col, "yyyyMMdd")


def iso_date(col: Column) -> Column:
    """Date out of the first ten characters of ISO text, null when unparseable."""
    return F.try_to_date(F.left(col, F.lit(10)), "yyyy-MM-dd")


def days_before(as_of: Column, days: int) -> Column:
    return F.date_sub(as_of, days)
