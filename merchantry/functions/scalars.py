"""Text, number and key helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: stands for a null part inside a hashed key.
NULL_KEY_PART = "_dbt_utils_surrogate_key_null_"


def email(col: Column) -> Column:
    """Trimmed lower-case address; an empty one stays an empty string."""
    return F.lower(F.trim(col))


def crm_email(col: Column) -> Column:
    """Like :func:`email`, but an empty address is null."""
    return F.nullif(email(col), F.lit(""))


def full_name(first: Column, last: Column) -> Column:
    blank = F.lit("")
    return F.trim(F.concat(F.coalesce(first, blank), F.lit(" "), F.coalesce(last, blank)))


def email_domain(col: Column) -> Column:
    return F.split_part(col, F.lit("@"), F.lit(2))


def postcode_area(postcode: Column) -> Column:
    """Leading letters of a postcode; null when it starts with anything else."""
    return F.regexp_substr(F.upper(F.trim(postcode)), F.lit("^[A-Z]+"))


def div0(a: Column, b: Column) -> Column:
    """``a / b``; 0 when ``b`` is 0, null when either is null."""
    return F.when(a.isNotNull() & (b == 0), F.lit(0.0)).otherwise(a / F.nullif(b, F.lit(0)))


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, null when ``b`` is 0."""
    return a / F.nullif(b, F.lit(0))


def percent(a: Column, b: Column, digits: int = 1) -> Column:
    return F.round(100.0 * a / F.nullif(b, F.lit(0)), digits)


def from_micros(col: Column) -> Column:
    return col / F.lit(1e6)


def surrogate_key(*cols: Column) -> Column:
    parts = [F.coalesce(c.cast("string"), F.lit(NULL_KEY_PART)) for c in cols]
    return F.md5(F.concat_ws("-", *parts))


def readable_key(*cols: Column) -> Column:
    """Key parts joined by ``|``; null if any part is null."""
    out = [cols[0]]
    for c in cols[1:]:
        out += [F.lit("|"), c]
    return F.concat(*out)


def any_of(conditions) -> Column:
    conditions = list(conditions)
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def constant_map(pairs: dict[str, str]) -> Column:
    """A literal string map, built as one expression."""
    quote = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    items = ", ".join(f"{quote(k)}, {quote(v)}" for k, v in pairs.items())
    return F.expr(f"map({items})")


def lookup(key: Column, pairs: dict[str, str], default: Column) -> Column:
    return F.coalesce(F.try_element_at(constant_map(pairs), key), default)
