"""Access to semi-structured export columns.

Landed columns may be nested structs (parquet), JSON text or variants.  Structs
are read field by field so that nested column pruning reaches the scan; JSON
text and variants are parsed once per column into the asked-for shape.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T


def unpack(df: DataFrame, shapes: dict[str, str]) -> DataFrame:
    """Parse JSON-text or variant columns into the DDL shape given for each.

    Scalars in a shape should be ``string``: numbers sent as text then survive
    and are cast where they are used.
    """
    parsed = {}
    for name, ddl in shapes.items():
        if name not in df.columns:
            continue
        kind = df.schema[name].dataType
        if isinstance(kind, T.StringType):
            parsed[name] = F.from_json(F.col(name), ddl)
        elif isinstance(kind, T.VariantType):
            parsed[name] = F.try_variant_get(F.col(name), "$", ddl)
    return df.withColumns(parsed) if parsed else df


def _step(col: Column, kind: T.DataType, name: str):
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            if f.name.lower() == name.lower():
                return col.getField(f.name), f.dataType
    elif isinstance(kind, T.MapType):
        return F.try_element_at(col, F.lit(name)), kind.valueType
    elif isinstance(kind, T.VariantType):
        return F.try_variant_get(col, f'$["{name}"]', "variant"), kind
    return None, None


def dig(col: Column, kind: T.DataType, path: Sequence[str], to: str) -> Column:
    """Nested value cast to ``to``; null where a step or the value is missing."""
    for name in path:
        col, kind = _step(col, kind, name)
        if col is None:
            return F.lit(None).cast(to)
    if isinstance(kind, T.VariantType):
        return F.try_variant_get(col, "$", to)
    return convert(col, kind, to)


def convert(col: Column, kind: T.DataType, to: str) -> Column:
    if kind.simpleString() == to:
        return col
    if to == "string" and isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(col)
    if isinstance(kind, (T.NullType,)):
        return col.cast(to)
    if isinstance(kind, T.StringType) and to in ("bigint", "long", "int", "integer"):
        # whole numbers may be written as 12.0 or 1.2e1; other fractions round, as a cast does in the warehouse
        whole = F.round(col.try_cast("decimal(38,6)"), 0).try_cast(to)
        return F.coalesce(col.try_cast(to), whole)
    return col.try_cast(to)


def field(df: DataFrame, path: str | Sequence[str], to: str, optional: bool = False) -> Column:
    """Value at ``path`` of a frame; a plain string names a top-level column.

    A top-level column that is not there is an error, unless it is ``optional`` and then null.
    """
    steps = [path] if isinstance(path, str) else list(path)
    actual = {c.lower(): c for c in df.columns}.get(steps[0].lower())
    if actual is None and optional:
        return F.lit(None).cast(to)
    if actual is None:
        raise KeyError(f"the export has no column {steps[0]}, only {', '.join(df.columns)}")
    return dig(F.col(f"`{actual}`"), df.schema[actual].dataType, steps[1:], to)


def element_type(df: DataFrame, column: str) -> T.DataType:
    kind = df.schema[column].dataType
    return kind.elementType if isinstance(kind, T.ArrayType) else T.NullType()


def clean_rows(df: DataFrame) -> DataFrame:
    """Rows whose load metadata reports no cast problem."""
    if "_airbyte_meta" not in df.columns:
        return df
    changes = field(df, ("_airbyte_meta", "changes"), "array<string>")
    return df.filter(changes.isNull() | (F.size(changes) == 0))


META_SHAPE = "struct<changes: array<string>>"
