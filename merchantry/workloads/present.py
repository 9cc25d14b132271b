"""One comparable form for results: rounded doubles, text dates, 64-bit integers."""

from __future__ import annotations

from pyspark.sql import DataFrame, types as T

DIGITS = 4
# Sums this large are compared to the penny: their fourth digit is summation noise.
LARGE, LARGE_DIGITS = 1e6, 2
# Added before rounding: an average that ends in exactly half a unit then rounds
# up everywhere, whatever the last bit of the sum in each engine.
NUDGE = 1e-7
STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def present(df: DataFrame) -> DataFrame:
    out = []
    for f in df.schema.fields:
        col, kind = f"`{f.name}`", f.dataType
        if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
            value = f"(cast({col} as double) + {NUDGE}D)"
            text = f"if(abs({value}) >= {LARGE}D, round({value}, {LARGE_DIGITS}), round({value}, {DIGITS}))"
        elif isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
            text = f"cast({col} as bigint)"
        elif isinstance(kind, T.DateType):
            text = f"cast({col} as string)"
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            text = f"date_format({col}, '{STAMP}')"
        else:
            text = col
        out.append(f"{text} as `{f.name}`")
    return df.selectExpr(*out)


def present_sql(source: str, columns: str) -> str:
    """SELECT list in the same form; columns are tagged ``n:`` integer, ``r:``
    double, ``d:`` date, ``t:`` timestamp, or carry no tag."""
    forms = {
        "n": "cast({c} as bigint)",
        "r": f"round(cast({{c}} as double) + {NUDGE}, case when abs(cast({{c}} as double)) >= {LARGE} then {LARGE_DIGITS} else {DIGITS} end)",
        "d": "cast(cast({c} as date) as varchar)",
        "t": "strftime({c}, '%Y-%m-%d %H:%M:%S.%f')",
        "": "{c}",
    }
    parts = []
    for item in columns.split():
        tag, _, name = item.rpartition(":")
        parts.append(f"{forms[tag].format(c=name)} as {name}")
    return f"select {', '.join(parts)} from {source}"
