"""Rows of one store that landed in another store's tables: find and remove."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from merchantry.functions import dates
from merchantry.operators.combine import union_all


def contamination_audit(
    own: DataFrame, other: DataFrame, own_name: str, other_name: str, key: str = "id", created: str = "created_at"
) -> DataFrame:
    """Overlapping keys, and first date, last date and row count of each side.

    The overlap multiplies per-key counts of the two sides, so repeated keys
    give the joined row count without building the joined rows.
    """
    per_key = [
        df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(n))
        for df, n in ((own, "_own"), (other, "_other"))
    ]
    both = per_key[0].join(per_key[1], key)
    overlap = both.agg(F.coalesce(F.sum(F.col("_own") * F.col("_other")), F.lit(0)).alias("v"))
    parts = [overlap.select(F.lit("overlapping_order_ids").alias("check_name"), F.col("v").cast("string").alias("value"))]
    for name, df in ((own_name, own), (other_name, other)):
        day = df.select(dates.local_date(df, created).alias("_day"))
        facts = day.agg(F.min("_day").alias("lo"), F.max("_day").alias("hi"), F.count(F.lit(1)).alias("n"))
        rows = F.array(
            *[
                F.struct(F.lit(f"{name}_{tag}").alias("check_name"), F.col(c).cast("string").alias("value"))
                for tag, c in (("earliest", "lo"), ("latest", "hi"), ("count", "n"))
            ]
        )
        parts.append(facts.select(F.inline(rows)))
    return union_all(parts)


def purge(df: DataFrame, foreign: DataFrame, key: str = "id", foreign_key: str = "id") -> DataFrame:
    """Rows whose key does not occur among the other store's keys."""
    keys = foreign.select(F.col(foreign_key).alias(key)).distinct()
    return df.join(keys, [key], "left_anti")
