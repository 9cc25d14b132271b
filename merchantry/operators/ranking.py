"""One row per key, top rows per group, and running numbers per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from merchantry.operators import scan


def _cols(items: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in items]


def top_n_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """First ``n`` rows of every group.

    The rank filter lets Spark cut each map task down to ``n`` rows per key
    before the shuffle (WindowGroupLimit), so a key with very many rows costs
    ``n`` rows per task on the wire.
    """
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= n).drop("_rank")


def latest_per_key(df: DataFrame, keys: Sequence[str], recency: str, ties: Sequence[Column] = ()) -> DataFrame:
    """Newest row of each key; rows without a load time never win over dated ones."""
    return top_n_per_group(df, keys, [F.col(recency).desc_nulls_last(), *ties])


def row_digest(df: DataFrame) -> Column:
    """Hash of the hashable columns: a repeatable tie-break between rows."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
    usable = [c for c, k in kinds.items() if k not in ("map", "variant")]
    return F.xxhash64(*[F.col(f"`{c}`") for c in usable])


def sequence_per_key(df: DataFrame, keys: Sequence[str], ts: str, ties: Sequence[str], name: str) -> DataFrame:
    """``row_number`` over (keys, ordered by ts then ties), nulls last, by a segmented scan.

    A plain window sorts all rows of one key in one task; here a key's rows, and those
    of one instant, are dealt to as many ranges as they fill.
    """
    return scan.sequence(df, keys, [F.col(c).asc_nulls_last() for c in (ts, *ties)], name)


def first_rows(df: DataFrame, entity: Sequence[str], ts: str, row_key: Sequence[str]) -> DataFrame:
    """Row keys of the earliest row of each entity, as one map-side-combined ``min``."""
    first = F.min(F.struct(F.col(ts).isNull().alias("_undated"), ts, *row_key)).alias("_first")
    return df.groupBy(*entity).agg(first).select(*[F.col(f"_first.{k}").alias(k) for k in row_key])


def place_in_key(row_key: Sequence[str], ts: str, digest: Column) -> Column:
    """Number from 1 of each of the rows that repeat a row key, the earliest first, of equal times the one with the least digest."""
    return F.row_number().over(W.partitionBy(*row_key).orderBy(F.col(ts).asc_nulls_last(), digest))


def once_per_key(mark: Column, row_key: Sequence[str], ts: str, digest: Column) -> Column:
    """``mark`` on the first of the rows that repeat a row key, by :func:`place_in_key`; 0 on the others."""
    return F.when(place_in_key(row_key, ts, digest) == 1, mark).otherwise(F.lit(0))


def mark_first(df: DataFrame, entity: Sequence[str], ts: str, row_key: Sequence[str], name: str) -> DataFrame:
    """1 on the earliest row of each entity, 0 on all others.

    The mark is joined back on the row key, so an entity with very many rows (or
    the null entity of all guests) spreads over all tasks.  Of rows that repeat a
    row key, one is marked.
    """
    marks = first_rows(df, entity, ts, row_key).withColumn("_mark", F.lit(1))
    joined = df.join(marks, list(row_key), "left")
    return joined.select(*[df[c] for c in df.columns], once_per_key(F.coalesce("_mark", F.lit(0)), row_key, ts, row_digest(df)).alias(name))

