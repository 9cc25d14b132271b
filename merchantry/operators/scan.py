"""Running values along each key's rows in time, where one key, and one instant, may hold most of the rows.

A window per key sorts all rows of a key in one task.  Here rows are sorted by range
over (key, time, ties), so a range holds its share of the rows whatever their keys
are, and the sorted rows are written.  Every range is scanned by itself; what a range
hands to the next is one row, and a scan over these rows, of which there are as many
as ranges, brings each range what it has to begin with.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from merchantry.sources.sinks import scratch

def _along() -> W:
    """Rows of a range in their order.  A range is a task of the shuffle: ``spark.sql.shuffle.partitions`` sets how many rows it gets."""
    return W.partitionBy("_range").orderBy("_place")


def _so_far(window: W) -> W:
    return window.rowsBetween(W.unboundedPreceding, W.currentRow)


def sorted_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``df`` with ``_range``, numbered in the order of (keys, ``order``), ``_place`` in it from 0, and ``_key``.

    Rows that tie in everything are spread at random, so that not even they fill one range.
    """
    by = [*[F.col(f"`{k}`").asc_nulls_first() for k in keys], *order, F.col("_spread")]
    laid = df.withColumn("_spread", F.rand(11)).repartitionByRange(*by).sortWithinPartitions(*by)
    laid = scratch(laid.drop("_spread").withColumn("_row", F.monotonically_increasing_id()), "sorted")
    key = F.struct(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)])
    place = {"_range": F.shiftright("_row", 33), "_place": F.col("_row").bitwiseAND(F.lit((1 << 33) - 1)), "_key": key}
    return laid.withColumns(place).drop("_row")


def sequence(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """``row_number`` over (keys, ``order``) as ``name``; null keys are one key."""
    laid, along, ranges = sorted_ranges(df, keys, order), _along(), W.orderBy("_range")
    begins = ~F.col("_key").eqNullSafe(F.lag("_key").over(along)) | (F.col("_place") == 0)
    scanned = laid.withColumns({"_begins": begins, "_ends": F.lead("_place").over(along).isNull()})
    scanned = scanned.withColumn("_start", F.max(F.when(F.col("_begins"), F.col("_place"))).over(_so_far(along)))
    scanned = scanned.withColumn("_local", F.col("_place") - F.col("_start") + 1)

    # per range: its first key, its last key, and how many rows the last key has at its end
    edges = scanned.where((F.col("_place") == 0) | F.col("_ends")).groupBy("_range").agg(
        F.min_by("_key", "_place").alias("_first"), F.max_by("_key", "_place").alias("_last"), F.max_by("_local", "_place").alias("_tail"), F.max("_start").alias("_from")
    )
    goes_on = F.coalesce(F.col("_first").eqNullSafe(F.lag("_last").over(ranges)) & (F.lag("_range").over(ranges).isNotNull()), F.lit(False))
    edges = edges.withColumn("_goes_on", goes_on)
    # a run of ranges that hold nothing but one key adds up; any other range begins a new sum
    fresh = (~F.col("_goes_on") | (F.col("_from") > 0)).cast("int")
    edges = edges.withColumn("_sum", F.sum(fresh).over(_so_far(ranges)))
    handed = F.sum("_tail").over(_so_far(W.partitionBy("_sum").orderBy("_range")))
    edges = edges.withColumn("_handed", handed)
    carried = edges.select("_range", F.when(F.col("_goes_on"), F.lag("_handed").over(ranges)).otherwise(0).alias("_carried"))

    before = F.when(F.col("_start") == 0, F.col("_carried")).otherwise(0)
    numbered = scanned.join(carried, "_range").withColumn(name, (F.col("_local") + before).cast("long"))
    return numbered.select(*[F.col(f"`{c}`") for c in df.columns], name)


def last_before(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, name: str) -> DataFrame:
    """Adds the last ``value`` that is not null among the rows of the same key up to and with each row."""
    laid, along = sorted_ranges(df, keys, order), _along()
    held = F.struct("_key", F.col(f"`{value}`").alias("v"))
    scanned = laid.withColumns(
        {"_seen": F.last(F.when(F.col(f"`{value}`").isNotNull(), held), ignorenulls=True).over(_so_far(along)), "_ends": F.lead("_place").over(along).isNull()}
    )
    handed = scanned.where("_ends").select("_range", F.col("_seen").alias("_handed"))
    carried = handed.select("_range", F.last("_handed", ignorenulls=True).over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)).alias("_carried"))
    own = lambda c: F.when(F.col(f"{c}._key").eqNullSafe(F.col("_key")), F.col(f"{c}.v"))
    found = scanned.join(carried, "_range").withColumn(name, F.coalesce(own("_seen"), own("_carried")))
    return found.select(*[F.col(f"`{c}`") for c in df.columns], name)
