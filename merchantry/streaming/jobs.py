"""Streams over landed files.  Each job is started by its caller's trigger.

Spark's state store holds nothing: what a job must remember is in tables of its own
(:mod:`merchantry.streaming.tables`), so rows count however late they land, memory
does not grow with days or keys, and a retried batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import timedelta
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from merchantry.operators import ranking
from merchantry.operators.touch import last_touch
from merchantry.streaming.tables import Hashed, Levelled, epoch_of


def read_files(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_batch: int = 1000) -> DataFrame:
    """Landed files as a stream with a bounded number of files per batch."""
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_batch).load(path)


def append_files(stream: DataFrame, target: str, checkpoint: str) -> DataStreamWriter:
    """Incremental append: each landed file is written to the target exactly once."""
    return (
        stream.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
    )


def stream_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def latest_per_key(
    stream: DataFrame, keys: Sequence[str], recency: str, ties: Sequence[str], target: str, checkpoint: str, leaf_rows: int = 1_000_000
) -> DataStreamWriter:
    """Keep a table of the newest row per key; null key parts are values like others.

    A batch is first cut to its newest row per key; then only the leaves its keys fall
    into are read, merged and rewritten, and split when they grow.  A stream that starts
    without its checkpoint sends its rows again, and they change nothing.
    """
    epoch = epoch_of(stream.sparkSession, target, checkpoint)
    order = [F.col(c).desc_nulls_last() for c in ties]

    def merge(batch: DataFrame, batch_id: int) -> None:
        newest = lambda df: ranking.latest_per_key(df, keys, recency, order)
        Hashed(batch.sparkSession, target, keys, leaf_rows).put(batch, newest, epoch, batch_id)

    return stream_batches(stream, merge, checkpoint)


def read_latest(spark: SparkSession, target: str) -> DataFrame:
    """Current rows of a table kept by :func:`latest_per_key`."""
    return Hashed(spark, target, []).rows()


def first_per_order(stream: DataFrame, ts: str, keys: Sequence[str], target: str, checkpoint: str, leaf_rows: int = 1_000_000) -> DataStreamWriter:
    """Keep the first arrival per key, however late it lands; all repeats are dropped.

    Of repeats in one batch the earliest stays, of equal times the one with the least
    digest; a later batch never replaces a row, so the first to arrive need not be the
    earliest.  Rows with a null key part repeat nothing and all stay.
    """
    epoch = epoch_of(stream.sparkSession, target, checkpoint)

    def keep(batch: DataFrame, batch_id: int) -> None:
        unknown = reduce(or_, [F.col(k).isNull() for k in keys])

        def first(df: DataFrame) -> DataFrame:
            order = [F.col(ts).asc_nulls_last(), ranking.row_digest(df)]
            return ranking.top_n_per_group(df.where(~unknown), keys, order).unionByName(df.where(unknown))

        Hashed(batch.sparkSession, target, keys, leaf_rows, null_apart=True).insert(batch, first, epoch, batch_id)

    return stream_batches(stream, keep, checkpoint)


def read_first(spark: SparkSession, target: str) -> DataFrame:
    """The rows kept by :func:`first_per_order`."""
    return Hashed(spark, target, []).rows()


def _added(by: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.groupBy("day", *by).agg(F.sum("n").alias("n"))


def daily_counts(stream: DataFrame, ts: str, by: Sequence[str], target: str, checkpoint: str, fan: int = 4) -> DataStreamWriter:
    """Keep the number of events per day and group, however late they land; events without a time are of the null day.

    A batch adds its own counts; readers add up a number of runs that grows with the
    logarithm of the batches.
    """
    epoch = epoch_of(stream.sparkSession, target, checkpoint)

    def add(batch: DataFrame, batch_id: int) -> None:
        counted = batch.groupBy(F.to_date(ts).alias("day"), *by).agg(F.count(F.lit(1)).alias("n"))
        Levelled(batch.sparkSession, target, _added(by), fan=fan).add(counted, epoch, batch_id)

    return stream_batches(stream, add, checkpoint)


def read_daily_counts(spark: SparkSession, target: str, by: Sequence[str]) -> DataFrame:
    """(day, by..., n) as kept by :func:`daily_counts`."""
    return Levelled(spark, target, _added(by)).rows()


def attribute_orders(
    stream: DataFrame,
    is_order: Column,
    keys: Sequence[str],
    order_id: Sequence[str],
    ts: str,
    touch_id: str,
    carry: dict[str, str],
    target: str,
    checkpoint: str,
    lookback_days: int = 5,
    leaf_rows: int = 1_000_000,
) -> DataStreamWriter:
    """Keep orders with their last touch: what :func:`last_touch` gives over all that has landed, in whatever order it landed.

    ``stream`` holds orders (where ``is_order``) and touches; ``carry`` names columns of
    the touch for the result.  Both go into a log of runs by day.  A batch credits its
    own orders and, again, those landed before that a touch of the batch may concern:
    of the same key, in the look-back time from the touch on.  Only the days around the
    batch's own are read.  Credits are upserted by ``order_id``: more touches only ever
    lead to a later one, so of two credits of an order that with the later touch holds.
    """
    epoch = epoch_of(stream.sparkSession, target, checkpoint)
    reach = lookback_days + 1  # the look-back may begin within a day
    order = [F.col("touch_at").desc(), F.col("touch_tie").desc(), F.struct(*[F.col(f"`{c}`") for c in stream.columns]).desc()]
    best = lambda df: ranking.top_n_per_group(df, order_id, order)

    def attribute(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = reduce(and_, [F.col(c).isNotNull() for c in (*keys, ts)])
        dated = batch.where(known).withColumns({"_is_order": F.coalesce(is_order, F.lit(False)), "_day": F.to_date(ts)})
        log = Levelled(spark, f"{target}/log", partition_by=["_day"])
        log.add(dated, epoch, batch_id)
        landed = log.rows()
        # there are no more days than the calendar has
        own = [tuple(r) for r in dated.select("_is_order", "_day").distinct().collect()]
        around = lambda first, last, kinds: sorted({d + timedelta(days=i) for kind, d in own if kind in kinds for i in range(first, last + 1)})
        later = F.explode(F.transform(F.sequence(F.lit(0), F.lit(reach)), lambda i: F.date_add("_day", i)))
        concerned = dated.where(~F.col("_is_order")).select(*keys, later.alias("_day")).distinct()
        again = landed.where(F.col("_is_order") & F.col("_day").isin(around(0, reach, (False,)))).join(concerned, [*keys, "_day"], "left_semi")
        orders = dated.where("_is_order").unionByName(again).select(*stream.columns)
        seen = landed.where(~F.col("_is_order") & F.col("_day").isin(sorted({*around(-reach, 0, (True,)), *around(-reach, reach, (False,))})))
        touches = seen.select(*keys, F.col(ts).alias("touch_ts"), F.col(touch_id).alias("touch_tie"), *[F.col(c).alias(name) for name, c in carry.items()])
        credited = last_touch(orders, touches, keys, order_id, ts, "touch_ts", "touch_tie", ["touch_tie", *carry], lookback_days)
        Hashed(spark, f"{target}/credits", order_id, leaf_rows).put(credited, best, epoch, batch_id)

    return stream_batches(stream, attribute, checkpoint)


def read_credits(spark: SparkSession, target: str) -> DataFrame:
    """Orders with ``touch_at`` and the carried columns, as kept by :func:`attribute_orders`."""
    return Hashed(spark, f"{target}/credits", []).rows().drop("touch_tie")
