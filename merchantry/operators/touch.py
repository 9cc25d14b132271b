"""As-of join: the newest touch inside a look-back window before each order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from merchantry.operators import scan


def last_touch(
    orders: DataFrame,
    touches: DataFrame,
    keys: Sequence[str],
    order_id: Sequence[str],
    order_ts: str,
    touch_ts: str,
    touch_id: str,
    carry: Sequence[str],
    lookback_days: int = 5,
) -> DataFrame:
    """Orders with the carried columns of their last touch; untouched ones drop out.

    A touch counts from exactly ``lookback_days`` before the order up to the
    order's own instant; of two touches at one instant the greater id wins.  Of rows
    that repeat an order id, that with the later touch stays.

    No order/touch pairs are built, and no key or day is a unit of work: touches and
    orders are laid in one line by key and time, and a segmented scan hands the last
    touch along, so one profile's rows spread over many tasks even if they are of one
    instant.  Touches are read once.
    """
    for name in orders.columns:
        if name.startswith("_"):
            raise ValueError(f"column name {name} is reserved")
    for k in keys:
        orders, touches = orders.filter(F.col(k).isNotNull()), touches.filter(F.col(k).isNotNull())
    touch = F.struct(F.col(touch_ts).alias("_ts"), F.col(touch_id).alias("_id"), *[F.col(c).alias(f"_c_{c}") for c in carry])
    whole = F.struct(*[F.col(f"`{c}`") for c in orders.columns])
    seen = touches.filter(F.col(touch_ts).isNotNull()).select(*keys, F.col(touch_ts).alias("_at"), F.lit(0).alias("_kind"), touch.alias("_touch"))
    placed = orders.filter(F.col(order_ts).isNotNull()).select(*keys, F.col(order_ts).alias("_at"), F.lit(1).alias("_kind"), whole.alias("_order"))
    line = seen.unionByName(placed, allowMissingColumns=True)
    order = [F.col("_at"), F.col("_kind"), F.col("_touch").asc_nulls_first()]
    floor_ts = F.col(f"_order.{order_ts}") - F.make_dt_interval(F.lit(lookback_days))
    found = scan.last_before(line, keys, order, "_touch", "_seen").filter((F.col("_kind") == 1) & (F.col("_seen._ts") >= floor_ts))

    ids = [F.col(f"_order.{c}").alias(f"_o{i}") for i, c in enumerate(order_id)]
    best = found.groupBy(*ids).agg(F.max(F.struct("_seen", "_order")).alias("_best"))
    taken = [F.col(f"_best._seen._c_{c}").alias(c) for c in carry]
    return best.select("_best._order.*", F.col("_best._seen._ts").alias("touch_at"), *taken)
