"""Unions of tenants, key spines, shares, flattening and pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def union_tenants(frames: dict[str, DataFrame], shape: Callable[[DataFrame], DataFrame], tag: str = "store_id") -> DataFrame:
    """Shape every tenant's raw frame, stamp its id, and stack them.

    The id is a literal per branch, so a later filter on it removes the other
    branches from the plan.
    """
    return union_all(shape(df).withColumn(tag, F.lit(tenant)) for tenant, df in frames.items())


def spine_join(sides: dict[str, DataFrame], keys: Sequence[str], zero: Sequence[str] = ()) -> DataFrame:
    """All keys of any side, with every side's columns; ``zero`` columns get 0.

    Each side holds one row per key, so stacking the sides and taking the one
    non-null value per key equals joining each side to the union of keys, with
    a single shuffle in place of one per side.
    """
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sides.values())
    values = [c for c in stacked.columns if c not in keys]
    merged = stacked.groupBy(*keys).agg(*[F.max(c).alias(c) for c in values])
    filled = {c: F.coalesce(F.col(c), F.lit(0).cast(merged.schema[c].dataType)) for c in zero}
    return merged.withColumns(filled) if filled else merged


def share_of_total(df: DataFrame, column: str, name: str) -> DataFrame:
    """``column`` over its sum in all rows, which a scalar subquery takes from the same grouped rows.

    The subquery looks at every column, so that its plan below is that of ``df`` and
    Spark runs the grouping once for both.
    """
    others = [F.max(F.col(f"`{f.name}`")).alias(f"c{i}") for i, f in enumerate(df.schema.fields) if f.name != column]
    total = df.agg(F.struct(F.sum(column).alias("total"), *others).alias("all")).scalar().getField("total")
    return df.withColumn(name, F.col(column) / F.nullif(total, F.lit(0)))


def flatten(df: DataFrame, array: str, name: str, outer: bool = False) -> DataFrame:
    """One row per array element; ``outer`` keeps rows without elements."""
    blow = F.explode_outer if outer else F.explode
    return df.withColumn(name, blow(F.col(array)))


def sum_elements(array: Column, keep: Callable[[Column], Column] | None, value: Callable[[Column], Column]) -> Column:
    """Sum over matching array elements inside the row, in one walk; 0 for none, nulls skipped."""
    zero = F.lit(0.0)

    def add(total: Column, x: Column) -> Column:
        amount = F.coalesce(value(x), zero)
        return total + (F.when(keep(x), amount).otherwise(zero) if keep else amount)

    return F.coalesce(F.aggregate(array, zero, add), zero)


def any_element(array: Column, keep: Callable[[Column], Column]) -> Column:
    return F.coalesce(F.exists(array, keep), F.lit(False))


def pairs_within(
    items: DataFrame,
    group: Sequence[str],
    item: str,
    labels: Sequence[str],
    suffixes: tuple[str, str] = ("_a", "_b"),
    block: int = 256,
) -> DataFrame:
    """Number of groups in which two different items occur together.

    The items of a group, repeats folded, are packed into sorted blocks of about
    ``block``: one for most groups, more for a group that an estimate says is larger.
    Pairs inside a block are the triangle above its diagonal; pairs between two blocks
    of a group are built where block i meets block j, for i < j alone, so one huge group
    is built by many tasks and no pair is built to be thrown away.
    """
    a, b = suffixes
    known = [F.col(c).isNotNull() for c in (*group, item)]
    rows = reduce(lambda df, c: df.where(c), known, items).select(*group, item, *labels)
    large = (
        rows.groupBy(*group)
        .agg(F.approx_count_distinct(item).alias("_n"))
        .filter(F.col("_n") > block)
        .select(*group, F.ceil(F.col("_n") / block).cast("int").alias("_blocks"))
    )
    sized = rows.join(large, list(group), "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    entry = F.struct(F.col(item).alias("item"), *[F.col(c).alias(f"l{i}") for i, c in enumerate(labels)])
    packed = sized.groupBy(*group, "_blocks", F.pmod(F.xxhash64(item), F.col("_blocks")).cast("int").alias("_block")).agg(
        F.array_sort(F.collect_set(entry)).alias("_own")
    )

    def after(x: Column, i: Column) -> Column:
        rest = F.filter(F.slice("_own", i + 2, F.size("_own")), lambda y: y["item"] > x["item"])
        return F.transform(rest, lambda y: F.struct(x.alias("x"), y.alias("y")))

    inside = packed.select(F.inline(F.flatten(F.transform("_own", after))))
    several = packed.where("_blocks > 1")
    low = several.select(*group, F.col("_block").alias("_i"), F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_j"), F.col("_own").alias("_left")).where("_i < _j")
    high = several.select(*group, F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_i"), F.col("_block").alias("_j"), F.col("_own").alias("_right")).where("_i < _j")
    in_order = lambda x, y: F.when(x["item"] < y["item"], F.struct(x.alias("x"), y.alias("y"))).otherwise(F.struct(y.alias("x"), x.alias("y")))
    crossed = F.flatten(F.transform("_left", lambda x: F.transform("_right", lambda y: in_order(x, y))))
    between = low.join(high, [*group, "_i", "_j"]).select(F.inline(crossed))
    counted = inside.unionByName(between).groupBy("x", "y").agg(F.count(F.lit(1)).alias("together"))
    names = [("item", item), *[(f"l{i}", c) for i, c in enumerate(labels)]]
    return counted.select(*[F.col(f"{side}.{short}").alias(c + s) for side, s in (("x", a), ("y", b)) for short, c in names], "together")
