"""Metric queries over fact tables: filter, group, measure, calculate, sort, cut."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from merchantry.functions import dates, scalars
from merchantry.operators import combine


@dataclass(frozen=True)
class Filter:
    """``field op values``; the field is a dimension, as displayed.

    Operators: equals (any of the values), notEquals (nulls stay), isNull,
    isNotNull, inThePast (n months, the current one included), inBetween
    (both ends included).
    """

    field: str
    op: str
    values: tuple = ()


@dataclass(frozen=True)
class Calc:
    """A calculation on the grouped rows.

    Kinds: share (of the column total), ratio (a / b), complement (1 - a / b)
    and change (a / b - 1, for a figure beside its comparison period).
    """

    name: str
    kind: str
    a: str
    b: str | None = None


@dataclass(frozen=True)
class Labelled:
    """A code column shown under labels; a code without a label shows itself."""

    column: str
    labels: dict[str, str]

    def __call__(self) -> Column:
        return scalars.lookup(F.col(self.column), self.labels, F.col(self.column))

    def stored(self, shown: Sequence) -> list:
        """Codes shown as any of the given values."""
        codes = [code for code, label in self.labels.items() if label in shown]
        return codes + [value for value in shown if value not in self.labels]


@dataclass(frozen=True)
class MonthLabel:
    """A first-of-month date column shown as ``yyyy-MM``."""

    column: str

    def __call__(self) -> Column:
        return dates.month_label(F.col(self.column))

    def stored(self, shown: Sequence) -> list:
        return [date(int(v[:4]), int(v[5:7]), 1) for v in shown if re.fullmatch(r"\d{4}-(0[1-9]|1[0-2])", v)]


@dataclass(frozen=True)
class Explore:
    """A fact table with its metrics (SQL aggregates) and derived dimensions."""

    table: str
    metrics: dict[str, str]
    dimensions: dict[str, Callable[[], Column]] = field(default_factory=dict)

    def dimension(self, name: str) -> Column:
        rule = self.dimensions.get(name)
        return rule() if rule else F.col(name)

    def metric(self, name: str) -> Column:
        return F.expr(self.metrics[name])


@dataclass(frozen=True)
class MetricQuery:
    explore: str
    dims: tuple[str, ...] = ()
    metrics: tuple[str, ...] = ()
    filters: tuple[Filter, ...] = ()
    sort: tuple[str, bool] | None = None  # (field, descending)
    limit: int | None = None
    calcs: tuple[Calc, ...] = ()
    pivot: tuple[str, tuple[str, ...]] | None = None  # (dimension, values that come first)

    def with_filter(self, extra: Filter) -> "MetricQuery":
        return replace(self, filters=(*self.filters, extra))


def condition(explore: Explore, f: Filter, as_of: Column) -> Column:
    """Filter as a Column.

    Comparisons with displayed values are turned into comparisons of the stored
    column, so they reach the scan (partition pruning, row-group statistics).
    """
    col = explore.dimension(f.field)
    if f.op in ("equals", "notEquals"):
        rule, values = explore.dimensions.get(f.field), list(f.values)
        if hasattr(rule, "stored"):
            col, values = F.col(rule.column), rule.stored(values)
        hit = col.isin(*values) if values else F.lit(False)
        return hit if f.op == "equals" else col.isNull() | ~hit
    if f.op == "isNull":
        return col.isNull()
    if f.op == "isNotNull":
        return col.isNotNull()
    if f.op == "inThePast":
        return col >= F.add_months(F.trunc(as_of, "MM"), 1 - f.values[0])
    if f.op == "inBetween":
        low, high = (F.lit(v).cast("date") for v in f.values)
        return col.between(low, high)
    raise ValueError(f"unknown filter operator {f.op}")


def _calculate(grouped: DataFrame, calc: Calc) -> DataFrame:
    if calc.kind == "share":
        return combine.share_of_total(grouped, calc.a, calc.name)
    quotient = F.col(calc.a) / F.nullif(F.col(calc.b), F.lit(0))
    value = {"ratio": quotient, "complement": 1 - quotient, "change": quotient - 1}[calc.kind]
    return grouped.withColumn(calc.name, value)


DISTINCT = re.compile(r"count\(distinct (\w+)\)")


def distinct_counts(rows: DataFrame, dims: Sequence[Column], names: Sequence[str], counted: dict[str, str]) -> DataFrame:
    """Several distinct counts per group, by one shuffle.

    A row gives one entry (metric, value) for each count that it has a value for, and one
    without, which keeps groups that have none.  Equal entries fold where they are, once
    more after the shuffle, and what is left is counted.
    """
    values = [F.when(F.col(c).isNotNull(), F.struct(F.lit(i).alias("_metric"), F.col(c).cast("string").alias("_value"))) for i, c in enumerate(counted.values())]
    group = F.struct(F.lit(-1).alias("_metric"), F.lit(None).cast("string").alias("_value"))
    entries = F.inline(F.filter(F.array(group, *values), lambda x: x.isNotNull()))
    distinct = rows.select(*dims, entries).distinct()
    return distinct.groupBy(*names).agg(*[F.count_if(F.col("_metric") == i).alias(m) for i, m in enumerate(counted)])


def metric_query(
    table: DataFrame, explore: Explore, query: MetricQuery, as_of: date | None = None
) -> DataFrame:
    """Run a query on an explore's table.

    Without metrics the result is the distinct dimension rows.  Shares are taken
    before the cut to ``limit`` rows.  Rows that tie on the sort field are
    ordered by the dimensions, so a cut result is the same on every run; nulls
    come first when descending and last when ascending, as in the warehouse.
    """
    today = F.lit(as_of) if as_of else F.current_date()
    rows = table
    for f in query.filters:
        rows = rows.filter(condition(explore, f, today))
    dims = [explore.dimension(d).alias(d) for d in query.dims]
    measures = [explore.metric(m).alias(m) for m in query.metrics]
    counted = {m: found[1] for m in query.metrics if (found := DISTINCT.fullmatch(explore.metrics[m]))}
    if not measures:
        grouped = rows.select(*dims).distinct()
    elif len(counted) > 1:
        plain = [explore.metric(m).alias(m) for m in query.metrics if m not in counted]
        sides = {"distinct": distinct_counts(rows, dims, query.dims, counted)}
        if plain:
            sides["plain"] = rows.groupBy(*dims).agg(*plain)
        zero = () if dims else tuple(counted)
        grouped = combine.spine_join(sides, query.dims, zero).select(*query.dims, *query.metrics)
        grouped = grouped.withColumns({m: F.coalesce(m, F.lit(0)) for m in counted})
    elif dims:
        grouped = rows.groupBy(*dims).agg(*measures)
    else:
        grouped = rows.agg(*measures)
    for calc in query.calcs:
        grouped = _calculate(grouped, calc)
    if query.sort:
        name, descending = query.sort
        lead = F.col(name).desc_nulls_first() if descending else F.col(name).asc_nulls_last()
        rest = [F.col(d).asc_nulls_last() for d in query.dims if d != name]
        grouped = grouped.orderBy(lead, *rest)
    if query.limit and dims:
        grouped = grouped.limit(query.limit)
    if query.pivot:
        grouped = spread(grouped, query)
    return grouped


#: Columns that a pivot may have per measure.
MOST_COLUMNS = 500


def spread(grouped: DataFrame, query: MetricQuery) -> DataFrame:
    """Values of one dimension as columns, one per value and measure.

    The listed values lead, also those that do not occur; all others that do occur
    follow in order, rows without a value under ``no_`` and the dimension.  More than :data:`MOST_COLUMNS` values fail.
    """
    name, listed = query.pivot
    measures = [*query.metrics, *[c.name for c in query.calcs]]
    rest = [d for d in query.dims if d != name]
    found = [r[0] for r in grouped.select(name).distinct().limit(MOST_COLUMNS + 1).collect()]
    if len(found) > MOST_COLUMNS:
        raise ValueError(f"{name} has more than {MOST_COLUMNS} values")
    if None in found:
        none = f"no_{name}"
        grouped, found = grouped.withColumn(name, F.coalesce(F.col(name).cast("string"), F.lit(none))), [none if v is None else str(v) for v in found]
    values = [*listed, *sorted(v for v in found if v not in listed)]
    if not values:
        return grouped.select(*rest).distinct()
    if len(measures) == 1:
        return grouped.groupBy(*rest).pivot(name, values).agg(F.first(measures[0]))
    return grouped.groupBy(*rest).pivot(name, values).agg(*[F.first(m).alias(m) for m in measures])


def across_tiles(
    queries: dict[str, MetricQuery], f: Filter, remap: dict[str, str], skip: Sequence[str] = ()
) -> dict[str, MetricQuery]:
    """One filter for many queries; ``remap`` names the column some of them use."""
    out = {}
    for name, query in queries.items():
        moved = replace(f, field=remap.get(name, f.field))
        out[name] = query if name in skip else query.with_filter(moved)
    return out
