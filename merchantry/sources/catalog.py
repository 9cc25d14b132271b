"""Where raw tables live: one folder per system and store, or given frames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

Key = tuple[str, str, str | None]


@dataclass
class Catalog:
    """``<root>/<system>[_<store>]/<table>`` read in ``fmt``.

    ``aliases`` maps a logical table name to its physical one.  ``frames`` gives
    tables directly, as a DataFrame or a function that makes one; ``streams`` the same
    rows for readers that make one pass over them and sort none.
    """

    spark: SparkSession
    root: str | None = None
    fmt: str = "parquet"
    aliases: dict[Key, str] = field(default_factory=dict)
    frames: dict[Key, DataFrame | Callable[[], DataFrame]] = field(default_factory=dict)
    streams: dict[Key, Callable[[], DataFrame]] = field(default_factory=dict)

    def path(self, system: str, table: str, store: str | None = None) -> str:
        schema = f"{system}_{store}" if store else system
        physical = self.aliases.get((system, table, store), table)
        return f"{str(self.root).rstrip('/')}/{schema}/{physical}"

    def has(self, system: str, table: str, store: str | None = None) -> bool:
        if (system, table, store) in self.frames:
            return True
        if self.root is None:
            return False
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(system, table, store))
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def source(self, system: str, table: str, store: str | None = None) -> DataFrame:
        key = (system, table, store)
        given = self.frames.get(key)
        if given is not None:
            if callable(given):
                given = self.frames[key] = given()
            return given
        if self.root is None:
            raise KeyError(f"no raw table {(system, table, store)}")
        return self.spark.read.format(self.fmt).load(self.path(system, table, store))

    def streamed(self, system: str, table: str, store: str | None = None) -> DataFrame:
        """The rows of :meth:`source`, in no better pieces than they come where that spares a move."""
        make = self.streams.get((system, table, store))
        return make() if make else self.source(system, table, store)

    def tables(self) -> list[Key]:
        """All raw tables: the given frames, and the folders under ``root`` by their logical names."""
        found = list(self.frames)
        if self.root is not None:
            pattern = self.spark._jvm.org.apache.hadoop.fs.Path(f"{str(self.root).rstrip('/')}/*/*")
            listed = pattern.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
            named = {f"{system}_{store}" if store else system: (system, store) for system, _, store in self.aliases}
            logical = {(system, store, physical): table for (system, table, store), physical in self.aliases.items()}
            for status in listed:
                folder, table = status.getPath().getParent().getName(), status.getPath().getName()
                system, store = named.get(folder, (folder, None))
                found.append((system, logical.get((system, store, table), table), store))
        return sorted(set(found), key=str)
