"""Tables that streams keep: immutable runs of parquet, and a manifest that says which runs count.

A batch writes its runs into folders named after it and then commits a new manifest,
so a retried batch repeats the same writes, a committed one is passed over, and a
reader sees whole batches only.  Readers open the newest manifest and the runs it
names, nothing else.  Runs that the last manifests do not name are deleted.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: Manifests that stay, so that a reader who holds an older one can finish.
KEPT = 3


class Folder:
    """A folder of Hadoop's file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, pattern: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._files.globStatus(self._path(f"{self.root}/{pattern}")) or [])

    def exists(self, name: str) -> bool:
        return self._files.exists(self._path(f"{self.root}/{name}"))

    def make(self, name: str) -> None:
        self._files.mkdirs(self._path(f"{self.root}/{name}"))

    def read(self, name: str) -> str:
        stream = self._files.open(self._path(f"{self.root}/{name}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        """The whole file or none: written aside, then renamed."""
        aside = self._path(f"{self.root}/_{name.replace('/', '_')}")
        stream = self._files.create(aside, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        self.make(name.rpartition("/")[0])
        if not self._files.rename(aside, self._path(f"{self.root}/{name}")):
            raise OSError(f"{self.root}/{name} cannot be written")

    def delete(self, name: str) -> None:
        self._files.delete(self._path(f"{self.root}/{name}"), True)


@dataclass(frozen=True)
class Run:
    """A folder under ``runs``: of a level, or of a leaf (0: not dealt by leaves), with its rows where they are counted."""

    name: str
    level: int = 0
    leaf: int = 0
    rows: int = 0


@dataclass(frozen=True)
class State:
    """What a manifest holds: the batch it was made by, and the runs that count."""

    epoch: int
    batch: int
    schema: str
    runs: tuple[Run, ...] = field(default=())
    mark: str | None = None  # how far a load has come


class Kept:
    """Manifest and runs of one table."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.folder = spark, Folder(spark, root)

    def state(self) -> State | None:
        commits = self.folder.names("manifest/*.json")
        if not commits:
            return None
        found = json.loads(self.folder.read(f"manifest/{commits[-1]}"))
        return State(found["epoch"], found["batch"], found["schema"], tuple(Run(**r) for r in found["runs"]), found["mark"])

    def done(self, state: State | None, epoch: int, batch: int) -> bool:
        return state is not None and (state.epoch, state.batch) >= (epoch, batch)

    def commit(self, state: State) -> None:
        commits = self.folder.names("manifest/*.json")
        number = int(commits[-1].partition(".")[0]) + 1 if commits else 0
        text = {"epoch": state.epoch, "batch": state.batch, "schema": state.schema, "runs": [vars(r) for r in state.runs], "mark": state.mark}
        self.folder.put(f"manifest/{number:012d}.json", json.dumps(text))
        self._sweep()

    def _sweep(self) -> None:
        commits = self.folder.names("manifest/*.json")
        for old in commits[:-KEPT]:
            self.folder.delete(f"manifest/{old}")
        named = {r["name"].partition("/")[0] for c in commits[-KEPT:] for r in json.loads(self.folder.read(f"manifest/{c}"))["runs"]}
        for name in self.folder.names("runs/*"):
            if name not in named:
                self.folder.delete(f"runs/{name}")

    def write(self, rows: DataFrame, name: str, partition_by: Sequence[str] = ()) -> None:
        if partition_by:
            rows = rows.hint("rebalance", *partition_by)
        rows.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{self.folder.root}/runs/{name}")

    def read(self, runs: Sequence[Run], schema: str) -> DataFrame:
        """The rows of some runs."""
        kind = T.StructType.fromJson(json.loads(schema))
        if not runs:
            return self.spark.createDataFrame([], kind)
        under = f"{self.folder.root}/runs"
        found = self.spark.read.schema(kind).option("basePath", under).parquet(*[f"{under}/{r.name}" for r in runs])
        return found.select(*[f"`{c}`" for c in kind.names])

    def rows(self) -> DataFrame:
        """All rows of the newest manifest."""
        state = self.state()
        if state is None:
            raise FileNotFoundError(f"no committed batch under {self.folder.root}")
        return self.read(state.runs, state.schema)


class Levelled(Kept):
    """Rows that every batch adds to, in runs by level.

    A batch is a run of level 0.  When a level holds ``fan`` runs they are combined
    into one of the next, so n batches leave at most ``fan - 1`` runs in each of
    log(n) levels, and a row is written again once per level.  ``combine`` may fold
    rows as long as folding the parts and then the whole gives the same.  A stream
    that has lost its checkpoint sends everything again, so its first batch clears
    the table.
    """

    def __init__(self, spark: SparkSession, root: str, combine: Callable[[DataFrame], DataFrame] = lambda df: df, partition_by: Sequence[str] = (), fan: int = 4):
        super().__init__(spark, root)
        self.combine, self.partition_by, self.fan = combine, partition_by, fan

    def add(self, rows: DataFrame, epoch: int, batch: int) -> None:
        state = self.state()
        if self.done(state, epoch, batch):
            return
        schema = state.schema if state else rows.schema.json()
        runs = [*state.runs] if state and state.epoch == epoch else []
        runs.append(Run(f"run={epoch}-{batch}-0"))
        self.write(rows, runs[-1].name, self.partition_by)
        self.commit(State(epoch, batch, schema, self.compacted(runs, schema, f"run={epoch}-{batch}")))

    def compacted(self, runs: Sequence[Run], schema: str, name: str) -> tuple[Run, ...]:
        """The runs, with every full level combined into one run of the next."""
        level = 0
        while len(full := [r for r in runs if r.level == level]) >= self.fan:
            level += 1
            merged = Run(f"{name}-{level}", level)
            self.write(self.combine(self.read(full, schema)), merged.name, self.partition_by)
            runs = [r for r in runs if r not in full] + [merged]
        return tuple(runs)

    def rows(self) -> DataFrame:
        return self.combine(super().rows())


class Hashed(Kept):
    """Rows by key, in leaves of a directory of hash bits that doubles where it must (extendible hashing).

    Leaf ``1 << depth | code`` holds the keys whose hash ends in the ``depth`` bits of
    ``code``.  A leaf that would grow beyond ``leaf_rows`` is split when it is next
    rewritten, by as many bits as it takes; a batch reads only the leaves that its own
    keys fall into.  With ``null_apart`` a null in a key makes a row a key of its own;
    such rows are dealt to any leaf.
    """

    #: Bits of the directory at most: 65,536 slots bound what is broadcast to route rows.
    MOST_BITS = 16

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], leaf_rows: int = 1_000_000, null_apart: bool = False, fan: int = 4):
        super().__init__(spark, root)
        self.keys, self.leaf_rows, self.null_apart, self.fan = list(keys), leaf_rows, null_apart, fan

    def _hash(self) -> Column:
        keys = [F.col(f"`{k}`") for k in self.keys]
        by_key = F.xxhash64(*keys)
        return F.when(reduce(or_, [k.isNull() for k in keys]), F.xxhash64(F.rand(7))).otherwise(by_key) if self.null_apart else by_key

    def routed(self, rows: DataFrame, leaves: Sequence[int]) -> DataFrame:
        """``rows`` with the leaf of each."""
        bits = max(leaf.bit_length() - 1 for leaf in leaves)
        slots = [(code | high << depth, leaf) for leaf in leaves for depth in [leaf.bit_length() - 1] for code in [leaf - (1 << depth)] for high in range(1 << (bits - depth))]
        directory = self.spark.createDataFrame(slots, "_slot long, _leaf long")
        slotted = rows.withColumn("_slot", self._hash().bitwiseAND(F.lit((1 << bits) - 1)))
        return slotted.join(F.broadcast(directory), "_slot").drop("_slot")

    def _split(self, leaf: int, rows: int) -> list[int]:
        depth, more = leaf.bit_length() - 1, 0
        while rows > self.leaf_rows << more and depth + more < self.MOST_BITS:
            more += 1
        code = leaf - (1 << depth)
        return [1 << (depth + more) | code | high << depth for high in range(1 << more)]

    def _sizes(self, rows: DataFrame) -> dict[int, int]:
        """Rows per leaf: one number for each leaf, of which the directory bounds the number."""
        return {r["_leaf"]: r["n"] for r in rows.groupBy("_leaf").agg(F.count(F.lit(1)).alias("n")).collect()}

    def _dealt(self, rows: DataFrame, name: str, schema: str) -> list[Run]:
        """Writes routed rows, a run for each leaf."""
        self.write(rows, name, ["_leaf"])
        kind = T.StructType.fromJson(json.loads(schema)).add("_leaf", "long")
        sizes = self._sizes(self.spark.read.schema(kind).parquet(f"{self.folder.root}/runs/{name}"))
        return [Run(f"{name}/_leaf={leaf}", 0, leaf, n) for leaf, n in sorted(sizes.items())]

    def _whole(self, runs: Sequence[Run], leaves: Sequence[int], name: str) -> tuple[Run, ...]:
        """``runs``, and an empty one for each leaf without rows, which so keeps its place in the directory."""
        empty = sorted({*leaves} - {r.leaf for r in runs})
        for leaf in empty:
            self.folder.make(f"runs/{name}/_leaf={leaf}")
        return (*runs, *[Run(f"{name}/_leaf={leaf}", 0, leaf, 0) for leaf in empty])

    def put(self, rows: DataFrame, merge: Callable[[DataFrame], DataFrame], epoch: int, batch: int) -> None:
        """Upsert: ``merge`` folds the rows of a key into one, whatever their order.  Leaves that ``rows`` fall into are rewritten."""
        state = self.state()
        if self.done(state, epoch, batch):
            return
        fresh, name = merge(rows), f"run={epoch}-{batch}-0"
        schema = state.schema if state else fresh.schema.json()
        runs = state.runs if state else ()
        leaves = sorted({r.leaf for r in runs}) or [1]
        sizes = self._sizes(self.routed(fresh, leaves))
        touched, stay = [r for r in runs if r.leaf in sizes], [r for r in runs if r.leaf not in sizes]
        if sizes:
            split = [part for leaf, n in sizes.items() for part in self._split(leaf, n + sum(r.rows for r in touched if r.leaf == leaf))]
            whole = merge(fresh.unionByName(self.read(touched, schema))) if touched else fresh
            stay += self._dealt(self.routed(whole, [r.leaf for r in stay] + split), name, schema)
            leaves = [leaf for leaf in leaves if leaf not in sizes] + split
        self.commit(State(epoch, batch, schema, self._whole(stay, leaves, name)))

    def insert(self, rows: DataFrame, first: Callable[[DataFrame], DataFrame], epoch: int, batch: int) -> None:
        """Rows of keys that are not there yet; ``first`` picks one of each key.

        They become further runs of their leaves, of which only the keys were read.  The
        runs of a leaf that has ``fan`` of them, or too many rows, are written as one.
        """
        state = self.state()
        if self.done(state, epoch, batch):
            return
        fresh, name = first(rows), f"run={epoch}-{batch}"
        schema = state.schema if state else fresh.schema.json()
        runs = list(state.runs) if state else []
        leaves = sorted({r.leaf for r in runs}) or [1]
        dealt = self.routed(fresh, leaves)
        touched = self._sizes(dealt)
        if touched:
            known = self.read([r for r in runs if r.leaf in touched], schema).select(*self.keys)
            runs += self._dealt(dealt.join(known, self.keys, "left_anti"), f"{name}-0", schema)
        by_leaf = {leaf: [r for r in runs if r.leaf == leaf] for leaf in leaves}
        full = [leaf for leaf, own in by_leaf.items() if len(own) >= self.fan or sum(r.rows for r in own) > self.leaf_rows and leaf in touched]
        if full:
            split = [part for leaf in full for part in self._split(leaf, sum(r.rows for r in by_leaf[leaf]))]
            leaves = [leaf for leaf in leaves if leaf not in full] + split
            moved = self.routed(self.read([r for leaf in full for r in by_leaf[leaf]], schema), leaves)
            # rows dealt to any leaf may land in one that is not rewritten; they become a further run of it
            runs = [r for r in runs if r.leaf not in full] + self._dealt(moved, f"{name}-1", schema)
        self.commit(State(epoch, batch, schema, self._whole(runs, leaves, f"{name}-0")))


def epoch_of(spark: SparkSession, root: str, checkpoint: str) -> int:
    """The number of a target's current epoch; a missing checkpoint starts the next one, noted before any batch."""
    target, progress = Folder(spark, root), Folder(spark, checkpoint)
    last = max(map(int, target.names("_epochs/*")), default=-1)
    if last >= 0 and progress.exists("metadata"):
        return last
    target.make(f"_epochs/{last + 1}")
    return last + 1
