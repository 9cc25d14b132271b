"""Repeated lines found by levelled sorted runs of line hashes.

Documents come in batches.  A batch's distinct line hashes are sorted and
merge-anti-joined with the runs: hashes that no run holds are new, the others are
repeats.  Both go into the batch's own run with their document counts, at level
0.  When a level holds ``fanout`` runs they are merged into one run of the level
above, so a hash is rewritten once per level and the number of runs stays small.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from merchantry.llm.common import SPACES, ascii_lower, written


@dataclass(frozen=True)
class LineConfig:
    least_points: int = 20
    least_documents: int = 3
    batches: int = 6
    fanout: int = 3


def line_keys(text: Column) -> Column:
    """Array of the keys of a text's lines: stripped of ASCII white space, A-Z lower-cased."""
    lines = F.split(ascii_lower(F.coalesce(text, F.lit(""))), "\n", -1)
    return F.transform(lines, lambda x: F.trim(x, F.lit(SPACES)))


def key_hash(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


def named(docs: DataFrame) -> DataFrame:
    """(doc_id, text, known, k1, k2): what tells documents apart, the id or else the text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = F.col("doc_id").isNotNull()
    k1, k2 = F.coalesce("doc_id", F.xxhash64("text")), F.when(known, 0).otherwise(F.xxhash64(F.lit(1), F.col("text")))
    return rows.select("*", known.alias("known"), k1.alias("k1"), k2.cast("long").alias("k2"))


def line_hashes(rows: DataFrame, least_points: int) -> DataFrame:
    """(known, k1, k2, nr, h1, h2): each hashed key of at least ``least_points`` code points once per document; ``nr`` numbers the rows without an id."""
    long_keys = F.array_distinct(F.filter(line_keys(F.col("text")), lambda k: F.length(k) >= least_points))
    numbered = rows.withColumn("nr", F.when(F.col("known"), F.lit(0)).otherwise(F.monotonically_increasing_id()).cast("long"))
    exploded = numbered.select("known", "k1", "k2", "nr", F.explode(long_keys).alias("key"))
    return exploded.select("known", "k1", "k2", "nr", key_hash(F.col("key")).alias("h")).select("known", "k1", "k2", "nr", "h.h1", "h.h2").distinct()


def _merged(runs: list[DataFrame]) -> DataFrame:
    """(h1, h2, n_docs, last_doc) of several runs."""
    rows = runs[0]
    for run in runs[1:]:
        rows = rows.unionByName(run)
    return rows.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))


@dataclass
class LineRuns:
    """The levels of runs; each run is (h1, h2, n_docs, last_doc), sorted by hash and written."""

    fanout: int = 3
    levels: list[list[DataFrame]] = field(default_factory=list)

    @property
    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def _place(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self._place(written(_merged(old).sortWithinPartitions("h1", "h2"), f"run-level-{level + 1}"), level + 1)

    def add(self, hashes: DataFrame, least: int) -> DataFrame:
        """Adds a batch (doc, h1, h2) whose documents are in no earlier batch; ``doc`` is null for documents without an id.

        Returns (h1, h2) of the hashes that may be common: those that earlier batches
        hold, and those with ``least`` documents in this one.
        """
        own = hashes.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc").alias("last_doc"))
        own = written(own.sortWithinPartitions("h1", "h2"), "run-level-0")
        new = own.select("h1", "h2")
        for run in self.runs:
            new = new.join(run.hint("merge"), ["h1", "h2"], "left_anti")
        new = new.withColumn("new", F.lit(True)).hint("merge")
        repeats = own.join(new, ["h1", "h2"], "left").where(F.col("new").isNull() | (F.col("n_docs") >= least)).select("h1", "h2")
        self._place(own, 0)
        return repeats

    def counts(self, asked: DataFrame) -> DataFrame:
        """(h1, h2, n_docs, last_doc) over all batches of the hashes in ``asked``."""
        return _merged([run.join(asked, ["h1", "h2"], "left_semi") for run in self.runs])


def repeated_keys(batches: Iterable[DataFrame], conf: LineConfig = LineConfig()) -> DataFrame:
    """(h1, h2, last_doc) of the keys found in enough documents of all batches.

    Such a key is a repeat in some batch or reaches the count inside one, so only
    those are looked up in the runs at the end; lines found once are never merged.
    """
    runs = LineRuns(conf.fanout)
    asked = None
    for hashes in batches:
        maybe = written(runs.add(hashes, conf.least_documents), "repeats")
        asked = maybe if asked is None else asked.unionByName(maybe)
    counts = runs.counts(written(asked.distinct(), "asked"))
    return counts.where(F.col("n_docs") >= conf.least_documents).select("h1", "h2", "last_doc")


def among(ordered: Column, x: Column) -> Column:
    """Whether an array in ascending order holds ``x``, by halving."""

    def halved(range_: Column, _: Column) -> Column:
        middle = F.floor((range_["low"] + range_["high"]) / 2).cast("int")
        less = F.get(ordered, middle) < x
        return F.struct(F.when(less, middle + 1).otherwise(range_["low"]).alias("low"), F.when(less, range_["high"]).otherwise(middle).alias("high"))

    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(ordered) + 1)).cast("int"))
    at = F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.size(ordered).alias("high")), halved, lambda r: r["low"])
    return F.coalesce(F.get(ordered, at) == x, F.lit(False))


def drop_repeated_lines(docs: DataFrame, conf: LineConfig = LineConfig()) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped) per row of ``docs`` (doc_id, text), text without the repeated lines.

    A key of at least ``least_points`` code points in at least ``least_documents``
    documents loses its lines everywhere but in the largest doc_id that holds it.
    Documents are dealt to batches by a hash of their id.  Null or empty texts are
    one empty line.  Every row without doc_id is a document of its own and never the
    largest; a key that only such rows hold has no largest holder and stays.  Rows that
    repeat a doc_id are one document.  Other columns are ignored.
    """
    rows = named(docs)
    hashes = written(line_hashes(rows, conf.least_points), "line-hashes")
    batch = F.pmod(F.xxhash64("k1", "k2", "nr"), F.lit(conf.batches))
    doc = F.when(F.col("known"), F.col("k1")).alias("doc")
    common = written(repeated_keys((hashes.where(batch == b).select(doc, "h1", "h2") for b in range(conf.batches)), conf).where("last_doc is not null"), "repeated-lines")
    lost = hashes.join(common, ["h1", "h2"]).where("not known or k1 <> last_doc")
    drops = lost.groupBy("known", "k1", "k2").agg(F.array_sort(F.collect_set(F.struct("h1", "h2"))).alias("drops"))
    found = rows.join(drops.hint("shuffle_hash"), ["known", "k1", "k2"], "left")
    lines = F.split("text", "\n", -1)
    pairs = F.arrays_zip(lines.alias("line"), line_keys(F.col("text")).alias("key"))
    stay = F.filter(pairs, lambda x: ~((F.length(x["key"]) >= conf.least_points) & among(F.col("drops"), key_hash(x["key"]))))
    found = found.withColumn("kept", F.when(F.col("drops").isNull(), lines).otherwise(F.transform(stay, lambda x: x["line"])))
    return found.select("doc_id", F.array_join("kept", "\n").alias("text"), F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size("kept")).cast("long").alias("n_dropped"))
