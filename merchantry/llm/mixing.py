"""Mixing sources to target weights by pivotal dependent rounding.

A document's expected copies are its source's target over the source's size, and
their fractional part is rounded.  Two fractional documents trade words, one of
two ways at random so that expectations hold, until one of them is whole; the
other goes on.  This runs over blocks of documents of similar size, then over
the residuals of the blocks, and so on up a tree with one root per source: at
most one document of a source is left fractional, and the words taken differ
from the target by less than that document.

Only DataFrame functions are used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from merchantry.llm.common import free_name, written

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class MixConfig:
    """Weights repeat over the sources in code point order; shares and caps are of the sizes."""

    weights: tuple[float, ...] = (5, 2, 1)
    budget: float = 1.5
    most_copies: float = 2.0
    block: int = 64
    seed: int = 17


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """Adds ``nr``: 0, 1, 2 ... in ``order``, by a range sort; only one count per range is ranked in one task."""
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    sorted_ = written(sorted_.withColumn("_id", F.monotonically_increasing_id()), "sorted").withColumn("_part", F.shiftright("_id", 33))
    counts = sorted_.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_part", before.alias("_before"))
    nr = F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return sorted_.join(starts, "_part").withColumn("nr", nr).drop("_id", "_part", "_before")


def targets(sizes: DataFrame, conf: MixConfig) -> DataFrame:
    """(source, source_size, n_docs, nr, target) of ``sizes`` (source, size).

    Sources above their cap are fixed there and the rest is shared again by weight,
    until none is above: each turn reads two sums.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    weights = F.array(*[F.lit(float(w)) for w in conf.weights])
    sources = numbered(sources, F.col("source").asc_nulls_last()).withColumn("weight", F.element_at(weights, (F.col("nr") % len(conf.weights) + 1).cast("int")))
    sources = written(sources.withColumn("cap", conf.most_copies * F.col("source_size")), "sources")
    total = (sources.agg(F.sum("source_size")).first()[0] or 0) * conf.budget
    level, above = 0.0, -1
    while True:
        over = F.col("weight") * F.lit(level) > F.col("cap")
        n, fixed, free = sources.agg(F.count_if(over), F.sum(F.when(over, F.col("cap"))), F.sum(F.when(~over, F.col("weight")))).first()
        if n == above or not free:
            break
        above, level = n, max(0.0, total - (fixed or 0.0)) / free
    return sources.select("source", "source_size", "n_docs", "nr", F.least(F.col("weight") * F.lit(level), F.col("cap")).alias("target"))


def _uniform(*keys: Column | str) -> Column:
    return F.xxhash64(*keys).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))


def _fold(items: Column, seed: int, level: int) -> Column:
    """Pivotal rounding along an array of (pos, size, words): struct(done: array of (pos, whole), rest: item or null)."""
    item = "struct<pos:bigint,size:bigint,words:double>"
    start = F.struct(F.expr("cast(array() as array<struct<pos:bigint,whole:boolean>>)").alias("done"), F.expr(f"cast(null as {item})").alias("rest"))

    def whole(x: Column) -> Column:
        return F.struct(x["pos"].alias("pos"), (x["words"] > 0).alias("whole"))

    def moved(x: Column, words: Column) -> Column:
        return F.struct(x["pos"].alias("pos"), x["size"].alias("size"), words.alias("words"))

    def step(state: Column, b: Column) -> Column:
        a = state["rest"]
        up, down = F.least(a["size"] - a["words"], b["words"]), F.least(b["size"] - b["words"], a["words"])
        first = _uniform(F.lit(seed), F.lit(level), a["pos"], b["pos"]) * (up + down) < down
        by = F.when(first, up).otherwise(-down)
        # the end of a move is set exactly, so that no rounding error is left in it
        wa = F.when(first & (up == a["size"] - a["words"]), a["size"].cast("double")).when(~first & (down == a["words"]), F.lit(0.0)).otherwise(a["words"] + by)
        wb = F.when(first & (up == b["words"]), F.lit(0.0)).when(~first & (down == b["size"] - b["words"]), b["size"].cast("double")).otherwise(b["words"] - by)
        na, nb = moved(a, wa), moved(b, wb)
        settled = lambda x: (x["words"] == 0) | (x["words"] == x["size"])
        both = F.struct(F.concat(state["done"], F.array(whole(na), whole(nb))).alias("done"), F.expr(f"cast(null as {item})").alias("rest"))
        one = F.struct(F.concat(state["done"], F.array(whole(na))).alias("done"), nb.alias("rest"))
        two = F.struct(F.concat(state["done"], F.array(whole(nb))).alias("done"), na.alias("rest"))
        traded = F.when(settled(na) & settled(nb), both).when(settled(na), one).otherwise(two)
        return F.when(a.isNull(), F.struct(state["done"].alias("done"), b.alias("rest"))).otherwise(traded)

    return F.aggregate(items, start, step)


def rounded(docs: DataFrame, places: int, conf: MixConfig) -> DataFrame:
    """(pos, whole) of every fractional document (source_nr, place, pos, size, words).

    ``place`` is below ``places``, and a source's places follow each other; ``place``
    over the block size is the block of a source, at each level of the tree.
    """
    rows, level, out = docs, 0, None
    while True:
        blocks = rows.groupBy("source_nr", F.floor(F.col("place") / conf.block).alias("place")).agg(F.collect_list(F.struct("pos", "size", "words")).alias("items"))
        solved = blocks.select("source_nr", "place", _fold(F.array_sort("items"), conf.seed, level).alias("s"))
        solved = written(solved, f"rounding-{level}")
        done = solved.select(F.explode("s.done").alias("d")).select("d.pos", "d.whole")
        out = done if out is None else out.unionByName(done)
        rows = solved.where("s.rest is not null").select("source_nr", "place", "s.rest.*")
        places, level = -(-places // conf.block), level + 1
        if places <= 1:
            last = rows.select("pos", (_uniform(F.lit(conf.seed), F.lit(-1), "pos") * F.col("size") < F.col("words")).alias("whole"))
            return out.unionByName(last)


def _mixed(docs: DataFrame, row: Column, conf: MixConfig) -> DataFrame:
    """(row, doc_id, size, source_size, target, base, extra copies) per row of ``docs``; ``row`` tells rows apart and may be null."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sizes = written(docs.select(row.cast("long").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size")), "sizes")
    sources = written(targets(sizes, conf), "targets")
    order = [F.col("source").asc_nulls_last(), F.col("size").desc(), F.xxhash64(F.lit(conf.seed), "doc_id"), F.col("doc_id"), F.col("row")]
    placed = numbered(sizes, *order)
    starts = sources.select("source", "source_size", "target", "n_docs", F.col("nr").alias("source_nr"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate + 1e-9)
    part = F.greatest(rate - whole, F.lit(0.0))
    joined = placed.join(starts, placed["source"].eqNullSafe(starts["source"])).select("row", "doc_id", "size", "source_size", "target", "source_nr", F.col("nr").alias("pos"), whole.cast("long").alias("base"), part.alias("part"))
    joined = written(joined, "placed")
    open_ = joined.where("size > 0 and part > 1e-9").select("source_nr", F.col("pos").alias("place"), "pos", "size", (F.col("part") * F.col("size")).alias("words"))
    extra = rounded(open_, joined.count(), conf)
    copies = F.col("base") + F.when(F.coalesce("whole", F.lit(False)), 1).otherwise(0)
    return joined.join(extra, "pos", "left").withColumn("copies", copies.cast("long"))


def mix_sources(docs: DataFrame, conf: MixConfig = MixConfig()) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) per row of ``docs`` (doc_id, text, source).

    Size is the number of words, 0 for null or blank texts.  Documents of size 0 take
    nothing and have as many copies as fit whole.  A source without words has target
    0.  A null source is a source, the last.  Rows that repeat a doc_id are rounded
    each for itself.  Results depend on the rows and the seed alone.
    """
    mixed = _mixed(docs, F.lit(None), conf)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed_rows(docs: DataFrame, conf: MixConfig = MixConfig()) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with their columns.

    Rows are numbered when they are written, and each is taken by its own number, also
    where ids are null or repeat.  Further columns may have any name.
    """
    row, copy = free_name("row", docs), free_name("copy", docs)
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "mix-rows")
    taken = _mixed(rows, F.col(row), conf).where("copies > 0").select(F.col("row").alias(row), F.sequence(F.lit(1).cast("long"), "copies").alias(copy)).hint("shuffle_hash")
    return rows.join(taken, row).withColumn(copy, F.explode(copy)).select(*[F.col(f"`{c}`") for c in docs.columns])
