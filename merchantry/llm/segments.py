"""Hard-negative mining by segment summaries.

A vector is cut into short segments, and of each its mean and its deviation (the
length of what is left when the mean is taken off) are stored.  For one segment of
two vectors the inner product lies within the product of the deviations around the
product of the means, so sums over the segments bound a score from both sides.
Segments merge into longer ones, whose summaries follow from theirs: pairs are
first bounded by few long segments, what is still open by more and shorter ones,
and only what then remains is scored exactly.

The query set (the anchors) meets all rows block by block: a cell is one block of
anchors with one block of rows, both of bounded size, and sends on at most
``positives`` (or ``negatives``) rows for each anchor (or pair).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from merchantry.llm.common import written


@dataclass(frozen=True)
class MineConfig:
    """Positives per anchor, negatives per pair, the accepted share of the positive's score in percent, and sizes of blocks."""

    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95
    scale: int = 256
    leaf: int = 2  # components of the shortest segments
    fan: int = 4  # segments that merge into one of the next level
    row_block: int = 4096
    anchor_block: int = 512


def whole_rows(rows: DataFrame) -> DataFrame:
    """(vec_id, label, embedding) of the rows that take part, identical ones once.

    Rows with a null label, a null vector, or a null or non-finite component do not;
    an empty vector does, and scores 0 with all.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    cut = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return cut.where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(finite).distinct()


PACKED = "block long, ids array<long>, labels binary, dims long, kind string, vectors binary, means binary, deviations binary"


def summaries(v: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean times the root of the length, deviation) of each segment of ``leaf`` components, a row per vector."""
    n, dims = v.shape
    cut = [v[:, i : i + leaf].astype(float) for i in range(0, dims, leaf)]
    means = [c.sum(1) / np.sqrt(c.shape[1]) for c in cut]
    gone = [np.linalg.norm(c - c.mean(1, keepdims=True), axis=1) for c in cut]
    shape = (n, len(cut))
    return np.array(means).T.reshape(shape), np.array(gone).T.reshape(shape)


def packer(conf: MineConfig) -> Callable[[tuple, pa.Table], pa.Table]:
    """Packs the rows of a block, in the order of their ids (null last): floor(scale * x) as numbers, and the summaries."""

    def pack(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        ids, vectors = rows.column("vec_id"), rows.column("embedding").combine_chunks()
        order = np.lexsort((rows.column("label").to_numpy(), ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)))
        lengths = np.diff(vectors.offsets.to_numpy())
        dims = int(lengths.max(initial=0))
        whole = np.zeros((len(rows), dims))  # shorter vectors end in zeros
        whole[np.arange(dims) < lengths[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
        # beyond 2^53 a double is whole already, beyond 2^62 it is held at that
        numbers = np.clip(np.floor(conf.scale * whole[order]), -(2.0**62), 2.0**62)
        most = np.abs(numbers).max(initial=0)
        kind = "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<i8"
        m, d = summaries(numbers, conf.leaf)
        binary = lambda x, t: pa.array([np.ascontiguousarray(x, t).tobytes()], pa.binary())
        return pa.table(
            {
                "block": pa.array([key[0].as_py()], pa.int64()),
                "ids": pa.array([ids.take(pa.array(order)).to_pylist()], pa.list_(pa.int64())),
                "labels": binary(rows.column("label").to_numpy()[order], "<i8"),
                "dims": pa.array([dims], pa.int64()),
                "kind": pa.array([kind]),
                "vectors": binary(numbers, kind),
                "means": binary(m, "<f4"),
                "deviations": binary(d, "<f4"),
            }
        )

    return pack


def packed(rows: DataFrame, per_block: int, conf: MineConfig) -> tuple[DataFrame, int]:
    """Rows in blocks of about ``per_block``, dealt by a hash of the whole row, and the number of blocks."""
    blocks = max(1, -(-rows.count() // per_block))
    dealt = rows.withColumn("_block", F.pmod(F.xxhash64("vec_id", "label", "embedding"), F.lit(blocks)).cast("long"))
    return dealt.groupBy("_block").applyInArrow(packer(conf), PACKED), blocks


class Block:
    """A packed block: exact numbers, and summaries from few long segments to many short ones."""

    def __init__(self, row: dict, conf: MineConfig, dims: int):
        self.ids = row["ids"]
        self.labels = np.frombuffer(row["labels"], "<i8")
        n = len(self.labels)
        numbers = np.frombuffer(row["vectors"], row["kind"]).reshape(n, row["dims"])
        self.numbers = np.zeros((n, dims), numbers.dtype)
        self.numbers[:, : row["dims"]] = numbers
        self.values = self.numbers.astype(float)
        self.most = float(np.abs(self.values).max(initial=0))
        own, segments = -(-row["dims"] // conf.leaf), -(-dims // conf.leaf)
        lengths = np.full(own, float(conf.leaf))
        if row["dims"] % conf.leaf:
            lengths[-1] = row["dims"] % conf.leaf
        widen = lambda x: np.pad(x, [(0, 0)] * (x.ndim - 1) + [(0, segments - own)])
        m, d = (widen(np.frombuffer(row[c], "<f4").reshape(n, own)).astype(float) for c in ("means", "deviations"))
        self.levels = [(m, d)]
        # a segment that both vectors fill with zeros may count as longer: its mean and deviation stay what they are
        lengths = widen(lengths)
        while self.levels[0][0].shape[1] > 1:
            m, d, lengths = merged(*self.levels[0], lengths, conf.fan)
            self.levels.insert(0, (m, d))
        self.norms = np.sqrt((m * m + d * d).sum(1)) if segments else np.zeros(n)
        self.levels = [np.hstack(x).astype(np.float32) for x in self.levels]

    def exact(self, at: np.ndarray, vector: np.ndarray, most: float) -> np.ndarray:
        """Inner products of the rows ``at``; doubles hold them unless they could pass 2^53."""
        if self.most * most * max(1, len(vector)) < 2**53:
            few = 4 * len(at) < len(self.values)
            return (self.values[at] @ vector.astype(float) if few else (self.values @ vector.astype(float))[at]).astype(np.int64)
        sums = self.numbers[at].astype(object) @ vector.astype(object) if len(at) else np.zeros(0, object)
        return np.array([min(max(int(x), -(2**63)), 2**63 - 1) for x in sums], np.int64)


def merged(m: np.ndarray, d: np.ndarray, lengths: np.ndarray, fan: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Summaries of segments made of ``fan`` neighbours each."""
    n, own = m.shape
    groups = -(-own // fan)
    wide = lambda x: np.pad(x, [(0, 0)] * (x.ndim - 1) + [(0, groups * fan - own)]).reshape(*x.shape[:-1], groups, fan)
    m, d, lengths = wide(m), wide(d), wide(lengths)
    share = np.sqrt(lengths / np.maximum(lengths.sum(1, keepdims=True), 1))
    mean = (m * share).sum(2)
    spread = ((m - mean[:, :, None] * share) ** 2).sum(2)
    return mean, np.sqrt((d * d).sum(2) + spread), lengths.sum(1)


#: Anchors whose bounds are worked out together.
TOGETHER = 64


class Bounds:
    """Bounds of the scores of all rows of a block with some of its anchors, a level at a time, as far as asked for."""

    def __init__(self, rows: Block, anchors: Block, first: int):
        self.rows, self.anchors, self.part = rows, anchors, slice(first, first + TOGETHER)
        self.first, self.known = first, {}
        self.n_levels = len(rows.levels)

    def of(self, level: int, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(middle, half width) per row with anchor ``i``, with room for 32-bit rounding."""
        if level not in self.known:
            f, a = self.rows.levels[level], self.anchors.levels[level][self.part]
            half = f.shape[1] // 2
            slack = 1e-5 * np.outer(self.anchors.norms[self.part], self.rows.norms).astype(np.float32) + np.float32(1e-3)
            self.known[level] = a[:, :half] @ f[:, :half].T, a[:, half:] @ f[:, half:].T + slack
        middle, width = self.known[level]
        return middle[i - self.first], width[i - self.first]


def every_anchor(rows: Block, anchors: Block, which: list[int]) -> Iterator[tuple[int, Bounds]]:
    known = None
    for i in which:
        if known is None or i >= known.first + TOGETHER:
            known = Bounds(rows, anchors, i)
        yield i, known


def nearest(known: Bounds, i: int, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, score) of the ``n`` rows of ``at`` with the highest scores; ``at`` ascends in the order of ids, which settles ties."""
    rows, vector, most = known.rows, known.anchors.numbers[i], known.anchors.most
    for level in range(known.n_levels):
        if len(at) <= 4 * n:
            break
        middle, width = (x[at] for x in known.of(level, i))
        sure = np.argpartition(-middle, n - 1)[:n]  # n scores that are really there: what stays below the least is out
        at = at[middle + width >= rows.exact(at[sure], vector, most).min()]
    scores = rows.exact(at, vector, most)
    order = np.argsort(-scores, kind="stable")[:n]
    return at[order], scores[order]


def below(known: Bounds, i: int, at: np.ndarray, ranges: list[tuple[int, int]], n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each range of scores (both ends in it) the ``n`` rows of ``at`` with the highest scores inside, as in :func:`nearest`."""
    rows, vector, most = known.rows, known.anchors.numbers[i], known.anchors.most
    open_ = [(low, high) for low, high in ranges if low <= high]
    bar, top = min((low for low, _ in open_), default=0), max((high for _, high in open_), default=-1)
    at = at if open_ else at[:0]
    for level in range(known.n_levels):
        if len(at) <= 4 * n:
            break
        middle, width = (x[at] for x in known.of(level, i))
        if level == known.n_levels - 1:  # some likely scores, to see how high the n-th of each range is at least
            some = np.flatnonzero(middle <= top)
            most_some = 4 * n * len(open_)
            some = some[np.argpartition(-middle[some], most_some - 1)[:most_some]] if len(some) > most_some else some
            sure = np.sort(rows.exact(at[some], vector, most))
            inside = [sure[(sure >= low) & (sure <= high)] for low, high in open_]
            bar = min(int(x[-n]) if len(x) >= n else low for x, (low, _) in zip(inside, open_, strict=True))
        at = at[(middle + width >= bar) & (middle - width <= top)]
    scores = rows.exact(at, vector, most)
    hit = (scores >= bar) & (scores <= top)
    at, scores = at[hit], scores[hit]
    order = np.argsort(-scores, kind="stable")
    at, scores = at[order], scores[order]
    out = []
    for low, high in ranges:
        first = int(np.searchsorted(-scores, -high))
        last = min(first + n, int(np.searchsorted(-scores, -low, "right")))
        out.append((at[first : max(first, last)], scores[first : max(first, last)]))
    return out


def cells(index: DataFrame, blocks: int, anchors: DataFrame, anchor_blocks: int, run: Callable, schema: str) -> DataFrame:
    """``run(row block, anchor block)`` over every block of rows with every block of anchors."""
    copies = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = index.withColumn("_anchors", copies(anchor_blocks)).withColumnRenamed("block", "_rows")
    right = anchors.withColumn("_rows", copies(blocks)).withColumnRenamed("block", "_anchors")

    def cell(rows: pa.Table, found: pa.Table) -> pa.Table:
        if not len(rows) or not len(found):
            return pa.table({n: pa.array([], t) for n, t in zip(empty.names, empty.types, strict=True)})
        return run(rows.to_pylist()[0], found.to_pylist()[0])

    empty = pa.schema([(c.split()[0], {"long": pa.int64(), "int": pa.int32()}[c.split()[1]]) for c in schema.split(", ")])
    return left.groupBy("_rows", "_anchors").cogroup(right.groupBy("_rows", "_anchors")).applyInArrow(cell, schema)


def _table(columns: dict[str, list[np.ndarray]], ids: list, kind: dict[str, pa.DataType]) -> pa.Table:
    flat = {c: np.concatenate(x) if x else np.zeros(0, np.int64) for c, x in columns.items()}
    out = {c: pa.array(flat[c].astype(np.int64), pa.int64()) for c in kind if c != "row_id"}
    out["row_id"] = pa.array([ids[p] for p in flat["place"]], pa.int64())
    return pa.table({c: out[c] for c in kind})


FOUND = "anchors long, anchor long, pair long, row_id long, score long, block long, place long"
_KIND = {c.split()[0]: pa.int64() for c in FOUND.split(", ")}


def hard_negatives(rows: DataFrame, is_anchor: Column, conf: MineConfig = MineConfig()) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the anchors among ``rows`` (vec_id, embedding, label).

    An anchor's positives are its best ``positives`` rows of its label with another id;
    the negatives of a pair are its best ``negatives`` rows of another label with a
    score from ``low`` to ``high`` percent of the positive's.  Ties go by vec_id, null
    last, then by label and vector.  Rows that do not take part: see :func:`whole_rows`.
    Rows that differ and share an id all take part, each for itself; rows without an id
    are never anchors.  A shorter vector ends in zeros.  Scores beyond 64 bits are held
    at their limits.  An anchor without positives, and a pair without negatives, have no
    row; an empty table gives an empty result.  Other columns are not looked at.
    """
    taking = written(whole_rows(rows), "mine-rows")
    index, blocks = packed(taking, conf.row_block, conf)
    index = written(index, "mine-index")
    asked, anchor_blocks = packed(taking.where(F.col("vec_id").isNotNull() & is_anchor), conf.anchor_block, conf)
    asked = written(asked, "mine-anchors")

    def opened(row: dict, asked_row: dict) -> tuple[Block, Block]:
        dims = max(row["dims"], asked_row["dims"])
        return Block(row, conf, dims), Block(asked_row, conf, dims)

    def of_label(row: dict, asked_row: dict) -> pa.Table:
        own, anchors = opened(row, asked_row)
        ids = np.array([x is not None and x or 0 for x in own.ids], np.int64)
        named = np.array([x is not None for x in own.ids], bool)
        places = {label: np.flatnonzero(own.labels == label) for label in np.unique(own.labels)}
        out: dict[str, list] = {c: [] for c in ("anchors", "anchor", "pair", "score", "block", "place")}
        for i, known in every_anchor(own, anchors, list(range(len(anchors.ids)))):
            at = places.get(anchors.labels[i], np.zeros(0, np.int64))
            at = at[~((ids[at] == anchors.ids[i]) & named[at])]
            place, score = nearest(known, i, at, conf.positives)
            for c, x in (("anchors", asked_row["_anchors"]), ("anchor", i), ("pair", 0), ("score", score), ("block", row["_rows"]), ("place", place)):
                out[c].append(np.broadcast_to(x, len(place)))
        return _table(out, own.ids, _KIND)

    order = [F.col("score").desc(), F.col("row_id").asc_nulls_last(), "block", "place"]
    ranked = lambda found, *by: found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    found = ranked(cells(index, blocks, asked, anchor_blocks, of_label, FOUND), "anchors", "anchor").where(F.col("rank") <= conf.positives)
    positives = written(found.select("anchors", "anchor", F.col("rank").cast("long").alias("pair"), F.col("row_id").alias("positive_id"), F.col("score").alias("positive_score")), "mine-positives")

    # at most anchor_block * positives entries meet in one row
    pairs = positives.groupBy(F.col("anchors").alias("block")).agg(F.collect_list(F.struct("anchor", "pair", "positive_score")).alias("pairs"))
    paired = asked.join(pairs, "block")

    def of_others(row: dict, asked_row: dict) -> pa.Table:
        own, anchors = opened(row, asked_row)
        others = {label: np.flatnonzero(own.labels != label) for label in np.unique(anchors.labels)}
        out: dict[str, list] = {c: [] for c in ("anchors", "anchor", "pair", "score", "block", "place")}
        of: dict[int, list[dict]] = {}
        for p in asked_row["pairs"]:
            of.setdefault(p["anchor"], []).append(p)
        for i, known in every_anchor(own, anchors, sorted(of)):
            mine = of[i]
            # 50 * p <= 100 * s <= 95 * p in whole numbers
            ranges = [(-(-conf.low * p["positive_score"] // 100), conf.high * p["positive_score"] // 100) for p in mine]
            for p, (place, score) in zip(mine, below(known, i, others[anchors.labels[i]], ranges, conf.negatives), strict=True):
                for c, x in (("anchors", asked_row["_anchors"]), ("anchor", i), ("pair", p["pair"]), ("score", score), ("block", row["_rows"]), ("place", place)):
                    out[c].append(np.broadcast_to(x, len(place)))
        return _table(out, own.ids, _KIND)

    found = ranked(cells(index, blocks, paired, anchor_blocks, of_others, FOUND), "anchors", "anchor", "pair").where(F.col("rank") <= conf.negatives)
    names = asked.select(F.col("block").alias("anchors"), F.posexplode("ids").alias("anchor", "anchor_id")).withColumn("anchor", F.col("anchor").cast("long"))
    return (
        found.join(positives, ["anchors", "anchor", "pair"])
        .join(names, ["anchors", "anchor"])
        .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("row_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    )
