"""Near duplicates by fast similarity sketches, banding and exact verification.

A sketch has one coordinate per bin.  In round i every shingle is hashed to a bin
and a value above i; a bin keeps its smallest value, so later rounds only fill
what is empty.  After as many rounds as there are bins, round bins + j puts all
shingles into bin j: every coordinate is filled, however short the text.  Equal
coordinates are as likely as the Jaccard similarity, and concentrate around it
(Dahlgaard, Knudsen, Thorup 2017).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from merchantry.llm.common import Chunk, chunks, keep_rows, mix, written
from merchantry.llm.components import components

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


@dataclass(frozen=True)
class NearConfig:
    """``words`` per shingle, the least similarity in per cent, and the bands of the sketch.

    With 25 bands of 5 a pair at 80 % shares a band with probability 0.99995.
    """

    words: int = 5
    percent: int = 80
    bands: int = 25
    band_rows: int = 5
    members_per_task_group: int = 256
    leader_rounds: int = 5
    held_block: int = 384
    streamed_block: int = 1024


def shingle_sets(chunk: Chunk, k: int) -> Iterator[np.ndarray]:
    """Per document the sorted distinct 64-bit hashes of its k-word shingles; fewer words make one shingle."""
    odd = np.array([mix(np.array([ODD[i % len(ODD)] * (2 * i + 1) & 0xFFFFFFFFFFFFFFFF], np.uint64))[0] | np.uint64(1) for i in range(k)], np.uint64)
    token = chunk.hashes()[chunk.stream] if len(chunk.stream) else np.zeros(0, np.uint64)
    starts = chunk.starts
    n = max(0, len(token) - k + 1)
    whole = np.full(n, k, np.uint64) * GOLDEN
    for j in range(k):
        whole += token[j : j + n] * odd[j]
    whole = mix(whole)
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        if b - a >= k:
            yield np.unique(whole[a : b - k + 1])
        elif b > a:
            with np.errstate(over="ignore"):
                yield mix(np.array([np.uint64(b - a) * GOLDEN + (token[a:b] * odd[: b - a]).sum(dtype=np.uint64)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def fast_similarity_sketch(items: np.ndarray, bins: int) -> np.ndarray:
    """The sketch of a non-empty set of 64-bit numbers."""
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    sketch = np.full(bins, empty, np.uint64)
    low, at = np.uint64((1 << 48) - 1), 0
    step = max(1, int(1.2 * bins * np.log(bins) / len(items)) + 1)
    while at < bins:  # several rounds at once: their values are above those of earlier rounds
        rounds = np.arange(at, min(bins, at + step), dtype=np.uint64)
        h = mix(items[None, :] + (rounds[:, None] + np.uint64(1)) * GOLDEN)
        place = ((h >> np.uint64(48)) * np.uint64(bins)) >> np.uint64(16)
        np.minimum.at(sketch, place.ravel().astype(np.int64), ((rounds[:, None] << np.uint64(48)) | (h & low)).ravel())
        at += len(rounds)
        if not (sketch == empty).any():
            return sketch
    for j in np.flatnonzero(sketch == empty):
        h = mix(items + np.full(1, bins + j + 1, np.uint64) * GOLDEN)
        sketch[j] = (np.uint64(bins + j) << np.uint64(48)) | (h & low).min()
    return sketch


def _band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    grid = sketch.reshape(bands, rows)
    key = mix(np.arange(1, bands + 1, dtype=np.uint64) * GOLDEN)
    for j in range(rows):
        key = mix(key + grid[:, j] * np.uint64(ODD[0]) + np.uint64(j))
    return key.view(np.int64)


SKETCHES = "doc_id long, digest binary, n_shingles long, d1 long, d2 long, bands array<long>"


def _digest(text: Column) -> Column:
    """SHA-256 of the text as it is; tells rows with the same doc_id apart."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def sketches(docs: DataFrame, conf: NearConfig) -> DataFrame:
    """(doc_id, digest, n_shingles, d1, d2, bands): digest of the text, size and 128-bit digest of the shingle set, and its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, lower=True):
            sizes, d1, d2, bands = [], [], [], []
            for items in shingle_sets(chunk, conf.words):
                sizes.append(len(items))
                d1.append(int(mix(items).sum(dtype=np.uint64).view(np.int64)) if len(items) else 0)
                d2.append(int(mix(items ^ GOLDEN).sum(dtype=np.uint64).view(np.int64)) if len(items) else 0)
                bands.append(_band_keys(fast_similarity_sketch(items, conf.bands * conf.band_rows), conf.bands, conf.band_rows) if len(items) else np.zeros(0, np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(b) for b in bands])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    chunk.rows.column("doc_id").combine_chunks(),
                    chunk.rows.column("digest").combine_chunks(),
                    pa.array(sizes, pa.int64()),
                    pa.array(d1, pa.int64()),
                    pa.array(d2, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(bands))),
                ],
                names=["doc_id", "digest", "n_shingles", "d1", "d2", "bands"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text", _digest(F.col("text")).alias("digest")).mapInArrow(run, SKETCHES)


def _verified(pairs: DataFrame, texts: DataFrame, conf: NearConfig) -> DataFrame:
    """(leader, member, linked) of each pair, by the full sets.

    A leader's text is sent once per group of members; hot leaders get many groups,
    and inside a task one leader's set is held while its members stream past.
    """
    groups = pairs.groupBy("leader").agg((F.count("*") / conf.members_per_task_group).cast("int").alias("last"))
    heads = groups.select("leader", F.col("leader").alias("id"), F.explode(F.sequence(F.lit(0), "last")).alias("salt"))
    members = pairs.join(groups, "leader").select("leader", F.col("member").alias("id"), F.pmod(F.xxhash64("member"), F.col("last") + 1).cast("int").alias("salt"))
    placed = heads.unionByName(members).join(texts, "id").select("leader", "salt", F.col("id").alias("doc_id"), "text")
    placed = placed.repartition("leader", "salt").sortWithinPartitions("leader", "salt", F.col("doc_id") != F.col("leader"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, head = None, np.zeros(0, np.uint64)
        for chunk in chunks(batches, lower=True):
            out: list[tuple[int, int, bool]] = []
            columns = [chunk.rows.column(c).to_pylist() for c in ("leader", "salt", "doc_id")]
            for leader, salt, doc, items in zip(*columns, shingle_sets(chunk, conf.words), strict=True):
                if leader == doc:
                    now, head = (leader, salt), items
                    continue
                if now != (leader, salt):
                    raise RuntimeError("a leader's row is missing before its members")
                at = np.searchsorted(head, items)
                same = int((head[np.minimum(at, len(head) - 1)] == items).sum())
                out.append((leader, doc, 100 * same >= conf.percent * (len(head) + len(items) - same)))
            a, b, c = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.bool_())], names=["leader", "member", "linked"])

    return placed.mapInArrow(run, "leader long, member long, linked boolean")


def _can_link(inside: DataFrame, texts: DataFrame, conf: NearConfig) -> DataFrame:
    """(rep, s) of the members of open buckets that may have a link out of their component.

    s counts the member's shingles that another component of open buckets has as well;
    no link can share more.  A member with less than the wanted share of them has none.
    """
    members = inside.select(F.col("rep").alias("id"), "comp").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, lower=True, limit=1 << 20):
            ids, comps = (chunk.rows.column(c).to_numpy() for c in ("id", "comp"))
            sets = list(shingle_sets(chunk, conf.words))
            sizes = [len(x) for x in sets]
            out = [pa.array(np.repeat(ids, sizes)), pa.array(np.repeat(comps, sizes)), pa.array(np.concatenate(sets).view(np.int64))]
            yield pa.RecordBatch.from_arrays(out, names=["rep", "comp", "shingle"])

    held = written(texts.join(members, "id").mapInArrow(run, "rep long, comp long, shingle long"), "open-shingles")
    both = held.groupBy("shingle").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("shingle")
    return written(held.join(both, "shingle", "left_semi").groupBy("rep").agg(F.count("*").alias("s")), "may-link")


def _rest_links(inside: DataFrame, texts: DataFrame, conf: NearConfig) -> DataFrame:
    """(leader, member) of the links inside the groups of ``inside`` (g, rep, comp, main) that leave a component.

    In each group the members outside the main component are the query set, compared
    with all members: block against block, one block of sets held while the other
    streams past.  Rows sent grow with the group's size times the number of blocks,
    and only links come out.
    """
    asked = F.col("comp") != F.col("main")
    sizes = inside.groupBy("g").agg(F.ceil(F.count_if(asked) / conf.held_block).cast("int").alias("nl"), F.ceil(F.count("*") / conf.streamed_block).cast("int").alias("nr")).where("nl > 0")
    rows = inside.join(sizes, "g").withColumn("h", F.xxhash64("rep"))
    held = rows.where(asked).select("g", "rep", "comp", F.lit(0).alias("side"), F.pmod("h", "nl").cast("int").alias("l"), F.explode(F.sequence(F.lit(0), F.col("nr") - 1)).alias("r"))
    streamed = rows.select("g", "rep", "comp", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("nl") - 1)).alias("l"), F.pmod("h", "nr").cast("int").alias("r"))
    both = held.unionByName(streamed).withColumnRenamed("rep", "id").join(texts, "id")
    placed = both.repartition("g", "l", "r").sortWithinPartitions("g", "l", "r", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ready = None, False
        ids, comps, sets = [], [], []
        for chunk in chunks(batches, lower=True, limit=4 << 20):
            a, b = [], []
            columns = [chunk.rows.column(c).to_pylist() for c in ("g", "l", "r", "side", "id", "comp")]
            for g, left, right, side, doc, comp, items in zip(*columns, shingle_sets(chunk, conf.words), strict=True):
                if now != (g, left, right):
                    now, ready, ids, comps, sets = (g, left, right), False, [], [], []
                if side == 0:
                    ids.append(doc)
                    comps.append(comp)
                    sets.append(items)
                    continue
                if not sets:
                    continue
                if not ready:
                    ready, sizes_ = True, np.array([len(x) for x in sets])
                    owner, every = np.repeat(np.arange(len(sets)), sizes_), np.concatenate(sets)
                    by = np.argsort(every, kind="stable")
                    owner, every = owner[by], every[by]
                    id_array, comp_array = np.array(ids), np.array(comps)
                lo, hi = np.searchsorted(every, items, "left"), np.searchsorted(every, items, "right")
                n = hi - lo
                at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                same = np.bincount(owner[at], minlength=len(ids))
                good = (100 * same >= conf.percent * (sizes_ + len(items) - same)) & (comp_array != comp)
                a += id_array[good].tolist()
                b += [doc] * int(good.sum())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["leader", "member"])

    return placed.mapInArrow(run, "leader long, member long")


def _placed(docs: DataFrame, conf: NearConfig) -> DataFrame:
    """(doc_id, digest, n_shingles, comp, component_id, kept) per row: ``comp`` is the component's own number, null where a row is linked with nothing."""
    named = written(sketches(docs, conf), "sketches")
    usable = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    classes = named.where(usable).groupBy("d1", "d2").agg(F.min("doc_id").alias("low"))
    classes = written(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    heads = named.where(usable).join(classes.hint("shuffle_hash"), ["d1", "d2"]).where("doc_id = low").dropDuplicates(["d1", "d2"])
    heads = written(heads.select("rep", "doc_id", "digest", F.col("n_shingles").alias("n"), "bands"), "heads")
    entries = written(heads.select("rep", "n", F.explode("bands").alias("bucket")), "bands")
    shared = entries.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1")
    entries = written(entries.join(shared, "bucket"), "band-entries")
    central = written(entries.groupBy("rep").agg(F.sum("c").alias("central")), "central")
    entries = written(entries.drop("c").join(central, "rep"), "placed-entries")
    wanted = heads.join(central, "rep").select("rep", "doc_id", "digest")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _digest(F.col("text")).alias("digest"))
    texts = texts.join(wanted.hint("shuffle_hash"), ["doc_id", "digest"]).select(F.col("rep").alias("id"), "text")
    texts = written(texts, "candidate-texts")
    comps = written(central.select("rep", F.col("rep").alias("comp")), "comps")

    def joined(links: DataFrame, comps: DataFrame) -> DataFrame:
        ends = [comps.select(F.col("rep").alias(name), F.col("comp").alias(c)) for name, c in (("leader", "u"), ("member", "v"))]
        merged = components(links.join(ends[0], "leader").join(ends[1], "member").select("u", "v")).select(F.col("node").alias("comp"), F.col("component"))
        return written(comps.join(merged, "comp", "left").select("rep", F.coalesce("component", "comp").alias("comp")), "comps")

    def opened(placed: DataFrame, *order) -> DataFrame:
        """Per bucket with several components the member that is first in ``order``."""
        best = F.min(F.struct(*order, "rep", "comp", "n"))
        found = placed.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), best.alias("l")).where("lo < hi")
        return found.select("bucket", F.col("l.rep").alias("leader"), F.col("l.comp").alias("lcomp"), F.col("l.n").alias("ln"))

    first = (-F.col("central")).alias("c")
    led = tried = None
    for _ in range(conf.leader_rounds):
        placed = entries.join(comps, "rep")
        placed = placed.withColumn("led", F.lit(0)) if led is None else placed.join(led, "rep", "left").withColumn("led", F.coalesce("led", F.lit(0)))
        fits = (F.col("comp") != F.col("lcomp")) & (100 * F.least("n", "ln") >= conf.percent * F.greatest("n", "ln"))
        pairs = placed.alias("i").join(opened(placed, "led", first).alias("o"), (F.col("i.bucket") == F.col("o.bucket")) & fits)
        pairs = pairs.select(F.least("rep", "leader").alias("a"), F.greatest("rep", "leader").alias("b"), "leader", F.col("rep").alias("member"))
        pairs = pairs.groupBy("a", "b").agg(F.min(F.struct("leader", "member")).alias("p"))
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = written(pairs.select("p.leader", "p.member"), "pairs")
        links = written(_verified(pairs, texts, conf), "links")
        n, n_linked = links.agg(F.count("*"), F.count_if("linked")).first()
        if n_linked:
            comps = joined(links.where("linked"), comps)
        if 20 * n_linked <= n:
            break
        failed = links.where("not linked").select(F.least("leader", "member").alias("a"), F.greatest("leader", "member").alias("b"))
        tried = failed if tried is None else tried.unionByName(failed)
        heads = pairs.select(F.col("leader").alias("rep")).distinct().withColumn("led", F.lit(1))
        led = heads if led is None else written(led.unionByName(heads).distinct(), "led")

    placed = entries.join(comps, "rep")
    heads = opened(placed, first).select("bucket", F.col("leader").alias("g"), F.col("lcomp").alias("main"))
    inside = written(placed.join(heads, "bucket").select("g", "rep", "comp", "n", "main").distinct(), "open-groups")
    can = _can_link(inside, texts, conf)
    inside = inside.join(can, "rep").where(100 * F.col("s") >= conf.percent * F.col("n")).select("g", "rep", "comp", "main")
    rest = written(_rest_links(written(inside, "rest"), texts, conf), "rest-links")
    comps = joined(rest, comps)
    named_by = written(classes.join(comps, "rep", "left").select("d1", "d2", "low", F.coalesce("comp", "rep").alias("comp")), "class-comps")
    found = named_by.join(named_by.groupBy("comp").agg(F.min("low").alias("component_id")), "comp").select("d1", "d2", "comp", "component_id")
    linked = named.where(usable).join(found, ["d1", "d2"], "left").select("doc_id", "digest", "n_shingles", "comp", "component_id")
    alone = named.where(~usable).select("doc_id", "digest", "n_shingles", F.lit(None).cast("long").alias("comp"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_duplicates(docs: DataFrame, conf: NearConfig = NearConfig()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs`` (doc_id, text).

    Texts with the same shingle set form a class, which has a number of its own.
    Classes that share a band are candidates.  In each round every member of a band
    bucket is compared with one leader of the bucket, the one that shares most bands
    with others and has not led yet, and links join components; buckets whose members
    are in one component are done.  When rounds no longer join much, the buckets of a
    leader become a group, and its members outside the leader's component are compared
    with all of the group, but for those that share too few shingles with any other
    component, so no link is lost.

    Empty or null texts, and rows without doc_id, are linked with nothing; their
    component is their own doc_id and they stay.  Rows that repeat a doc_id get the
    component of their own text; a component is named by its smallest doc_id.  Other
    columns are ignored.
    """
    return _placed(docs, conf).select("doc_id", "n_shingles", "component_id", "kept")


def drop_near_duplicates(docs: DataFrame, conf: NearConfig = NearConfig()) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: one of each component, and each text that is linked with nothing.

    Where rows of a component repeat its doc_id with different texts, the first digest stays.
    """
    found = _placed(docs, conf).where("kept").groupBy("doc_id", "digest", "comp").agg(F.count("*").alias("n"))
    found = written(found, "kept-texts")
    one = found.where("comp is not null").groupBy("comp").agg(F.min(F.struct("digest", "doc_id", "n")).alias("w")).select("w.doc_id", "w.digest", "w.n")
    keys = written(one.unionByName(found.where("comp is null").select("doc_id", "digest", "n")), "kept-rows")
    return keep_rows(docs, _digest(F.col("text")), keys)
