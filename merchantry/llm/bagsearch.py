"""Ranked lexical search in which documents with the same bag are scored once.

What a document scores depends on how often it holds the terms of the items, and on
its length by way of one small number m.  So every document is cut down to the terms
that items ask for; documents whose counts and m agree form a class, found by hash
and told apart by the counts themselves; a class is scored once, and only classes
that win a place are opened again into their documents, in ascending order of id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from merchantry.llm.common import chunks, written

#: Terms are runs of ASCII letters and digits and of all that is not ASCII; the rest becomes a space.
PARTED = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))
#: Bytes of text held at a time.
LIMIT = 2 << 20


@dataclass(frozen=True)
class SearchConfig:
    """Results per item; how many (item, term) pairs one pass over the documents answers (more take several passes); cells scored at a time."""

    results: int = 50
    most_terms: int = 1 << 20
    dense: int = 256
    cells: int = 1 << 21


def split_terms(text: bytes) -> list[bytes]:
    return text.translate(PARTED).split()


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, terms) per distinct item that has a term; ``terms`` sorted, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist()
            terms = [sorted(set(split_terms((t or b"").lower()))) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.binary())).cast(pa.list_(pa.string()))], names=["item_id", "terms"])

    cut = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return cut.mapInArrow(run, "item_id long, terms array<string>").where(F.size("terms") > 0).distinct()


def bags(docs: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, n, bag) per row of ``docs`` with a term: all its terms counted, and (term number, tf) pairs of 32 bits for those in ``terms``, ascending."""
    held = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {t.encode(): i for i, t in enumerate(held.value)}
        for chunk in chunks(batches, lower=True, limit=LIMIT, split=split_terms):
            number = np.fromiter((place.get(w, -1) for w in chunk.words), np.int64, len(chunk.words))
            term = number[chunk.stream] if len(chunk.stream) else np.zeros(0, np.int64)
            doc = np.repeat(np.arange(len(chunk.lengths)), chunk.lengths)
            pair, tf = np.unique((doc * np.int64(len(place) + 1) + term)[term >= 0], return_counts=True)
            flat = np.stack([pair % (len(place) + 1), tf], axis=1).astype("<i4")
            kept = np.flatnonzero(chunk.lengths)
            size = np.bincount(pair // (len(place) + 1), minlength=len(chunk.lengths))
            ends = (8 * np.concatenate([[0], np.cumsum(size[kept])])).astype("<i4")
            bag = pa.Array.from_buffers(pa.binary(), len(kept), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(flat.tobytes())])
            ids = chunk.rows.column("doc_id").combine_chunks().take(pa.array(kept))
            yield pa.RecordBatch.from_arrays([ids, pa.array(chunk.lengths[kept], pa.int64()), bag], names=["doc_id", "n", "bag"])

    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cut.mapInArrow(run, "doc_id long, n long, bag binary")


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, tf) of all entries of a column of bags."""
    values = column.to_pylist()
    flat = np.frombuffer(b"".join(values), "<i4").reshape(-1, 2).astype(np.int64)
    return np.repeat(np.arange(len(values)), [len(v) // 8 for v in values]), flat[:, 0], flat[:, 1]


def document_frequencies(found: DataFrame, n_terms: int) -> np.ndarray:
    """In how many bags each term is: summed per task, then over the tasks; one number per term reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            total += np.bincount(unpacked(batch.column(0))[1], minlength=n_terms)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["term", "n"])

    out = np.zeros(n_terms, np.int64)
    rows = found.select("bag").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    out[rows["term"].to_numpy(np.int64)] = rows["n"].to_numpy()
    return out


class Scorer:
    """Scores of bags for all items of a pass; the terms that most items share by one matrix product, the others by their items."""

    def __init__(self, item_terms: list[np.ndarray], weights: np.ndarray, conf: SearchConfig):
        n_terms = len(weights)
        self.n_items, self.weights, self.cells = len(item_terms), weights, conf.cells
        item = np.repeat(np.arange(self.n_items), [len(t) for t in item_terms])
        term = np.concatenate(item_terms) if item_terms else np.zeros(0, np.int64)
        item = item[np.argsort(term, kind="stable")]
        asked = np.bincount(term, minlength=n_terms)
        shared = np.argsort(-asked, kind="stable")[: conf.dense]
        self.column = np.full(n_terms, -1)
        self.column[shared] = np.arange(len(shared))
        self.start, self.count = np.cumsum(asked) - asked, np.where(self.column >= 0, 0, asked)
        self.item = item
        # doubles add whole numbers exactly below 2^53; a weight meets at most 10^6
        most = max((len(t) for t in item_terms), default=0) * int(weights.max(initial=0)) * 10**6
        self.matrix = np.zeros((len(shared), self.n_items), np.float64 if most < 2**53 else np.int64)
        for k, t in enumerate(shared):
            self.matrix[k, item[self.start[t] : self.start[t] + asked[t]]] = 1

    def parts(self, row: np.ndarray, term: np.ndarray, n_rows: int) -> Iterator[slice]:
        """Rows in slices whose scores and postings stay within ``cells``."""
        cost = np.cumsum(np.bincount(row, self.count[term], minlength=n_rows) + self.n_items)
        first = 0
        while first < n_rows:
            done = cost[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(cost, done + self.cells, "right")))
            yield slice(first, last)
            first = last

    def scores(self, row: np.ndarray, term: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
        value = self.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[row]))
        wide = np.zeros((len(m), len(self.matrix)), self.matrix.dtype)
        column = self.column[term]
        wide[row[column >= 0], column[column >= 0]] = value[column >= 0]
        out = (wide @ self.matrix).astype(np.int64)
        count = self.count[term]
        entry = np.repeat(np.arange(len(term)), count)
        place = np.arange(len(entry)) - np.repeat(np.cumsum(count) - count, count)
        np.add.at(out, (row[entry], self.item[self.start[term[entry]] + place]), value[entry])
        return out


@dataclass
class Best:
    """The best classes of each item so far: by score, then by the smallest id (null last), then by class."""

    n_items: int
    results: int

    def __post_init__(self) -> None:
        self.bar = np.ones(self.n_items, np.int64)
        self.kept = np.zeros((4, 0), np.int64)  # item, class, score, smallest id
        self.null = np.zeros(0, bool)

    def add(self, scores: np.ndarray, classes: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        row, item = np.nonzero(scores >= self.bar)
        self.kept = np.hstack([self.kept, [item, classes[row], scores[row, item], ids[row]]])
        self.null = np.concatenate([self.null, null[row]])
        if len(self.null) > 8 * self.results * self.n_items:
            self.cut()

    def cut(self) -> None:
        item, of, score, ids = self.kept
        order = np.lexsort((of, ids, self.null, -score, item))
        item = item[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        self.kept, self.null = self.kept[:, order[rank < self.results]], self.null[order[rank < self.results]]
        last = rank == self.results - 1
        self.bar[item[last]] = score[order[last]]


def best_classes(classes: DataFrame, keys: np.ndarray, item_terms: list[np.ndarray], weights: np.ndarray, conf: SearchConfig) -> DataFrame:
    """(item, class, score, first_doc): each task's best classes of every item."""
    held = classes.sparkSession.sparkContext.broadcast((keys, item_terms, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, item_terms, weights = held.value
        scorer, best = Scorer(item_terms, weights, conf), Best(len(item_terms), conf.results)
        for batch in batches:
            of, m = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            first, null = batch.column(3).fill_null(0).to_numpy(zero_copy_only=False), batch.column(3).is_null().to_numpy(zero_copy_only=False)
            row, term, tf = unpacked(batch.column(2))
            for part in scorer.parts(row, term, batch.num_rows):
                entry = slice(*np.searchsorted(row, [part.start, part.stop]))
                best.add(scorer.scores(row[entry] - part.start, term[entry], tf[entry], m[part]), of[part], first[part], null[part])
        best.cut()
        item, of, score, ids = best.kept
        yield pa.RecordBatch.from_arrays([pa.array(keys[item], pa.int64()), pa.array(of), pa.array(score), pa.array(ids, pa.int64(), mask=best.null)], names=["item", "class", "score", "first_doc"])

    return classes.select("class", "m", "bag", "first_doc").mapInArrow(run, "item long, class long, score long, first_doc long")


def _ranked(rows: DataFrame, by: str, order: list, most: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= most)


def _search(docs: DataFrame, items: DataFrame, conf: SearchConfig) -> DataFrame:
    """One pass over ``docs`` for ``items`` (item, item_id, terms), whose terms the configuration bounds."""
    spark = docs.sparkSession
    asked = items.select("item", "terms").toPandas().sort_values("item")
    terms = sorted({t for own in asked["terms"] for t in own})
    number = {t: i for i, t in enumerate(terms)}
    own = [np.array([number[t] for t in x], np.int64) for x in asked["terms"]]
    found = written(bags(docs, terms), "bags")
    n_docs, all_terms = found.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not n_docs or not terms:
        return spark.createDataFrame([], RESULT)
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in document_frequencies(found, len(terms)).tolist()], np.int64)
    measured = found.where("length(bag) > 0").withColumn("m", F.expr(f"50L + (50L * n * {n_docs}L) div {all_terms}L")).withColumn("h", F.xxhash64("m", "bag"))
    grouped = measured.groupBy("h", "m", "bag").agg(F.min("doc_id").alias("first_doc"))
    classes = written(grouped.withColumn("class", F.monotonically_increasing_id()), "bag-classes")
    order = [F.col("score").desc(), F.col("first_doc").asc_nulls_last(), "class"]
    # classes in this order hold all winners: each has a document that comes before all of the next class
    won = written(_ranked(best_classes(classes, asked["item"].to_numpy(np.int64), own, weights, conf), "item", order, conf.results).select("item", "class", "score"), "bag-winners")
    opened = written(classes.join(won.select("class").distinct(), "class", "left_semi").select("class", "h", "m", "bag"), "bags-opened")
    members = measured.select("doc_id", "h", "m", "bag").join(opened, ["h", "m", "bag"]).select("class", "doc_id")
    by_id = F.col("doc_id").asc_nulls_last()
    first = _ranked(members, "class", [by_id], conf.results).drop("rank")
    placed = _ranked(won.join(first, "class"), "item", [F.col("score").desc(), by_id], conf.results)
    return placed.join(items.select("item", "item_id"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


RESULT = "item_id long, rank int, doc_id long, score long"


def search(docs: DataFrame, items: DataFrame, conf: SearchConfig = SearchConfig()) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``results`` best rows of ``docs`` (doc_id, text) for each row of ``items`` (item_id, text).

    Equal scores go by ascending doc_id, null last.  Every row of ``docs`` is a document,
    also if ids or texts repeat; null and empty texts, and texts without a term, count
    for nothing.  Identical items are one, items that differ and share an id are ranked
    each for itself; an item without terms, or without a document that scores above 0,
    has no row.  Empty tables give an empty result; other columns are not looked at.
    """
    numbered = written(item_terms(items).withColumn("item", F.monotonically_increasing_id()), "items")
    n_pairs = numbered.agg(F.sum(F.size("terms"))).first()[0] or 0
    passes = max(1, -(-n_pairs // conf.most_terms))
    parts = [numbered.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == k) if passes > 1 else numbered for k in range(passes)]
    out = [_search(docs, part, conf) for part in parts]
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    return out[0]
