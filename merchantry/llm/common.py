"""What the operators share: table access, scratch tables, chunks of tokenised documents."""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from merchantry.session import shared_folder

#: ASCII white space, the separators of words in all contracts: [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text that one chunk of documents holds; a longer text is a chunk alone.
CHUNK_BYTES = 16 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The rows, written in the shared folder and read from there: computed once, and safe from lost executors."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def remainder(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of`` (null: -1)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % of, F.lit(-1))


@dataclass
class Chunk:
    """Whole documents: their rows, the words in order as numbers, and the words that the numbers stand for."""

    rows: pa.Table
    lengths: np.ndarray
    stream: np.ndarray
    words: list[bytes]

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.lengths)]).astype(np.int64)

    def hashes(self, seed: int = 0) -> np.ndarray:
        return np.array([xxhash.xxh64_intdigest(w, seed) for w in self.words], np.uint64)


def chunks(batches: Iterable[pa.RecordBatch], lower: bool = False, limit: int = CHUNK_BYTES, split=None) -> Iterator[Chunk]:
    """Cuts Arrow batches into chunks of whole documents of about ``limit`` bytes of text.

    Batches have a column ``text`` (null: empty) and any others.  Words are what
    ``split`` makes of the bytes, by default what ASCII white space separates.
    """
    rows: list[pa.RecordBatch] = []
    lengths: list[int] = []
    parts: list[np.ndarray] = []
    words: defaultdict[bytes, int] = defaultdict(itertools.count().__next__)
    size = 0

    def done() -> Chunk:
        stream = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        return Chunk(pa.Table.from_batches(rows), np.array(lengths, np.int64), stream, list(words))

    for batch in batches:
        first = 0
        texts = batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist()
        for i, text in enumerate(texts):
            raw = text or b""
            if lower:
                raw = raw.lower()
            found = split(raw) if split else raw.split()
            parts.append(np.fromiter(map(words.__getitem__, found), np.int32, len(found)))
            lengths.append(len(found))
            size += len(raw) + 1
            if size >= limit:
                rows.append(batch.slice(first, i + 1 - first))
                yield done()
                rows, lengths, parts, size, first = [], [], [], 0, i + 1
                words = defaultdict(itertools.count().__next__)
        if first < batch.num_rows:
            rows.append(batch.slice(first))
    if rows:
        yield done()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def free_name(base: str, df: DataFrame) -> str:
    """``base``, longer by as many underscores as it takes to be no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def keep_rows(docs: DataFrame, digest: Column, keys: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose (doc_id, ``digest`` of the text) is in ``keys`` (doc_id, digest, n; distinct, may hold null ids), one row of each.

    Rows with the same id, or without one, all stay if their texts differ.  Of the n
    rows of a key the longest text stays, then the first in the order of all columns.
    Only keys with several rows are ranked; the rank filter is applied before their
    shuffle as well.  Further columns of ``docs`` may have any name.
    """
    own, key, key_digest, nth = (free_name(c, docs) for c in ("digest", "key_id", "key_digest", "nth"))
    named = docs.withColumn(own, digest)

    def within(part: DataFrame) -> DataFrame:
        wanted = part.select(F.col("doc_id").alias(key), F.col("digest").alias(key_digest)).hint("shuffle_hash")
        return named.join(wanted, F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(own) == F.col(key_digest)), "left_semi")

    longest = F.length(F.coalesce("text", F.lit(""))).desc()
    rank = F.row_number().over(Window.partitionBy("doc_id", own).orderBy(longest, *[F.col(f"`{c}`").cast("string") for c in docs.columns]))
    several = within(keys.where("n > 1")).withColumn(nth, rank).where(F.col(nth) == 1).drop(nth)
    return within(keys.where("n = 1")).unionByName(several).drop(own)
