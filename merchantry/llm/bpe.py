"""BPE over a table of distinct words: each is encoded once, and its ids are joined back by position.

No token of a BPE tokenizer that drops white space crosses ASCII white space, so
a text's ids are those of its words in order.  Words are split in Spark and dealt
to buckets by hash; equal words meet in one task, which has the tokenizer encode
each once; the ids go back to the chunks that asked, and replace the words by
position.  Decoding
looks each id up in the table of pieces, which has the tokenizer's fixed size.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from merchantry.llm.common import chunks
from merchantry.llm.packed import batches_of, from_planes, key_of, pack, planes, unpack

#: Bytes of text of a chunk: its words in order become Python numbers where they meet their ids.
CHUNK = 8 << 20


@dataclass(frozen=True)
class BpeConfig:
    """The tokenizer's file, the buckets of words, and what a task holds or packs at once.

    A bucket's words are sent packed, one row per chunk.  ``held_words`` bounds memory:
    a task with more distinct words than that starts its table afresh.
    """

    path: str = field(default_factory=lambda: public_tokenizers.path("word_bpe_49k.json"))
    buckets: int = 4096
    held_words: int = 300_000
    requests_at_once: int = 256
    answers_at_once: int = 200_000


def pieces(path: str) -> list[str]:
    """The piece of each id, in order; the vocabulary and the added tokens of a tokenizers file."""
    with open(path, encoding="utf-8") as file:
        known = json.load(file)
    by_id = {i: piece for piece, i in known["model"]["vocab"].items()} | {t["id"]: t["content"] for t in known["added_tokens"]}
    return [by_id.get(i, "") for i in range(max(by_id) + 1)]


def _requests(docs: DataFrame, conf: BpeConfig) -> DataFrame:
    """(bucket, key, blob): the words of a chunk that hash to a bucket, and their numbers in the chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3, write_content_size=True)
        for chunk in chunks(batches, limit=CHUNK):
            if not chunk.words:
                continue
            bucket = (chunk.hashes() % np.uint64(conf.buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            held = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1)
            blobs = []
            for own in held:
                text = b"\n".join([chunk.words[i] for i in own.tolist()])
                blobs.append(press.compress(len(own).to_bytes(4, "little") + planes(np.diff(own, prepend=0)) + text))
            columns = [pa.array(bucket[[own[0] for own in held]]), pa.array(np.full(len(held), key_of(chunk))), pa.array(blobs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["bucket", "key", "blob"])

    return docs.select("text").mapInArrow(run, "bucket int, key long, blob binary")


def _encoder(path: str) -> Callable[[list[bytes]], list[list[int]]]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda words: [e.ids for e in tokenizer.encode_batch([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)]


def _answers(requests: DataFrame, conf: BpeConfig) -> DataFrame:
    """(key, blob): for each chunk, numbers of words with their ids."""

    def packed(numbers: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
        head = np.array([len(numbers)], np.int64)
        return pack(np.concatenate([head, np.diff(numbers, prepend=0), lengths, ids]))

    def emit(held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        keys, numbers, lengths, ids = (np.concatenate(x) for x in zip(*held, strict=True))
        starts = np.concatenate([[0], np.cumsum(lengths)])
        order = np.lexsort((numbers, keys))
        cuts = np.flatnonzero(np.diff(keys[order])) + 1
        out_keys, blobs = [], []
        for own in np.split(order, cuts):
            spread = np.repeat(starts[own] - np.concatenate([[0], np.cumsum(lengths[own])[:-1]]), lengths[own]) + np.arange(lengths[own].sum())
            out_keys.append(keys[own[0]])
            blobs.append(packed(numbers[own], lengths[own], ids[spread.astype(np.int64)]))
        return pa.RecordBatch.from_arrays([pa.array(np.array(out_keys, np.int64)), pa.array(blobs, pa.binary())], names=["key", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, press = _encoder(conf.path), zstandard.ZstdDecompressor()
        known: dict[bytes, bytes] = {}
        held, n = [], 0
        rows = (row for batch in batches for row in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
        while some := list(itertools.islice(rows, conf.requests_at_once)):
            words: list[bytes] = []
            counts, numbers = [], []
            for _, blob in some:
                raw = press.decompress(blob)
                count = int.from_bytes(raw[:4], "little")
                counts.append(count)
                numbers.append(np.cumsum(from_planes(raw[4 : 4 + 4 * count]).astype(np.int64)))
                words += raw[4 + 4 * count :].split(b"\n")
            if len(known) > conf.held_words:
                known = {}
            fresh = [w for w in dict.fromkeys(words) if w not in known]
            known.update(zip(fresh, (np.array(x, "<u4").tobytes() for x in encode(fresh)), strict=True))
            ids = [known[w] for w in words]
            lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            held.append((np.repeat([key for key, _ in some], counts), np.concatenate(numbers), lengths, np.frombuffer(b"".join(ids), "<u4")))
            n += len(words)
            if n >= conf.answers_at_once:
                yield emit(held)
                held, n = [], 0
        if held:
            yield emit(held)

    return requests.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "key long, blob binary")


STREAM = pa.schema([("key", pa.int64()), ("doc_ids", pa.binary()), ("lengths", pa.binary()), ("stream", pa.binary()), ("words", pa.int64())])


def _streams(docs: DataFrame) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for chunk in chunks(batches, limit=CHUNK):
            ids = chunk.rows.select(["doc_id"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, ids.schema) as writer:
                writer.write_table(ids)
            yield key_of(chunk), sink.getvalue().to_pybytes(), pack(chunk.lengths), pack(chunk.stream), len(chunk.words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches_of(rows(batches), STREAM)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "key long, doc_ids binary, lengths binary, stream binary, words long")


def _with_words(docs: DataFrame, conf: BpeConfig, out: pa.Schema, ddl: str, make: Callable) -> DataFrame:
    """Chunks meet the ids of their words: ``make(stream, word ids as bytes, lengths in ids)`` gives a document's values."""

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return out.empty_table()
        n_words = left.column("words")[0].as_py()
        ids: list[bytes | None] = [None] * n_words
        for blob in right.column("blob").to_pylist():
            raw = unpack(blob)
            n = int(raw[0])
            ends = np.cumsum(raw[1 + n : 1 + 2 * n].astype(np.int64)) * 4
            data = raw[1 + 2 * n :].tobytes()
            for number, a, b in zip(np.cumsum(raw[1 : 1 + n].astype(np.int64)).tolist(), np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist(), strict=True):
                ids[number] = data[a:b]
        if any(x is None for x in ids):
            raise RuntimeError("words of a chunk have no ids: the documents were not the same in both passes; write them first")
        prepared = make(ids)
        parts = []
        for row in left.to_pylist():
            lengths, stream = unpack(row["lengths"]), unpack(row["stream"]).tolist()
            ends = np.cumsum(lengths.astype(np.int64)).tolist()
            columns = [prepared(stream[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            doc_ids = pa.ipc.open_stream(row["doc_ids"]).read_all().column(0).combine_chunks()
            parts.append(pa.Table.from_arrays([doc_ids, *(pa.array(c, f.type) for c, f in zip(zip(*columns, strict=True), list(out)[1:], strict=True))], schema=out))
        return pa.concat_tables(parts)

    streams, answers = _streams(docs), _answers(_requests(docs, conf), conf)
    return streams.groupBy("key").cogroup(answers.groupBy("key")).applyInArrow(meet, ddl)


def encode(docs: DataFrame, conf: BpeConfig = BpeConfig()) -> DataFrame:
    """(doc_id, ids) per row of ``docs`` (doc_id, text): array of ids, empty for null or blank texts."""
    out = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def make(ids: list[bytes]) -> Callable:
        return lambda stream: (np.frombuffer(b"".join(map(ids.__getitem__, stream)), "<u4").astype(np.int32),)

    return _with_words(docs, conf, out, "doc_id long, ids array<int>", make)


def piece_table(spark, conf: BpeConfig = BpeConfig()) -> DataFrame:
    """(id, piece) of the tokenizer."""
    return spark.createDataFrame(list(enumerate(pieces(conf.path))), "id int, piece string")


def decode(encoded: DataFrame, table: DataFrame) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids), by a join of ids with (id, piece); pieces are joined by a space.

    The table has as many rows as the tokenizer has ids, so it is broadcast.  Rows
    are told apart by their position; rows without ids decode to the empty text.
    """
    rows = encoded.select("doc_id", "ids").withColumn("row", F.monotonically_increasing_id())
    placed = rows.select("doc_id", "row", F.posexplode_outer("ids").alias("pos", "id"))
    joined = placed.join(F.broadcast(table), "id", "left").groupBy("row", "doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "piece"))).alias("p"))
    return joined.select("doc_id", F.array_join(F.transform("p", lambda x: x["piece"]), " ").alias("text"))


def encoded_digests(docs: DataFrame, conf: BpeConfig = BpeConfig()) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) per row of ``docs`` (doc_id, text).

    Ids are hashed as little-endian unsigned 32-bit integers, decoded texts as UTF-8.
    Null or blank texts have no ids and decode to the empty text; rows that repeat a
    doc_id are encoded each for itself; other columns are ignored.
    """
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    table = docs.sparkSession.sparkContext.broadcast([p.encode() for p in pieces(conf.path)])

    def make(ids: list[bytes]) -> Callable:
        piece = table.value
        decoded = [b" ".join([piece[i] for i in np.frombuffer(x, "<u4").tolist()]) for x in ids]

        def digests(stream: list[int]) -> tuple:
            raw = b"".join(map(ids.__getitem__, stream))
            text = b" ".join([d for d in map(decoded.__getitem__, stream) if d])
            return len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256(text).hexdigest()

        return digests

    return _with_words(docs, conf, out, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", make)
