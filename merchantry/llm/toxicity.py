"""Toxicity by multiple-instance learning: documents are bags of sentences.

A sentence's score is a logistic function of its words, and a document's is the
noisy-or of its sentences: it is toxic if any sentence is.  Only documents are
labelled; the gradient of the noisy-or finds the sentences to blame.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from merchantry.llm.common import Chunk, chunks, written

#: Punctuation between words becomes a space; the ends of sentences become words of their own.
BLANK = b",;:()[]{}\"'|*#$%&<>/\\_+=~^@-"
BLANKED = bytes.maketrans(BLANK, b" " * len(BLANK))
#: Bytes of text held at a time: a word takes about a dozen numbers on its way to a score.
LIMIT = 2 << 20


@dataclass(frozen=True)
class ToxicConfig:
    """At most ``most_labelled`` texts are learned from; every word that at least ``least_texts`` of them hold has a weight."""

    most_labelled: int = 24_000
    least_texts: int = 8
    rounds: int = 20
    step: float = 0.4
    decay: float = 0.02
    threshold: float = 0.3


def split_words(text: bytes) -> list[bytes]:
    """Lower-cased words, with a full stop after each sentence."""
    for end in (b"!", b"?", b"\n"):
        text = text.replace(end, b".")
    return text.translate(BLANKED).replace(b".", b" . ").split()


@dataclass
class Bags:
    """Features of sentences in order: ``feature`` per word, ``sentence`` per word, ``bag`` per sentence."""

    feature: np.ndarray
    sentence: np.ndarray
    bag: np.ndarray
    n_bags: int
    number: np.ndarray  # of a sentence in its document, from 0, empty ones counted

    def sentence_scores(self, weights: np.ndarray, bias: float) -> np.ndarray:
        z = bias + np.bincount(self.sentence, weights[self.feature], minlength=len(self.bag))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def log_clean(self, p: np.ndarray) -> np.ndarray:
        """Per bag the log of the probability that no sentence is toxic."""
        return np.bincount(self.bag, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=self.n_bags)


def bags_of(chunk: Chunk, words: np.ndarray) -> Bags:
    """Sentences with a word; features are places in ``words`` (sorted hashes), once per sentence, other words have none."""
    stop = next((i for i, w in enumerate(chunk.words) if w == b"."), -1)
    hashed = chunk.hashes()
    place = np.minimum(np.searchsorted(words, hashed), max(0, len(words) - 1))
    place = np.where(words[place] == hashed, place, -1) if len(words) else np.full(len(hashed), -1)
    is_end = chunk.stream == stop
    doc = np.repeat(np.arange(len(chunk.lengths)), chunk.lengths)
    ended = np.cumsum(is_end) - is_end
    word = np.flatnonzero(~is_end)
    # documents so far plus ends so far: grows at the end of each sentence and of each document
    at = doc[word] + ended[word]
    lead = np.concatenate([[True], at[1:] != at[:-1]]) if len(at) else np.zeros(0, bool)
    sentence = np.cumsum(lead) - 1
    bag = doc[word[lead]]
    ends_before = np.concatenate([[0], np.cumsum(is_end)])[chunk.starts[:-1]]
    feature = place[chunk.stream[word]] if len(word) else np.zeros(0, np.int64)
    key = np.unique(sentence[feature >= 0] * np.int64(len(words) + 1) + feature[feature >= 0])
    return Bags(key % (len(words) + 1), key // (len(words) + 1), bag, len(chunk.lengths), ended[word[lead]] - ends_before[bag])


@dataclass(frozen=True)
class ToxicModel:
    """A weight for each word of a sorted array of hashes, and the bias of a sentence."""

    words: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, bags: Bags) -> tuple[np.ndarray, np.ndarray]:
        """(score per bag, score per sentence)."""
        p = bags.sentence_scores(self.weights, self.bias)
        return -np.expm1(bags.log_clean(p)), p


def sampled(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(text, y) of at most ``most`` distinct labelled texts, those with the smallest hashes; toxic if any copy is.

    Labels meet hashes of texts; only the sample, bounded by ``most``, is broadcast to
    find its texts.
    """
    given = labels.where("toxic in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("y"))
    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).join(given, "doc_id")
    picked = hashed.groupBy("h").agg(F.max("y").alias("y"), F.min("doc_id").alias("doc_id")).orderBy("h").limit(most)
    picked = written(picked, "picked")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id")
    return written(rows.where(F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("h")).select("text", "y"), "labelled-sample")


def _sparse(values: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(values)
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(values[at], pa.float64())], names=["at", "value"])


def _summed(parts: DataFrame, size: int) -> np.ndarray:
    out = np.zeros(size)
    rows = parts.groupBy("at").agg(F.sum("value").alias("value")).toPandas()
    out[rows["at"].to_numpy(np.int64)] = rows["value"].to_numpy()
    return out


def word_counts(sample: DataFrame) -> DataFrame:
    """(h, clean, toxic): in how many clean and toxic texts of the sample each word is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, lower=True, limit=LIMIT, split=split_words):
            doc = np.repeat(np.arange(len(chunk.lengths)), chunk.lengths)
            pair = np.unique(doc * np.int64(len(chunk.words) + 1) + chunk.stream)
            word, y = pair % (len(chunk.words) + 1), np.array(chunk.rows.column("y").to_pylist(), np.int64)[pair // (len(chunk.words) + 1)]
            both = [pa.array(np.bincount(word[y == k], minlength=len(chunk.words)), pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(chunk.hashes().view(np.int64)), *both], names=["h", "clean", "toxic"])

    found = sample.mapInArrow(run, "h long, clean long, toxic long")
    return found.groupBy("h").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def train(docs: DataFrame, labels: DataFrame, conf: ToxicConfig = ToxicConfig()) -> ToxicModel:
    """A model from the rows of ``docs`` (doc_id, text) with a label 0 or 1 in ``labels`` (doc_id, toxic); repeated labels: the highest.

    Bags are written once.  Each round the tasks sum the gradient of their bags over
    the bounded number of words, and the driver adds the sums and steps (Adam).
    Without toxic rows every score is near 0.
    """
    spark = docs.sparkSession
    sample = sampled(docs, labels, conf.most_labelled)
    n_clean, n_toxic = sample.agg(F.count_if(F.col("y") == 0), F.count_if(F.col("y") == 1)).first()
    if not n_toxic:
        return ToxicModel(np.zeros(0, np.uint64), np.zeros(0), -12.0)
    total = F.col("clean") + F.col("toxic")
    top = word_counts(sample).where(total >= conf.least_texts).toPandas()  # bounded by the sample
    words = top["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(words)
    words, clean, toxic = words[order], top["clean"].to_numpy(float)[order], top["toxic"].to_numpy(float)[order]
    n_words = len(words)
    known = spark.sparkContext.broadcast(words)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, lower=True, limit=LIMIT, split=split_words):
            bags = bags_of(chunk, known.value)
            y = np.array(chunk.rows.column("y").to_pylist(), np.int32)
            parts = [bags.feature.astype(np.int32), bags.sentence.astype(np.int32), bags.bag.astype(np.int32), y]
            yield pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts], names=["feature", "sentence", "bag", "y"])

    bags = written(sample.mapInArrow(featured, "feature binary, sentence binary, bag binary, y binary"), "bags")
    # the start: how much more often a word is in toxic texts, shrunk for rare words; words only ever add
    # evidence, else the many harmless words of a sentence would outweigh the one that offends
    odds = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))
    support = toxic + clean
    weights = np.clip(odds * support / (support + 5.0), 0.0, 10.0)
    bias = -7.5
    m, v = np.zeros(n_words + 1), np.zeros(n_words + 1)
    for turn in range(1, conf.rounds + 1):
        held = spark.sparkContext.broadcast((weights, bias))

        def gradient(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            w, b0 = held.value
            total = np.zeros(n_words + 1)
            for batch in batches:
                for row in zip(*(batch.column(c).to_pylist() for c in ("feature", "sentence", "bag", "y")), strict=True):
                    feature, sentence, bag, y = (np.frombuffer(x, np.int32).astype(np.int64) for x in row)
                    b = Bags(feature, sentence, bag, len(y), bag)
                    p = b.sentence_scores(w, b0)
                    log_clean = b.log_clean(p)
                    # d/dz of the negative log likelihood: p in a clean bag, -p (1 - P) / P in a toxic one with score P
                    score = np.maximum(-np.expm1(log_clean), 1e-9)
                    dz = p * np.where(y == 1, -np.exp(log_clean) / score, 1.0)[bag]
                    total[:-1] += np.bincount(feature, dz[sentence], minlength=n_words)
                    total[-1] += dz.sum()
            yield _sparse(total)

        g = _summed(bags.mapInArrow(gradient, "at int, value double"), n_words + 1)
        g[:-1] += conf.decay * weights
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        change = conf.step * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-3)
        weights, bias = np.maximum(weights - change[:-1], 0.0), float(bias - change[-1])
        held.unpersist()
    return ToxicModel(words, weights, bias)


SCORED = "doc_id long, score double, n_sentences long, offending array<struct<sentence:long,score:double>>"


def score(docs: DataFrame, model: ToxicModel, conf: ToxicConfig = ToxicConfig()) -> DataFrame:
    """(doc_id, score, n_sentences, offending) per row of ``docs`` (doc_id, text).

    ``offending`` lists the sentences (numbered from 0 in the text) with a score of at
    least the threshold.  A null or blank text has no sentence and score 0.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, lower=True, limit=LIMIT, split=split_words):
            bags = bags_of(chunk, held.value.words)
            scores, p = held.value.scores(bags)
            bad = np.flatnonzero(p >= conf.threshold)
            spans = pa.StructArray.from_arrays([pa.array(bags.number[bad], pa.int64()), pa.array(p[bad])], names=["sentence", "score"])
            ends = np.concatenate([[0], np.cumsum(np.bincount(bags.bag[bad], minlength=bags.n_bags))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    chunk.rows.column("doc_id").combine_chunks(),
                    pa.array(np.clip(scores, 0.0, 1.0)),
                    pa.array(np.bincount(bags.bag, minlength=bags.n_bags), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends), spans),
                ],
                names=["doc_id", "score", "n_sentences", "offending"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCORED)


def drop_toxic(docs: DataFrame, model: ToxicModel, conf: ToxicConfig = ToxicConfig()) -> DataFrame:
    """The rows of ``docs`` scored below the threshold, with their columns, in one pass over the texts."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, lower=True, limit=LIMIT, split=split_words):
            scores, _ = held.value.scores(bags_of(chunk, held.value.words))
            yield from chunk.rows.filter(pa.array(scores < conf.threshold)).to_batches()

    return docs.mapInArrow(run, docs.schema)
