"""Class-based bigrams after Brown: words in classes, transitions between classes, words emitted by classes.

P(word | previous) = P(class of word | history class of previous) * P(word | class).
History classes are those of a bounded set of numbers: the most frequent words, and
the endings of all others.  A sequential exchange clusters them.  The classes of words
are those of every word that the training text holds often enough: starting from the
class of its number, each moves to the class where the text is likeliest, half of the
words at a time, by tasks that need nothing but the counts of (history class, class).
So what is clustered, and what it is learned from, grows with the text.  Rarer words
and words never seen keep the class of their ending.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from merchantry.llm.common import chunks, remainder, written
from merchantry.llm.packed import batches_of, pack, unpack


@dataclass(frozen=True)
class BrownConfig:
    """History: words with at least ``frequent`` of all tokens (so at most 1 / frequent of them) and ``endings``, in ``passes`` of exchange; then ``moves`` of all words with ``least`` training tokens."""

    classes: int = 96
    frequent: float = 2e-4
    endings: int = 1024
    passes: int = 12
    least: int = 5
    moves: int = 6
    transition_prior: float = 20.0
    emission_prior: float = 0.4


def ending(word: bytes, n: int) -> int:
    """Number of a word's ending: its last three characters (seven bytes at most)."""
    tail = word[-12:].decode("utf-8", "replace")[-3:]
    return xxhash.xxh32_intdigest(tail) % n


#: Bytes of text that a chunk holds: tasks keep several arrays with an entry for each of its words.
CUT_BYTES = 8 << 20
CHUNKS = pa.schema([(c, pa.binary()) for c in ("docs", "lengths", "stream", "hashes", "tails")] + [("words", pa.int64())])


def cut(docs: DataFrame, conf: BrownConfig) -> DataFrame:
    """The documents as chunks, cut once and written: their words in order as numbers, and per number the word's hash and ending."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for chunk in chunks(batches, lower=True, limit=CUT_BYTES):
            sink = pa.BufferOutputStream()
            own = chunk.rows.select(["doc_id", "held_out"])
            with pa.ipc.new_stream(sink, own.schema) as writer:
                writer.write_table(own)
            tails = np.array([ending(w, conf.endings) for w in chunk.words], np.int64)
            yield sink.getvalue().to_pybytes(), pack(chunk.lengths), pack(chunk.stream), chunk.hashes().tobytes(), pack(tails), len(chunk.words)

    found = docs.select("doc_id", "text", "held_out").mapInArrow(lambda x: batches_of(rows(x), CHUNKS), "docs binary, lengths binary, stream binary, hashes binary, tails binary, words long")
    return written(found.withColumn("key", F.monotonically_increasing_id()), "cut")


@dataclass
class Cut:
    """A chunk as read back."""

    row: dict

    def __post_init__(self) -> None:
        self.docs = pa.ipc.open_stream(self.row["docs"]).read_all()
        self.lengths = unpack(self.row["lengths"]).astype(np.int64)
        self.stream = unpack(self.row["stream"]).astype(np.int32)
        self.hashes = np.frombuffer(self.row["hashes"], np.uint64)
        self.tails = unpack(self.row["tails"]).astype(np.int64)
        self.train = ~np.array(self.docs.column("held_out").to_pylist(), bool)

    @property
    def in_training(self) -> np.ndarray:
        return np.repeat(self.train, self.lengths)


def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[Cut]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Cut({name: batch.column(name)[i].as_py() for name in batch.schema.names})


REQUESTS = "h long, ending int, key long, nr int, n long"


def _requests(table: DataFrame) -> DataFrame:
    """Per chunk and distinct word: its hash, ending, number, and occurrences in training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in cuts(batches):
            n = len(c.hashes)
            counts = np.bincount(c.stream[c.in_training], minlength=n)
            columns = [c.hashes.view(np.int64), c.tails.astype(np.int32), np.full(n, c.row["key"]), np.arange(n, dtype=np.int32), counts.astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["h", "ending", "key", "nr", "n"])

    return table.mapInArrow(run, REQUESTS)


@dataclass
class Lexicon:
    """Numbers of words: frequent ones by hash in order, then endings, then the end of a text."""

    frequent: np.ndarray  # sorted unsigned hashes
    endings: int

    @property
    def size(self) -> int:
        return len(self.frequent) + self.endings + 1

    @property
    def end(self) -> int:
        return self.size - 1

    def numbers(self, c: Cut) -> np.ndarray:
        tails = c.tails + len(self.frequent)
        if not len(self.frequent):
            return tails
        at = np.minimum(np.searchsorted(self.frequent, c.hashes), len(self.frequent) - 1)
        return np.where(self.frequent[at] == c.hashes, at, tails)


def with_ends(c: Cut, of_word: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """What ``of_word`` says of the words of each training document, each followed by an ``end``; and the same of what is before."""
    ids = of_word[c.stream][c.in_training] if len(of_word) else np.zeros(0, np.int64)
    flat = np.insert(ids, np.cumsum(c.lengths[c.train]), end)
    return flat, np.concatenate([[end], flat[:-1]])[: len(flat)]


def _bigrams(table: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(a, b, n): how often number b follows a in the training documents; each text begins after an end and ends with one."""
    held = table.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = held.value
        for c in cuts(batches):
            flat, before = with_ends(c, lex.numbers(c), lex.end)
            key, n = np.unique(before * np.int64(lex.size) + flat, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key // lex.size, pa.int32()), pa.array(key % lex.size, pa.int32()), pa.array(n, pa.int64())], names=["a", "b", "n"])

    return table.mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def exchange(bigrams: DataFrame, size: int, end: int, conf: BrownConfig) -> np.ndarray:
    """The class of each number.

    In each pass Spark sums the bigrams up to the classes of either neighbour: at most
    size times classes counts a side, however long the text.  Then numbers, the most
    frequent first, move to the class where the text is likeliest, with the class
    counts kept up to date.  There are two starts, as the text decides which one gets
    stuck: the most frequent numbers alone and all others together, or all dealt out in
    turn.  The likelier after three passes goes on.  The end of a text keeps a class of
    its own, 0.
    """
    spark, k = bigrams.sparkSession, conf.classes
    totals = bigrams.groupBy("b").agg(F.sum("n").alias("n")).toPandas()
    count = np.zeros(size)
    count[totals["b"].to_numpy(np.int64)] = totals["n"]
    order = np.argsort(-count, kind="stable")
    order = order[(order != end) & (count[order] > 0)]

    def likelihood(pair: np.ndarray, mass: np.ndarray) -> float:
        return float((pair * np.log(np.maximum(pair, 1))).sum() - 2 * (mass * np.log(np.maximum(mass, 1))).sum())

    def passes(classes: np.ndarray, most: int) -> tuple[float, np.ndarray]:
        found = -np.inf
        for _ in range(most):
            named = F.broadcast(spark.createDataFrame(list(enumerate(classes.tolist())), "id int, cls int"))
            right = bigrams.join(named, F.col("b") == F.col("id")).groupBy(F.col("a").alias("w"), "cls").agg(F.sum("n").alias("n")).toPandas()
            left = bigrams.join(named, F.col("a") == F.col("id")).groupBy(F.col("b").alias("w"), "cls").agg(F.sum("n").alias("n")).toPandas()
            after, before = np.zeros((size, k)), np.zeros((size, k))
            after[right["w"].to_numpy(np.int64), right["cls"].to_numpy(np.int64)] = right["n"]
            before[left["w"].to_numpy(np.int64), left["cls"].to_numpy(np.int64)] = left["n"]
            pair = np.zeros((k, k))
            np.add.at(pair, classes, after)
            mass = np.bincount(classes, count, minlength=k)
            moved = 0
            for w in order.tolist():
                old = classes[w]
                pair[old] -= after[w]
                pair[:, old] -= before[w]
                mass[old] -= count[w]
                pair = np.maximum(pair, 0.0)
                follows = np.log((pair + 0.5) / (pair.sum(axis=1, keepdims=True) + 0.5 * k))
                gain = follows @ after[w] + before[w] @ follows - count[w] * np.log(mass + count[w])
                gain[0] = -np.inf
                new = int(np.argmax(gain))
                pair[new] += after[w]
                pair[:, new] += before[w]
                mass[new] += count[w]
                classes[w] = new
                moved += new != old
            found = likelihood(pair, mass)
            if moved <= len(order) // 200:
                break
        return found, classes

    turns = np.arange(len(order))
    tried = []
    for start in (np.minimum(1 + turns, k - 1), 1 + turns % (k - 1)):
        classes = np.full(size, 1, np.int64)
        classes[order], classes[end] = start, 0
        tried.append(passes(classes, 3))
    _, classes = max(tried, key=lambda x: x[0])
    return passes(classes, max(0, conf.passes - 3))[1]


# classes of all words --------------------------------------------------------------------
#: Requests that one bucket of words sums up.
BUCKET = 500_000
CONTEXTS = pa.schema([("bucket", pa.int64())] + [(c, pa.binary()) for c in ("hashes", "start", "sizes", "before", "n")])
WORDS = pa.schema([("bucket", pa.int64())] + [(c, pa.binary()) for c in ("hashes", "c", "cls", "sizes", "before", "n", "cells")] + [("moved", pa.int64())])
DDL = {pa.int64(): "long", pa.binary(): "binary"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {DDL[f.type]}" for f in schema)


def _contexts(table: DataFrame, lexicon: Lexicon, history: np.ndarray, buckets: int) -> DataFrame:
    """Per chunk and bucket of hashes: its words, their classes to start with, and how often each follows each history class."""
    held = table.sparkSession.sparkContext.broadcast((lexicon, history))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        lex, history = held.value
        k = int(history.max(initial=0)) + 1
        for c in cuts(batches):
            classes = history[lex.numbers(c)]
            flat, previous = with_ends(c, np.arange(len(classes), dtype=np.int32), len(classes))
            before = np.append(classes, history[lex.end]).astype(np.uint8)[previous]
            key = flat.astype(np.int64) * k + before
            del flat, previous, before
            key, n = np.unique(key, return_counts=True)
            word, before = key // k, key % k
            ended = word == len(classes)  # the end of a text is a word of its own, in bucket -1
            if ended.any():
                yield -1, b"", b"", pack(np.array([ended.sum()])), pack(before[ended]), pack(n[ended])
            word, before, n = word[~ended], before[~ended], n[~ended]
            bucket = (c.hashes[word] >> np.uint64(11)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in range(buckets):
                at = order[edges[b] : edges[b + 1]]
                if len(at):
                    own, sizes = np.unique(word[at], return_counts=True)
                    yield b, c.hashes[own].tobytes(), classes[own].astype(np.uint8).tobytes(), pack(sizes), pack(before[at]), pack(n[at])

    return table.mapInArrow(lambda x: batches_of(rows(x), CONTEXTS), _ddl(CONTEXTS))


def _cells(cls: np.ndarray, before: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """How often a class follows each history class: a row per history class."""
    return np.bincount(before * k + cls, n, minlength=k * k).astype(np.int64).reshape(k, k)


def _summed_words(conf: BrownConfig):
    """A bucket's words over all chunks: those with ``least`` tokens, and the cells of the others."""
    k = conf.classes

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        parts = [(np.frombuffer(r["hashes"], np.uint64), np.frombuffer(r["start"], np.uint8), *(unpack(r[c]).astype(np.int64) for c in ("sizes", "before", "n"))) for r in rows.to_pylist()]
        if key[0].as_py() < 0:
            before, n = np.concatenate([p[3] for p in parts]), np.concatenate([p[4] for p in parts])
            return _row((-1, b"", pack(np.zeros(0)), b"", pack(np.zeros(0)), pack(np.zeros(0)), pack(np.zeros(0)), _cells(np.zeros(len(before), np.int64), before, n, k).tobytes(), 0))
        hashes, first = np.unique(np.concatenate([p[0] for p in parts]), return_index=True)
        start = np.concatenate([p[1] for p in parts])[first].astype(np.int64)
        word = np.concatenate([np.repeat(np.searchsorted(hashes, p[0]), p[2]) for p in parts])
        pair, back = np.unique(word * k + np.concatenate([p[3] for p in parts]), return_inverse=True)
        n = np.bincount(back, np.concatenate([p[4] for p in parts])).astype(np.int64)
        word, before = pair // k, pair % k
        c = np.bincount(word, n, minlength=len(hashes)).astype(np.int64)
        often = c >= conf.least
        entry = often[word]
        rare = _cells(start[word[~entry]], before[~entry], n[~entry], k)
        cls = start[often]
        # rare words stay where they are: their cells stand beside those of the words that move
        own = _cells(start[word[entry]], before[entry], n[entry], k)
        sizes = np.bincount(word, minlength=len(hashes))[often]
        return _row((key[0].as_py(), hashes[often].tobytes(), pack(c[often]), cls.astype(np.uint8).tobytes(), pack(sizes), pack(before[entry]), pack(n[entry]), (rare + own).tobytes(), 0))

    return run


def _row(values: tuple) -> pa.Table:
    return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip(values, WORDS, strict=True)], schema=WORDS)


def _counted(words: DataFrame, k: int) -> tuple[np.ndarray, int]:
    """The cells of all buckets, and how many words moved: k * k numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k + 1, np.int64)
        for batch in batches:
            for cells, moved in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[:-1] += np.frombuffer(cells, np.int64)
                total[-1] += moved
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["cell", "n"])

    out = np.zeros(k * k + 1, np.int64)
    rows = words.select("cells", "moved").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out[rows["cell"].to_numpy(np.int64)] = rows["n"].to_numpy()
    return out[:-1].reshape(k, k), int(out[-1])


def best_classes(x: np.ndarray, c: np.ndarray, cls: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """The class where each word makes the text likeliest, given all others: words by history classes in ``x``, tokens in ``c``.

    A word's own counts are taken out of the class that it is in.  Class 0 is the end's.
    """
    mass = cells.sum(axis=0)
    gain = x @ np.log(cells + 0.5) - c[:, None] * np.log(mass[None, :] + c[:, None])
    at = np.arange(len(c))
    stay = (x * np.log(np.maximum(cells[:, cls].T - x, 0) + 0.5)).sum(axis=1) - c * np.log(np.maximum(mass[cls], 1))
    gain[at, cls] = stay
    gain[:, 0] = -np.inf
    best = np.argmax(gain, axis=1)
    return np.where(gain[at, best] > gain[at, cls] + 1e-9, best, cls)


def _moved(words: DataFrame, cells: np.ndarray, half: int, conf: BrownConfig) -> DataFrame:
    """The words after those of one half have moved."""
    k = conf.classes
    held = words.sparkSession.sparkContext.broadcast(cells)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for row in batch.to_pylist():
                hashes, old = np.frombuffer(row["hashes"], np.uint64), np.frombuffer(row["cls"], np.uint8).astype(np.int64)
                c, sizes, before, n = (unpack(row[x]).astype(np.int64) for x in ("c", "sizes", "before", "n"))
                word = np.repeat(np.arange(len(c)), sizes)
                new = old.copy()
                turn = np.flatnonzero((hashes & np.uint64(1)) == half)
                if len(turn):
                    x = np.zeros((len(c), k))
                    x[word, before] = n
                    new[turn] = best_classes(x[turn], c[turn].astype(float), old[turn], held.value)
                own = np.frombuffer(row["cells"], np.int64).reshape(k, k) - _cells(old[word], before, n, k) + _cells(new[word], before, n, k)
                yield tuple(row[f.name] for f in WORDS)[:3] + (new.astype(np.uint8).tobytes(), row["sizes"], row["before"], row["n"], own.tobytes(), int((new != old).sum()))

    return words.mapInArrow(lambda b: batches_of(rows(b), WORDS), _ddl(WORDS))


def clustered(table: DataFrame, lexicon: Lexicon, history: np.ndarray, requests: int, conf: BrownConfig) -> tuple[DataFrame, np.ndarray]:
    """(h, cls) of all words with ``least`` training tokens, and how often each class follows each history class."""
    buckets = max(1, -(-requests // BUCKET))
    words = written(_contexts(table, lexicon, history, buckets).groupBy("bucket").applyInArrow(_summed_words(conf), _ddl(WORDS)), "clustered-0")
    cells, _ = _counted(words, conf.classes)
    for turn in range(conf.moves):
        words = written(_moved(words, cells, turn % 2, conf), f"clustered-{turn + 1}")
        cells, _ = _counted(words, conf.classes)

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, cls in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(h, np.int64)), pa.array(np.frombuffer(cls, np.uint8).astype(np.int32))], names=["h", "cls"])

    return words.select("hashes", "cls").mapInArrow(flat, "h long, cls int"), cells


@dataclass
class BrownModel:
    lexicon: Lexicon
    history: np.ndarray  # class of each number
    follows: np.ndarray  # log10 P(class | history class)
    emits: np.ndarray  # per class: tokens, distinct words
    n_tokens: int
    n_words: int
    n_ends: int


def train(table: DataFrame, docs: DataFrame, conf: BrownConfig) -> tuple[BrownModel, DataFrame]:
    """The model, and the table (h, c, cls) of training counts and classes."""
    spark = table.sparkSession
    counts = written(_requests(table).groupBy("h", "ending").agg(F.sum("n").alias("c")).where("c > 0"), "word-counts")
    n_ends = docs.where("not held_out").count()
    words, tokens = counts.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    n = tokens + n_ends
    often = counts.where(F.col("c") >= max(conf.least, conf.frequent * n)).select("h").toPandas()
    lexicon = Lexicon(np.sort(often["h"].to_numpy(np.int64).view(np.uint64)), conf.endings)
    bigrams = written(_bigrams(table, lexicon), "bigrams")
    history = exchange(bigrams, lexicon.size, lexicon.end, conf)
    requests = table.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    moved, cells = clustered(table, lexicon, history, requests, conf)
    endings = spark.createDataFrame([(i, int(history[len(lexicon.frequent) + i])) for i in range(conf.endings)], "ending int, start int")
    named = counts.join(moved, "h", "left").join(F.broadcast(endings), "ending").select("h", "c", F.coalesce("cls", "start").alias("cls"))
    named = written(named, "word-classes")
    emits = np.zeros((conf.classes, 2))
    for r in named.groupBy("cls").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():  # a row per class
        emits[r["cls"]] = r["c"], r["v"]
    emits[history[lexicon.end]] += n_ends, n_ends > 0
    alone = (cells.sum(axis=0) + 1) / (cells.sum() + conf.classes)
    follows = np.log10((cells + conf.transition_prior * alone) / (cells.sum(axis=1, keepdims=True) + conf.transition_prior))
    return BrownModel(lexicon, history, follows, emits, n, words + (n_ends > 0), n_ends), named


STREAM = pa.schema([("key", pa.int64()), ("docs", pa.binary()), ("lengths", pa.binary()), ("stream", pa.binary()), ("history", pa.binary()), ("endings", pa.binary())])
SCORES = pa.schema(
    [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
)
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, held_out: int = 2, of: int = 7, conf: BrownConfig = BrownConfig()) -> DataFrame:
    """Scores per row of ``docs`` (doc_id, text), learned from those whose crc32(doc_id) mod ``of`` is not ``held_out``.

    ``base_score`` is the add-one unigram's log10 probability and ``score`` the class
    model's, which is perplexity 10 ** (-score / n_tokens).  A null or blank text is an
    end alone.  A null doc_id is a training row; rows that repeat a doc_id count each.
    Without training rows both models know the unknown word alone.  Other columns are
    ignored.  The documents are read once; everything after works on the written chunks.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (remainder(F.col("doc_id"), of) == held_out).alias("held_out"))
    table = cut(docs, conf)
    model, counts = train(table, docs, conf)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        m = held.value
        for c in cuts(batches):
            history, endings = m.history[m.lexicon.numbers(c)], m.history[c.tails + len(m.lexicon.frequent)]
            yield c.row["key"], c.row["docs"], c.row["lengths"], c.row["stream"], history.astype(np.uint8).tobytes(), endings.astype(np.uint8).tobytes()

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return SCORES.empty_table()
        m = held.value
        n, v = m.n_tokens, m.n_words
        (row,) = left.to_pylist()
        own = pa.ipc.open_stream(row["docs"]).read_all()
        lengths, stream = unpack(row["lengths"]).astype(np.int64), unpack(row["stream"]).astype(np.int64)
        end = m.history[m.lexicon.end]
        history = np.append(np.frombuffer(row["history"], np.uint8).astype(np.int64), end)
        cls = np.append(np.frombuffer(row["endings"], np.uint8).astype(np.int64), end)  # of words that training never saw
        c = np.append(np.zeros(len(cls) - 1), m.n_ends)
        nr = right.column("nr").to_numpy()
        c[nr], cls[nr] = right.column("c").to_numpy(), right.column("cls").to_numpy()
        base = np.log10((c + 1) / (n + (v + 1)))
        a = conf.emission_prior
        emit = np.log10((c + a) / (m.emits[cls, 0] + a * (m.emits[cls, 1] + 1)))
        ends = np.cumsum(lengths)
        flat = np.insert(stream, ends, len(cls) - 1)
        before = np.concatenate([[end], history[flat[:-1]]])
        each = m.follows[before, cls[flat]] + emit[flat]
        starts = ends + np.arange(1, len(ends) + 1) - lengths - 1
        sums = [np.add.reduceat(x, starts) for x in ((c > 0)[flat].astype(np.int64), base[flat], each)]
        columns = [own.column("doc_id").combine_chunks(), own.column("held_out").combine_chunks(), pa.array(lengths + 1), pa.array(sums[0]), pa.array(np.full(len(lengths), n, np.int64)), pa.array(sums[1]), pa.array(sums[2])]
        return pa.Table.from_arrays(columns, schema=SCORES)

    streams = table.mapInArrow(lambda b: batches_of(rows(b), STREAM), "key long, docs binary, lengths binary, stream binary, history binary, endings binary")
    answers = _requests(table).select("h", "key", "nr").join(counts, "h").select("key", "nr", "c", "cls")
    return streams.groupBy("key").cogroup(answers.groupBy("key")).applyInArrow(meet, SCORED)
