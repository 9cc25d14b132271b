"""The class model against its definition, counted plainly from the training texts."""

import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from merchantry.llm import brown
from merchantry.llm.common import remainder

CONF = brown.BrownConfig(classes=7, frequent=0.02, endings=16, least=3, moves=4)


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(6)
    left, right = [f"l{i}x" for i in range(25)], [f"r{i}y" for i in range(25)]
    rows = [(i, " ".join(rng.choice(left if j % 2 else right) for j in range(int(rng.integers(0, 40))))) for i in range(150)]
    return rows + [(None, "l1x r2y Rare1"), (None, None), (7, "once r1y l1x"), (9, "")]


def test_scores_equal_the_definition(spark, corpus):
    docs = spark.createDataFrame(corpus, "doc_id long, text string")
    marked = docs.withColumn("held_out", remainder(F.col("doc_id"), 7) == 2)
    table = brown.cut(marked, CONF)
    model, named = brown.train(table, marked, CONF)
    count = {r.h: r.c for r in named.collect()}
    cls = {r.h: r.cls for r in named.collect()}
    hashed = lambda w: int(np.uint64(xxhash.xxh64_intdigest(w)).view(np.int64))
    words = lambda t: (t or "").encode().lower().split()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    train = [words(t) for i, t in corpus if not held(i)]
    c = Counter(w for t in train for w in t)
    assert count == {hashed(w): n for w, n in c.items()}
    place = {int(h): i for i, h in enumerate(model.lexicon.frequent)}
    ending = lambda w: model.history[len(place) + brown.ending(w, CONF.endings)]
    history = lambda w: model.history[place[xxhash.xxh64_intdigest(w)]] if xxhash.xxh64_intdigest(w) in place else ending(w)
    of = lambda w: 0 if w is None else cls[hashed(w)] if w in c else ending(w)
    assert len(place) > 3 and all(cls[hashed(w)] == ending(w) for w in c if c[w] < CONF.least)

    cells = np.zeros((CONF.classes, CONF.classes))
    for t in train:
        for a, b in zip([None, *t], [*t, None], strict=True):
            cells[0 if a is None else history(a), of(b)] += 1
    tokens, distinct = Counter(), Counter()
    for w, n in [*c.items(), (None, len(train))]:
        tokens[of(w)] += n
        distinct[of(w)] += 1
    alone = (cells.sum(axis=0) + 1) / (cells.sum() + CONF.classes)
    got = Counter((r.doc_id, r.n_tokens, round(r.score, 6)) for r in brown.score(docs, conf=CONF).collect())
    want = Counter()
    for i, text in corpus:
        total, before = 0.0, 0
        for w in [*words(text), None]:
            k, n = of(w), len(train) if w is None else c[w]
            follows = (cells[before, k] + CONF.transition_prior * alone[k]) / (cells[before].sum() + CONF.transition_prior)
            total += np.log10(follows * (n + CONF.emission_prior) / (tokens[k] + CONF.emission_prior * (distinct[k] + 1)))
            before = 0 if w is None else history(w)
        want[i, len(words(text)) + 1, round(total, 6)] += 1
    assert got == want


def test_every_word_held_often_enough_is_clustered(spark, corpus):
    marked = spark.createDataFrame(corpus, "doc_id long, text string").withColumn("held_out", F.lit(False))
    table = brown.cut(marked, CONF)
    c = Counter(w for _, t in corpus for w in (t or "").encode().lower().split())
    lexicon = brown.Lexicon(np.zeros(0, np.uint64), CONF.endings)
    history = 1 + np.arange(lexicon.size) % (CONF.classes - 1)
    history[lexicon.end] = 0
    for least in (1, 3, 30):
        conf = brown.BrownConfig(classes=7, endings=16, least=least, moves=2)
        found, cells = brown.clustered(table, lexicon, history, 100, conf)
        assert {r.h for r in found.collect()} == {int(np.uint64(xxhash.xxh64_intdigest(w)).view(np.int64)) for w, n in c.items() if n >= least}
        assert cells.sum() == sum(c.values()) + len(corpus)


def test_a_move_raises_the_likelihood():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 9, (40, 6)).astype(float)
    c, cls = x.sum(axis=1), rng.integers(1, 6, 40)

    def likelihood(cls):
        cells = np.zeros((6, 6))
        np.add.at(cells.T, cls, x)
        mass = cells.sum(axis=0)
        return (cells * np.log(np.maximum(cells, 1))).sum() - (mass * np.log(np.maximum(mass, 1))).sum()

    cells = np.zeros((6, 6))
    np.add.at(cells.T, cls, x)
    gained = 0
    for w in range(40):
        new = brown.best_classes(x[w : w + 1], c[w : w + 1], cls[w : w + 1], cells)[0]
        if new != cls[w]:
            moved = cls.copy()
            moved[w] = new
            gained += likelihood(moved) >= likelihood(cls) - 0.5
    assert gained >= 0.9 * sum(brown.best_classes(x, c, cls, cells) != cls) > 0
