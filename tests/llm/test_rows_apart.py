"""Stages that hand rows on: null and repeated ids, and columns that are named like helpers."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from merchantry.llm import exact, minhash, mixing, toxicity

NAMES = ("_digest", "digest", "_k", "key_id", "_rank", "nth", "_id", "_copies", "row", "copy", "copies", "h", "n")


@pytest.fixture
def odd(spark):
    words = [f"w{i}" for i in range(40)]
    rng = np.random.default_rng(2)
    made = [" ".join(rng.choice(words, 30)) for _ in range(40)]
    rows = [(None if i % 3 == 0 else i // 2, made[i % 30], "abc"[i % 3]) for i in range(120)] + [(None, None, None), (5, "", "a"), (None, "", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for i, name in enumerate(NAMES):
        df = df.withColumn(name, F.lit(i) + F.coalesce("doc_id", F.lit(0)))
    return df


def test_clashing_names_pass_through_every_stage(odd):
    texts = {(r.text or "").strip() for r in odd.collect()}
    for stage in (exact.drop_exact_duplicates, minhash.drop_near_duplicates, mixing.mixed_rows, lambda d: toxicity.drop_toxic(d, toxicity.ToxicModel(np.zeros(0, np.uint64), np.zeros(0), -12.0))):
        got = stage(odd)
        assert got.columns == odd.columns and got.exceptAll(got.intersect(odd)).count() == got.count() - got.distinct().count()
        rows = got.collect()
        assert all(r[name] == i + (r.doc_id or 0) for r in rows for i, name in enumerate(NAMES))
        if stage is exact.drop_exact_duplicates:
            assert sorted((r.text or "").strip() for r in rows) == sorted(texts)


def test_mixed_rows_meet_targets_without_ids(spark):
    rng = np.random.default_rng(4)
    rows = [(None if i % 3 == 0 else i % 7, " ".join(["x"] * int(n)), "abcd"[i % 4]) for i, n in enumerate(rng.integers(1, 80, 400))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    wanted = {r.source_size: r.target for r in mixing.mix_sources(docs).collect()}
    size, largest, taken = Counter(), Counter(), Counter()
    for _, text, source in rows:
        size[source] += len(text.split())
        largest[source] = max(largest[source], len(text.split()))
    got = mixing.mixed_rows(docs).collect()
    for r in got:
        taken[r.source] += len(r.text.split())
    assert all(abs(taken[s] - wanted[size[s]]) <= largest[s] for s in size)
    most = Counter((r.doc_id, r.text, r.source) for r in got)
    there = Counter(map(tuple, rows))
    assert all(n <= 2 * there[k] for k, n in most.items())


def test_mix_ends_near_its_targets(spark):
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(["x"] * int(n)), "abc"[i % 3]) for i, n in enumerate(rng.integers(1, 200, 900))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    off = []
    for seed in range(4):
        mixed = mixing.mix_sources(docs, mixing.MixConfig(seed=seed)).join(docs.select("doc_id", "source"), "doc_id")
        sums = mixed.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()
        off += [abs(r.taken - r.target) for r in sums]
    # the last open document of a source is among its small ones
    assert np.mean(off) < 50 and max(off) <= 200
