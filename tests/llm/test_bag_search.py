import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from merchantry.llm import bagsearch

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, most=50):
    found = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, all_terms = sum(bool(c) for _, c in found), sum(c.total() for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item, asked in {(i, frozenset(terms(t))) for i, t in items}:
        scored = []
        for doc, c in found:
            m = 50 + 50 * c.total() * n_docs // max(1, all_terms)
            weight = lambda t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
            score = sum(weight(t) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in asked if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, k, s[3], -s[0]) for k, s in enumerate(sorted(scored)[:most], 1)]
    return sorted(out, key=str)


def searched(spark, docs, items, conf=bagsearch.SearchConfig(), **more):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({k: F.lit(v) for k, v in more.items()})
    q = spark.createDataFrame(items, "item_id long, text string").withColumns({k: F.lit(v) for k, v in more.items()})
    return sorted(map(tuple, bagsearch.search(d, q, conf).collect()), key=str)


def made(seed, n):
    rng = random.Random(seed)
    words = ["the", "The", "cat", "Dog", "été", "ÉTÉ", "x1", "42", "naïve", "K", "日本", "b c", "_", "--", "a.b", "\x85"] + [f"w{i}" for i in range(30)]
    return " ".join(rng.choices(words, k=n))


DOCS = [(i, made(i % 90, i % 40)) for i in range(300)] + [
    (None, made(3, 30)), (None, made(3, 30)), (7, made(5, 25)), (7, made(5, 25)), (400, None), (401, ""), (402, " .;- "), (403, made(1, 20000)), (-1, "the cat the cat"),
]
ITEMS = [(1, "the cat w1 w2 w3"), (1, "the cat w1 w2 w3"), (1, "dog été"), (2, "ÉTÉ 42 x1 naïve K"), (3, None), (4, "..."), (5, "nowhere"), (None, "日本 c w4 W4"), (6, made(8, 300))]


@pytest.mark.parametrize("conf", [bagsearch.SearchConfig(), bagsearch.SearchConfig(results=3, most_terms=20, dense=2, cells=16)])
def test_search_equals_brute_force(spark, conf):
    got = searched(spark, DOCS, ITEMS, conf, bag=1, n="x", m=2, item="y", rank=0, **{"class": 1})
    assert got == brute(DOCS, ITEMS, conf.results) and len(got) > 10


def test_equal_bags_expand_in_order_of_ids(spark):
    docs = [(i, "copy of a page") for i in range(200, 0, -1)] + [(i, f"other {i}") for i in range(1000, 1400)]
    got = searched(spark, docs, [(9, "copy page")])
    assert got == brute(docs, [(9, "copy page")]) and sorted(r[2] for r in got) == list(range(1, 51))


def test_empty_tables(spark):
    assert searched(spark, [], ITEMS) == searched(spark, DOCS, []) == searched(spark, [], []) == searched(spark, [(1, None)], ITEMS) == []


def test_large_scores_stay_whole():
    import numpy as np

    weights = np.array([50_000] * 200_000)
    scorer = bagsearch.Scorer([np.arange(200_000)], weights, bagsearch.SearchConfig())
    row = np.zeros(200_000, np.int64)
    got = scorer.scores(row, np.arange(200_000), np.full(200_000, 999), np.array([50]))
    assert got[0, 0] == 200_000 * 50_000 * (10**9 * 999 // (999_000 + 1000))
