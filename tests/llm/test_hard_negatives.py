import math

import pytest
from pyspark.sql import functions as F

from merchantry.llm import segments

CONF = segments.MineConfig(row_block=16, anchor_block=4)


def brute(rows, conf=CONF, every=50):
    """The definition, one pair at a time."""
    taking = {}
    for vec_id, vector, label in rows:
        if label is not None and vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            taking[vec_id, label, tuple(vector)] = [math.floor(conf.scale * x) for x in vector]
    out = []
    for (anchor, own, _), a in taking.items():
        if anchor is None or anchor % every:
            continue
        scored = [(-sum(x * y for x, y in zip(a, v, strict=False)), i is None, i or 0, label, i) for (i, label, _), v in taking.items()]
        positives = sorted(s for s in scored if s[3] == own and s[4] != anchor)[: conf.positives]
        for p in positives:
            near = sorted(s for s in scored if s[3] != own and conf.low * -p[0] <= 100 * -s[0] <= conf.high * -p[0])
            out += [(anchor, p[4], k, n[4], -p[0], -n[0]) for k, n in enumerate(near[: conf.negatives], 1)]
    return sorted(out, key=str)


def mined(spark, rows, conf=CONF):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return sorted(map(tuple, segments.hard_negatives(df, F.col("vec_id") % 50 == 0, conf).collect()), key=str)


def test_hard_negatives_equal_brute_force(spark, small):
    data = [tuple(r) for r in spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = mined(spark, data)
    assert got == brute(data) and len(got) > 50


def test_nulls_ties_repeats_and_odd_lengths(spark):
    base = [(50 * i, [1.0, 0.5, 0.25 * i, 0.0, 0.125], i % 2) for i in range(4)]
    near = [(i + 1, [0.75, 0.5, 0.25, 0.0], i % 3) for i in range(40)]  # equal scores: ids decide
    odd = [
        (None, [0.75, 0.5, 0.25, 0.0], 0), (None, [0.7, 0.5], 1), (201, None, 1), (202, [1.0], None), (203, [1.0, None], 0),
        (204, [float("nan"), 1.0], 0), (205, [float("inf")], 0), (206, [], 0), (250, [], 1),
    ]
    data = base + near + odd
    assert mined(spark, data + data) == mined(spark, data) == brute(data) != []


def test_large_numbers_are_exact(spark):
    data = [(50, [1e7, 1e7], 0), (1, [1e7, 1.0], 0), (2, [6e6, 0.5], 1), (3, [9.4e6, 3.0], 1), (4, [9.6e6, 0.0], 1), (5, [3e9, 1.0], 2)]
    assert mined(spark, data) == brute(data) != []


def test_no_rows_and_clashing_names(spark):
    assert mined(spark, []) == []
    data = [(50 * i, [1.0 - i / 8, 0.25], i % 2) for i in range(8)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")
    for name in ("_block", "block", "anchors", "rank", "ids"):
        df = df.withColumn(name, F.lit("x"))
    assert sorted(map(tuple, segments.hard_negatives(df, F.col("vec_id") % 50 == 0, CONF).collect()), key=str) == brute(data) != []


@pytest.mark.parametrize("dims", [1, 3, 64, 70])
def test_bounds_hold_on_every_level(dims):
    import numpy as np

    rng = np.random.default_rng(dims)
    numbers = rng.integers(-300, 300, (50, dims))
    m, d = segments.summaries(numbers, CONF.leaf)
    row = {
        "ids": list(range(50)), "labels": np.zeros(50, "<i8").tobytes(), "dims": dims, "kind": "<i2", "vectors": numbers.astype("<i2").tobytes(),
        "means": m.astype("<f4").tobytes(), "deviations": d.astype("<f4").tobytes(),
    }
    block = segments.Block(row, CONF, dims)
    known, widths = segments.Bounds(block, block, 0), []
    for level in range(known.n_levels):
        middle, width = known.of(level, 7)
        exact = numbers @ numbers[7]
        assert (np.abs(exact - middle) <= width).all()
        widths.append(width.mean())
    assert widths == sorted(widths, reverse=True)
