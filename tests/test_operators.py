from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import Window as W, functions as F

from merchantry.operators import combine, ranking, scan, touch
from tests.conftest import rows

T0 = datetime(2024, 1, 10, 12)
COMMON = dict(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


@pytest.fixture
def small_ranges(spark):
    """Ranges of a few rows stay apart, as ranges of many do."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_latest_ignores_undated_loads(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, 5, "a"), (1, 7, "b"), (2, None, "only")], "k int, at int, v string")
    assert rows(ranking.latest_per_key(df, ["k"], "at"), "k", "v") == [(1, "b"), (2, "only")]


def test_latest_prunes_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").alias("at"))
    plan = ranking.latest_per_key(df, ["k"], "at")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_top_n(spark):
    df = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 9)], "g string, v int")
    assert rows(ranking.top_n_per_group(df, ["g"], [F.col("v").desc()], 2)) == [("a", 3), ("a", 4), ("b", 9)]


@pytest.mark.usefixtures("small_ranges")
@given(st.lists(st.tuples(st.sampled_from([None, 1, 2]), st.integers(0, 4)), min_size=1, max_size=40))
@settings(**COMMON)
def test_sequence_equals_window(spark, items):
    data = [(i, k, T0 + timedelta(hours=13 * h)) for i, (k, h) in enumerate(items)]
    df = spark.createDataFrame(data, "id int, k int, at timestamp")
    want = df.withColumn("seq", F.row_number().over(W.partitionBy("k").orderBy("at", "id")))
    got = ranking.sequence_per_key(df, ["k"], "at", ["id"], "seq")
    assert rows(got, "id", "seq") == rows(want, "id", "seq")


def hot_rows(spark, one_instant):
    """A third of all rows has one key, and its rows one day, or one instant."""
    at = F.lit(T0) + (F.make_dt_interval(secs=F.lit(0)) if one_instant else F.make_dt_interval(secs=F.col("id")))
    return spark.range(6000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 50).alias("k"), "id", at.alias("at"))


@pytest.mark.parametrize("one_instant", [False, True])
def test_scan_spreads_a_hot_key_and_instant(spark, small_ranges, one_instant):
    df = hot_rows(spark, one_instant)
    want = df.withColumn("seq", F.row_number().over(W.partitionBy("k").orderBy("at", "id")))
    assert rows(ranking.sequence_per_key(df, ["k"], "at", ["id"], "seq"), "id", "seq") == rows(want, "id", "seq")
    laid = scan.sorted_ranges(df, ["k"], [F.col("at"), F.col("id")])
    sizes = [r.n for r in laid.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) == 4 and max(sizes) < 6000 / 4 * 1.5
    # rows that tie in everything are spread too
    same = spark.range(4000).select(F.lit(1).alias("k"), F.lit(T0).alias("at"))
    sizes = [r.n for r in scan.sorted_ranges(same, ["k"], [F.col("at")]).groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) == 4 and max(sizes) < 1500
    assert ranking.sequence_per_key(same, ["k"], "at", [], "seq").select("seq").distinct().count() == 4000


def test_scan_hands_values_over_ranges_of_one_key(spark, small_ranges):
    df = hot_rows(spark, False).withColumn("v", F.when(F.col("id") % 700 == 0, F.col("id")))
    want = df.withColumn("l", F.last("v", ignorenulls=True).over(W.partitionBy("k").orderBy("at", "id").rowsBetween(W.unboundedPreceding, 0)))
    assert rows(scan.last_before(df, ["k"], [F.col("at"), F.col("id")], "v", "l"), "id", "l") == rows(want, "id", "l")
    assert scan.sequence(df.limit(0), ["k"], [F.col("at")], "s").count() == scan.last_before(df.limit(0), ["k"], [F.col("at")], "v", "l").count() == 0


def test_first_mark_per_entity_and_guests(spark):
    df = spark.createDataFrame(
        [(1, 7, T0), (2, 7, T0), (3, None, T0), (4, None, T0 - timedelta(1)), (5, 8, None), (6, 8, T0)],
        "id int, who int, at timestamp",
    )
    got = ranking.mark_first(df, ["who"], "at", ["id"], "first")
    assert rows(got, "id", "first") == [(1, 1), (2, 0), (3, 0), (4, 1), (5, 0), (6, 1)]
    twice = ranking.mark_first(df.unionByName(df), ["who"], "at", ["id"], "first")
    assert rows(twice.filter("first = 1"), "id") == [(1,), (4,), (6,)] and twice.count() == 12


def brute_touch(orders, touches, days):
    out = []
    for oid, who, at in orders:
        fit = [(t, tid, c) for tid, w, t, c in touches if w == who and who is not None and at - timedelta(days) <= t <= at]
        if fit:
            _, tid, c = max(fit)
            out.append((oid, tid, c))
    return sorted(out)


def run_touch(spark, orders, touches, days=5, **kw):
    o = spark.createDataFrame(orders, "oid int, who int, at timestamp")
    t = spark.createDataFrame(touches, "tid int, who int, t_at timestamp, camp string")
    got = touch.last_touch(o, t, ["who"], ["oid"], "at", "t_at", "tid", ["tid", "camp"], days, **kw)
    return sorted(tuple(r) for r in got.select("oid", "tid", "camp").collect())


def test_touch_window_edges(spark):
    orders = [(1, 1, T0)]
    day5 = T0 - timedelta(5)
    assert run_touch(spark, orders, [(1, 1, day5, "a")]) == [(1, 1, "a")]
    assert run_touch(spark, orders, [(1, 1, day5 - timedelta(seconds=1), "a")]) == []
    assert run_touch(spark, orders, [(1, 1, T0, "a")]) == [(1, 1, "a")]
    assert run_touch(spark, orders, [(1, 1, T0 + timedelta(microseconds=1), "a")]) == []
    assert run_touch(spark, orders, [(1, 1, T0, "a"), (2, 1, T0, None)]) == [(1, 2, None)]
    assert run_touch(spark, [(1, None, T0)], [(1, None, T0, "a")]) == []


@given(
    st.lists(st.tuples(st.integers(1, 2), st.integers(0, 200)), min_size=1, max_size=12),
    st.lists(st.tuples(st.integers(1, 2), st.integers(0, 200)), min_size=1, max_size=25),
)
@settings(**COMMON)
def test_touch_equals_brute_force(spark, orders, touches):
    o = [(i, w, T0 + timedelta(hours=h)) for i, (w, h) in enumerate(orders)]
    t = [(i, w, T0 + timedelta(hours=h), f"c{i}") for i, (w, h) in enumerate(touches)]
    assert run_touch(spark, o, t) == brute_touch(o, t, 5)


def test_touch_builds_no_pairs(spark, small_ranges):
    # one profile holds everything: 600 orders and 600 touches in one day
    o = [(i, 1, T0 + timedelta(seconds=2 * i + 1)) for i in range(600)]
    t = [(i, 1, T0 + timedelta(seconds=2 * i), "c") for i in range(600)]
    assert run_touch(spark, o, t) == [(i, i, "c") for i in range(600)]
    # all at one instant: the greatest id wins for every order
    o, t = [(i, 1, T0) for i in range(600)], [(i, 1, T0, "c") for i in range(600)]
    assert run_touch(spark, o, t) == [(i, 599, "c") for i in range(600)]


@given(st.lists(st.tuples(st.integers(1, 4), st.integers(1, 9)), min_size=1, max_size=40), st.sampled_from([2, 512]))
@settings(**COMMON)
def test_pairs_equal_brute_force(spark, items, block):
    df = spark.createDataFrame(items, "g int, p int")
    got = combine.pairs_within(df, ["g"], "p", [], block=block)
    want = {}
    sets = {}
    for g, p in items:
        sets.setdefault(g, set()).add(p)
    for ps in sets.values():
        for a in ps:
            for b in ps:
                if a < b:
                    want[(a, b)] = want.get((a, b), 0) + 1
    assert {(r.p_a, r.p_b): r.together for r in got.collect()} == want


def test_pairs_of_one_huge_group(spark):
    df = spark.range(300).select(F.lit(1).alias("g"), F.col("id").alias("p"))
    got = combine.pairs_within(df.unionByName(df), ["g"], "p", [], block=32)
    assert got.count() == 300 * 299 // 2 and got.filter("together <> 1").count() == 0


def test_spine_keeps_every_key(spark):
    a = spark.createDataFrame([(1, 2.0), (2, None)], "k int, x double")
    b = spark.createDataFrame([(2, 5), (3, 7)], "k int, y int")
    got = combine.spine_join({"a": a, "b": b}, ["k"], ["x"])
    assert rows(got, "k", "x", "y") == [(1, 2.0, None), (2, 0.0, 5), (3, 0.0, 7)]


def test_share_sums_to_one(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "k string, v double")
    got = combine.share_of_total(df, "v", "s")
    assert rows(got, "k", "s") == [("a", 0.25), ("b", 0.75)]
    nothing = combine.share_of_total(df.withColumn("v", F.lit(0.0)), "v", "s")
    assert rows(nothing, "s") == [(None,), (None,)]


def test_share_groups_once(spark, small):
    orders = spark.read.parquet(f"{small}/orders.parquet")
    grouped = orders.groupBy("o_orderpriority").agg(F.sum("o_totalprice").alias("v"), F.count(F.lit(1)).alias("n"))
    shares = combine.share_of_total(grouped, "v", "s")
    assert abs(sum(r.s for r in shares.collect()) - 1) < 1e-9
    assert "ReusedExchange" in shares._jdf.queryExecution().executedPlan().toString()


def test_flatten_inner_outer_and_sums(spark):
    df = spark.createDataFrame([(1, [("p", "2.5"), ("q", "1"), ("p", None)]), (2, []), (3, None)], "id int, a array<struct<k: string, v: string>>")
    assert combine.flatten(df, "a", "e").count() == 3
    assert combine.flatten(df, "a", "e", outer=True).count() == 5
    total = combine.sum_elements(F.col("a"), lambda e: e.k == "p", lambda e: e.v.try_cast("double"))
    assert rows(df.select("id", total)) == [(1, 2.5), (2, 0.0), (3, 0.0)]
    assert rows(df.select("id", combine.any_element(F.col("a"), lambda e: e.k == "q"))) == [(1, True), (2, False), (3, False)]


def test_tenant_filter_removes_branches(spark, small):
    orders = spark.read.parquet(f"{small}/orders.parquet")
    both = combine.union_tenants({"a": orders, "b": orders}, lambda d: d.select("o_orderkey"))
    plan = both.filter("store_id = 'a'")._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan


@pytest.mark.parametrize("name", ["_touch", "_order"])
def test_reserved_names_are_refused(spark, name):
    df = spark.createDataFrame([(1, T0)], f"{name} int, at timestamp")
    with pytest.raises(ValueError):
        touch.last_touch(df, df, [name], [name], "at", "at", name, [])
