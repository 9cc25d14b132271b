import os
import subprocess
import sys
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from merchantry.operators import ranking
from merchantry.session import shared_folder
from merchantry.sources import audit, loads, purge, sinks
from merchantry.sources.catalog import Catalog
from merchantry.streaming import jobs
from merchantry.streaming.tables import KEPT, Hashed, Levelled
from tests.conftest import rows

T0 = datetime(2024, 1, 1)


def landed(spark, *hours):
    data = [(i, T0 + timedelta(hours=h)) for i, h in enumerate(hours)]
    return spark.createDataFrame(data, "id int, at timestamp")


def test_catalog_paths_and_aliases(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/shop_alpha/ORDERS_123")
    catalog = Catalog(spark, str(tmp_path), aliases={("shop", "orders", "alpha"): "ORDERS_123"})
    assert catalog.source("shop", "orders", "alpha").count() == 3
    assert catalog.has("shop", "orders", "alpha") and not catalog.has("shop", "orders", "beta")
    with pytest.raises(KeyError):
        Catalog(spark).source("shop", "orders")
    made = Catalog(spark, frames={("a", "b", None): lambda: spark.range(2)})
    assert made.source("a", "b").count() == 2 and made.source("a", "b") is made.source("a", "b")


def test_incremental_append_takes_each_row_once(spark, tmp_path):
    path = f"{tmp_path}/t"
    with pytest.raises(FileNotFoundError):
        loads.read_increments(spark, path)
    old = spark.createDataFrame([(9, datetime(2019, 1, 1)), (8, None), (8, None)], "id int, at timestamp")
    late = spark.createDataFrame([(20, T0 + timedelta(hours=2)), (1, T0 + timedelta(hours=2)), (7, None), (8, None)], "id int, at timestamp")
    first = landed(spark, 1, 2).unionByName(old)
    want = [(0,), (1,), (8,), (8,)]
    for part, more in ((first, []), (first, []), (first.unionByName(late), [(20,), (1,), (7,), (8,)]), (first.unionByName(late).unionByName(landed(spark, 1, 2, 2, 5)), [(2,), (3,), (1,)])):
        loads.append_increment(part, path, "at")
        want = sorted(want + more, key=str)
        assert rows(loads.read_increments(spark, path), "id") == want
    loads.append_increment(landed(spark, 1).limit(0), path, "at")
    assert rows(loads.read_increments(spark, path), "id") == want


def test_an_increment_does_not_scan_its_target(spark, tmp_path):
    path = f"{tmp_path}/t"
    for hour in range(1, 8):
        loads.append_increment(landed(spark, *range(1, hour + 1)), path, "at")
    assert loads.read_increments(spark, path).count() == 7
    state = Levelled(spark, path).state()
    assert state.mark.startswith("2024-01-01 07") and len([r for r in state.runs if r.level >= 0]) <= 4


def test_full_refresh_swaps_whole_versions(spark, tmp_path):
    root = f"{tmp_path}/t"
    with pytest.raises(FileNotFoundError):
        loads.read_current(spark, root)
    loads.full_refresh(spark.range(3), root, "1")
    loads.full_refresh(spark.range(5), root, "2")
    spark.range(9).write.parquet(f"{root}/version=3")
    (tmp_path / "t" / "version=3" / "_SUCCESS").unlink()  # a write that did not finish
    assert loads.read_current(spark, root).count() == 5


def test_versions_are_ordered_by_number(spark, tmp_path):
    root = str(tmp_path / "t")
    for n in (9, 10):
        loads.full_refresh(spark.range(n), root, str(n))
    assert loads.read_current(spark, root).count() == 10


def test_load_health(spark):
    tables = {"fresh": (landed(spark, 1), "at"), "old": (landed(spark, -90), "at"), "none": (landed(spark, 1).limit(0), "at")}
    got = loads.load_health(tables, F.lit("2024-01-02 00:00:00"))
    assert rows(got, "table_name", "row_count", "status") == [("fresh", 1, "ok"), ("none", 0, "empty"), ("old", 1, "stale")]


def test_health_of_every_raw_table(spark, tmp_path):
    from merchantry.plans.warehouse import Warehouse

    loaded = spark.createDataFrame([(1, T0)], "id int, _airbyte_extracted_at timestamp")
    loaded.write.parquet(f"{tmp_path}/shop_alpha/ORDERS_2")
    loaded.limit(0).write.parquet(f"{tmp_path}/crm/leads")
    catalog = Catalog(spark, str(tmp_path), aliases={("shop", "orders", "alpha"): "ORDERS_2"}, frames={("web", "visits", None): lambda: spark.range(2)})
    assert catalog.tables() == [("crm", "leads", None), ("shop", "orders", "alpha"), ("web", "visits", None)]
    got = Warehouse(spark, catalog).health(F.lit("2024-01-02 00:00:00"))
    assert rows(got, "table_name", "row_count", "status") == [("crm.leads", 0, "empty"), ("shop_alpha.orders", 1, "ok"), ("web.visits", 2, "stale")]


def test_audit_and_purge(spark):
    cols = "id int, created_at string"
    own = spark.createDataFrame([(1, "2024-01-01T23:00:00-05:00"), (2, "2024-02-01T00:00:00Z"), (2, "2024-02-01T00:00:00Z"), (None, None)], cols)
    other = spark.createDataFrame([(2, "2024-03-01T00:00:00Z"), (None, None)], cols)
    got = dict(rows(audit.contamination_audit(own, other, "own", "other")))
    assert got == {
        "overlapping_order_ids": "2", "own_earliest": "2024-01-01", "own_latest": "2024-02-01", "own_count": "4",
        "other_earliest": "2024-03-01", "other_latest": "2024-03-01", "other_count": "2",
    }
    assert rows(audit.purge(own, other), "id") == [(1,), (None,)]


def test_purge_writes_only_files_with_foreign_rows_again(spark, tmp_path):
    own, target = {}, f"{tmp_path}/purged"
    for name in purge.RULES:
        key = purge.RULES[name].key
        df = spark.range(40).select(F.when(F.col("id") != 39, F.col("id")).alias(key), F.lit(name).alias("of"))
        df.repartitionByRange(4, key).write.parquet(f"{tmp_path}/{name}")
        own[name] = f"{tmp_path}/{name}"
    other = {name: spark.createDataFrame([(k,) for k in ids] + [(None,)], "id long") for name, ids in (("orders", [3, 4, 900]), ("customers", []), ("products", range(40)), ("product_variants", [0, 38]))}
    assert purge.purge_store(spark, own, other, target) == {"orders": 1, "customers": 0, "order_line_items": 1, "products": 4, "product_variants": 2}
    schema = {name: spark.read.parquet(path).schema for name, path in own.items()}
    left = {name: sorted((r[0] for r in purge.read_purged(spark, target, name, schema[name]).collect()), key=str) for name in own}
    keys = lambda gone: sorted([*({*range(39)} - {*gone}), None], key=str)
    assert left == {"orders": keys([3, 4]), "customers": keys([]), "order_line_items": keys([3, 4]), "products": keys(range(39)), "product_variants": keys([0, 38])}
    files = lambda name: {*purge.read_purged(spark, target, name, schema[name]).inputFiles()}
    assert len(files("orders") & {*spark.read.parquet(own["orders"]).inputFiles()}) == 3
    # the next purge goes on from there
    other["orders"] = spark.createDataFrame([(10,)], "id long")
    assert purge.purge_store(spark, own, other, target)["orders"] == 1
    assert purge.read_purged(spark, target, "orders", schema["orders"]).count() == 37
    assert spark.read.parquet(own["orders"]).count() == 40


def test_sinks(spark, tmp_path):
    df = spark.range(6).select("id", (F.col("id") % 2).alias("m"))
    sinks.write_table(df, f"{tmp_path}/t", ("m",))
    assert spark.read.parquet(f"{tmp_path}/t").filter("m = 1").count() == 3
    assert sinks.database_name(" gold ", "main") == "GOLD" and sinks.database_name(None, "main") == "main"
    sinks.register_views(spark, {"some_view": df})
    assert spark.sql("select count(*) from some_view").collect()[0][0] == 6


def test_shared_folder_follows_the_session(spark):
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    first, second = shared_folder(spark, "x"), shared_folder(spark, "x")
    assert first.startswith(root) and first != second


def test_scratch_folders_go_when_the_program_ends(tmp_path):
    program = f"""
from merchantry.session import build_session, shared_folder
spark = build_session("t", "local[1]", **{{"spark.ui.enabled": "false", "spark.checkpoint.dir": "{tmp_path}/shared"}})
spark.range(3).write.parquet(shared_folder(spark, "x"))
import os
print("there", os.listdir("{tmp_path}/shared"))
spark.stop()
"""
    ran = subprocess.run([sys.executable, "-c", program], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(__file__)), timeout=120)
    assert "'run-" in ran.stdout, ran.stderr[-2000:]
    assert not [f for f in os.listdir(tmp_path / "shared") if f.startswith("run-")]


def test_a_cluster_must_name_its_shared_folder():
    class Cluster:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="checkpoint"):
        shared_folder(Cluster, "x")


def finish(writer):
    query = writer.start()
    query.awaitTermination()


def event_files(spark, folder, *batches):
    schema = "id int, who int, kind string, at timestamp, v double"
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.read.parquet(folder).schema


BATCHES = (
    [(1, 1, "view", T0, 1.0), (2, 1, "buy", T0 + timedelta(hours=1), 5.0), (3, 2, "view", T0 + timedelta(hours=2), 1.0)],
    [(4, 2, "buy", T0 + timedelta(days=1), 7.0), (5, 1, "view", T0 + timedelta(days=1), 1.0)],
    [(6, 1, "buy", T0 + timedelta(days=2), 9.0), (7, 1, "view", T0 + timedelta(hours=3), 1.0)],
)


@pytest.fixture
def event_stream(spark, tmp_path):
    folder = f"{tmp_path}/events"
    schema = event_files(spark, folder, *BATCHES)
    return folder, jobs.read_files(spark, folder, schema, files_per_batch=1)


def test_stream_append_is_incremental(spark, tmp_path, event_stream):
    folder, stream = event_stream
    target, progress = f"{tmp_path}/out", f"{tmp_path}/progress"
    finish(jobs.append_files(stream, target, progress))
    event_files(spark, folder, [(8, 3, "view", T0, 0.0)])
    finish(jobs.append_files(stream, target, progress))
    assert rows(spark.read.parquet(target), "id") == [(i,) for i in range(1, 9)]


def test_stream_latest_equals_batch(spark, tmp_path, event_stream):
    folder, stream = event_stream
    finish(jobs.latest_per_key(stream, ["who", "kind"], "at", ["id"], f"{tmp_path}/out", f"{tmp_path}/progress", 4))
    batch = ranking.latest_per_key(spark.read.parquet(folder), ["who", "kind"], "at", [F.col("id").desc()])
    assert rows(jobs.read_latest(spark, f"{tmp_path}/out"), "who", "kind", "id") == rows(batch, "who", "kind", "id")


def test_stream_latest_after_a_lost_checkpoint(spark, tmp_path):
    target = f"{tmp_path}/out"
    schema = event_files(spark, f"{tmp_path}/old", [(1, 1, "buy", T0, 1.0)], [(2, 1, "buy", T0 + timedelta(hours=1), 1.0), (3, 2, "buy", T0, 1.0)])
    event_files(spark, f"{tmp_path}/new", [(4, 1, "buy", T0 + timedelta(hours=2), 1.0)])
    for folder, progress in (("old", "first"), ("new", "second")):
        stream = jobs.read_files(spark, f"{tmp_path}/{folder}", schema, files_per_batch=1)
        finish(jobs.latest_per_key(stream, ["who"], "at", ["id"], target, f"{tmp_path}/{progress}", 4))
    assert rows(jobs.read_latest(spark, target), "who", "id") == [(1, 4), (2, 3)]


def counted(df):
    return df.groupBy(F.to_date("at").alias("day"), "kind").agg(F.count(F.lit(1)).alias("n"))


def test_stream_daily_counts_equal_batch(spark, tmp_path, event_stream):
    folder, stream = event_stream
    event_files(spark, folder, [(9, 1, "view", None, 0.0), (9, 1, None, T0, 0.0)])
    finish(jobs.daily_counts(stream, "at", ["kind"], f"{tmp_path}/out", f"{tmp_path}/progress", fan=2))
    got = jobs.read_daily_counts(spark, f"{tmp_path}/out", ["kind"])
    assert rows(got, "day", "kind", "n") == rows(counted(spark.read.parquet(folder)), "day", "kind", "n")
    # without its checkpoint the stream sends all again, which counts once
    finish(jobs.daily_counts(stream, "at", ["kind"], f"{tmp_path}/out", f"{tmp_path}/other", fan=2))
    got = jobs.read_daily_counts(spark, f"{tmp_path}/out", ["kind"])
    assert rows(got, "day", "kind", "n") == rows(counted(spark.read.parquet(folder)), "day", "kind", "n")


def test_levels_grow_with_the_logarithm_of_the_batches(spark, tmp_path):
    table = Levelled(spark, f"{tmp_path}/t", lambda df: df.groupBy("k").agg(F.sum("n").alias("n")), fan=2)
    for batch in range(11):
        table.add(spark.createDataFrame([("a", 1), (None, 1)], "k string, n long"), 0, batch)
        table.add(spark.createDataFrame([("a", 50)], "k string, n long"), 0, batch)  # sent again after its commit: passed over
    state = table.state()
    assert sorted(r.level for r in state.runs) == [0, 1, 3]  # 11 = 1 + 2 + 8
    assert rows(table.rows(), "k", "n") == [("a", 11), (None, 11)]
    assert len(list((tmp_path / "t" / "manifest").glob("*.json"))) == KEPT
    named = {r.name for r in state.runs}
    assert named <= {p.name for p in (tmp_path / "t" / "runs").iterdir()} and len(list((tmp_path / "t" / "runs").iterdir())) <= 3 * KEPT


def test_leaves_split_and_old_runs_go(spark, tmp_path):
    table = Hashed(spark, f"{tmp_path}/t", ["k"], leaf_rows=20)
    newest = lambda df: ranking.latest_per_key(df, ["k"], "at")
    for batch in range(6):
        made = [(k, batch) for k in range(batch * 7, batch * 7 + 40)] + [(None, batch)]
        table.put(spark.createDataFrame(made, "k long, at long"), newest, 0, batch)
    want = {k: max(b for b in range(6) if b * 7 <= k < b * 7 + 40) for k in range(75)} | {None: 5}
    assert dict(map(tuple, table.rows().collect())) == want
    state = table.state()
    assert sum(r.rows for r in state.runs) == 76 and max(r.rows for r in state.runs) <= 20 and len(state.runs) >= 4
    # only the leaf of the one key is written again
    table.put(spark.createDataFrame([(3, 99)], "k long, at long"), newest, 0, 6)
    assert len({*table.state().runs} - {*state.runs}) == 1
    table.put(spark.createDataFrame([], "k long, at long"), newest, 0, 7)
    assert dict(map(tuple, table.rows().collect())) == want | {3: 99}
    folders = {p.name for p in (tmp_path / "t" / "runs").iterdir()}
    assert {r.name.partition("/")[0] for r in table.state().runs} <= folders and "run=0-0-0" not in folders


def test_a_batch_that_died_before_its_commit_is_written_again(spark, tmp_path):
    table = Hashed(spark, f"{tmp_path}/t", ["k"])
    keep = lambda df: ranking.latest_per_key(df, ["k"], "at")
    table.put(spark.createDataFrame([(1, 1)], "k long, at long"), keep, 0, 0)
    (tmp_path / "t" / "runs" / "run=0-1-0" / "_leaf=1").mkdir(parents=True)
    spark.createDataFrame([(9, 9)], "k long, at long").write.mode("append").parquet(f"{tmp_path}/t/runs/run=0-1-0/_leaf=1")
    assert rows(table.rows()) == [(1, 1)]
    table.put(spark.createDataFrame([(2, 2)], "k long, at long"), keep, 0, 1)
    assert rows(table.rows()) == [(1, 1), (2, 2)]
    with pytest.raises(FileNotFoundError):
        Hashed(spark, f"{tmp_path}/none", ["k"]).rows()


def test_stream_first_per_order(spark, tmp_path):
    folder, target = f"{tmp_path}/events", f"{tmp_path}/out"
    late = [
        [(1, 1, "buy", T0, 1.0), (1, 1, "buy", T0 + timedelta(seconds=2), 2.0), (None, 7, "buy", T0, 1.0)],
        [(1, 1, "buy", T0 - timedelta(days=50), 3.0), (2, 1, "buy", T0 + timedelta(days=40), 1.0), (None, 7, "buy", T0, 1.0)],
        [(3, 1, "buy", T0 - timedelta(days=40), 1.0), (2, 1, "buy", T0, 9.0), (4, 2, "buy", None, 1.0)],
        [(i, 1, "buy", T0, 1.0) for i in range(1, 60)] + [(None, 8, "buy", None, 1.0)],
        [(i, 1, "buy", T0, 2.0) for i in range(1, 70)],
    ]
    schema = event_files(spark, folder, *late)
    stream = jobs.read_files(spark, folder, schema, files_per_batch=1)
    finish(jobs.first_per_order(stream, "at", ["id"], target, f"{tmp_path}/p", leaf_rows=16))
    got = jobs.read_first(spark, target)
    assert rows(got.where("id is not null"), "id") == sorted([(i,) for i in range(1, 70)], key=str)
    assert rows(got.where("id <= 4"), "id", "v") == [(1, 1.0), (2, 1.0), (3, 1.0), (4, 1.0)]
    assert rows(got.where("id is null"), "who") == [(7,), (7,), (8,)]
    state = Hashed(spark, target, ["id"]).state()
    assert len({r.leaf for r in state.runs}) > 2 and all(len([r for r in state.runs if r.leaf == leaf]) <= 5 for leaf in {r.leaf for r in state.runs})


@pytest.mark.parametrize("order", [(0, 1, 2, 3), (3, 2, 1, 0), (2, 0, 3, 1)])
def test_stream_attribution_equals_batch_in_any_order(spark, tmp_path, order):
    from merchantry.operators.touch import last_touch

    day = lambda d, h=0: T0 + timedelta(days=d, hours=h)
    batches = [
        [(1, 1, "view", T0, 1.0), (2, 1, "buy", day(0, 1), 5.0), (3, 2, "view", day(0, 2), 1.0), (11, None, "buy", T0, 1.0)],
        [(4, 2, "buy", day(1), 7.0), (5, 1, "view", day(1), 1.0), (8, 3, "buy", day(9), 1.0), (12, 3, "view", None, 1.0)],
        [(6, 1, "buy", day(2), 9.0), (7, 1, "view", day(0, 3), 1.0), (9, 3, "view", day(4), 1.0)],
        [(10, 1, "view", day(1, 23), 1.0), (13, 4, "buy", day(5, 1), 1.0), (14, 4, "view", day(0, 1), 1.0), (15, 4, "view", day(0, 0), 1.0)],
    ]
    folder = f"{tmp_path}/events"
    schema = event_files(spark, folder, *[batches[i] for i in order])
    stream = jobs.read_files(spark, folder, schema, files_per_batch=1)
    bought = F.col("kind") == "buy"
    finish(jobs.attribute_orders(stream, bought, ["who"], ["id"], "at", "id", {"tid": "id"}, f"{tmp_path}/out", f"{tmp_path}/progress", leaf_rows=2))
    landed = spark.read.parquet(folder)
    touches = landed.where(~bought).select("who", F.col("at").alias("t_at"), F.col("id").alias("tid"))
    batch = last_touch(landed.where(bought), touches, ["who"], ["id"], "at", "t_at", "tid", ["tid"])
    got = jobs.read_credits(spark, f"{tmp_path}/out")
    assert rows(got, "id", "tid", "touch_at") == rows(batch, "id", "tid", "touch_at")
    assert rows(got, "id", "tid") == [(13, 14), (2, 1), (4, 3), (6, 10), (8, 9)]
