"""Tables are spread by their rows, so that a task's share does not grow with the table."""

from merchantry.workloads import exports


def test_pieces_follow_from_the_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(exports, "PIECE_ROWS", 100)
    path = str(tmp_path / "wide.parquet")
    spark.range(5000).selectExpr("id as k", "id % 3 as v").coalesce(1).write.parquet(path)
    df = exports.read_spread(spark, path)
    assert df.rdd.getNumPartitions() >= 50
    assert max(df.rdd.glom().map(len).collect()) <= 200  # a hash deals them, not quite evenly
    assert sorted(r.k for r in df.collect()) == list(range(5000))


def test_many_small_pieces_stay(spark, tmp_path):
    path = str(tmp_path / "even.parquet")
    files = spark.sparkContext.defaultParallelism * 2
    spark.range(0, 10 * files, 1, files).toDF("k").write.parquet(path)
    spark.conf.set("spark.sql.files.openCostInBytes", "128MB")  # a piece per file
    try:
        assert "Exchange" not in exports.read_spread(spark, path)._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_an_empty_table_is_read(spark, tmp_path):
    path = str(tmp_path / "empty.parquet")
    spark.range(0).toDF("k").write.parquet(path)
    assert exports.read_spread(spark, path).collect() == []
