"""The search for files with foreign keys sorts numbers, not paths."""

from merchantry.sources import purge


def test_files_are_found_by_numbers(spark, tmp_path):
    root = str(tmp_path / "own")
    for i, keys in enumerate(([1, 1, 2], [3, None], [2, 9], [4])):
        spark.createDataFrame([(k, "x" * 50) for k in keys], "id long, v string").coalesce(1).write.parquet(f"{root}/part={i}")
    rows = spark.read.parquet(root)
    assert purge.marked(rows, "id").dtypes == [("key", "bigint"), ("file", "bigint")]
    foreign = spark.createDataFrame([(2,), (4,), (7,)], "key long")
    found = purge.files_with(rows, "id", foreign)
    assert sorted(f.rpartition("/part=")[2][0] for f in found) == ["0", "2", "3"]
    assert len(found) == len({*found}) and purge.files_with(rows, "id", foreign.where("key > 7")) == []
