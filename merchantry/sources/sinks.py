"""Writing tables and views."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from merchantry.session import shared_folder

# Fixed name: where it is set, Spark deletes an execution's shuffle files when the execution ends.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def moves_freed(spark: SparkSession) -> Iterator[None]:
    """What a write in this block shuffled leaves the disk when the write ends, not when the driver collects its garbage."""
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREED)
        else:
            spark.conf.set(FREED, before)


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), mode: str = "overwrite") -> None:
    """Write a parquet table, compressed by zstd: wide facts are written once and scanned by few.

    What was shuffled for it is freed.  With partition columns the rows are first rebalanced on them: files get an
    even size, a large month is split over several, small ones are not scattered.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.mode(mode).option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with moves_freed(df.sparkSession):
        writer.parquet(path)


def scratch(df: DataFrame, purpose: str) -> DataFrame:
    """The rows, written in the shared folder and read from there: computed once, and safe from lost executors."""
    path = shared_folder(df.sparkSession, purpose)
    write_table(df, path, mode="errorifexists")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def database_name(layer: str | None, default: str) -> str:
    """Database of a layer: its name in upper case, or the default."""
    return layer.strip().upper() if layer else default


def save_as_table(df: DataFrame, database: str, name: str) -> None:
    df.sparkSession.sql(f"create database if not exists {database}")
    df.write.mode("overwrite").saveAsTable(f"{database}.{name}")


def register_views(spark: SparkSession, frames: dict[str, DataFrame]) -> None:
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
