"""Incremental and full-refresh loads of landed files, and load health."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from merchantry.operators.combine import union_all
from merchantry.sources.sinks import write_table
from merchantry.streaming.tables import Kept, Levelled, Run, State

# Fixed value: where incremental loads begin.
START = "2020-01-01 00:00:00"


#: Level of the run that counts the loaded rows which a later load may meet again.
SEEN = -1
_SEEN = "digest string, undated boolean, n bigint"


def append_increment(landed: DataFrame, path: str, cursor: str, start: str = START) -> None:
    """Load the rows of ``landed`` that the table under ``path`` does not hold yet.

    A load takes rows past the mark, which is the greatest cursor value loaded so far
    and kept in the table's manifest, so the table itself is not scanned.  Rows at the
    mark's own instant and rows without a cursor cannot be told by the mark: of these
    the table keeps digests with the number of rows each stands for, and a load takes
    as many of them as ``landed`` has more.  So every row is loaded once, repeats as
    often as they landed.  The first load takes what is past ``start``, and what has
    no cursor.  Data, mark and digests become valid by one commit.
    """
    spark = landed.sparkSession
    table, seen_table = Levelled(spark, path), Kept(spark, path)
    state = table.state()
    batch = state.batch + 1 if state else 0
    runs = state.runs if state else ()
    schema = state.schema if state else landed.schema.json()
    seen_schema = spark.createDataFrame([], _SEEN).schema.json()
    kind = landed.schema[cursor].dataType
    mark = F.lit(state.mark if state and state.mark is not None else start).cast(kind)
    row = F.struct(*[F.col(f"`{c}`") for c in landed.columns])
    at, digest = F.col(f"`{cursor}`"), F.sha2(F.to_json(row), 256)

    seen = seen_table.read([r for r in runs if r.level == SEEN], seen_schema)
    again = at.isNull() | (at == mark) if state else at.isNull()
    lane = landed.where(again).groupBy(digest.alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.first(row).alias("row"))
    known = seen.select("digest", F.col("n").alias("known"))
    more = lane.join(known, "digest", "left").withColumn("more", F.col("n") - F.coalesce("known", F.lit(0))).where("more > 0")
    repeated = more.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "more"))).select("row.*")
    new = Run(f"run=0-{batch}-0")
    table.write(landed.where(at > mark).unionByName(repeated), new.name)

    loaded = table.read([new], schema)
    top = loaded.select(F.greatest(F.max(at), mark).cast("string")).first()[0]
    now = F.lit(top).cast(kind)
    met = loaded.where(at.isNull() | (at == now)).select(digest.alias("digest"), at.isNull().alias("undated"), F.lit(1).cast("long").alias("n"))
    stays = seen if state and top == state.mark else seen.where("undated")
    counted = stays.unionByName(met).groupBy("digest", "undated").agg(F.sum("n").alias("n"))
    marked = Run(f"run=0-{batch}-seen", SEEN)
    table.write(counted, marked.name)
    data = table.compacted([*[r for r in runs if r.level != SEEN], new], schema, f"run=0-{batch}")
    table.commit(State(0, batch, schema, (*data, marked), top))


def read_increments(spark: SparkSession, path: str) -> DataFrame:
    """The rows loaded by :func:`append_increment`."""
    table = Kept(spark, path)
    state = table.state()
    if state is None:
        raise FileNotFoundError(f"nothing was loaded into {path}")
    return table.read([r for r in state.runs if r.level != SEEN], state.schema)


def full_refresh(
    df: DataFrame, root: str, version: str | None = None, partition_by: tuple[str, ...] = ()
) -> str:
    """Write a complete new version beside the old one and return its folder.

    A version counts once its commit marker is there, so readers see the whole
    old table or the whole new one, also when the job dies half-way.
    """
    version = version or datetime.now().strftime("%Y%m%d%H%M%S%f")
    path = f"{root.rstrip('/')}/version={version}"
    write_table(df, path, partition_by, mode="errorifexists")
    return path


def read_current(spark: SparkSession, root: str) -> DataFrame:
    """The newest committed version of a full-refresh table: by number, or by commit time where a version is no number."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/version=*/_SUCCESS")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    commits = {str(s.getPath().getParent().toString()): s.getModificationTime() for s in found or []}
    if not commits:
        raise FileNotFoundError(f"no committed version under {root}")
    names = {folder: folder.rpartition("version=")[2] for folder in commits}
    if all(n.isdecimal() for n in names.values()):
        return spark.read.parquet(max(commits, key=lambda folder: int(names[folder])))
    return spark.read.parquet(max(commits, key=lambda folder: (commits[folder], names[folder])))


def load_health(
    tables: dict[str, tuple[DataFrame, str]], as_of: Column, stale_after_hours: int = 48
) -> DataFrame:
    """Rows and last load time per table, flagged when empty or stale."""
    parts = []
    for name, (df, loaded_at) in tables.items():
        parts.append(
            df.agg(F.count(F.lit(1)).alias("row_count"), F.max(loaded_at).cast("timestamp").alias("last_loaded_at"))
            .select(F.lit(name).alias("table_name"), "row_count", "last_loaded_at")
        )
    limit = as_of.cast("timestamp") - F.make_dt_interval(hours=F.lit(stale_after_hours))
    stale = F.col("last_loaded_at").isNull() | (F.col("last_loaded_at") < limit)
    status = F.when(F.col("row_count") == 0, "empty").when(stale, "stale").otherwise("ok")
    return union_all(parts).withColumn("status", status)
