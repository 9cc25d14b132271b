"""Removing another store's rows from a store's tables, file by file.

Only files that hold a foreign key are written again; a new version of all tables
lists the files that stay beside those written anew, and becomes valid as a whole.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from merchantry.streaming.tables import Folder


@dataclass(frozen=True)
class Rule:
    """Rows go whose ``key`` is a ``foreign_key`` of the other store's ``foreign`` table."""

    key: str
    foreign: str
    foreign_key: str = "id"


# The tables of a shop that are purged, and by what.
RULES = {
    "orders": Rule("id", "orders"),
    "customers": Rule("id", "customers"),
    "order_line_items": Rule("order_id", "orders"),
    "products": Rule("id", "products"),
    "product_variants": Rule("id", "product_variants"),
}


def marked(rows: DataFrame, key: str) -> DataFrame:
    """(key, file) of each row, the file as the hash of its path: paths would fill the sort, as they shrink to nothing in a shuffle whose pieces are made by their size."""
    return rows.select(F.col(f"`{key}`").alias("key"), F.xxhash64("_metadata.file_path").alias("file"))


def files_with(rows: DataFrame, key: str, foreign: DataFrame) -> list[str]:
    """Files of ``rows`` that hold a key of ``foreign`` (key), of which there is at most the table's own number.

    Only the key column is read.  Its range is a filter of the scan, so row groups whose
    statistics lie outside are passed over.  Should two paths have one hash, both are named.
    """
    low, high = foreign.agg(F.min("key"), F.max("key")).first()
    if low is None:
        return []
    near = marked(rows.where(F.col(f"`{key}`").between(low, high)), key)
    hit = near.join(foreign, "key", "left_semi").select("file").distinct()
    paths = rows.select(F.col("_metadata.file_path").alias("path")).distinct()
    return [r["path"] for r in paths.join(hit, F.xxhash64("path") == F.col("file"), "left_semi").collect()]


def purge_store(spark: SparkSession, own: dict[str, str], other: dict[str, DataFrame], target: str, rules: dict[str, Rule] = RULES) -> dict[str, int]:
    """Write a version of the tables under ``own`` (Parquet folders by name) without the other store's rows.

    Returns the number of files written again per table.  The folders in ``own`` are not
    touched; a purge of a purged store starts from its newest version.  Rows with a null
    key stay.
    """
    folder = Folder(spark, target)
    number, before = _newest(folder)
    version, rewritten = {}, {}
    for name, path in own.items():
        rule = rules[name]
        files = before[name] if before else spark.read.parquet(path).inputFiles()
        foreign = other[rule.foreign].select(F.col(rule.foreign_key).alias("key")).where("key is not null").distinct()
        rows = spark.read.parquet(*files)
        hit = {*files_with(rows, rule.key, foreign)}
        plain = {f: _plain(f) for f in files}
        again = [f for f in files if plain[f] in {_plain(h) for h in hit}]
        version[name], rewritten[name] = [f for f in files if f not in again], len(again)
        if again:
            out = f"{folder.root}/{name}/version={number + 1}"
            kept = spark.read.parquet(*again).join(foreign.withColumnRenamed("key", rule.key), [rule.key], "left_anti")
            kept.select(*[F.col(f"`{c}`") for c in rows.columns]).write.mode("overwrite").parquet(out)
            version[name] += spark.read.schema(rows.schema).parquet(out).inputFiles()
    folder.put(f"versions/{number + 1:012d}.json", json.dumps(version))
    return rewritten


def _plain(path: str) -> str:
    """A file's path without the scheme and slashes that different listings put in front."""
    return "/" + path.partition(":")[2].lstrip("/") if ":" in path.split("/")[0] else path


def _newest(folder: Folder) -> tuple[int, dict[str, list[str]] | None]:
    found = folder.names("versions/*.json")
    if not found:
        return -1, None
    return int(found[-1].partition(".")[0]), json.loads(folder.read(f"versions/{found[-1]}"))


def read_purged(spark: SparkSession, target: str, name: str, schema) -> DataFrame:
    """A table of the newest version."""
    _, version = _newest(Folder(spark, target))
    if version is None:
        raise FileNotFoundError(f"nothing was purged into {target}")
    return spark.read.schema(schema).parquet(*version[name]) if version[name] else spark.createDataFrame([], schema)
