"""Session settings the models rely on, and the shared scratch folder."""

from __future__ import annotations

import atexit
import contextlib
import re
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import SparkSession

# UTC keeps date arithmetic independent of the machine; the adaptive settings
# let Spark split skewed join partitions, merge small ones, and broadcast a join
# side once its measured size (not an estimate) is under the limit.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64MB",
}


def build_session(app: str = "merchantry", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**REQUIRED, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the required runtime settings to a session made elsewhere."""
    for key, value in REQUIRED.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


_CLEANED: set[str] = set()


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder all executors can reach, under ``spark.checkpoint.dir``.

    On a cluster the setting must name shared storage.  On one machine, where it may be
    unset, the folder is under the warehouse folder.  All folders of a session are in
    one, which is deleted when the program ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"
    run = f"{root.rstrip('/')}/run-{spark.sparkContext.applicationId}"
    if run not in _CLEANED:
        _CLEANED.add(run)
        atexit.register(_delete, spark._jvm, spark._jsc.hadoopConfiguration(), run)
    return f"{run}/{purpose}-{uuid.uuid4().hex[:12]}"


def _delete(jvm, conf, folder: str) -> None:
    with contextlib.suppress(Py4JError, OSError):  # the JVM may have ended first
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
