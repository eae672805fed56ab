"""The session this library is written for: UTC, ANSI, adaptive execution."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "tallyworks", **more: str) -> SparkSession:
    """A session with the settings above; on a cluster, master and memory come from spark-submit."""
    return SparkSession.builder.appName(name).config(map=SETTINGS | more).getOrCreate()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that every executor sees: below spark.checkpoint.dir, which only a session in one process may leave unset (tests).

    It goes when the program ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tallyworks-")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, path)
    return path


def _forget(spark: SparkSession, path: str) -> None:
    with suppress(Exception):  # the session's JVM may be gone
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def settled(df: DataFrame, name: str = "settled") -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and its plan ends there."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
