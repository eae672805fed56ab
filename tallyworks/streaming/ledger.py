"""Stored tables that batches are committed to, and snapshots of several tables.

A batch is a folder of its own, named by its number, and is written whole: committing it
again writes the same folder, so a repeated batch changes nothing and a failed one leaves
nothing. What the table holds is read from all batches: of each key the first or the last
row. ``compact`` writes that as one batch.

A snapshot is several tables written beside each other under a number; it is there once
its marker is, and readers take the largest number that has one. So tables that belong
together change together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.findings import member_counts, replace_by_key
from ..session import settled


#: The column of a batch's number.
BATCH = "__batch"


def commit(batch: DataFrame, path: str, number: int) -> None:
    batch.write.mode("overwrite").parquet(f"{path}/{BATCH}={number}")


def committed(spark: SparkSession, path: str, schema, keys: list[str], order: list[str], last: bool) -> DataFrame:
    """Of each key the ``last`` (or first) row by batch and ``order``; rows with a null in a key are all there."""
    rows = spark.read.schema(schema).parquet(path)  # the number comes from the folders' names
    by = [BATCH, *order]
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) if last else F.asc(c) for c in by]))
    keyed = F.lit(True)
    for k in keys:
        keyed = keyed & F.col(k).isNotNull()
    names = rows.drop(BATCH).columns
    return rows.where(keyed).withColumn("__n", nth).where("__n = 1").select(*names).unionByName(rows.where(~keyed).select(*names))


def compact(spark: SparkSession, path: str, to: str, schema, keys: list[str], order: list[str], last: bool) -> None:
    """The table as batch 0 of a new folder."""
    commit(committed(spark, path, schema, keys, order, last), to, 0)


def commit_stream(stream: DataFrame, path: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """All that is there, batch by batch; numbers are the stream's, so one that is repeated after a failure replaces itself."""
    query = stream.writeStream.foreachBatch(lambda df, number: commit(prepare(df), path, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


# ---------------------------------------------------------------- snapshots


def publish(tables: dict[str, DataFrame], root: str, number: int) -> None:
    """Write ``tables`` as snapshot ``number``; it counts when the marker, written last, is there."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/data/{number}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.range(1).select(F.lit(number).cast("long").alias("number")).coalesce(1).write.mode("overwrite").parquet(f"{root}/published/{number}")


def current(spark: SparkSession, root: str) -> int | None:
    """The number of the newest snapshot, None before the first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/published")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema("number long").option("recursiveFileLookup", "true").parquet(f"{root}/published").agg(F.max("number")).first()[0]


def snapshot(spark: SparkSession, root: str, name: str, number: int | None = None) -> DataFrame:
    number = current(spark, root) if number is None else number
    return spark.read.parquet(f"{root}/data/{number}/{name}")


def replace_filings(rows: DataFrame, findings: DataFrame, members: DataFrame, filings: DataFrame, read: DataFrame) -> dict[str, DataFrame]:
    """rows, findings and members after filings have been read again.

    Rows of filings in ``read`` give way to those read; findings about a row that gave way
    go, as its id is no longer there, and come again when findings are next derived; members are
    counted anew. A filing that the new read has nothing for keeps its rows and findings,
    so an empty read changes nothing. Findings without a transaction stay.
    """
    gone = rows.join(read.select("filing_id").distinct(), "filing_id", "left_semi").select("txn_id").distinct()
    # findings without a transaction meet no row, and would all go to one task to find none
    named = findings.where("txn_id IS NOT NULL").join(gone, "txn_id", "left_anti").select(*findings.columns)
    left = settled(named.unionByName(findings.where("txn_id IS NULL")), "left")  # written once, as members are counted from it too
    return {"rows": replace_by_key(rows, read, "filing_id"), "findings": left, "members": member_counts(members, left, filings)}
