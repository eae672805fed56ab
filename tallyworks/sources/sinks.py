"""Writers that can be repeated."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str, by: list[str] | None = None, rows_each: int = 5_000_000) -> None:
    """Replace a table; partitions named by ``by`` are written by several tasks where they are large."""
    spread = df.hint("rebalance", *by) if by else df.hint("rebalance")
    writer = spread.write.mode("overwrite").option("maxRecordsPerFile", rows_each)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def append_failures(df: DataFrame, path: str) -> None:
    """Failed downloads as CSV with a header in each file."""
    df.write.mode("append").option("header", True).csv(path)
