"""Writers of cleaned tables and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_clean(df: DataFrame, folder: str, table: str, stage: str = "stage", year: str = "year") -> str:
    """A cleaned table as Parquet by stage and year; one shuffle puts a partition's rows into few files.

    Only the stages and years that ``df`` holds are replaced, so a year can be cleaned again beside the others, and a run
    that failed can be repeated. Adaptive execution splits a partition that holds too many rows.
    """
    path = f"{folder}/{table}"
    writer = df.hint("rebalance", stage, year).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(stage, year).parquet(path)
    return path


def write_report(table: DataFrame, path: str) -> str:
    """A published table as CSV with a header."""
    table.write.mode("overwrite").option("header", True).csv(path)
    return path
