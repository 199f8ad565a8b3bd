"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallybook.session import scratch_folder

BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the cluster's shared folder and read it back: a lost executor costs a re-read, not a re-run."""
    path = f"{scratch_folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables made by ``stored``, once all that was made from them is stored itself."""
    for df in tables:
        place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_path)
        place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def text_key(text: str = "text") -> Column:
    """16 bytes that stand for a whole text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def sized(df: DataFrame, row_bytes: int, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast only if its counted rows, at ``row_bytes`` each, stay under ``most``; else unmarked.

    ``df`` should be a stored table, since its rows are counted.
    """
    return F.broadcast(df) if df.count() * row_bytes <= most else df


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
