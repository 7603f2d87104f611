"""Sinks on partitioned Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append(df: DataFrame, path: str, partition: str) -> None:
    """Append, one file per partition value and task."""
    df.write.mode("append").partitionBy(partition).parquet(path)


def replace_partitions(df: DataFrame, path: str, partition: str) -> None:
    """Replace exactly the partitions that ``df`` has: running it again gives the same table."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def archive(df: DataFrame, path: str, before: str, column: str = "day") -> DataFrame:
    """Write what is older as gzipped JSON lines; give what stays."""
    old = F.col(column) < F.lit(before)
    df.where(old).write.mode("overwrite").json(path, compression="gzip")
    return df.where(~old)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)
