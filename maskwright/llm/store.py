"""Intermediate tables and joins of this subpackage: those of maskwright.store, and one that frees what it was made from."""

from __future__ import annotations

from pyspark.sql import DataFrame

from maskwright.store import dropped, join_hot, partitions, shared_folder, written

__all__ = ["dropped", "join_hot", "partitions", "released", "shared_folder", "written"]


def released(df: DataFrame, name: str, *consumed: DataFrame) -> DataFrame:
    """`written`, after which the tables it was made from are deleted, and so are the files of its shuffles: nothing reads
    them again, and Spark would keep them until the driver's next collection of garbage."""
    table = written(df, name)
    for old in consumed:
        dropped(old)
    table.sparkSession._jvm.System.gc()
    return table
