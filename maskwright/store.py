"""Intermediate tables, in a folder that the driver and all executors share, and joins that survive hot keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process, so that they share every folder."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset, a temporary one in a session on one machine, and
    an error on a cluster, whose machines would each write to a folder of their own."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not is_local(spark):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="maskwright-"))
    return context.getCheckpointDir()


def written(df: DataFrame, name: str, most: int = 0) -> DataFrame:
    """df as a table in the shared folder, read again: cuts lineage, so lost executors cost no recomputation. most: rows of a file, as
    the reader takes some thousand rows of a file at a time, however large they are; 0 is any number."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", most).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(table: DataFrame) -> None:
    """Deletes the files of a table made by `written` that nothing will read again. Only files in the shared folder go."""
    spark = table.sparkSession
    own = shared_folder(spark).partition(":")[2].lstrip("/") or shared_folder(spark).lstrip("/")
    folders = {f.rpartition("/")[0] for f in table.inputFiles()}
    for folder in folders:
        if own in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Deletes all intermediate tables of this application; results that are still to be read from them are lost."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], n_left: str, rows: int, parts: int, least: int = 256) -> DataFrame:
    """left and right joined on equal keys, without n_left. right: one row for each key; its column n_left says how many rows of
    `left` have the key. rows: how many `left` has, about.

    A key with more than a partition's share of the rows is hot: a hash of the whole row deals its rows of `left` out
    over so many salts that each has a share, and its row of `right` is there once for each salt.
    """
    share = max(least, rows // (2 * max(1, parts)))
    salts = F.ceil(F.col(n_left) / share)
    # At most rows / share of them, so this broadcast is bounded by twice the number of partitions, whatever the input.
    hot = right.filter(F.col(n_left) > share).select(*keys, salts.alias("_salts"))
    own = F.coalesce(F.pmod(F.xxhash64(*left.columns, F.lit(29)), F.col("_salts")), F.lit(0).cast("long"))
    dealt = left.join(F.broadcast(hot), keys, "left").withColumn("_salt", own).drop("_salts")
    every = right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(salts, F.lit(1)) - 1)))
    return dealt.join(every.drop(n_left), [*keys, "_salt"]).drop("_salt")


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
