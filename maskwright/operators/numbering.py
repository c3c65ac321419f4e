"""Ordered numbering and ordered sums without putting all rows into one task.

Rows are dealt out by ranges of their key, so each partition holds a stretch of the global order. Spark takes the borders from
a sample of the keys: sparse, dense, skewed, negative and nested keys all give partitions of about the same size, and
the number of partitions, not the values of the key, says how many there are. A row for each partition carries the
sums of those before it. The dealt rows are a table, so that a lost executor cannot deal them differently.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.store import written

BEFORE = (Window.unboundedPreceding, -1)


def ordered_sums(df: DataFrame, keys: Sequence[str | Column], sums: Mapping[str, Column | str]) -> DataFrame:
    """df with, for each name in `sums`, the sum of that amount over the rows that come before in the order of `keys`.

    Rows alike in all keys are interchangeable; they share a partition. Null keys come first, null amounts count as 0.
    An amount keeps its kind: whole numbers sum exactly, doubles in the order of the rows.
    """
    own = {f"_key{i}": F.col(k) if isinstance(k, str) else k for i, k in enumerate(keys)}
    dealt = df.withColumns(own).withColumns({f"_amount_{k}": F.col(a) if isinstance(a, str) else a for k, a in sums.items()})
    dealt = written(dealt.repartitionByRange(*own).withColumn("_part", F.spark_partition_id()), "ordered")
    totals = dealt.groupBy(F.col("_part").alias("_of")).agg(*[F.sum(f"_amount_{k}").alias(f"_total_{k}") for k in sums])
    # A row for each partition: their number is the session's, whatever the rows are.
    parts = Window.orderBy("_of").rowsBetween(*BEFORE)
    zero = lambda c: F.coalesce(c, F.lit(0))
    totals = totals.select("_of", *[zero(F.sum(f"_total_{k}").over(parts)).alias(f"_before_{k}") for k in sums])
    inside = Window.partitionBy("_part").orderBy(*own).rowsBetween(*BEFORE)
    found = dealt.withColumns({f"_inside_{k}": zero(F.sum(f"_amount_{k}").over(inside)) for k in sums})
    found = found.join(F.broadcast(totals), F.col("_part") == F.col("_of"))
    return found.withColumns({k: F.col(f"_before_{k}") + F.col(f"_inside_{k}") for k in sums}).select(*df.columns, *sums)


def numbered(df: DataFrame, keys: str | Sequence[str | Column], out: str, start: Column | int = 0) -> DataFrame:
    """df with `out`: 1, 2, 3, ... in the order of the key columns, counted on from `start`. Keys may be of any type
    that has an order, structs included."""
    own = [keys] if isinstance(keys, str) else list(keys)
    found = ordered_sums(df, own, {"_earlier": F.lit(1).cast("long")})
    return found.withColumn(out, ((F.lit(start) if isinstance(start, int) else start) + F.col("_earlier") + 1).cast("long")).select(*df.columns, out)
