"""Running sums over large groups without gathering a group in one task, and pseudorandom permutations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEFORE = (Window.unboundedPreceding, -1)
LANES_PER_PART = 4096


def running_sum(df: DataFrame, rows: int, group: str, amount: str, ties: list[str], out: str, lane_rows: int = 1024) -> DataFrame:
    """df with `out`: the sum of `amount` over the rows of the same group that come before it.

    rows: how many rows df has. A hash of the columns in `ties` deals every group into lanes, rows / lane_rows of
    them, so even a group that holds most rows is cut into lanes of about lane_rows rows. The order is lane, hash,
    ties. Rows alike in all of them are interchangeable. Sums of lanes (a row each) are summed in parts. `group` must
    not be null.
    """
    lanes = max(1, -(-rows // lane_rows))
    dealt = df.withColumn("_tie", F.xxhash64(*ties, F.lit(17))).withColumn("_lane", F.pmod(F.xxhash64("_tie", F.lit(3)), F.lit(lanes)))
    sums = dealt.groupBy(F.col(group).alias("_g"), F.col("_lane").alias("_l")).agg(F.sum(amount).alias("_sum"))
    sums = sums.withColumn("_part", F.floor(F.col("_l") / LANES_PER_PART))
    inside = F.coalesce(F.sum("_sum").over(Window.partitionBy("_g", "_part").orderBy("_l").rowsBetween(*BEFORE)), F.lit(0))
    parts = sums.groupBy(F.col("_g").alias("_pg"), F.col("_part").alias("_pp")).agg(F.sum("_sum").alias("_part_sum"))
    earlier = F.coalesce(F.sum("_part_sum").over(Window.partitionBy("_pg").orderBy("_pp").rowsBetween(*BEFORE)), F.lit(0))
    parts = parts.withColumn("_earlier", earlier)
    offsets = sums.withColumn("_inside", inside).join(parts, (F.col("_g") == F.col("_pg")) & (F.col("_part") == F.col("_pp")))
    offsets = offsets.select("_g", "_l", (F.col("_inside") + F.col("_earlier")).alias("_offset"))
    own = F.coalesce(F.sum(amount).over(Window.partitionBy(group, "_lane").orderBy("_tie", *ties).rowsBetween(*BEFORE)), F.lit(0))
    found = dealt.withColumn("_own", own).join(offsets, (F.col(group) == F.col("_g")) & (F.col("_lane") == F.col("_l")))
    return found.withColumn(out, F.col("_offset") + F.col("_own")).select(*df.columns, out)


def permuted(df: DataFrame, index: str, size: str, keys: list[str], out: str, rounds: int = 16) -> DataFrame:
    """df with `out`: the image of `index` under a permutation of 0 .. size-1, another one for each value of `keys`.

    Swap-or-not rounds: x and its mirror image k - x (mod size) change places or not by a bit that depends on the
    pair. Every round is its own inverse, so the whole is one-to-one for any size, with no lookup table and no sort.
    """
    df = df.withColumn(out, F.col(index).cast("long"))
    for r in range(rounds):
        df = df.withColumn("_k", F.pmod(F.xxhash64(*keys, F.lit(1000 + r)), F.col(size)))
        df = df.withColumn("_mirror", F.pmod(F.col("_k") - F.col(out), F.col(size)))
        swap = F.xxhash64(F.greatest(F.col(out), F.col("_mirror")), "_k", F.lit(r)).bitwiseAND(F.lit(1)) == 1
        df = df.withColumn(out, F.when(swap, F.col("_mirror")).otherwise(F.col(out)))
    return df.drop("_k", "_mirror")
