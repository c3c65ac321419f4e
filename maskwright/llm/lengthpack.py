"""Packing into length buckets that are optimal for the corpus, with DataFrame functions.

Lengths are words. A text longer than the longest bucket is cut into pieces of that length and a rest. The histogram
of all piece lengths (at most `max_words` rows, so bounded by a parameter) goes to the driver, where dynamic
programming finds the bucket boundaries with the least padding. Inside a bucket, pieces in pseudorandom order form
batches of as many pieces as the token budget holds at the bucket's length.

Defined results: a null or empty text, or one without words, is one row with length 0 and null bucket, batch and
padding. Repeated rows are packed one by one. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.llm.mixture import WORD
from maskwright.llm.runindex import running_sum
from maskwright.llm.store import written


@dataclass(frozen=True)
class PackSettings:
    max_words: int = 2048
    buckets: int = 8
    budget_words: int = 32_768


def boundaries(histogram: dict[int, int], buckets: int) -> list[int]:
    """At most so many upper boundaries, from the lengths that occur, with the least sum of padding.

    best[j] is the least padding of the first j lengths in k buckets; a bucket over lengths i .. j-1 pads
    lengths[j-1] * count - words. Ties take the leftmost cut.
    """
    lengths = np.array(sorted(x for x in histogram if x > 0), np.int64)
    n = len(lengths)
    if n == 0:
        return []
    counts = np.array([histogram[int(x)] for x in lengths], np.int64)
    rows, words = np.r_[0, np.cumsum(counts)], np.r_[0, np.cumsum(counts * lengths)]
    big = np.iinfo(np.int64).max // 4
    best = np.full(n + 1, big)
    best[0] = 0
    cuts = []
    for _ in range(min(buckets, n)):
        step, cut = np.full(n + 1, big), np.zeros(n + 1, np.int64)
        step[0] = 0
        for j in range(1, n + 1):
            cost = best[:j] + lengths[j - 1] * (rows[j] - rows[:j]) - (words[j] - words[:j])
            cut[j] = cost.argmin()
            step[j] = cost[cut[j]]
        best = step
        cuts.append(cut)
    found, j = [], n
    for cut in reversed(cuts):
        if j == 0:
            break
        found.append(int(lengths[j - 1]))
        j = int(cut[j])
    return found[::-1]


def bucket_of(length: Column, bounds: list[int]) -> Column:
    """The least boundary that is not below the length; null for length 0."""
    found = F.lit(None).cast("long")
    for b in reversed(bounds):
        found = F.when(length <= b, F.lit(b).cast("long")).otherwise(found)
    return F.when(length > 0, found)


def pack(documents: DataFrame, settings: PackSettings = PackSettings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows doc_id, piece (from 0), first_word, n_words, bucket, batch, place (in the batch), padding."""
    most = settings.max_words
    text = F.coalesce(documents[text_col].cast("string"), F.lit(""))
    sized = documents.select(
        documents[id_col].alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size")
    )
    pieces = sized.select("doc_id", "text_hash", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("size") / most) - 1, F.lit(0)))).alias("piece"))
    pieces = pieces.withColumn("first_word", F.col("piece") * most).withColumn("n_words", F.least(F.col("size") - F.col("first_word"), F.lit(most)))
    pieces = written(pieces, "pack-lengths")
    histogram = {r["n_words"]: r["n"] for r in pieces.groupBy("n_words").agg(F.count("*").alias("n")).collect()}
    bounds = boundaries(histogram, settings.buckets)
    pieces = pieces.withColumn("bucket", bucket_of(F.col("n_words"), bounds))
    pieces = pieces.withColumn("_group", F.coalesce("bucket", F.lit(0))).withColumn("_one", F.lit(1).cast("long"))
    pieces = running_sum(pieces, sum(histogram.values()), "_group", "_one", ["doc_id", "text_hash", "piece"], "_nth")
    hold = F.greatest(F.lit(1), F.floor(F.lit(settings.budget_words) / F.col("bucket")))
    batch = F.floor(F.col("_nth") / hold)
    return pieces.select(
        "doc_id", "piece", "first_word", "n_words", "bucket", batch.alias("batch"),
        F.when(F.col("bucket").isNotNull(), F.pmod("_nth", hold)).alias("place"), (F.col("bucket") - F.col("n_words")).alias("padding"),
    )
