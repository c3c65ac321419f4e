"""Pseudonymisation of streams.

Addresses need no state: their pseudonym is a function of the address and the seed, so a stream of texts is a plain
map. Numbered identities (users, e-mails, hosts and serial numbers in texts) need the mapping so far: each micro-batch
detects, takes what the mapping lacks, goes on numbering, appends, and rewrites. Tables are written under the batch's
number and overwritten on a retry, so a batch that runs twice changes nothing. An identity is known from the batch on in
which it is first found; objects are found in configurations, which are not streamed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from maskwright.functions import columns as C
from maskwright.operators import allocate, detect, rewrite_joined

MAPPING = "category string, original string, pseudonym string"


def rewrite_stream(stream: DataFrame, text_col: str, seed: str) -> DataFrame:
    """The stream with its addresses replaced."""
    return stream.withColumn(text_col, C.rewritten_ipv4(F.col(text_col), F.lit(seed)))


def mapping_before(spark, folder: str, batch: int) -> DataFrame:
    """The mapping of all earlier batches."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(MAPPING + ", batch long").parquet(folder).filter(F.col("batch") < batch).select("category", "original", "pseudonym")
    except AnalysisException:
        return spark.createDataFrame([], MAPPING)


KINDS = ("user", "email", "host", "serial")


def text_identities(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows kind, value, category, seq of texts, ready for numbering in the order of texts, kinds and places."""
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    found = detect.occurrences(rows, id_col, text_col, KINDS)
    return found.select("kind", "value", F.lit("").alias("category"), F.struct("id", rank.alias("rank"), "pos").alias("seq"))


def incremental(stream: DataFrame, id_col: str, text_col: str, seed: str, folder: str, words: tuple[str, ...] = ()) -> StreamingQuery:
    """Starts a query that keeps folder/mapping and folder/out, each partitioned by batch. id_col: anything ordered.
    words: plain words that are never identities."""

    def step(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        rows = rows.persist()
        known = mapping_before(spark, f"{folder}/mapping", batch)
        found = text_identities(rows, id_col, text_col).persist()
        mapping = allocate.map_names(found, words, known)
        new = mapping.join(known.select(F.col("category").alias("_c"), F.col("original").alias("_o")), (F.col("category") == F.col("_c")) & (F.col("original") == F.col("_o")), "left_anti")
        new.write.mode("overwrite").parquet(f"{folder}/mapping/batch={batch}")
        whole = mapping_before(spark, f"{folder}/mapping", batch + 1)
        out = rewrite_joined.rewrite_texts(rewrite_stream(rows, text_col, seed), text_col, whole)
        out.write.mode("overwrite").parquet(f"{folder}/out/batch={batch}")
        found.unpersist()
        rows.unpersist()

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
