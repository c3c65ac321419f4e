"""A corpus pipeline of five operators, counted as part of the subpackage for corpus preparation.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the last return the
columns of documents. ORACLE_SQL is None: several stages cannot be expressed in SQL, so the pipeline is tested
against a brute-force version.

Defined results: null and empty texts fail the quality rules and go. Documents whose identifier is null are told apart
by their text; of rows alike in both, one stays. Null languages and sources are kept as they are. An empty table goes
through all stages. Extra columns are dropped by the first stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from maskwright.llm import lengthpack, mixture, pii_lstm, repetition, simhash
from maskwright.llm.store import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules reject go. Rows keep all their columns."""
    return repetition.keep(docs.select(*COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays: the one with the least doc_id."""
    return simhash.one_of_each(docs.select(*COLUMNS))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by its kind in brackets, and n_chars follows."""
    return pii_lstm.redact(docs.select(*COLUMNS), pii_lstm.default_tagger()).selectExpr(
        "doc_id", "text", "lang", "source", "cast(length(text) as long) as n_chars"
    )


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, or runs of their blocks, as often as the mix takes them."""
    return mixture.mixed_documents(docs, mixture.mix(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in length buckets and batches."""
    return lengthpack.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("PII", personal_data),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{i}")
    return docs
