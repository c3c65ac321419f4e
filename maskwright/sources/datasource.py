"""SQL surface: the archive format, and table functions over a document.

    register(spark)
    spark.read.format("tararchive").option("payload", "false").load("/folder/*.tgz")
    spark.sql("SELECT f.* FROM configs, LATERAL xml_identities(document) f")

The format opens files with Python, so it is for paths that every executor sees; read_archives takes any store.
"""

from __future__ import annotations

from collections.abc import Iterator
from glob import glob
from pathlib import Path

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.functions import udtf

from maskwright.operators.xmlwalk import identities, tag_sequence
from maskwright.sources.archive import COLUMNS, MEMBERS, members_of


class ArchivePartition(InputPartition):
    """One archive: the format can be split no further."""

    def __init__(self, path: str) -> None:
        self.path = path


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.payload = options["path"], options.get("payload", "true").lower() != "false"

    def partitions(self) -> list[ArchivePartition]:
        found = sorted(p for p in glob(self.path) if Path(p).is_file()) or sorted(map(str, Path(self.path).glob("*.t*")))
        return [ArchivePartition(p) for p in found]

    def read(self, partition: ArchivePartition) -> Iterator[pa.RecordBatch]:
        for member in members_of(partition.path, Path(partition.path).read_bytes(), self.payload):
            yield pa.RecordBatch.from_pylist([member], schema=MEMBERS)


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tararchive"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


@udtf(returnType="pos int, kind string, value string, category string")
class XmlIdentities:
    """Findings of an XML document in order; a complaint of the parser is a last row of kind warning."""

    def eval(self, document: str):
        found, complaint = identities((document or "").encode("utf-8", "replace")) if document else ([], None)
        for i, (kind, value, category) in enumerate(found):
            yield i, kind, value, category
        if complaint:
            yield len(found), "warning", complaint, ""


@udtf(returnType="pos int, tag string")
class XmlTags:
    """Qualified tags of a document in order; none if it does not parse."""

    def eval(self, document: str):
        yield from enumerate(tag_sequence(document) or [] if document else [])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArchiveSource)
    spark.udtf.register("xml_identities", XmlIdentities)
    spark.udtf.register("xml_tags", XmlTags)
