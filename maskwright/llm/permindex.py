"""Approximate nearest neighbours by inner product with a permutation index.

A vector is represented by its nearest pivots in order, by angle. The order is made once for each vector and kept with it.
Vectors are dealt into blocks; a block posts its vectors in one inverted file for each pivot, with the pivot's place in
the vector's order. A query reads the files of its own nearest pivots and adds up what the two orders share: with
places i and j below the prefix length, the footrule distance of two prefixes falls by 2 (length - max(i, j)) for each
common pivot, so the largest sums are the least distances. Queries are dealt into blocks too, and each pair of blocks
is one group of Spark; the best of all blocks meet in the end.

Orders know angles, not lengths. A line, fitted on a bounded sample, turns shared sums into cosines; times the vector's own
norm that estimates the inner product up to the query's norm, and the share of a block with the largest estimates is
reranked by the exact inner product in double precision. With vectors of one norm that is the order of footrule distance.

Copies of a vector are one entry of a block, with the smallest identifiers a result can need; so any number of copies
costs one comparison, and ties go to the smaller identifier.

Defined results: rows whose identifier is null or no integer, or whose vector is null, zero, of another length than most,
or holds a null, NaN or infinity, take no part. Rows with the query's identifier are its own. An identifier that
occurs several times counts once for a query, with its best score. An empty table, or one without queries, gives no
rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.llm.store import written


@dataclass(frozen=True)
class PermutationSettings:
    """pivots: a sample of so many vectors, drawn by a hash of the identifier. prefix: length of an order. share: how much
    of a block is compared exactly, the same at every size. rows, queries: size of blocks. sample: vectors that the line
    from shared sums to cosines is fitted on."""

    pivots: int = 256
    prefix: int = 64
    share: float = 0.3
    rows: int = 16_384
    queries: int = 1024
    sample: int = 2048


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Columns vec_id, vector (array<double>) of the rows that take part."""
    rows = vectors.select(vectors[id_col].try_cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()).filter(fine)
    common = rows.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").first()
    return rows.filter(F.size("vector") == F.lit(common["n"] if common else 0))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    own = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return own.flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)


def orders(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """For each vector its nearest pivots by angle, nearest first; ties to the earlier pivot."""
    return np.argsort(-(vectors @ pivots.T), axis=1, kind="stable")[:, :prefix]


class PivotFiles:
    """The inverted files of one block: for each pivot the vectors that have it in their prefix, and what its place there
    adds to a sum at most. orders: a row of pivots for each vector."""

    def __init__(self, orders: np.ndarray, pivots: int) -> None:
        self.size, self.prefix = orders.shape
        by = np.argsort(orders.ravel(), kind="stable")
        self.row, self.left = by // self.prefix, (self.prefix - by % self.prefix).astype(np.int32)
        self.first = np.searchsorted(orders.ravel()[by], np.arange(pivots + 1))

    def shared(self, order: np.ndarray) -> np.ndarray:
        """For each vector what its order shares with that one."""
        found = np.zeros(self.size, np.int32)
        for j, pivot in enumerate(order):
            own = slice(self.first[pivot], self.first[pivot + 1])
            found[self.row[own]] += np.minimum(self.left[own], self.prefix - j)
        return found


def fitted(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> tuple[float, float]:
    """Cosine as a line over the shared sum, by least squares over the first 64 vectors against all; (0, 1) if flat."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True) if len(vectors) else vectors
    if len(unit) < 3:
        return 0.0, 1.0
    own = orders(unit, pivots, prefix)
    files = PivotFiles(own, len(pivots))
    x = np.concatenate([np.delete(files.shared(own[i]), i) for i in range(min(64, len(unit)))]).astype(float)
    y = np.concatenate([np.delete(unit @ unit[i], i) for i in range(min(64, len(unit)))])
    slope = ((x - x.mean()) * (y - y.mean())).sum() / max(((x - x.mean()) ** 2).sum(), 1e-300)
    return (y.mean() - slope * x.mean(), slope) if slope > 0 else (0.0, 1.0)


@dataclass(frozen=True)
class Index:
    """What all blocks share: unit pivots and the line from sums to cosines."""

    pivots: np.ndarray
    base: float
    slope: float


def search_block(
    ids: np.ndarray, vectors: np.ndarray, own_orders: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, query_orders: np.ndarray,
    index: Index, nearest: int, settings: PermutationSettings,
) -> list[np.ndarray]:
    """Columns query_id, vec_id, score: the best `nearest` of the block for each query, ties to smaller identifiers."""
    keys = np.ascontiguousarray(vectors + 0.0).view(f"V{vectors.shape[1] * 8}").ravel()
    _, at, group = np.unique(keys, return_index=True, return_inverse=True)
    distinct = vectors[at]
    norms = np.linalg.norm(distinct, axis=1)
    by = np.lexsort((ids, group))
    first = np.searchsorted(group[by], np.arange(len(at) + 1))
    members = [np.unique(ids[by[a:b]])[: nearest + 1] for a, b in zip(first, first[1:], strict=False)]
    files = PivotFiles(own_orders[at], len(index.pivots))
    most = min(len(distinct), max(2 * nearest, int(np.ceil(settings.share * len(distinct)))))
    found: list[tuple] = []
    for own, query, order in zip(query_ids, queries, query_orders, strict=True):
        guess = (index.base + index.slope * files.shared(order)) * norms
        near = np.argpartition(-guess, most - 1)[:most]
        score = (distinct[near] * query).sum(1)
        if len(near) > nearest + 1:
            bound = np.partition(score, len(score) - nearest - 1)[len(score) - nearest - 1]
            near, score = near[score >= bound], score[score >= bound]
        other = np.concatenate([members[g] for g in near])
        score = np.repeat(score, [len(members[g]) for g in near])
        other, score = other[other != own], score[other != own]
        best = np.lexsort((other, -score))[:nearest]
        found.append((np.full(len(best), own), other[best], score[best]))
    return [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]


def built(rows: DataFrame, settings: PermutationSettings) -> Index:
    """Pivots and line, from the vectors whose identifiers have the least hashes: at most settings.sample of them."""
    most = max(settings.pivots, settings.sample)
    sample = rows.orderBy(F.xxhash64("vec_id", F.lit(23)), "vec_id").limit(most).select("vector").toArrow()
    if not sample.num_rows:
        return Index(np.zeros((0, 0)), 0.0, 1.0)
    vectors = matrix(sample["vector"])
    pivots = np.unique(vectors[: settings.pivots], axis=0)
    pivots = pivots / np.maximum(np.linalg.norm(pivots, axis=1, keepdims=True), 1e-300)
    return Index(pivots, *fitted(np.unique(vectors, axis=0)[: settings.sample], pivots, settings.prefix))


def search(vectors: DataFrame, is_query: Column, nearest: int = 20, settings: PermutationSettings = PermutationSettings(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows query_id, rank, vec_id, score. is_query: a condition on the column vec_id."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col).withColumn("is_query", is_query)
    shared = spark.sparkContext.broadcast(built(rows, settings))

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = orders(matrix(batch["vector"]), shared.value.pivots, settings.prefix).astype(np.int16)
                column = pa.ListArray.from_arrays(np.arange(len(near) + 1, dtype=np.int32) * near.shape[1], near.ravel())
                yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, "near"])

    rows = written(rows.mapInArrow(ordered, "vec_id long, vector array<double>, is_query boolean, near array<smallint>"), "permutation-rows")
    facts = rows.agg(F.count("*").alias("n"), F.count_if("is_query").alias("queries")).first()
    of_rows, of_queries = max(1, -(-facts["n"] // settings.rows)), max(1, -(-facts["queries"] // settings.queries))
    own_block, own_query = F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(of_rows)), F.pmod(F.xxhash64("vec_id", F.lit(6)), F.lit(of_queries))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    data = rows.select("vec_id", "vector", "near", F.lit(False).alias("asks"), own_block.alias("row_block"), every(of_queries).alias("query_block"))
    asked = rows.filter("is_query").select("vec_id", "vector", "near", F.lit(True).alias("asks"), every(of_rows).alias("row_block"), own_query.alias("query_block"))

    def run(block: pa.Table) -> pa.Table:
        asks = block["asks"].to_numpy()
        ids, values, near = block["vec_id"].to_numpy(), matrix(block["vector"]), matrix(block["near"])
        best = search_block(ids[~asks], values[~asks], near[~asks], ids[asks], values[asks], near[asks], shared.value, nearest, settings) if asks.any() and not asks.all() else [[], [], []]
        return pa.table({"query_id": pa.array(best[0], pa.int64()), "vec_id": pa.array(best[1], pa.int64()), "score": pa.array(best[2], pa.float64())})

    found = data.unionByName(asked).groupBy("row_block", "query_block").applyInArrow(run, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")
