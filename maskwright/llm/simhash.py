"""SimHash near-duplicates, linked with a Gray-order hierarchical index.

Fingerprints: ASCII letters are lower-cased, words are runs of bytes other than ASCII white space, and each shingle of
four words (the whole sequence if there are fewer) is hashed with XXH64, seed 42. A bit of the fingerprint is 1 if it
is set in over half of the hashes; without words the fingerprint is 0.

Links: two distinct fingerprints at most `bits` apart agree on whole segments of their bits, so both occur in a cell
that is keyed by a choice of segments and their bits. In a cell, fingerprints are sorted by Gray rank and grouped in a
tree; an upper node holds the mask of bits on which all below agree, and those bits. Pairs of nodes are compared from
the top: differences on shared masks accumulate downwards, so a pair of groups that already differs in too many bits
is dropped whole, one that cannot differ in too many is linked whole, and one that is linked already is not opened.
A cell gives a star for each local component, never all pairs. Cells with more than a partition's share of rows are
cut into blocks and each pair of blocks becomes a cell of its own. Stars are joined into components by alternating
large-star and small-star steps.

Defined results: an identifier that is no integer counts as null. Null and empty texts have fingerprint 0 and link with each other like any others. A null identifier
takes part but is never the smallest of its component unless all are null. Copies share a fingerprint and are linked
through it, so groups of any size cost no pairs. Repeated rows each get a row. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.store import join_hot, partitions, written

WIDTH = 64
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


@dataclass(frozen=True)
class SimHashSettings:
    """least_block: cells of up to so many rows are never cut. broadcast_cells: the table of cells to cut (a row each)
    is broadcast up to so many rows. cell_rows: unrelated fingerprints in a cell, about. fan_out: children of a tree node. open_pairs: node pairs compared at a time."""

    shingle: int = 4
    seed: int = 42
    bits: int = 4
    least_block: int = 256
    broadcast_cells: int = 5000
    cell_rows: int = 512
    fan_out: int = 8
    open_pairs: int = 200_000


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    words = text.lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    take = min(shingle, len(words))
    starts = np.r_[0, ends[: len(words) - take] + 1].tolist()
    stops = ends[take - 1 :].tolist()
    count, votes, digest = len(starts), np.zeros(WIDTH, np.int64), xxhash.xxh64_intdigest
    for at in range(0, count, 32768):
        hashes = np.array([digest(flat[a:b], seed) for a, b in zip(starts[at : at + 32768], stops[at : at + 32768], strict=True)], "<u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > count, bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, settings: SimHashSettings = SimHashSettings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows doc_id, text_hash (tells apart rows that share an identifier), fp (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [fingerprint(t or b"", settings.shingle, settings.seed) for t in part.column(2).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(np.array(found, np.uint64).view(np.int64))], ["doc_id", "text_hash", "fp"])

    text = documents[text_col].cast("string")
    rows = documents.select(documents[id_col].try_cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Place of each value in the reflected Gray order, where neighbours differ in one bit."""
    rank = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Trees over the fingerprints of some cells, one tree for each cell, all of the same height.

    Level 0 has the fingerprints; `first[k]` has, for each node of level k, its first child on the level below (and
    a last entry, the number of those), `mask[k]` and `bits[k]` what all below it share.
    """

    def __init__(self, cells: np.ndarray, values: np.ndarray, fan_out: int) -> None:
        order = np.lexsort((gray_rank(values), cells))
        self.cells, self.values = cells[order], values[order]
        n = len(values)
        self.first, self.mask, self.bits = [np.arange(n + 1)], [np.full(n, ALL)], [self.values]
        self.leaf = [np.arange(n + 1)]
        cell = np.cumsum(np.r_[0, self.cells[1:] != self.cells[:-1]]) if n else np.zeros(0, int)
        while len(cell) > (cell[-1] + 1 if n else 0):
            begins = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            inside = np.arange(len(cell)) - begins[cell]
            starts = np.flatnonzero(inside % fan_out == 0)
            low, high = self.mask[-1] & ~self.bits[-1], self.bits[-1]
            ones, zeros = np.bitwise_and.reduceat(high, starts), np.bitwise_and.reduceat(low, starts)
            self.first.append(np.r_[starts, len(cell)])
            self.leaf.append(self.leaf[-1][self.first[-1]])
            self.mask.append(ones | zeros)
            self.bits.append(ones)
            cell = cell[starts]

    def components(self, most: int, open_pairs: int) -> np.ndarray:
        """For each fingerprint, in the order of self.values, the place of the first one in its component."""
        n = len(self.values)
        parent = np.arange(n)
        top = len(self.first) - 1
        roots = np.arange(len(self.mask[top]))
        stack = [(top, roots, roots)]
        while stack:
            level, a, b = stack.pop()
            if len(a) > open_pairs:
                half = len(a) // 2
                stack += [(level, a[:half], b[:half]), (level, a[half:], b[half:])]
                continue
            shared = self.mask[level][a] & self.mask[level][b]
            apart = np.bitwise_count((self.bits[level][a] ^ self.bits[level][b]) & shared)
            near = apart <= most
            a, b, surely = a[near], b[near], (apart + np.bitwise_count(~shared) <= most)[near]
            if level:
                first, last = self.leaf[level], self.leaf[level][1:] - 1
                for node in (a[surely], b[surely]):
                    self._join_ranges(parent, first[node], last[node])
                self._join(parent, first[a[surely]], first[b[surely]])
                a, b = a[~surely], b[~surely]
                low, high = np.minimum.reduceat(parent, first[:-1]), np.maximum.reduceat(parent, first[:-1])
                done = (low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b])
                a, b = a[~done], b[~done]
                if len(a):
                    stack.append((level - 1, *self._opened(level, a, b)))
            else:
                self._join(parent, a, b)
        return parent

    def _opened(self, level: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = self.first[level]
        wide_a, wide_b = first[a + 1] - first[a], first[b + 1] - first[b]
        pair = np.repeat(np.arange(len(a)), wide_a * wide_b)
        nth = np.arange(len(pair)) - np.repeat(np.cumsum(wide_a * wide_b) - wide_a * wide_b, wide_a * wide_b)
        left, right = first[a][pair] + nth // wide_b[pair], first[b][pair] + nth % wide_b[pair]
        keep = left <= right if level > 1 else left < right
        return left[keep], right[keep]

    @staticmethod
    def _join(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        """Merges components in place; afterwards every entry points at the first of its component."""
        while True:
            x, y = parent[a], parent[b]
            differ = x != y
            if not differ.any():
                return
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
            while True:
                jumped = parent[parent]
                if (jumped == parent).all():
                    break
                parent[:] = jumped

    def _join_ranges(self, parent: np.ndarray, first: np.ndarray, last: np.ndarray) -> None:
        if len(first):
            edge = np.zeros(len(parent) + 1, np.int64)
            np.add.at(edge, first, 1)
            np.subtract.at(edge, last, 1)
            at = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
            self._join(parent, at, at + 1)


def choices(distinct: int, bits: int, cell_rows: int) -> list[int]:
    """Bit masks so that any two fingerprints at most `bits` apart agree on all bits of at least one.

    The width is cut into s segments; at least s - bits of them agree. The fewest segments are taken that leave at
    most about cell_rows unrelated fingerprints in a cell: more segments give smaller cells, but more rows.
    """
    segments = bits + 1
    while segments < 2 * bits and distinct >> ((segments - bits) * WIDTH // segments) > cell_rows:
        segments += 1
    edges = [WIDTH * i // segments for i in range(segments + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(own) for own in combinations(parts, segments - bits)]


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def stars(distinct: DataFrame, settings: SimHashSettings) -> DataFrame:
    """distinct: different fingerprints, column fp. Rows u, v with v < u: u is linked to v, maybe over others."""
    spark = distinct.sparkSession
    n = distinct.count()
    masks = choices(n, settings.bits, settings.cell_rows)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(parts, n * len(masks) // 400_000)
    block = max(settings.least_block, n * len(masks) // (2 * parts))
    keys = F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for i, m in enumerate(masks)])
    rows = distinct.select("fp", F.inline(keys))
    hot = rows.groupBy("choice", "key").agg(F.count("*").alias("rows")).filter(F.col("rows") > block)
    hot = written(hot.select("choice", "key", F.ceil(F.col("rows") / block).alias("blocks")), "simhash-cells")
    small = hot.count() <= settings.broadcast_cells
    rows = rows.join(F.broadcast(hot) if small else hot, ["choice", "key"], "left")
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks"))
    other = F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    rows = rows.select("fp", "choice", "key", F.coalesce(own, F.lit(0)).alias("own"), F.explode(other).alias("other"))
    cell = F.xxhash64("choice", "key", F.least("own", "other"), F.greatest("own", "other"))
    rows = rows.select(cell.alias("cell"), "fp").repartition(parts, "cell")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not read:
            return
        index = GrayIndex(np.concatenate([c for c, _ in read]), np.concatenate([f for _, f in read]).view(np.uint64), settings.fan_out)
        parent = index.components(settings.bits, settings.open_pairs)
        at = np.flatnonzero(parent != np.arange(len(parent)))
        u, v = index.values[at].view(np.int64), index.values[parent[at]].view(np.int64)
        for i in range(0, len(at), 65536):
            a, b = u[i : i + 65536], v[i : i + 65536]
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["u", "v"])

    return rows.mapInArrow(link, "u long, v long").distinct()


def components(links: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """links: pairs of different nodes. Rows u, v: every node but the least of its component, and that least one.

    Large-star links a node's greater neighbours to its least neighbour, small-star the others; both keep components,
    and repeated they end in stars. A hub costs one row for each neighbour: least neighbours are found by partial
    aggregation and joined back, those of hubs by broadcast.
    """

    parts = partitions(links)

    def both(e: DataFrame) -> DataFrame:
        return e.select(F.inline(F.array(F.struct(F.col("u").alias("a"), F.col("v").alias("b")), F.struct(F.col("v").alias("a"), F.col("u").alias("b")))))

    def large(e: DataFrame, rows: int) -> DataFrame:
        near = both(e)
        least = near.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("a", "m"))
        return join_hot(near.filter("b > a"), written(least, "components-least"), ["a"], "n", 2 * rows, parts).select(F.col("b").alias("u"), F.col("m").alias("v")).distinct()

    def small(e: DataFrame, rows: int) -> DataFrame:
        least = e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        near = join_hot(e, written(least, "components-least"), ["u"], "n", rows, parts)
        own = F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        return near.select(F.inline(own)).filter("u <> v").distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())

    links = links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).filter("u <> v")
    links = written(links.distinct(), "components")
    before = mark(links)
    while before[0]:
        links = written(large(links, before[0]), "components")
        links = written(small(links, before[0]), "components")
        now = mark(links)
        if now == before:
            break
        before = now
    return links


def near_duplicates(documents: DataFrame, settings: SimHashSettings = SimHashSettings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows doc_id, text_hash, fp, root (a fingerprint that stands for the component) and component_id."""
    docs = written(fingerprints(documents, settings, id_col, text_col), "simhash-documents")
    distinct = written(docs.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "simhash-fingerprints")
    roots = components(stars(distinct.select("fp"), settings))
    labelled = distinct.join(roots, F.col("fp") == F.col("u"), "left").select("fp", F.coalesce("v", "fp").alias("root"), "least", "copies")
    labelled = written(labelled, "simhash-roots")
    whole = written(labelled.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("prints")), "simhash-components")
    parts, rows = partitions(documents), distinct.agg(F.count("*").alias("prints"), F.coalesce(F.sum("copies"), F.lit(0)).alias("rows")).first()
    # Copies of one text, and members of one component, may be a third of all rows: neither meets in one task.
    labelled = written(join_hot(labelled, whole, ["root"], "prints", rows["prints"], parts), "simhash-labelled")
    found = join_hot(docs, labelled.drop("least"), ["fp"], "copies", rows["rows"], parts)
    return found.select("doc_id", "text_hash", "fp", "root", "component_id")


def one_of_each(documents: DataFrame, settings: SimHashSettings = SimHashSettings()) -> DataFrame:
    """The rows of `documents` that stay: of each component the one with the least identifier (null first), then the
    least text hash; of rows alike in both, one."""
    found = near_duplicates(documents, settings)
    # Partial aggregation leaves a row for each component in each task, however large the component.
    kept = found.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("kept")).select(F.col("kept.doc_id").alias("_id"), F.col("kept.text_hash").alias("_hash"))
    rows = documents.withColumn("_own", F.xxhash64(F.coalesce(documents["text"].cast("string"), F.lit(""))))
    rows = rows.join(kept, (F.col("_own") == F.col("_hash")) & documents["doc_id"].eqNullSafe(F.col("_id")), "left_semi")
    return rows.dropDuplicates(["doc_id", "_own"]).drop("_own")
