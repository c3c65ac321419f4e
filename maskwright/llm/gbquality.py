"""Quality classifier: histogram gradient-boosted trees over statistics of each document.

Statistics come from the whole text. Trees are grown level by level on binned statistics with a logistic loss;
each is stored as a complete binary tree in flat arrays, so a batch of rows walks all trees with numpy indexing.

Defined results: a null text counts as empty; an empty text has all statistics 0 and gets a score like any other.
Without labelled rows, or with one class only, every score is the share of label 1 (0.5 if there are none).
Repeated rows, and null or repeated identifiers, get one result each; of several labels for an identifier the
lowest counts. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATISTICS = (
    "log_chars", "log_words", "word_length", "lower_share", "upper_share", "digit_share", "space_share", "mark_share",
    "symbol_share", "other_share", "shout_per_word", "bar_per_word", "symbol_per_word", "log_lines", "words_per_line",
    "repeated_lines", "distinct_words", "longest_word", "log_longest_line", "ended_lines", "capital_words", "stops_per_word",
)
CLASSES = ("lower", "upper", "digit", "space", "mark", "symbol", "other")


@dataclass(frozen=True)
class BoostSettings:
    """sample: the expected number of labelled rows to learn from, at most."""

    trees: int = 60
    depth: int = 4
    bins: int = 64
    rate: float = 0.15
    least_weight: float = 2.0
    penalty: float = 1.0
    sample: int = 12_000


@dataclass(frozen=True)
class BoostedTrees:
    """feature and cut have a row for each tree and an entry for each inner node; leaf one for each leaf."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def margin(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.base)
        at = np.arange(len(rows))
        inner = self.feature.shape[1]
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(rows), np.int64)
            for _ in range((inner + 1).bit_length() - 1):
                node = 2 * node + 1 + (rows[at, feature[node]] > cut[node])
            total += leaf[node - inner]
        return total

    def score(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(rows)))


@cache
def classes() -> np.ndarray:
    def kind(c: str) -> int:
        if c in "#*$%&|<>":
            return 5
        if c.isspace():
            return 3
        if c.isdigit():
            return 2
        if c.isalpha():
            return 1 if c.isupper() else 0
        return 4 if c in ".,;:!?'\"()-" else 6

    return np.fromiter((kind(chr(c)) for c in range(0x110000)), np.int64, 0x110000)


def statistics(texts: list[str]) -> np.ndarray:
    """One row of STATISTICS for each text."""
    if not texts:
        return np.zeros((0, len(STATISTICS)))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.array([len(t) for t in texts])
    row = np.repeat(np.arange(len(texts)), sizes)
    by = np.bincount(row * len(CLASSES) + classes()[points], minlength=len(texts) * len(CLASSES)).reshape(-1, len(CLASSES)).astype(float)
    chars = np.maximum(sizes, 1)[:, None]
    own = np.zeros((len(texts), 12))
    for i, text in enumerate(texts):
        words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
        n = max(1, len(words))
        own[i] = (
            len(words), text.count("!") / n, text.count("|") / n, len(lines), n / max(1, len(lines)), 1 - len(set(lines)) / max(1, len(lines)),
            len(set(words)) / n, max(map(len, words), default=0), max(map(len, lines), default=0),
            sum(x.rstrip()[-1] in ".!?" for x in lines) / max(1, len(lines)), sum(w[0].isupper() for w in words) / n, text.count(".") / n,
        )
    words = np.maximum(own[:, 0], 1)
    share = by / chars
    columns = (
        np.log1p(sizes), np.log1p(own[:, 0]), (sizes - by[:, 3]) / words, *(share[:, j] for j in range(len(CLASSES))),
        own[:, 1], own[:, 2], by[:, 5] / words, np.log1p(own[:, 3]), own[:, 4], own[:, 5], own[:, 6], own[:, 7],
        np.log1p(own[:, 8]), own[:, 9], own[:, 10], own[:, 11],
    )
    return np.column_stack(columns)


def blocks(texts: list[str], most: int = 400_000) -> Iterator[list[str]]:
    own: list[str] = []
    size = 0
    for text in texts:
        if own and size + len(text) > most:
            yield own
            own, size = [], 0
        own.append(text)
        size += len(text)
    if own:
        yield own


def fit(rows: np.ndarray, labels: np.ndarray, settings: BoostSettings = BoostSettings()) -> BoostedTrees:
    """Boosted trees for labels 0 and 1."""
    inner, leaves = (1 << settings.depth) - 1, 1 << settings.depth
    positive = labels.mean() if len(labels) else 0.5
    if len(labels) == 0 or positive in (0, 1):
        base = {0: -20.0, 0.5: 0.0, 1: 20.0}[positive]
        return BoostedTrees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    n, width = rows.shape
    cuts = [np.unique(np.quantile(rows[:, j], np.linspace(0, 1, settings.bins + 1)[1:-1])) for j in range(width)]
    binned = np.column_stack([np.searchsorted(c, rows[:, j], side="left") for j, c in enumerate(cuts)])
    base = float(np.log(positive / (1 - positive)))
    margin = np.full(n, base)
    features, edges, values = [], [], []
    for _ in range(settings.trees):
        share = 1 / (1 + np.exp(-margin))
        slope, curve = labels - share, np.maximum(share * (1 - share), 1e-9)
        feature, cut, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
        bin_cut = np.full(inner, settings.bins)
        for level in range(settings.depth):
            first, many = (1 << level) - 1, 1 << level
            best = np.zeros(many)
            for j in range(width):
                key = (node - first) * settings.bins + binned[:, j]
                up = np.bincount(key, slope, many * settings.bins).reshape(many, -1).cumsum(1)
                down = np.bincount(key, curve, many * settings.bins).reshape(many, -1).cumsum(1)
                all_up, all_down = up[:, -1:], down[:, -1:]
                gain = up**2 / (down + settings.penalty) + (all_up - up) ** 2 / (all_down - down + settings.penalty) - all_up**2 / (all_down + settings.penalty)
                gain[(down < settings.least_weight) | (all_down - down < settings.least_weight)] = 0
                gain = gain[:, : len(cuts[j])]
                if not gain.size:
                    continue
                top = gain.argmax(1)
                better = gain[np.arange(many), top] > best + 1e-9
                best = np.where(better, gain[np.arange(many), top], best)
                at = first + np.flatnonzero(better)
                feature[at], bin_cut[at], cut[at] = j, top[better], cuts[j][top[better]]
            node = 2 * node + 1 + (binned[np.arange(n), feature[node]] > bin_cut[node])
        node -= inner
        leaf = settings.rate * np.bincount(node, slope, leaves) / (np.bincount(node, curve, leaves) + settings.penalty)
        margin += leaf[node]
        features.append(feature)
        edges.append(cut)
        values.append(leaf)
    return BoostedTrees(base, np.array(features), np.array(edges), np.array(values))


def train(documents: DataFrame, labels: DataFrame, settings: BoostSettings = BoostSettings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> BoostedTrees:
    """labels: the rows that may be learned from. A bounded sample of their identifiers, drawn by a hash, is broadcast."""
    own = labels.select(labels[id_col].alias("id"), labels[label_col].alias("label")).filter("id is not null and label is not null")
    own = own.groupBy("id").agg(F.min("label").alias("label"))
    share = min(1.0, settings.sample / max(1, own.count()))
    own = own.filter(F.pmod(F.xxhash64("id", F.lit(9)), F.lit(1 << 20)) < share * (1 << 20))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for part in blocks([t or "" for t in batch.column(2).to_pylist()]) for r in statistics(part)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([list(r) for r in rows], pa.list_(pa.float64()))], ["id", "label", "row"])

    texts = documents.select(documents[id_col].alias("id"), documents[text_col].alias("text"))
    found = texts.join(F.broadcast(own), "id").select("id", F.col("label").cast("long").alias("label"), "text")
    found = found.mapInArrow(run, "id long, label long, row array<double>").groupBy("id").agg(F.min("label").alias("label"), F.min("row").alias("row")).toArrow().sort_by("id")
    rows = np.array(found["row"].to_pylist(), float).reshape(-1, len(STATISTICS))
    return fit(rows, found["label"].to_numpy(), settings)


def classify(documents: DataFrame, model: BoostedTrees, id_col: str = "doc_id", text_col: str = "text", **extra: Column) -> DataFrame:
    """Columns doc_id, the extra ones and score for every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    names = list(extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            score = np.concatenate([np.zeros(0), *(shared.value.score(statistics(part)) for part in blocks(texts))])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score)], ["doc_id", *names, "score"])

    picked = documents.select(documents[id_col].alias("doc_id"), *[c.alias(k) for k, c in extra.items()], documents[text_col].alias("text"))
    kinds = ", ".join(f"`{k}` {t}" for k, t in picked.dtypes[:-1])
    return picked.mapInArrow(run, f"{kinds}, score double")
