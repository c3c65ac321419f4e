"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, everything but letters becomes a space, runs of spaces collapse, and the n-grams of one
to three characters are hashed into a fixed number of buckets. Counts for each language are summed by Spark; the
smoothed log-probability matrix (languages x buckets, at most 128 MB by default: more languages than the limit are an
error) is broadcast, and batches of texts are scored as a sparse product: bucket ids gathered from the matrix and added up
between the offsets of the rows.

Defined results: a null text, or one without letters, is `und` with score 0. With nothing to learn from, every
row is `und` with score 0. Ties go to the language that sorts first. Repeated rows, and null or repeated
identifiers, get one result each. Extra columns are ignored. Texts are read whole, a block of characters at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageSettings:
    """sample_per_language: the expected number of labelled rows of each language to learn from, at most.
    most_languages: bounds the matrix that is broadcast, and each task's counts; beyond it training raises ValueError."""

    orders: tuple[int, ...] = (1, 2, 3)
    bucket_bits: int = 14
    smoothing: float = 0.5
    sample_per_language: int = 5000
    most_languages: int = 1024
    block_chars: int = 400_000


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    log_prior: np.ndarray
    log_prob: np.ndarray  # buckets x languages
    settings: LanguageSettings


@cache
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _blocks(texts: list[str], most: int) -> Iterator[tuple[int, int]]:
    start = 0
    while start < len(texts):
        end, size = start, 0
        while end < len(texts) and (end == start or size + len(texts[end]) <= most):
            size += len(texts[end])
            end += 1
        yield start, end
        start = end


def ngrams(texts: list[str], settings: LanguageSettings) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each order, bucket ids with their text numbers (rising); with the first, which texts have letters."""
    lowered = [t.lower() for t in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4")
    row = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in lowered])
    real = letters()[points]
    has = np.zeros(len(texts), bool)
    has[row[real]] = True
    change = np.r_[True, row[1:] != row[:-1]] if len(row) else np.zeros(0, bool)
    keep = real | np.r_[True, real[:-1]][: len(real)] | change
    char = np.where(real, points, 32)[keep].astype(np.uint64)
    row, real = row[keep], real[keep]
    mixed = (char + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    code, some = np.zeros(len(char), np.uint64), np.zeros(len(char), bool)
    for n in range(1, max(settings.orders) + 1):
        last = len(char) - n + 1
        if last <= 0:
            break
        code = (code[:last] ^ (code[:last] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + mixed[n - 1 :]
        some = some[:last] | real[n - 1 :]
        if n in settings.orders:
            fine = some & (row[:last] == row[n - 1 :])
            salted = (code[fine] + np.uint64(n)) * np.uint64(0x94D049BB133111EB)
            yield (salted >> np.uint64(64 - settings.bucket_bits)).astype(np.int32), row[:last][fine], has


def log_scores(texts: list[str], model: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    """Joint log-probabilities, texts x languages, and which texts have letters."""
    scores = np.tile(model.log_prior, (len(texts), 1))
    has = np.zeros(len(texts), bool)
    for start, end in _blocks(texts, model.settings.block_chars):
        for bucket, row, found in ngrams(texts[start:end], model.settings):
            has[start:end] = found
            if len(row):
                first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                for j in range(len(model.languages)):
                    scores[start + row[first], j] += np.add.reduceat(model.log_prob[:, j][bucket], first)
    return scores, has


def predict(texts: list[str], model: LanguageModel) -> tuple[list[str], np.ndarray]:
    if not model.languages:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    scores, has = log_scores(texts, model)
    best = scores.argmax(1)
    share = 1 / np.exp(scores - scores.max(1, keepdims=True)).sum(1)
    return [model.languages[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)], np.where(has, share, 0.0)


def train(labelled: DataFrame, settings: LanguageSettings = LanguageSettings()) -> LanguageModel:
    """labelled: columns id, lang, text. Rows are sampled by a hash of the id, so reruns agree."""
    spark = labelled.sparkSession
    labelled = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counted = labelled.groupBy("lang").agg(F.count("*").alias("n")).limit(settings.most_languages + 1).collect()
    if len(counted) > settings.most_languages:
        raise ValueError(f"more than {settings.most_languages} languages to learn")
    sizes = dict(sorted((r["lang"], r["n"]) for r in counted))
    if not sizes:
        return LanguageModel((), np.zeros(0), np.zeros((1 << settings.bucket_bits, 0)), settings)
    names = list(sizes)
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, settings.sample_per_language / n)))])
    draw = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(1)), F.lit(1 << 20)) / float(1 << 20)
    buckets = 1 << settings.bucket_bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), buckets), np.int64)
        for batch in batches:
            index = np.array([names.index(x) for x in batch.column(0).to_pylist()], np.int64)
            texts = batch.column(1).to_pylist()
            for start, end in _blocks(texts, settings.block_chars):
                for bucket, row, _ in ngrams(texts[start:end], settings):
                    total += np.bincount(index[start:end][row] * buckets + bucket, minlength=total.size).reshape(total.shape)
        lang, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(bucket), pa.array(total[lang, bucket])], ["lang", "bucket", "n"])

    sums = (
        labelled.filter(draw < share[F.col("lang")])
        .select("lang", "text")
        .mapInArrow(count, "lang long, bucket long, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    counts = np.zeros((buckets, len(names)))
    counts[sums["bucket"].to_numpy(), sums["lang"].to_numpy()] = sums["n"].to_numpy()
    log_prob = np.log(counts + settings.smoothing) - np.log((counts + settings.smoothing).sum(0))
    prior = np.array(list(sizes.values()), float)
    return LanguageModel(tuple(names), np.log(prior / prior.sum()), np.asfortranarray(log_prob), settings)


def identify(documents: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", **extra: Column) -> DataFrame:
    """Columns doc_id, the extra ones, lang_pred and score for every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    names = list(extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                found, score = predict([t or "" for t in part.column(part.num_columns - 1).to_pylist()], shared.value)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(found, pa.string()), pa.array(score)], ["doc_id", *names, "lang_pred", "score"])

    picked = documents.select(documents[id_col].alias("doc_id"), *[c.alias(k) for k, c in extra.items()], documents[text_col].alias("text"))
    kinds = ", ".join(f"`{k}` {t}" for k, t in picked.dtypes[:-1])
    return picked.mapInArrow(run, f"{kinds}, lang_pred string, score double")
