"""Quality rules from repetition, found with a suffix array over the words of each text.

Words are maximal runs of bytes other than ASCII white space (0x20, 0x09-0x0D), so a non-breaking space
belongs to a word. For a batch of texts one suffix array is built by prefix doubling; every text has word
ids of its own, so the suffixes of a text are neighbours and no repeat reaches across texts. The longest
common prefix of neighbouring suffixes gives, for each position, the longest run of words starting there
that occurs again. The spans of those maximal repeats are joined, and the verdict limits the share of
characters they cover and the longest repeat. The columns count repeats of min_words or more; the verdict
also limits the share of short repeats, so that words or phrases said again and again do not pass.

Defined results: a null text counts as empty; an empty text or one without words has zero counts, fails the
base rule (fewer than 20 words) and is not kept. Rows are independent, so repeated rows, ties and repeated or
null identifiers give one result each. Extra input columns are ignored. Texts of any length are treated whole;
memory is proportional to the words of a batch of texts, or of one text if that is longer.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SYMBOLS = "#*$%&|<>"
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, repeat_chars long, longest_repeat long, repeat_spans array<struct<first:long,last:long>>"
)
SPACES = b" \t\n\r\x0b\x0c"


@dataclass(frozen=True)
class RepetitionRules:
    """min_words: the fewest words a repeat needs to count. max_covered: largest share of a text's word
    characters inside such repeats. max_longest_share: largest share of a text's words that one repeat may
    have, applied from longest_floor words on. short_words, max_short_covered: the same as the first two for
    short repeats, which only the verdict counts."""

    min_words: int = 8
    max_covered: float = 0.30
    max_longest_share: float = 0.25
    longest_floor: int = 24
    short_words: int = 3
    max_short_covered: float = 0.50
    batch_words: int = 250_000


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array of dense non-negative ids, and the ranks by the first 1, 2, 4, ... symbols.

    Only suffixes whose prefix is still shared are sorted again. Ranks of one round are equal exactly if
    that many leading symbols are equal. The last symbol must be unique.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    key = symbols[order]
    fresh = np.r_[True, key[1:] != key[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    rounds, step = [rank.astype(np.int32)], 1
    active = order[~(fresh & np.r_[fresh[1:], True])]
    while len(active):
        head = rank[active]
        tail = rank[np.minimum(active + step, n - 1)]
        by = np.argsort(head * (n + 1) + tail, kind="stable")
        active, head, tail = active[by], head[by], tail[by]
        new_head = np.r_[True, head[1:] != head[:-1]]
        new_pair = new_head | np.r_[True, tail[1:] != tail[:-1]]
        at = np.arange(len(active))
        starts = np.maximum.accumulate(np.where(new_pair, at, 0)) - np.maximum.accumulate(np.where(new_head, at, 0))
        rank[active] = head + starts
        rounds.append(rank.astype(np.int32))
        active = active[~(new_pair & np.r_[new_pair[1:], True])]
        step *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    return order, rounds


def neighbour_prefixes(order: np.ndarray, rounds: list[np.ndarray]) -> np.ndarray:
    """Longest common prefix of each suffix with the one before it in the array; 0 for the first."""
    n = len(order)
    common = np.zeros(n, np.int64)
    pairs = np.flatnonzero(np.r_[False, rounds[0][order[1:]] == rounds[0][order[:-1]]])
    a, b, got = order[pairs - 1], order[pairs], np.zeros(len(pairs), np.int64)
    for j in range(len(rounds) - 1, -1, -1):
        same = rounds[j][np.minimum(a + got, n - 1)] == rounds[j][np.minimum(b + got, n - 1)]
        got += same << j
    common[pairs] = got
    return common


def longest_repeats(symbols: np.ndarray) -> np.ndarray:
    """For each position, the length of the longest run of symbols from there that also starts elsewhere."""
    if not len(symbols):
        return np.zeros(0, np.int64)
    order, rounds = suffix_array(symbols)
    common = neighbour_prefixes(order, rounds)
    best = np.empty(len(symbols), np.int64)
    best[order] = np.maximum(common, np.r_[common[1:], 0])
    return best


def covered(repeats: np.ndarray, least: int) -> np.ndarray:
    """Which positions lie inside a repeat of at least that many symbols."""
    at = np.flatnonzero(repeats >= least)
    edge = np.zeros(len(repeats) + 1, np.int64)
    edge[at] += 1
    np.subtract.at(edge, at + repeats[at], 1)
    return np.cumsum(edge[:-1]) > 0


def spans_of(marks: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.r_[False, marks, False].astype(np.int8)))
    return [{"first": int(a), "last": int(b) - 1} for a, b in zip(edges[::2], edges[1::2], strict=True)]


def chars_in(words: list[bytes], spans: list[dict]) -> int:
    return sum(len(b"".join(words[s["first"] : s["last"] + 1]).decode("utf-8", "replace")) for s in spans)


def duplicate_lines(text: bytes) -> int:
    seen: set[bytes] = set()
    found = 0
    for line in text.split(b"\n"):
        if line.strip(SPACES):
            if line in seen:
                found += 1
            else:
                seen.add(line)
    return found


def measure(texts: list[bytes], rules: RepetitionRules) -> Iterator[dict]:
    """One record for each text, in order; texts are measured in batches of about rules.batch_words words."""
    start = 0
    while start < len(texts):
        size, end = 0, start
        words: list[list[bytes]] = []
        while end < len(texts) and (not words or size < rules.batch_words):
            words.append(texts[end].split())
            size += len(words[-1])
            end += 1
        yield from _measure_batch(texts[start:end], words, rules)
        start = end


def _measure_batch(texts: list[bytes], words: list[list[bytes]], rules: RepetitionRules) -> Iterator[dict]:
    fresh = count()
    ids: list[int] = []
    for each in words:
        own = defaultdict(fresh.__next__)
        ids.extend(map(own.__getitem__, each))
        ids.append(next(fresh))
    symbols = np.fromiter(ids, np.int64, len(ids))
    del ids
    repeats = longest_repeats(symbols)
    inside, short = covered(repeats, rules.min_words), covered(repeats, rules.short_words)
    at = 0
    for text, each in zip(texts, words, strict=True):
        n = len(each)
        marks, short_marks, own = inside[at : at + n], short[at : at + n], repeats[at : at + n]
        at += n + 1
        flat = b"".join(each)
        chars = len(flat.decode("utf-8", "replace")) if not flat.isascii() else len(flat)
        spans = spans_of(marks)
        repeat_chars, short_chars = chars_in(each, spans), chars_in(each, spans_of(short_marks))
        repeat_words = int(marks.sum())
        longest = int(own.max()) if n else 0
        longest = longest if longest >= rules.min_words else 0
        failed = n < 20 or 100 * repeat_words > 30 * n
        within = repeat_chars <= rules.max_covered * chars and short_chars <= rules.max_short_covered * chars and (
            longest < rules.longest_floor or longest <= rules.max_longest_share * n
        )
        yield {
            "n_words": n,
            "word_chars": chars,
            "n_symbols": sum(flat.count(s) for s in SYMBOLS.encode()),
            "n_dup_lines": duplicate_lines(text),
            "n_repeat_words": repeat_words,
            "base_failed": failed,
            "kept": not failed and within,
            "repeat_chars": repeat_chars,
            "longest_repeat": longest,
            "repeat_spans": spans,
        }


ARROW = pa.schema(
    [("doc_id", pa.int64())]
    + [(k, pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [("base_failed", pa.bool_()), ("kept", pa.bool_()), ("repeat_chars", pa.int64()), ("longest_repeat", pa.int64())]
    + [("repeat_spans", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))]
)


def repetition(documents: DataFrame, rules: RepetitionRules = RepetitionRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, repeat spans (numbers of words, first and last) and verdict for every row. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()]
                rows = [{"doc_id": i, **r} for i, r in zip(part.column(0).to_pylist(), measure(texts, rules), strict=True)]
                yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

    return documents.select(documents[id_col].try_cast("long").alias("doc_id"), documents[text_col].cast("string").alias("text")).mapInArrow(run, SCHEMA)


def keep(documents: DataFrame, rules: RepetitionRules = RepetitionRules(), text_col: str = "text") -> DataFrame:
    """The rows of `documents`, with all columns, that the rules keep."""
    at = documents.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts = [t or b"" for t in part.column(at).cast(pa.binary()).to_pylist()]
                yield part.filter(pa.array([r["kept"] for r in measure(texts, rules)], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
