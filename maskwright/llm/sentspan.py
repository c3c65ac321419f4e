"""Substring de-duplication by sliding spans of sentences.

Pieces: a line is cut into sentences, which end with a word whose last sign is one of . ! ?; a sentence of more than
`longest` words is cut into pieces of that many words, so long passages without full stops have several pieces too.
Every run of `run` consecutive pieces is hashed. Hashes that occur twice are found by a count; only the runs with such
a hash go on, with 128 bits of hash, to find the first one of each group by (doc_id, hash of the row, place). Every
piece inside a run that is not the first of its group is removed, from the whole text.

Pieces are counted from a sentence's start, so a passage spliced into a sentence may share no run. Therefore every
window of `passage` words that occurs earlier loses its words too, wherever it starts. Windows are not all shuffled:
each text is fingerprinted by winnowing (the least hash of `gram` words in each window), which equal windows share, and
only windows whose fingerprint repeats go on. Of these, windows wholly inside removed runs stay out: one that equals
them came before, so they are never the first and their words are gone. Tables that a step has used up are deleted.

Defined results: a null text stays null, with 0 pieces. A text with fewer pieces than a run has and fewer words than a
passage is kept as it is. n_removed counts the pieces that lose words.
White space is ASCII (0x20, 0x09-0x0D) and does not count in comparisons. A line without removed words keeps its
text exactly; in others the remaining words are joined by single spaces, and a line of which nothing remains goes.
Null identifiers come first. Rows alike in identifier and text are one row to this operator: both keep or lose the
same pieces. A copy of a whole document under another identifier loses all its pieces. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.store import join_hot, partitions, released, written

ENDS = frozenset(b".!?")


@dataclass(frozen=True)
class SpanSettings:
    run: int = 3
    longest: int = 16
    passage: int = 51

    @property
    def gram(self) -> int:
        return max(1, self.passage // 2 - 1)


def line_pieces(line: bytes, longest: int) -> list[list[bytes]]:
    words = line.split()
    stops = [i + 1 for i, w in enumerate(words) if w[-1] in ENDS]
    if words and (not stops or stops[-1] < len(words)):
        stops.append(len(words))
    found, start = [], 0
    for stop in stops:
        while stop - start > longest:
            found.append(words[start : start + longest])
            start += longest
        found.append(words[start:stop])
        start = stop
    return found


def piece_hashes(text: bytes, settings: SpanSettings) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(b" ".join(p)) for line in text.split(b"\n") for p in line_pieces(line, settings.longest)], np.uint64)


def run_hashes(pieces: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each run of pieces."""
    n = max(0, len(pieces) - run + 1)
    found = []
    for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        own = np.full(n, salt, np.uint64)
        for i in range(run):
            own = (own ^ pieces[i : i + n]) * np.uint64(0x94D049BB133111EB)
            own ^= own >> np.uint64(31 + i % 2)
            own *= np.uint64(salt)
        found.append((own ^ (own >> np.uint64(29))).view(np.int64))
    return found[0], found[1]


WORDS_AT_ONCE = 200_000


def batches_of_words(texts: list[bytes]) -> Iterator[tuple[int, list[list[bytes]]]]:
    """The words of texts, some texts at a time, with the number of the first of them."""
    first, size, words = 0, 0, []
    for i, text in enumerate(texts):
        words.append(text.split())
        size += len(words[-1])
        if size >= WORDS_AT_ONCE:
            yield first, words
            first, size, words = i + 1, 0, []
    if words:
        yield first, words


def word_hashes(words: list[list[bytes]]) -> np.ndarray:
    return np.fromiter((h for own in words for h in map(xxhash.xxh3_64_intdigest, own)), np.uint64, sum(map(len, words)))


def over_windows(values: np.ndarray, size: int, join: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """For each place the values of `size` neighbours from there joined, by doubling; the last step may overlap."""
    done = 1
    while done * 2 <= size:
        values, done = join(values[:-done], values[done:]), done * 2
    return join(values[: -(size - done)], values[size - done :]) if done < size else values


def mixed(salt: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        own = (a * np.uint64(salt)) ^ (b + np.uint64(0x2545F4914F6CDD1D))
        own ^= own >> np.uint64(31)
        own *= np.uint64(0x94D049BB133111EB)
        return own ^ (own >> np.uint64(29))

    return join


def window_starts(sizes: list[int], passage: int) -> np.ndarray:
    """For the joined words of texts of these sizes: whether a window that starts there ends in the same text."""
    ends = np.repeat(np.cumsum(sizes), sizes)
    return np.arange(len(ends)) + passage <= ends


def winnowed(hashes: np.ndarray, sizes: list[int], settings: SpanSettings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of grams, the least of each window (0 where no window starts), and the places of all these least."""
    if len(hashes) < settings.passage:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    grams = over_windows(hashes, settings.gram, mixed(0x9E3779B97F4A7C15)) | np.uint64(1)
    span = settings.passage - settings.gram + 1
    least = over_windows(grams, span, np.minimum)
    least = np.where(window_starts(sizes, settings.passage)[: len(least)], least, np.uint64(0))
    # A gram is a fingerprint if it is the least of any window around it, and none of those is greater.
    around = over_windows(np.r_[np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)], span, np.maximum)
    return grams, least, np.flatnonzero(around == grams)


def split_places(places: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    """Places in joined texts as places in each text."""
    starts = np.cumsum([0, *sizes])
    cuts = np.searchsorted(places, starts)
    return [places[a:b] - s for a, b, s in zip(cuts, cuts[1:], starts, strict=False)]


def fingerprints(texts: list[bytes], settings: SpanSettings) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text the hashes and places of its fingerprints."""
    found = []
    for _, words in batches_of_words(texts):
        sizes = [len(w) for w in words]
        grams, _, at = winnowed(word_hashes(words), sizes, settings)
        own, start = split_places(at, sizes), 0
        for places, size in zip(own, sizes, strict=True):
            found.append((grams[places + start].view(np.int64), places))
            start += size
    return found


def piece_words(text: bytes, settings: SpanSettings) -> list[int]:
    """The numbers of words of the pieces."""
    return [len(p) for line in text.split(b"\n") for p in line_pieces(line, settings.longest)]


def words_of_runs(removed: list[int], sizes: list[int], settings: SpanSettings) -> np.ndarray:
    """For each word whether it is in a run that starts at one of these places."""
    gone = np.zeros(len(sizes), bool)
    for r in removed:
        gone[r : r + settings.run] = True
    return np.repeat(gone, sizes)


def shared_windows(text: bytes, runs: list[int], marks: list[int], settings: SpanSettings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes and the place of each window whose least gram is at one of the marks; not of those inside runs."""
    words, size = [text.split()], settings.passage
    hashes = word_hashes(words)
    grams, least, _ = winnowed(hashes, [len(hashes)], settings)
    if not len(grams):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    own = np.full(len(grams), np.iinfo(np.uint64).max, np.uint64)
    own[marks] = grams[marks]
    picked = over_windows(own, size - settings.gram + 1, np.minimum) == least
    if runs:
        kept = ~words_of_runs(runs, piece_words(text, settings), settings)
        before = np.r_[0, np.cumsum(kept)]
        picked &= before[size:] > before[:-size]
    at = np.flatnonzero(picked)
    h, g = (over_windows(hashes, size, mixed(salt))[at].view(np.int64) for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))
    return h, g, at


def without(text: bytes, removed: list[int], windows: list[int], settings: SpanSettings) -> tuple[bytes, int]:
    """The text without the runs and the windows that start at these places, and how many pieces lost words."""
    gone = words_of_runs(removed, piece_words(text, settings), settings)
    for w in windows:
        gone[w : w + settings.passage] = True
    out, at, n = [], 0, 0
    for line in text.split(b"\n"):
        kept: list[bytes] = []
        lost = 0
        for piece in line_pieces(line, settings.longest):
            own = gone[at : at + len(piece)]
            at += len(piece)
            lost += bool(own.any())
            kept += [w for w, g in zip(piece, own.tolist(), strict=True) if not g]
        n += lost
        if not lost:
            out.append(line)
        elif kept:
            out.append(b" ".join(kept))
    return b"\n".join(out), n


def _rows(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = documents[text_col].cast("string")
    return documents.select(documents[id_col].try_cast("long").alias("doc_id"), F.xxhash64(documents[id_col], text, F.lit(3)).alias("row_hash"), text.alias("text"))


PLACES = "doc_id long, row_hash long, place int"


def hashed_places(part: pa.RecordBatch, found: list[tuple], kind: int | None = None) -> pa.RecordBatch:
    """A row for each hash of each text: hashes, the text's identifier and hash (its first two columns), place."""
    take = pa.array(np.repeat(np.arange(part.num_rows), [len(f[-1]) for f in found]))
    columns = [pa.array(np.concatenate([f[k] for f in found])) for k in range(len(found[0]))]
    names = ["h", "g", "doc_id", "row_hash", "place"]
    columns = [*columns[:-1], part.column(0).take(take), part.column(1).take(take), columns[-1].cast(pa.int32())]
    if kind is not None:
        columns, names = [*columns, pa.array(np.full(len(take), kind, np.int32))], [*names, "kind"]
    return pa.RecordBatch.from_arrays(columns, names)


def later_ones(some: DataFrame, name: str) -> DataFrame:
    """Rows doc_id, row_hash, place that share both hashes with an earlier one."""
    place = F.struct("doc_id", "row_hash", "place")
    first = some.groupBy(F.col("h").alias("_h"), F.col("g").alias("_g")).agg(F.min(place).alias("first"), F.count("*").alias("_n")).filter("_n > 1")
    first = written(first, name)
    both = join_hot(some.withColumnsRenamed({"h": "_h", "g": "_g"}), first, ["_h", "_g"], "_n", some.count(), partitions(some))
    return both.filter(~place.eqNullSafe(F.col("first"))).select("doc_id", "row_hash", "place")


def repeated(documents: DataFrame, settings: SpanSettings, id_col: str, text_col: str) -> DataFrame:
    """Rows h, g, doc_id, row_hash, place, kind: runs (kind 0) and fingerprints (1) whose hash occurs twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts = [t or b"" for t in part.column(2).cast(pa.binary()).to_pylist()]
                runs = [run_hashes(piece_hashes(t, settings), settings.run) for t in texts]
                yield hashed_places(part, [(*r, np.arange(len(r[0]))) for r in runs], 0)
                yield hashed_places(part, [(h, h, p) for h, p in fingerprints(texts, settings)], 1)

    every = _rows(documents, id_col, text_col).mapInArrow(run, f"h long, g long, {PLACES}, kind int")
    twice = every.groupBy("h", "kind").agg(F.count("*").alias("_n")).filter("_n > 1")
    twice = released(twice, "spans-twice")
    rows = twice.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    return released(join_hot(every, twice, ["h", "kind"], "_n", rows, partitions(documents)), "spans-repeated", twice)


def marked_windows(rows: DataFrame, settings: SpanSettings) -> DataFrame:
    """Rows h, g, doc_id, row_hash, place: the windows that may repeat. rows: doc_id, row_hash, text, runs, marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = [t or b"" for t in part.column(2).cast(pa.binary()).to_pylist()]
                runs, marks = (part.column(k).to_pylist() for k in (3, 4))
                yield hashed_places(part, [shared_windows(t, r or [], m, settings) for t, r, m in zip(texts, runs, marks, strict=True)])

    return rows.select("doc_id", "row_hash", "text", "runs", "marks").mapInArrow(run, f"h long, g long, {PLACES}")


def places_of(found: DataFrame, name: str) -> DataFrame:
    return found.groupBy(F.col("row_hash").alias("_row")).agg(F.sort_array(F.collect_set("place")).alias(name))


def remove_repeats(documents: DataFrame, settings: SpanSettings = SpanSettings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows doc_id, n_pieces, n_removed, text (what remains) for every row."""
    some = repeated(documents, settings, id_col, text_col)
    runs = released(places_of(later_ones(some.filter("kind = 0"), "spans-first"), "runs"), "spans-runs")
    marks = places_of(some.filter("kind = 1"), "marks")
    # Places are far smaller than texts: hashing them spares sorting the texts.
    both = marks.join(runs.withColumnRenamed("_row", "_run"), F.col("_row") == F.col("_run"), "left").select("_row", "runs", "marks")
    both = released(both, "spans-marks", some)
    rows = _rows(documents, id_col, text_col)
    windows = released(marked_windows(rows.join(both.hint("shuffle_hash"), F.col("row_hash") == F.col("_row")), settings), "spans-windows", both)
    later = released(later_ones(windows, "spans-first-windows"), "spans-later", windows)
    found = places_of(later, "windows").withColumnRenamed("_row", "_window")
    places = runs.join(found, F.col("_row") == F.col("_window"), "full_outer").select(F.coalesce("_row", "_window").alias("_row"), "runs", "windows")
    places = released(places, "spans-removed", runs, later)
    rows = rows.join(places.hint("shuffle_hash"), F.col("row_hash") == F.col("_row"), "left").select("doc_id", "text", "runs", "windows")
    schema = pa.schema([("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                ids, texts, runs, windows = (c.to_pylist() for c in batch.slice(at, 512).columns)
                out: list[list] = [ids, [], [], []]
                for text, own, more in zip(texts, runs, windows, strict=True):
                    raw = (text or "").encode()
                    out[1].append(len(piece_words(raw, settings)))
                    rest, gone = without(raw, own or [], more or [], settings) if own or more else (raw, 0)
                    out[2].append(gone)
                    out[3].append(None if text is None else rest.decode())
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return rows.mapInArrow(cut, "doc_id long, n_pieces long, n_removed long, text string")
