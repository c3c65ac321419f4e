"""Rewriting texts with a mapping of any size, which is joined and never collected.

A text needs only the keys that occur in it, and more keys of the mapping change nothing. So each pass of the rewriter
lists what in a text may be a key, joins that with the mapping, and rewrites the text with its own part. Matches of the
patterns are keys as they are. Keys of the dictionaries may have several words: first the words of a text are joined with the
keys' first words, which tells what lengths to try where; then the pieces of those lengths are joined.

Passes follow each other, as one may find keys in what another has put in; each ends in a table. Rows are told apart by
a hash; of rows whose hashes meet, each gets the parts of all, which changes nothing.

Defined results: those of `rewrite.rewrite_texts` with the same mapping. Null texts stay null; an empty mapping or table
changes nothing; repeated rows stay.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.functions import fixed
from maskwright.operators import rewrite
from maskwright.operators.rewrite import HOST_EDGES, NAME_EDGES, Dictionary, Rewriter, lowered
from maskwright.store import dropped, join_hot, partitions, written

KEY, PART = "_rewrite_key", "_rewrite_part"
PASSES = (("emails",), ("fqdns",), ("usernames", "named_objects"), ("ip_addresses",), ("serial_numbers",))
SLICE = 256  # rows of a batch that are taken apart together

Lengths = dict[str, list[int]]


def first_words(word: str) -> list[str]:
    """The words under which the dictionary looks for keys that begin with this one: itself, and without a glued year."""
    glued = rewrite._YEAR.search(word)
    return [word, word[: glued.start()]] if glued and glued.start() else [word]


def pieces(text: str, lengths: Lengths, own: Dictionary) -> set[str]:
    """Parts of a text, of the lengths known for their first word, with neighbours that a key may have."""
    found = set()
    for at, word in own._starts(text):
        for first in first_words(word):
            for n in lengths.get(first, ()):
                end = at + n
                if end <= len(text) and own.edges.before.match(text, at) and own.edges.after.match(text, end):
                    found.add(text[at:end])
    return found


def listed(rows: DataFrame, found: Callable[..., Iterable[str]]) -> DataFrame:
    """Rows key, value: what `found` sees in the columns of a row but the first, which is its key."""
    schema = pa.schema([(KEY, pa.int64()), ("value", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                pairs = [(key, v) for key, *rest in zip(*(c.to_pylist() for c in batch.slice(at, SLICE).columns), strict=True) for v in found(*rest)]
                yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], f.type) for i, f in enumerate(schema)], schema=schema)

    return rows.mapInArrow(run, f"{KEY} long, value string")


def attached(rows: DataFrame, links: DataFrame, right: DataFrame, used: list[DataFrame]) -> DataFrame:
    """rows with the column PART: `own` of all values that the row is linked to. right: value, own (an array), one row for each
    value. A value may be in a third of all texts, so hot ones are dealt out. used gets the tables to delete in the end."""
    links = written(links.distinct(), "rewrite-links")
    counted = written(right.join(links.groupBy("value").agg(F.count("*").alias("n")), "value"), "rewrite-values")
    used += [links, counted]
    found = join_hot(links, counted, ["value"], "n", links.count(), partitions(rows))
    return rows.join(found.groupBy(KEY).agg(F.flatten(F.collect_list("own")).alias(PART)), KEY, "left")


def key_lengths(keys: DataFrame, edges: rewrite.Edges) -> DataFrame:
    """Rows value, own: the first words of keys, each with the lengths of its keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_pylist()
            firsts = [m[0] if (m := edges.words.match(k)) else k[:1] for k in own]
            yield pa.RecordBatch.from_arrays([pa.array(firsts, pa.string()), pa.array(map(len, own), pa.int32())], ["value", "n"])

    lengths = keys.select("value").mapInArrow(run, "value string, n int").groupBy("value").agg(F.collect_set("n").alias("lengths"))
    return lengths.select("value", F.array(F.struct("value", "lengths")).alias("own"))


def candidates(texts: DataFrame, category: str, part: DataFrame, used: list[DataFrame]) -> DataFrame:
    """Rows key, value: what in the texts may be a key of that category."""
    if category in ("fqdns", "usernames"):
        edges = HOST_EDGES if category == "fqdns" else NAME_EDGES
        same = lowered if category == "fqdns" else str
        own = Dictionary({}, edges)
        words = listed(texts, lambda text: {f for _, w in own._starts(same(text)) for f in first_words(w)})
        known = attached(texts, words, key_lengths(part, edges), used).filter(F.col(PART).isNotNull())
        return listed(known, lambda text, parts: pieces(same(text), {p["value"]: p["lengths"] for p in parts}, own))
    patterns = Rewriter({})
    seen = {
        "emails": lambda text: {m[0].lower() for m in patterns.email.finditer(text)},
        "ip_addresses": lambda text: {m[1] for m in patterns.address.finditer(text)},
        "serial_numbers": lambda text: {m[0] for m in patterns.digits.finditer(text)},
    }
    return listed(texts, seen[category])


def rewritten(rows: DataFrame, text_col: str) -> DataFrame:
    """Rows with the text rewritten by their part, which goes, and replacements added to."""
    names = [c for c in rows.columns if c != PART]
    at, before, part = (rows.columns.index(c) for c in (text_col, "replacements", PART))
    schema = rows.select(*names).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for text, said, parts in zip(batch.column(at).to_pylist(), batch.column(before).to_pylist(), batch.column(part).to_pylist(), strict=True):
                mapping: dict[str, dict[str, str]] = {}
                for p in parts or ():
                    mapping.setdefault(p["category"], {})[p["original"]] = p["pseudonym"]
                new, more = Rewriter(mapping).text(text) if mapping and text else (text, {})
                texts.append(new)
                counts.append(sorted([*said, *more.items()]))
            made = {at: pa.array(texts, pa.string()), before: pa.array(counts, pa.map_(pa.string(), pa.int64()))}
            yield pa.RecordBatch.from_arrays([made.get(i, c) for i, c in enumerate(batch.columns) if i != part], names)

    return rows.mapInArrow(run, schema)


def rewrite_joined(df: DataFrame, text_col: str, mapping: DataFrame) -> DataFrame:
    """df with a text column rewritten and `replacements` added. mapping: rows category, original, pseudonym, settled as by
    `rewrite.final_mapping`."""
    mapping = mapping.filter(F.col("category").isin(*fixed.CATEGORIES) & (F.col("original") != "") & (F.col("original") != F.col("pseudonym")))
    value = F.when(F.col("category") == "fqdns", F.lower("original")).otherwise(F.col("original"))
    mapping = written(mapping.groupBy("category", value.alias("value")).agg(F.min("pseudonym").alias("pseudonym")), "rewrite-mapping")
    there = {r["category"] for r in mapping.select("category").distinct().collect()}  # categories are few
    hashed = [c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    nothing = F.create_map().cast("map<string,long>").alias("replacements")
    rows = written(df.select("*", F.xxhash64(*hashed).alias(KEY), nothing), "rewrite-rows")
    for categories in (c for c in PASSES if there.intersection(c)):
        own = F.struct("category", F.col("value").alias("original"), "pseudonym")
        part = mapping.filter(F.col("category").isin(*categories)).groupBy("value").agg(F.collect_list(own).alias("own"))
        used = [rows]
        links = candidates(rows.select(KEY, text_col).filter(F.col(text_col).isNotNull()), categories[0], part, used)
        rows = written(rewritten(attached(rows, links, part, used), text_col), "rewrite-rows")
        for table in used:
            dropped(table)
    dropped(mapping)
    return rows.drop(KEY)


def rewrite_texts(df: DataFrame, text_col: str, mapping: DataFrame) -> DataFrame:
    """The same by the way that fits the mapping's size: broadcast up to rewrite.MOST_MAPPED rows, joined beyond. mapping
    is read twice, so it should be a table."""
    if mapping.limit(rewrite.MOST_MAPPED + 1).count() > rewrite.MOST_MAPPED:
        return rewrite_joined(df, text_col, mapping)
    return rewrite.rewrite_texts(df, text_col, rewrite.collected(mapping))
