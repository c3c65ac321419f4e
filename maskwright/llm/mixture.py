"""Mixing sources to target weights, with DataFrame functions only.

Each source's words, in a pseudorandom order of its documents, form a stream that is cut into blocks of fixed length
(the last one may be shorter). The quota of a source is the number of blocks whose expected words are its target.
The output has as many slots as the quotas together, dealt into shards of fixed size. Every slot draws a source with
the probability of its quota, by a hash of shard and slot: the counts of sources in a shard are a multinomial draw,
independent of those in other shards. The draws of a source are numbered in a pseudorandom order of slots. What it draws
beyond its quota is settled in the end: those slots, which lie in all shards, go in a pseudorandom order to the sources that
drew less than their quota.

The n-th slot of a source goes to epoch n div blocks, and a permutation of that source and epoch gives the block, so no
block is taken again before all have been. Slots and blocks meet in a join by source and block.

Targets: sources in code point order (null last) weigh 1, 2, 3, 1, ...; each gets its share of all words by weight,
but no more than `most_epochs` times its own; what is left goes to the others by weight.

Defined results: a null or empty text has size 0 and takes 0. Documents of a null source form a source. Rows that
share an identifier are told apart by a hash of the text; rows alike in both are interchangeable. An empty table, or
one without words, gives targets and takings of 0. Extra columns are ignored. A document's words may be cut anywhere
by block borders.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.llm.runindex import permuted, running_sum
from maskwright.llm.store import written
from maskwright.operators.numbering import numbered, ordered_sums

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class MixSettings:
    """chunk: slots or draws that one row of a step stands for. broadcast_sources: the table of sources (a row each) is
    broadcast only up to so many rows."""

    block_words: int = 64
    shard_slots: int = 4096
    most_epochs: int = 3
    chunk: int = 4096
    broadcast_sources: int = 2000


@dataclass(frozen=True)
class Mix:
    """documents: a row for each input row, with sid, start and size in its source's stream. taken: a row for each
    slot and document in it: shard, slot, sid, epoch, block, start of the document, first word and words."""

    documents: DataFrame
    taken: DataFrame


def targets(sizes: DataFrame, most_epochs: int) -> DataFrame:
    """sizes: a row for each source, with source_size. Adds sid, weight and target.

    Caps bind in the order of cap over weight; a source is capped if its cap is at most its share of what the sources
    before it leave. Sums in an order run over ranges of it, so sources may be as many as rows.
    """
    ranked = numbered(sizes, (F.col("source").isNull(), "source"), "sid").withColumn("weight", F.pmod(F.col("sid") - 1, F.lit(3)) + 1)
    ranked = ranked.withColumn("_cap", F.col("source_size") * most_epochs)
    every = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("words"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weights")).first()
    ranked = ordered_sums(ranked, (F.col("_cap") / F.col("weight"), "sid"), {"_capped": "_cap", "_passed": "weight"})
    left, weights = every["words"] - F.col("_capped"), every["weights"] - F.col("_passed")
    ranked = written(ranked.withColumn("_bound", F.col("_cap") * weights <= F.col("weight") * left), "mix-targets")
    bound = ranked.filter("_bound").agg(F.coalesce(F.sum("_cap"), F.lit(0)).alias("words"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weights")).first()
    level = (every["words"] - bound["words"]) / max(1, every["weights"] - bound["weights"])
    target = F.when(F.col("_bound"), F.col("_cap").cast("double")).otherwise(F.col("weight") * F.lit(float(level)))
    return ranked.withColumn("target", target).select(*sizes.columns, "sid", "weight", "target")


def row_hashes(id_col: str, source_col: str, text: Column) -> dict[str, Column]:
    """What tells rows apart: a hash of identifier and source, and one of the text."""
    return {"doc_hash": F.xxhash64(F.col(id_col), F.col(source_col), F.lit(5)), "text_hash": F.xxhash64(text)}


def mix(documents: DataFrame, settings: MixSettings = MixSettings(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> Mix:
    spark, length = documents.sparkSession, settings.block_words
    text = F.coalesce(documents[text_col].cast("string"), F.lit(""))
    sized = documents.select(
        documents[id_col].alias("doc_id"),
        documents[source_col].cast("string").alias("source"),
        *[c.alias(k) for k, c in row_hashes(id_col, source_col, text).items()],
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
    )
    sized = written(sized, "mix-sizes")
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows")), settings.most_epochs)
    sources = sources.withColumn("blocks", F.ceil(F.col("source_size") / length).cast("long"))
    quota = F.when(F.col("source_size") > 0, F.round(F.col("target") * F.col("blocks") / F.col("source_size"))).otherwise(F.lit(0.0)).cast("long")
    sources = sources.withColumn("quota", F.least(quota, F.col("blocks") * settings.most_epochs))
    sources = written(ordered_sums(sources, ("sid",), {"first_slot": "quota"}), "mix-sources")
    facts = sources.agg(F.count("*").alias("n"), F.coalesce(F.sum("quota"), F.lit(0)).alias("slots")).first()
    few = few_or_all(sources, facts["n"], settings)
    placed = sized.join(few.select(F.col("source").alias("_source"), "sid", "source_size", "target"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    placed = written(running_sum(placed, sized.count(), "sid", "size", ["doc_hash", "text_hash", "size"], "start"), "mix-places")

    filled = placed.filter("size > 0")
    blocks = filled.select("sid", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / length), F.floor((F.col("start") + F.col("size") - 1) / length))).alias("block"))
    first = F.greatest(F.col("block") * length - F.col("start"), F.lit(0))
    last = F.least((F.col("block") + 1) * length - F.col("start"), F.col("size"))
    blocks = blocks.select("sid", "block", "start", first.alias("first_word"), (last - first).alias("words"))

    # Written before the join: else the optimiser pushes the join's null filter through all rounds, doubling it in each.
    return Mix(placed, written(drawn(sources, facts["slots"], facts["n"], settings), "mix-slots").join(blocks, ["sid", "block"]))


def drawn(sources: DataFrame, slots: int, n_sources: int, settings: MixSettings) -> DataFrame:
    """sources: sid, blocks, quota, first_slot. Rows sid, block, epoch, shard, slot: a block for each of `slots` slots.

    Quotas lie end to end on a line of `slots` places, and a slot draws a place: the chunk of the line that it falls into finds
    the source, by an equal join, however many sources there are.
    """
    spark, size = sources.sparkSession, settings.shard_slots
    chunk = max(settings.chunk, slots // 65536)
    chunks = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / chunk)))
    line = sources.filter("quota > 0").withColumn("_end", F.col("first_slot") + F.col("quota"))
    parts = F.sequence(F.floor(F.col("first_slot") / chunk), F.floor((F.col("_end") - 1) / chunk))
    line = line.select(F.col("sid").alias("own"), "first_slot", "_end", F.explode(parts).alias("chunk"))
    many = int(max(1, min(slots // chunk + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    every = spark.range(0, max(1, -(-slots // chunk)), 1, many).select((F.col("id") * chunk).alias("_from"))
    every = every.select(F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + chunk, F.lit(slots)) - 1)).alias("at")).filter(F.col("at") < slots)
    shard, slot = F.floor(F.col("at") / size), F.pmod("at", F.lit(size))
    place = F.pmod(F.xxhash64(shard, slot, F.lit(31)), F.lit(max(1, slots)))
    every = every.select(shard.alias("shard"), slot.alias("slot"), place.alias("_place")).withColumn("chunk", F.floor(F.col("_place") / chunk))
    found = every.join(line, "chunk").filter((F.col("_place") >= F.col("first_slot")) & (F.col("_place") < F.col("_end")))
    found = written(found.select("shard", "slot", F.col("own").alias("sid")), "mix-draws")

    totals = found.groupBy(F.col("sid").alias("own")).agg(F.count("*").alias("drawn"))
    whole = sources.join(totals, F.col("sid") == F.col("own"), "left").select("sid", "blocks", "quota", F.coalesce("drawn", F.lit(0)).alias("drawn"))
    whole = written(ordered_sums(whole, ("sid",), {"first_short": F.greatest(F.col("quota") - F.col("drawn"), F.lit(0))}), "mix-settled")
    # A pseudorandom order of slots, so that what is beyond a quota comes from all shards alike.
    found = running_sum(found.withColumn("_one", F.lit(1).cast("long")), slots, "sid", "_one", ["shard", "slot"], "nth")
    found = found.join(few_or_all(whole, n_sources, settings).select("sid", "quota"), "sid")
    found = written(found.select("sid", "shard", "slot", "nth", "quota"), "mix-numbered")

    fine = found.filter("nth < quota").select("sid", "nth", "shard", "slot")
    over = ordered_sums(found.filter("nth >= quota"), (F.xxhash64("shard", "slot", F.lit(37)), "shard", "slot"), {"_turn": F.lit(1).cast("long")})
    short = whole.filter("drawn < quota").select("sid", "quota", "drawn", "first_short", chunks(F.col("quota") - F.col("drawn")).alias("_c"))
    short = short.select("sid", "drawn", "quota", "first_short", F.explode(F.sequence(F.col("_c") * chunk, F.least((F.col("_c") + 1) * chunk, F.col("quota") - F.col("drawn")) - 1)).alias("_k"))
    short = short.select("sid", (F.col("drawn") + F.col("_k")).alias("nth"), (F.col("first_short") + F.col("_k")).alias("_turn"))
    slots_of = fine.unionByName(short.join(over.select("_turn", "shard", "slot"), "_turn").select("sid", "nth", "shard", "slot"))
    slots_of = written(slots_of.join(few_or_all(sources, n_sources, settings).select("sid", "blocks"), "sid"), "mix-settled-slots")
    turns = slots_of.select("sid", "shard", "slot", "blocks", F.floor(F.col("nth") / F.col("blocks")).alias("epoch"), F.pmod("nth", "blocks").alias("turn"))
    return permuted(turns, "turn", "blocks", ["sid", "epoch"], "block").select("sid", "block", "epoch", "shard", "slot")


def few_or_all(sources: DataFrame, n: int, settings: MixSettings) -> DataFrame:
    """The table of sources, to be broadcast if its size, which is checked, is small."""
    return F.broadcast(sources) if n <= settings.broadcast_sources else sources


def taken_words(mixed: Mix) -> DataFrame:
    """A row for each input row: doc_id, size, source_size, target, taken."""
    sums = mixed.taken.groupBy(F.col("sid").alias("_sid"), F.col("start").alias("_start")).agg(F.sum("words").alias("taken"))
    held = (F.col("sid") == F.col("_sid")) & (F.col("start") == F.col("_start")) & (F.col("size") > 0)
    found = mixed.documents.join(sums, held, "left")
    return found.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(documents: DataFrame, mixed: Mix) -> DataFrame:
    """The mix as documents: a row for each run of neighbouring blocks of a document taken in one epoch.

    Returns doc_id, text, lang, source and n_chars, so `documents` must have those columns; a run that is the whole document keeps
    its text as it is, any other run keeps its words with the white space before them.
    """
    runs = mixed.taken.select("sid", "start", "epoch", "block", "first_word", "words")
    order = Window.partitionBy("sid", "start", "epoch").orderBy("block")
    runs = runs.withColumn("_new", F.when(F.lag("block").over(order) == F.col("block") - 1, 0).otherwise(1))
    runs = runs.withColumn("_run", F.sum("_new").over(order)).groupBy("sid", "start", "epoch", "_run")
    runs = runs.agg(F.min("first_word").alias("first"), F.sum("words").alias("words"))
    runs = runs.groupBy("sid", "start").agg(F.array_sort(F.collect_list(F.struct("epoch", "first", "words"))).alias("runs"))
    runs = runs.join(mixed.documents.filter("size > 0").select("sid", "start", "size", "doc_hash", "text_hash"), ["sid", "start"])

    texts = documents.select("doc_id", "text", "lang", "source").withColumns(row_hashes("doc_id", "source", F.coalesce("text", F.lit(""))))
    texts = texts.dropDuplicates(["doc_hash", "text_hash"])
    joined = texts.join(runs.select("doc_hash", "text_hash", "size", "runs"), ["doc_hash", "text_hash"])
    pieces = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    whole = lambda r: (r["first"] == 0) & (r["words"] == F.col("size"))
    cut = F.exists("runs", lambda r: ~whole(r))
    joined = joined.withColumn("pieces", F.when(cut, pieces)).withColumn("n_pieces", F.size("pieces"))
    part = lambda r: F.array_join(F.slice("pieces", (r["first"] + 1).cast("int"), r["words"].cast("int")), "")
    parts = F.transform("runs", lambda r: F.when(whole(r), F.col("text")).otherwise(part(r)))
    joined = joined.select("doc_id", F.explode(parts).alias("text"), "lang", "source", "n_pieces")
    return joined.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))
