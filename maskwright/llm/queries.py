"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(column: str, by: int, held: int) -> Column:
    """Whether crc32 of the identifier as text leaves that remainder; false for a null identifier."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string")), F.lit(by)) == held, F.lit(False))


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskwright.llm import langid

    docs = table(spark, sf_dir, "documents")
    held = remainder("doc_id", 3, 1)
    model = langid.train(docs.filter(~held & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("id"), "lang", "text"))
    return langid.identify(docs, model, held_out=held)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskwright.llm import gbquality

    docs = table(spark, sf_dir, "documents")
    held = remainder("doc_id", 4, 2)
    model = gbquality.train(docs, table(spark, sf_dir, "labels").filter(~held))
    scored = gbquality.classify(docs, model, held_out=held)
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op2_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskwright.llm.repetition import repetition

    return repetition(table(spark, sf_dir, "documents")).drop("repeat_spans")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskwright.llm import mixture

    return mixture.taken_words(mixture.mix(table(spark, sf_dir, "documents")))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskwright.llm.lengthpack import pack

    return pack(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskwright.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskwright.llm.pii_lstm import default_tagger, personal_data

    return personal_data(table(spark, sf_dir, "documents"), default_tagger())


def op5_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskwright.llm.permindex import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskwright.llm.sentspan import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskwright.llm.licences import scan_licences

    return scan_licences(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


SPACE = r"\x20\x09-\x0D"
#: Pieces of up to 16 words, runs of three, and windows of 51 words; the first of each group by doc_id and place. w51 is made of
#: hashes of 2, 4, ... 32 words and the last 32 again.
SENTENCE_SPANS = rf"""
WITH lines AS (SELECT doc_id, generate_subscripts(ls, 1) AS l, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
words AS (SELECT doc_id, l, generate_subscripts(ws, 1) AS w, unnest(ws) AS word FROM (SELECT doc_id, l, regexp_extract_all(line, '[^{SPACE}]+') AS ws FROM lines)),
sentences AS (SELECT *, coalesce(sum(CASE WHEN right(word, 1) IN ('.', '!', '?') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, l ORDER BY w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM words),
cut AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, l, s ORDER BY w) - 1) // 16 AS c FROM sentences),
pieces AS (SELECT doc_id, l, s, c, string_agg(word, ' ' ORDER BY w) AS piece, row_number() OVER (PARTITION BY doc_id ORDER BY l, s, c) AS p FROM cut GROUP BY doc_id, l, s, c),
runs AS (SELECT doc_id, p, piece, lead(piece, 1) OVER own AS second, lead(piece, 2) OVER own AS third FROM pieces WINDOW own AS (PARTITION BY doc_id ORDER BY p)),
later AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY piece, second, third ORDER BY doc_id, p) AS nth FROM runs WHERE third IS NOT NULL) WHERE nth > 1),
gone AS (SELECT DISTINCT doc_id, p + d AS p FROM later, (VALUES (0), (1), (2)) AS t(d)),
placed AS (SELECT cut.doc_id, cut.l, cut.w, word, pieces.p, row_number() OVER (PARTITION BY cut.doc_id ORDER BY cut.l, cut.w) AS i
  FROM cut JOIN pieces ON pieces.doc_id = cut.doc_id AND pieces.l = cut.l AND pieces.s = cut.s AND pieces.c = cut.c),
w2 AS (SELECT doc_id, i, md5(word || ' ' || lead(word) OVER own) AS h FROM placed WINDOW own AS (PARTITION BY doc_id ORDER BY i)),
w4 AS (SELECT doc_id, i, md5(h || lead(h, 2) OVER own) AS h FROM w2 WINDOW own AS (PARTITION BY doc_id ORDER BY i)),
w8 AS (SELECT doc_id, i, md5(h || lead(h, 4) OVER own) AS h FROM w4 WINDOW own AS (PARTITION BY doc_id ORDER BY i)),
w16 AS (SELECT doc_id, i, md5(h || lead(h, 8) OVER own) AS h FROM w8 WINDOW own AS (PARTITION BY doc_id ORDER BY i)),
w32 AS (SELECT doc_id, i, md5(h || lead(h, 16) OVER own) AS h FROM w16 WINDOW own AS (PARTITION BY doc_id ORDER BY i)),
w51 AS (SELECT doc_id, i, h || lead(h, 19) OVER own AS h FROM w32 WINDOW own AS (PARTITION BY doc_id ORDER BY i)),
again AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1 AS later FROM w51 WHERE h IS NOT NULL),
inside AS (SELECT placed.doc_id, placed.l, placed.i, placed.p, word, coalesce(max(CASE WHEN later THEN 1 ELSE 0 END) OVER
  (PARTITION BY placed.doc_id ORDER BY placed.i ROWS BETWEEN 50 PRECEDING AND CURRENT ROW), 0) = 1 AS passage
  FROM placed LEFT JOIN again ON again.doc_id = placed.doc_id AND again.i = placed.i),
marked AS (SELECT inside.*, passage OR gone.p IS NOT NULL AS removed FROM inside LEFT JOIN gone ON gone.doc_id = inside.doc_id AND gone.p = inside.p),
by_line AS (SELECT doc_id, l, count(DISTINCT p) AS n, count(DISTINCT CASE WHEN removed THEN p END) AS r, string_agg(word, ' ' ORDER BY i) FILTER (NOT removed) AS rest FROM marked GROUP BY doc_id, l),
kept AS (SELECT lines.doc_id, lines.l, coalesce(n, 0) AS n, coalesce(r, 0) AS r, CASE WHEN coalesce(r, 0) = 0 THEN line ELSE rest END AS line FROM lines LEFT JOIN by_line ON by_line.doc_id = lines.doc_id AND by_line.l = lines.l)
SELECT documents.doc_id, coalesce(sum(n), 0)::BIGINT AS n_pieces, coalesce(sum(r), 0)::BIGINT AS n_removed,
  CASE WHEN any_value(documents.text) IS NOT NULL THEN coalesce(string_agg(line, chr(10) ORDER BY l) FILTER (line IS NOT NULL), '') END AS text
FROM documents LEFT JOIN kept ON kept.doc_id = documents.doc_id GROUP BY documents.doc_id
"""

#: Windows of eight words, and of three for the limit on short repeats; the longest repeat is the longest run of equal windows at one distance, and seven words.
REPETITION = rf"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT r, generate_subscripts(ws, 1) AS w, unnest(ws) AS word FROM (SELECT r, regexp_extract_all(text, '[^{SPACE}]+') AS ws FROM texts)),
windows AS (SELECT *, string_agg(word, ' ') OVER (PARTITION BY r ORDER BY w ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS g,
  count(*) OVER (PARTITION BY r ORDER BY w ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS size FROM words),
twice AS (SELECT *, CASE WHEN size = 8 AND count(*) OVER (PARTITION BY r, size, g) > 1 THEN 1 ELSE 0 END AS again FROM windows),
inside AS (SELECT r, word, max(again) OVER (PARTITION BY r ORDER BY w ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS covered FROM twice),
threes AS (SELECT r, w, word, word || ' ' || lead(word, 1) OVER own || ' ' || lead(word, 2) OVER own AS g FROM words WINDOW own AS (PARTITION BY r ORDER BY w)),
three_twice AS (SELECT r, w, word, CASE WHEN g IS NOT NULL AND count(*) OVER (PARTITION BY r, g) > 1 THEN 1 ELSE 0 END AS again FROM threes),
three_inside AS (SELECT r, word, max(again) OVER (PARTITION BY r ORDER BY w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS covered FROM three_twice),
short AS (SELECT r, sum(CASE WHEN covered = 1 THEN length(word) ELSE 0 END)::BIGINT AS short_chars FROM three_inside GROUP BY r),
counts AS (SELECT r, count(*) AS n_words, sum(length(word))::BIGINT AS word_chars, sum(covered)::BIGINT AS n_repeat_words,
  sum(CASE WHEN covered = 1 THEN length(word) ELSE 0 END)::BIGINT AS repeat_chars FROM inside GROUP BY r),
pairs AS (SELECT a.r, b.w - a.w AS apart, a.w FROM twice a JOIN twice b ON a.r = b.r AND a.g = b.g AND a.w < b.w WHERE a.again = 1 AND b.again = 1),
islands AS (SELECT r, apart, w - row_number() OVER (PARTITION BY r, apart ORDER BY w) AS island FROM pairs),
longest AS (SELECT r, max(n) + 7 AS longest_repeat FROM (SELECT r, count(*) AS n FROM islands GROUP BY r, apart, island) GROUP BY r),
lines AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM texts) WHERE regexp_matches(line, '[^{SPACE}]') GROUP BY r),
whole AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(repeat_chars, 0) AS repeat_chars, coalesce(longest_repeat, 0) AS longest_repeat,
  coalesce(short_chars, 0) AS short_chars FROM texts LEFT JOIN short USING (r) LEFT JOIN counts USING (r) LEFT JOIN longest USING (r) LEFT JOIN lines USING (r))
SELECT * EXCLUDE (short_chars), n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND short_chars <= 0.5::DOUBLE * word_chars AND repeat_chars <= 0.3::DOUBLE * word_chars AND (longest_repeat < 24 OR longest_repeat <= 0.25::DOUBLE * n_words) AS kept
FROM whole
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_repetition": REPETITION, "op7_sentence_spans": SENTENCE_SPANS}
