"""Document fingerprints: threshold-scaled sketches of word shingles (operator 1).

A sketch keeps every shingle hash below a fixed fraction of the hash range. Unlike a sketch of fixed size, it grows with its document, so
sketches of very unequal documents, and unions of sketches, still estimate containment without bias. Everything is an
expression of built-in functions; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_JAVA, WORD_SQL

WORDS_A_SHINGLE = 5
#: The share of all hashes that is kept, as the first digits of an MD5 in hexadecimal: below 08 is 1/32.
BELOW = "08"


def sketch_of(text, k: int = WORDS_A_SHINGLE, below: str = BELOW):
    """Column: STRUCT<n_shingles, sketch> of a text column; the sketch is sorted and has 60-bit hashes."""
    ws = F.regexp_extract_all(F.lower(text), F.lit(WORD_JAVA), F.lit(0))
    last = lambda w: F.greatest(F.size(w) - (k - 1), F.least(F.size(w), F.lit(1)))
    hashed = lambda w: F.transform(F.sequence(F.lit(1), last(w)), lambda i: F.md5(F.concat_ws(" ", F.slice(w, i, k)).cast("binary")))
    kept = lambda w: F.when(F.size(w) > 0, F.filter(hashed(w), lambda h: h < below)).otherwise(F.array().cast("array<string>"))
    number = lambda h: F.conv(F.substring(h, 1, 15), 16, 10).cast("bigint")
    # The words stand in an array of one element, so that they are split once and not at each use.
    whole = F.transform(F.array(ws), lambda w: F.struct(last(w).cast("bigint").alias("n_shingles"), F.array_sort(F.array_distinct(F.transform(kept(w), number))).alias("sketch")))
    return F.when(text.isNotNull(), whole[0])


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = WORDS_A_SHINGLE, below: str = BELOW) -> DataFrame:
    """(key, n_shingles, sketch), one row for each row of docs.

    Words are runs of letters, digits and marks in lower case, and each character of scripts written without blanks. A text of fewer than k words
    is one shingle; one without words has none and an empty sketch; a NULL text has NULL in both. Equal texts have equal sketches.
    Very long texts are covered whole. Columns but the two named aren't read.
    """
    s = docs.select(F.col(f"`{key}`").alias("__wa_key"), sketch_of(F.col(f"`{text}`"), k, below).alias("__wa_s"))
    return s.select(F.col("__wa_key").alias(key), F.col("__wa_s.n_shingles").alias("n_shingles"), F.col("__wa_s.sketch").alias("sketch"))


def merge_sketches(sketches: DataFrame, by: list[str], sketch: str = "sketch") -> DataFrame:
    """(by..., sketch): the sketch of each group's documents together, which is that of their joined shingle sets. NULL sketches add nothing."""
    each = sketches.select(*by, F.explode_outer(sketch).alias("h")).distinct()
    return each.groupBy(*by).agg(F.array_sort(F.collect_list("h")).alias(sketch))


def containment(left: DataFrame, right: DataFrame, key: str = "doc_id", sketch: str = "sketch") -> DataFrame:
    """(left_id, right_id, shared, containment, jaccard) of pairs whose sketches meet.

    containment is the share of the left document's shingles that the right one has, estimated from the
    kept hashes; pairs that share none are left out, as are documents with an empty or NULL sketch and rows without a key. Rows that
    repeat a key are one document with the sketches of all. Hashes join by a shuffle; of a hash that many documents share, all
    pairs of these are results, so give documents without their exact copies.
    """

    def side(d: DataFrame, n: str) -> DataFrame:
        each = d.filter(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").alias(f"{n}_id"), F.explode(F.col(f"`{sketch}`")).alias("h")).distinct()
        return each.join(each.groupBy(f"{n}_id").agg(F.count("*").alias(f"{n}_n")), f"{n}_id")

    both = side(left, "left").join(side(right, "right"), "h").groupBy("left_id", "right_id", "left_n", "right_n").agg(F.count("*").alias("shared"))
    return both.select("left_id", "right_id", "shared", F.try_divide("shared", "left_n").alias("containment"), F.try_divide("shared", F.col("left_n") + F.col("right_n") - F.col("shared")).alias("jaccard"))


FINGERPRINTS_SQL = rf"""
WITH w AS (SELECT doc_id, text, regexp_extract_all(lower(text), '{WORD_SQL}') AS ws FROM documents),
h AS (
  SELECT doc_id, text IS NULL AS missing, CASE WHEN len(ws) > 0 THEN greatest(len(ws) - {WORDS_A_SHINGLE - 1}, 1) ELSE 0 END AS n,
    CASE WHEN len(ws) > 0 THEN list_transform(range(1, greatest(len(ws) - {WORDS_A_SHINGLE - 1}, 1) + 1),
      lambda i: md5(array_to_string(ws[i:i + {WORDS_A_SHINGLE - 1}], ' '))) ELSE [] END AS hs
  FROM w)
SELECT doc_id, CASE WHEN NOT missing THEN CAST(n AS BIGINT) END AS n_shingles,
  CASE WHEN NOT missing THEN coalesce(array_to_string(list_transform(list_sort(list_distinct(list_transform(
    list_filter(hs, lambda x: x < '{BELOW}'), lambda x: CAST('0x' || substr(x, 1, 15) AS BIGINT)))), lambda x: CAST(x AS VARCHAR)), ','), '') END AS sketch
FROM h
"""
