"""Mixing sources to target weights by temperature (operator 2).

A source's weight is its share of tokens raised to an exponent. The exponent is found by bisection: the largest that
meets a target entropy, or the smallest repetition that a limit allows. Weights become a budget of tokens for each source, and the
budget is realised as epochs: each epoch is a permutation of the source's documents, the last one
cut where the budget ends. The stream is laid out in blocks that each hold every source in its weight.

Permutations come from a hash, and places in them from prefix sums in two steps (over hash buckets,
then inside a bucket), so no source, however large, passes through one task. Only mix_documents, which lays the texts themselves out, shuffles them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Stored, keep_small_side

MAX_REPEATS = 2.0
BLOCK_TOKENS = 1_000_000
SEED = "mix"
ITERATIONS = 50
#: A plan of so many sources at most is broadcast; a larger one is joined by a shuffle.
BROADCAST_SOURCES = 100_000
TOKEN = r"[^ \t\n\r\f]+"


@dataclass
class Share:
    source: str | None
    total: int
    weight: float
    repeats: float
    full: int  # whole epochs
    rest: int  # tokens of the last, partial one

    @property
    def quota(self) -> int:
        return self.full * self.total + self.rest


def entropy(totals: list[int], alpha: float) -> float:
    most = max(totals)
    powers = [(t / most) ** alpha for t in totals]
    whole = sum(powers)
    return -sum(p / whole * math.log(p / whole) for p in powers if p)


def find_exponent(totals: list[int], max_repeats: float | None, target_entropy: float | None) -> float:
    """In [0, 1]: 1 keeps the corpus's shares, 0 weighs all sources alike.

    With target_entropy: the largest exponent whose weights have this entropy (nats) or more, 0 if none has. Without: the
    smallest under which no source is repeated more than max_repeats times while the largest is used
    once. If both are given, the limit prevails. With neither, 1.
    """
    if len(totals) < 2 or (max_repeats is None and target_entropy is None):
        return 1.0
    ratio = min(totals) / max(totals)
    low, high = 0.0, 1.0
    if target_entropy is not None:
        for _ in range(ITERATIONS):
            mid = (low + high) / 2
            low, high = (mid, high) if entropy(totals, mid) >= target_entropy else (low, mid)
        alpha, low, high = low, 0.0, 1.0
        if max_repeats is None or ratio ** (alpha - 1) <= max_repeats:
            return alpha
    if max_repeats is not None and ratio**-1.0 <= max_repeats:
        return 0.0
    for _ in range(ITERATIONS):
        mid = (low + high) / 2
        low, high = (low, mid) if ratio ** (mid - 1) <= max_repeats else (mid, high)
    return high


def plan(totals: list[tuple[str | None, int]], max_repeats: float | None = MAX_REPEATS, target_entropy: float | None = None, budget_tokens: int | None = None) -> list[Share]:
    """Shares by source. Without a budget, it is the smallest that uses every document at least once, so nothing is lost.

    A source without tokens has weight 0; its documents are taken once. Under a budget that is too small for its share, a source
    is used in part; under a large one, repeats can pass the limit, as the budget says so.
    """
    some = [t for _, t in totals if t > 0]
    out = []
    alpha = find_exponent(some, max_repeats, target_entropy) if some else 1.0
    most = max(some, default=1)
    whole = sum((t / most) ** alpha for t in some)
    for source, total in totals:
        if total <= 0:
            out.append(Share(source, 0, 0.0, 1.0, 1, 0))
            continue
        weight = (total / most) ** alpha / whole
        repeats = round((total / most) ** (alpha - 1) if budget_tokens is None else weight * budget_tokens / total, 9)
        full = math.floor(repeats)
        out.append(Share(source, total, weight, repeats, full, math.floor((repeats - full) * total)))
    return out


def _name(column):
    return F.when(column.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), column.cast("string")))


def _order(key, epoch):
    return F.md5(F.concat(F.lit(f"{SEED}:"), epoch.cast("string"), F.lit(":"), F.coalesce(key.cast("string"), F.lit(""))))


def _shares(spark: SparkSession, sizes: DataFrame, **limits) -> tuple[list[Share], DataFrame]:
    found = sizes.groupBy("s").agg(F.sum("n").alias("t")).orderBy("s").collect()
    shares = plan([(r["s"], r["t"] or 0) for r in found], **limits)
    kinds = {"source": pa.string(), "total": pa.int64(), "weight": pa.float64(), "full": pa.int64(), "rest": pa.int64(), "quota": pa.int64()}
    # not from a list: Python processes on the executors would make its rows and stay for a minute
    table = spark.createDataFrame(pa.table({k: pa.array([getattr(x, k) for x in shares], kind) for k, kind in kinds.items()})).withColumnRenamed("source", "s")
    return shares, keep_small_side(table, len(shares), BROADCAST_SOURCES)


def _uses(docs: DataFrame, text: str, key: str, source: str, block_tokens: int, **limits) -> tuple[DataFrame, int]:
    """(k, id, source, epoch, block, weight, sort_key), a row for each use of a document, id being a hash of key and text; and the number of blocks."""
    k, s, t = F.col(f"`{key}`"), F.col(f"`{source}`"), F.col(f"`{text}`")
    sizes = docs.select(k.alias("k"), F.xxhash64(k, t).alias("id"), s.alias("source"), _name(s).alias("s"), F.coalesce(F.regexp_count(t, F.lit(TOKEN)), F.lit(0)).cast("bigint").alias("n"))
    shares, table = _shares(docs.sparkSession, sizes, **limits)
    blocks = max(1, math.ceil(sum(x.quota for x in shares) / block_tokens))
    uses = sizes.join(table, "s").withColumn("epoch", F.explode(F.expr("sequence(0, full)"))).filter("epoch < full or rest > 0")
    uses = uses.withColumn("h", _order(F.col("k"), F.col("epoch"))).withColumn("bucket", F.substring("h", 1, 3))
    cell = ["s", "epoch", "bucket"]
    sums = uses.groupBy(*cell).agg(F.sum("n").alias("b")).withColumn("before", F.sum("b").over(Window.partitionBy("s", "epoch").orderBy("bucket")) - F.col("b")).drop("b")
    placed = uses.join(sums.hint("shuffle_hash"), cell).withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy(*cell).orderBy("h")))
    taken = placed.filter("epoch < full or upto <= rest")
    at = F.expr(f"cast((epoch * total + upto - n) as decimal(38,0)) * {blocks} div greatest(quota, 1)")
    return taken.select("k", "id", "source", "epoch", F.least(at, F.lit(blocks - 1)).cast("bigint").alias("block"), "weight", F.substring("h", 1, 16).alias("sort_key")), blocks


def mixture(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", block_tokens: int = BLOCK_TOKENS, **limits) -> DataFrame:
    """(key, source, epoch, block, weight, sort_key): a row for each use of a document.

    weight is its source's; sort_key orders the permutation inside the block. limits are those of plan(). Tokens are runs of other
    characters than white space. NULL sources form a source of their own; NULL and empty texts have no token and go with
    their epoch; rows with a NULL or repeated id are separate documents that tie in the permutation, and rows that tie at the
    end of the budget are taken together or not at all. An empty table gives an empty result. A
    column of the input is only read if named.
    """
    uses, _ = _uses(docs, text, key, source, block_tokens, **limits)
    return uses.select(F.col("k").alias(key), F.col("source").alias(source), "epoch", "block", "weight", "sort_key")


def mix_documents(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", block_tokens: int = BLOCK_TOKENS, **limits) -> DataFrame:
    """The rows of docs, each as often as mixture() uses it, in the order of the mixture: each partition holds successive blocks, sorted by block and permutation.

    Columns stay as they are; names that begin with __wa_ are reserved. Written to files, the blocks lie in them one behind the other. NULLs, empty texts and tables
    are as in mixture(); rows that repeat both id and text all stand where the first of them does. Rows get their places by a join on a
    hash of id and text, and are moved once more to the partition of their block; no task holds a source or sorts more than its blocks.
    """
    store = Stored(docs.sparkSession, "mixing")
    uses, blocks = _uses(docs, text, key, source, block_tokens, **limits)
    once = uses.groupBy("id", "epoch").agg(F.min(F.struct("block", "sort_key")).alias("at"))
    places = store.write(once.groupBy("id").agg(F.collect_list(F.struct("at.block", "at.sort_key", "epoch")).alias("__wa_at")), "places")
    placed = docs.withColumn("__wa_id", F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`"))).join(places.withColumnRenamed("id", "__wa_id").hint("merge"), "__wa_id")
    spread = placed.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode("__wa_at").alias("__wa_at"))
    parts = max(1, min(blocks, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    laid = spread.repartitionById(parts, F.expr(f"cast(cast(__wa_at.block as decimal(38,0)) * {parts} div {blocks} as int)")).sortWithinPartitions("__wa_at.block", "__wa_at.sort_key", "__wa_at.epoch")
    return laid.select(*[F.col(f"`{c}`") for c in docs.columns])


MIXTURE_SQL = rf"""
WITH RECURSIVE sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{TOKEN}')) AS n FROM documents),
totals AS (SELECT source, CAST(sum(n) AS BIGINT) AS total FROM sizes GROUP BY source),
ends AS (SELECT CAST(min(total) AS DOUBLE) / max(total) AS ratio, max(total) AS most, count(*) AS k FROM totals WHERE total > 0),
halve AS (
  SELECT 0 AS i, CAST(0 AS DOUBLE) AS low, CAST(1 AS DOUBLE) AS high FROM ends
  UNION ALL
  SELECT i + 1,
    CASE WHEN pow(ratio, (low + high) / 2 - 1) <= {MAX_REPEATS} THEN low ELSE (low + high) / 2 END,
    CASE WHEN pow(ratio, (low + high) / 2 - 1) <= {MAX_REPEATS} THEN (low + high) / 2 ELSE high END
  FROM halve, ends WHERE i < {ITERATIONS}),
exponent AS (
  SELECT CASE WHEN k < 2 THEN 1.0 WHEN pow(ratio, -1) <= {MAX_REPEATS} THEN 0.0 ELSE high END AS alpha, most
  FROM halve, ends WHERE i = {ITERATIONS}),
whole AS (SELECT sum(pow(CAST(total AS DOUBLE) / most, alpha)) AS w FROM totals, exponent WHERE total > 0),
repeats AS (
  SELECT source, total, CASE WHEN total > 0 THEN pow(CAST(total AS DOUBLE) / most, alpha) / w ELSE 0 END AS weight,
    CASE WHEN total > 0 THEN round(pow(CAST(total AS DOUBLE) / most, alpha - 1), 9) ELSE 1 END AS r
  FROM totals, exponent, whole),
plan AS (
  SELECT source, total, weight, CAST(floor(r) AS BIGINT) AS whole_epochs, CAST(floor((r - floor(r)) * total) AS BIGINT) AS rest
  FROM repeats),
budget AS (SELECT greatest(1, CAST(ceil(sum(whole_epochs * total + rest) / {float(BLOCK_TOKENS)}) AS BIGINT)) AS blocks FROM plan),
uses AS (
  SELECT s.doc_id, s.source, s.n, p.total, p.weight, p.whole_epochs, p.rest, e.epoch,
    md5('{SEED}:' || e.epoch || ':' || coalesce(CAST(s.doc_id AS VARCHAR), '')) AS h
  FROM sizes s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source
  JOIN (SELECT unnest(range(0, (SELECT max(whole_epochs) + 1 FROM plan))) AS epoch) e
    ON e.epoch < p.whole_epochs OR (e.epoch = p.whole_epochs AND p.rest > 0)),
placed AS (SELECT *, sum(n) OVER (PARTITION BY source, epoch ORDER BY h) AS upto FROM uses)
SELECT doc_id, source, epoch,
  CAST(least(blocks - 1, (epoch * total + upto - n) * CAST(blocks AS HUGEINT) // greatest(whole_epochs * total + rest, 1)) AS BIGINT) AS block,
  round(weight, 9) AS weight, substr(h, 1, 16) AS sort_key
FROM placed, budget WHERE epoch < whole_epochs OR upto <= rest
"""
