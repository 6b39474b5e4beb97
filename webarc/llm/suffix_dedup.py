"""Repeated passages by a logarithmic family of suffix arrays (operator 9).

A passage is a run of words. The suffix array of a batch of documents holds suffixes in the order of their first PREFIX words
(as hashes); of every WINDOW neighbouring suffixes only the least are in it, and since equal passages of at
least MATCH words pick the same ones, none of those passages is missed. A new batch's array is merge-scanned with all existing
levels, which tells suffixes that begin alike; what is new becomes a level, and two levels of equal size merge into
one of the next size, so a batch meets no more levels than the logarithm of the number of batches.

Matches are then verified: in documents with matching suffixes, every run of MATCH words around one is compared with all the
others, and overlapping repeated runs join into passages. So the result is exact but for hash collisions (96 bits).
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BLANK_SQL, WORD_SQL, Stored, _powers, buffer_of, byte_classes, grams, keep_small_side, mix, slices, words

MATCH = 50
PREFIX = 16
BATCHES = 4
#: Documents with a match are picked by a broadcast of their ids up to so many; beyond, by a shuffle.
BROADCAST_IDS = 2_000_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _sliding(a: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each width neighbours, by doubling."""
    out, have = a, 1
    while have < width:
        step = min(have, width - have)
        out = pick(out[:-step], out[step:])
        have += step
    return out


def sampled(h: np.ndarray, row: np.ndarray, match: int = MATCH, prefix: int = PREFIX) -> tuple[np.ndarray, np.ndarray]:
    """(key, place) of the suffixes that are in an array, for words given by hash and row; place counts words over all rows."""
    window = match - prefix + 1
    g, r, at = grams(h, row, prefix, short=False)
    if len(g) < window:
        return g[:0], at[:0]
    least = _sliding(g, window, np.minimum)
    inside = r[: len(least)] == r[window - 1 :]  # the window lies in one text
    least = np.where(inside, least, np.uint64(0))
    pad = np.zeros(window - 1, np.uint64)
    most = _sliding(np.concatenate([pad, least, pad]), window, np.maximum)
    chosen = (most == g) & (g > 0)
    return g[chosen], at[chosen]


def _words(texts: pa.Array):
    raw, offs = buffer_of(texts)
    low = _LOWER[raw]
    h, row, start, end = words(low, offs, byte_classes(low))
    return raw, offs, h, row, start, end


def _array_of(match: int, prefix: int):
    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column(1)):
                _, _, h, row, _, _ = _words(batch.column(1).slice(a, b - a))
                key, at = sampled(h, row, match, prefix)
                first = np.searchsorted(row, row[at])
                of = pa.array(row[at])
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0).slice(a, b - a).take(of), batch.column(2).slice(a, b - a).take(of), pa.array((at - first).astype(np.int32))], names=["key", "id", "mark", "pos"])

    return run


def _neighbours(batches, same: list[str]):
    """Of sorted rows, for each batch: the columns, and whether a row agrees in the columns of same with the one before and with the one behind it. Rows equal in all columns count once."""
    carry, carried, names = None, False, []
    for batch in itertools.chain(batches, [None]):
        if batch is None and not carry:
            return
        names = batch.schema.names if batch is not None else names
        table = [np.asarray(c) for c in batch.columns] if batch is not None else [c[:0] for c in carry]
        if carry:
            table = [np.concatenate([c, t]) for c, t in zip(carry, table, strict=True)]
        if not len(table[0]):
            continue
        new = np.r_[True, np.any([t[1:] != t[:-1] for t in table], axis=0)]
        table = [t[new] for t in table]
        n = len(table[0])
        alike = np.all([table[names.index(c)][1:] == table[names.index(c)][:-1] for c in same], axis=0) if n > 1 else np.zeros(0, bool)
        before, behind = np.r_[carried if carry else False, alike], np.r_[alike, False]
        last = n if batch is None else n - 1
        carry, carried = [t[last:] for t in table] if last < n else None, bool(before[-1])
        if last:
            yield dict(zip(names, (t[:last] for t in table), strict=True)), before[:last], behind[:last]


def _merge_scan(batches):
    """Of entries sorted by (key, age, id, pos, mark): those that begin as another does (hit), and the first of each key that no level holds."""
    for t, before, behind in _neighbours(batches, ["key"]):
        hit, fresh = before | behind, ~before & (t["age"] == 1)
        for kind, rows in ((1, hit), (0, fresh)):
            at = np.flatnonzero(rows)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), *(pa.array(t[c][at]) for c in ("key", "id", "mark", "pos"))], names=["kind", "key", "id", "mark", "pos"])


class SuffixIndex:
    """The levels: (size in batches, table of (key, id, mark, pos) with each key once, in one level only). The mark tells texts of one id apart."""

    def __init__(self, spark: SparkSession, match: int = MATCH, prefix: int = PREFIX):
        self.spark, self.match, self.prefix = spark, match, prefix
        self.store, self.levels, self.made = Stored(spark, "suffix"), [], 0

    def add(self, texts: DataFrame, last: bool = False) -> DataFrame:
        """Takes a batch (id, t) in; (id, pos) of suffixes, of the batch or of older ones, that begin alike. With last, the levels aren't kept up."""
        marked = texts.select("id", "t", F.hash("t").alias("mark"))
        new = marked.mapInArrow(_array_of(self.match, self.prefix), "key bigint, id bigint, mark int, pos int").withColumn("age", F.lit(1))
        for _, level in self.levels:
            new = new.union(level.select("key", "id", "mark", "pos", F.lit(0).alias("age")))
        scanned = new.select("key", "age", "id", "pos", "mark").repartition("key").sortWithinPartitions("key", "age", "id", "pos", "mark").mapInArrow(_merge_scan, "kind int, key bigint, id bigint, mark int, pos int")
        self.made += 1
        scanned = self.store.write(scanned, f"scan{self.made}")
        hits = scanned.filter("kind = 1").select("id", "pos")
        if last:
            return hits
        self.levels.append((1, scanned.filter("kind = 0").select("key", "id", "mark", "pos")))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (n, a), (m, b) = self.levels.pop(), self.levels.pop()
            self.made += 1
            self.levels.append((n + m, self.store.write(a.union(b).repartition("key").sortWithinPartitions("key"), f"level{self.made}")))
        return hits


def _runs(match: int, prefix: int):
    """All runs of match words that hold a matching suffix's prefix: part, two hashes, id, text, first word, first and end character.

    The part follows from the least prefix in the run, so equal runs have the same, and neighbouring runs mostly do.
    """
    window = match - prefix + 1

    def run(batches):
        for batch in batches:
            ids, texts, marks, places = (batch.column(batch.schema.get_field_index(c)) for c in ("id", "t", "mark", "places"))
            for a, b in slices(texts):
                raw, offs, h, row, start, end = _words(texts.slice(a, b - a))
                m = len(h)
                head = np.searchsorted(row, np.arange(b - a + 1))
                part = places.slice(a, b - a)
                owner = np.repeat(np.arange(b - a), np.diff(np.asarray(part.offsets)))
                at = head[owner] + np.asarray(part.flatten(), np.int64)
                edge = np.zeros(m + match + 1, np.int64)
                at = at[at + prefix <= head[owner + 1]]
                low = np.maximum(at - (match - prefix), head[row[at]]) if len(at) else at
                np.add.at(edge, low, 1)
                np.add.at(edge, at + 1, -1)
                s = np.flatnonzero(np.cumsum(edge)[: max(0, m - match + 1)] > 0)
                s = s[row[s] == row[s + match - 1]] if len(s) else s
                g, _, place = grams(h, row, prefix, short=False)
                all_grams = np.full(m, ~np.uint64(0))
                all_grams[place] = g
                part_of = (_sliding(all_grams, window, np.minimum)[s] >> np.uint64(20) & np.uint64(0xFFFFF)).astype(np.int32) if m >= window else np.zeros(0, np.int32)
                p, inv = _powers(m + 1)
                both = []
                with np.errstate(over="ignore"):
                    for salt in (0, 0x5851F42D4C957F2D):
                        total = np.zeros(m + 1, np.uint64)
                        np.cumsum(mix(h ^ np.uint64(salt)) * p[:m], out=total[1:])
                        both.append(mix((total[s + match] - total[s]) * inv[s]))
                chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                base = chars[offs[:-1]]
                doc = row[s]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(part_of), pa.array(both[0].view(np.int64)), pa.array((both[1] >> np.uint64(32)).astype(np.uint32).view(np.int32)), ids.slice(a, b - a).take(pa.array(doc)), marks.slice(a, b - a).take(pa.array(doc)),
                        pa.array((s - head[doc]).astype(np.int32)), pa.array((chars[start[s]] - base[doc]).astype(np.int32)), pa.array((chars[end[s + match - 1]] - base[doc]).astype(np.int32)),
                    ],
                    names=["part", "h", "h2", "id", "mark", "word", "first", "stop"],
                )

    return run


def _repeated(batches):
    """Of runs sorted by hashes, then by place: those that come more than once, and whether one comes before."""
    for t, before, behind in _neighbours(batches, ["h", "h2"]):
        at = np.flatnonzero(before | behind)
        yield pa.RecordBatch.from_arrays([*(pa.array(t[c][at]) for c in ("id", "mark", "word", "first", "stop")), pa.array(before[at])], names=["id", "mark", "word", "first", "stop", "again"])


def _joined(match: int):
    """Of repeated runs sorted by document, again and word: neighbours and overlapping ones as one (word of the first and of the last run)."""

    def run(batches):
        held = None
        for batch in itertools.chain(batches, [None]):
            t = [np.asarray(c) if c.type != pa.bool_() else c.to_numpy(zero_copy_only=False) for c in batch.columns] if batch is not None else None
            if t is None or not len(t[0]):
                if batch is None and held is not None:
                    yield _spans(held)
                continue
            ident, mark, again, word, first, stop = t
            apart = np.r_[True, (ident[1:] != ident[:-1]) | (mark[1:] != mark[:-1]) | (again[1:] != again[:-1]) | (word[1:] > word[:-1] + match)]
            heads = np.flatnonzero(apart)
            tails = np.r_[heads[1:], len(word)] - 1
            got = [ident[heads], mark[heads], again[heads], word[heads], word[tails], first[heads], np.maximum.reduceat(stop, heads)]
            if held is not None:
                if all(held[k][0] == got[k][0] for k in range(3)) and got[3][0] <= held[4][0] + match:
                    got[3][0], got[5][0], got[6][0] = held[3][0], held[5][0], max(held[6][0], got[6][0])
                else:
                    yield _spans(held)
            yield _spans([c[:-1] for c in got])
            held = [c[-1:].copy() for c in got]

    return run


def _spans(columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["id", "mark", "again", "word", "last", "first", "stop"])


def repeated_passages(docs: DataFrame, text: str = "text", key: str = "doc_id", match: int = MATCH, prefix: int = PREFIX, batches: int = BATCHES) -> DataFrame:
    """(key, start, stop, n_words, is_removed): a row for each passage of at least match words whose every run of match words comes elsewhere too.

    start and stop count characters. Words are runs of letters, digits and marks (ASCII case aside), and each character of scripts without blanks; what stands between
    them doesn't count. A run stays where it comes first, by key, then by place: passages of such runs have is_removed false,
    those of later ones true; the two can overlap. Passages may repeat within a document or across documents.

    NULL keys and texts, empty texts and ones of fewer words have no row. Rows that repeat a key and its text count
    once; rows that repeat a key with other texts are documents of their own. An empty table gives an empty result. Texts are
    covered whole; columns but the two named aren't read. Keys are cast to bigint.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{text}`").cast("string").alias("t")).filter("id is not null and t is not null")
    index, found = SuffixIndex(spark, match, prefix), None
    for k in range(batches):
        batch = texts.filter(F.pmod(F.xxhash64("id"), F.lit(batches)) == k) if batches > 1 else texts
        hits = index.add(batch, last=k == batches - 1)
        found = hits if found is None else found.union(hits)
    places = index.store.write(found.groupBy("id").agg(F.array_sort(F.collect_set("pos")).alias("places")), "places")
    for k in range(1, index.made + 1):  # what the levels held is in places now
        index.store.drop(f"scan{k}")
        index.store.drop(f"level{k}")
    small = keep_small_side(places.select("id"), places.count(), BROADCAST_IDS)
    touched = texts.join(small, "id", "left_semi").withColumn("mark", F.hash("t")).join(places.hint("merge"), "id")
    runs = touched.select("id", "t", "mark", "places").mapInArrow(_runs(match, prefix), "part int, h bigint, h2 int, id bigint, mark int, word int, first int, stop int")
    again = runs.repartition("part").drop("part").sortWithinPartitions("h", "h2", "id", "word", "mark").mapInArrow(_repeated, "id bigint, mark int, word int, first int, stop int, again boolean")
    near = again.select("id", "mark", "again", "word", "first", "stop").sortWithinPartitions("id", "mark", "again", "word").mapInArrow(_joined(match), "id bigint, mark int, again boolean, word int, last int, first int, stop int")
    order = Window.partitionBy("id", "mark", "again").orderBy("word")
    before = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    joined = near.withColumn("apart", F.coalesce(F.col("word") > before + match, F.lit(True)).cast("int")).withColumn("passage", F.sum("apart").over(order)).groupBy("id", "mark", "again", "passage")
    spans = joined.agg(F.min("first").alias("start"), F.max("stop").alias("stop"), (F.max("last") - F.min("word") + match).alias("n_words"))
    return spans.select(F.col("id").alias(key), F.col("start").cast("bigint").alias("start"), F.col("stop").cast("bigint").alias("stop"), F.col("n_words").cast("bigint").alias("n_words"), F.col("again").alias("is_removed"))


PASSAGES_SQL = rf"""
WITH t AS (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
cut AS (SELECT doc_id, text, regexp_extract_all(text, '{WORD_SQL}|{BLANK_SQL}') AS xs FROM t),
tok AS (SELECT doc_id, text, unnest(xs) AS x, generate_subscripts(xs, 1) AS i FROM cut),
pos AS (SELECT *, CAST(sum(length(x)) OVER (PARTITION BY doc_id, text ORDER BY i) AS BIGINT) AS stop FROM tok),
doc AS (
  SELECT doc_id, text, list(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ORDER BY i) AS ws,
    list(stop - length(x) ORDER BY i) AS firsts, list(stop ORDER BY i) AS stops
  FROM pos WHERE regexp_full_match(x, '{WORD_SQL}') GROUP BY doc_id, text),
place AS (SELECT *, unnest(range(1, len(ws) - {MATCH - 2})) AS k FROM doc WHERE len(ws) >= {MATCH}),
run AS (
  SELECT doc_id, md5(text) AS mark, k, md5(array_to_string(ws[k:k + {MATCH - 1}], ' ')) AS h, firsts[k] AS first, stops[k + {MATCH - 1}] AS stop
  FROM place),
seen AS (SELECT *, count(*) OVER (PARTITION BY h) AS n, row_number() OVER (PARTITION BY h ORDER BY doc_id, k) > 1 AS again FROM run),
near AS (SELECT *, CASE WHEN k <= lag(k) OVER o + {MATCH} THEN 0 ELSE 1 END AS apart FROM seen WHERE n > 1 WINDOW o AS (PARTITION BY doc_id, mark, again ORDER BY k)),
joined AS (SELECT *, sum(apart) OVER (PARTITION BY doc_id, mark, again ORDER BY k) AS passage FROM near)
SELECT doc_id, min(first) AS start, max(stop) AS stop, max(k) - min(k) + {MATCH} AS n_words, again AS is_removed
FROM joined GROUP BY doc_id, mark, again, passage
"""
