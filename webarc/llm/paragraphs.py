"""Near-duplicate paragraphs by MinHash banding (operator 4).

A text is cut at line ends and, as passages are often set into other lines, at sentence ends too. A piece of at least
MIN_WORDS words is a paragraph; shorter neighbours in a line are paragraphs in pairs, if both together are long enough.
Other short pieces are joined, also across line ends, and if they are too few, with words of their neighbours.
The bands are tuned to the threshold for a given recall, paragraphs that collide in a band are joined, their exact
Jaccard similarity decides, and connected paragraphs form a cluster of which the first one stays.
"""

from __future__ import annotations

import itertools
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, buffer_of, byte_classes, lead_points, mix, slices, words
from .ngram_join import Unseen, first_of_classes, gram_sets, linked_sets, named_sets, sent, set_hash

MIN_WORDS = 15
#: What short lines must have together to be a paragraph; sentences of one line need MIN_WORDS.
LINE_WORDS = 20
GRAM = 2
THRESHOLD = 0.7
RECALL = 0.97
MOST_HASHES = 64


def pieces(text: str, least: int = MIN_WORDS) -> list[tuple[int, int]]:
    """(start, stop) of the paragraphs of one text, in characters and in order; pairs of short neighbours may overlap."""
    raw, offs = buffer_of(pa.array([text]))
    _, start, stop = cut(raw, offs, least)
    chars = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
    return list(zip(chars[start].tolist(), chars[stop].tolist(), strict=True))


def _breaks(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of visible characters: whether a sentence or line ends behind each, and whether a line does."""
    lines = np.cumsum(np.r_[False, raw == 10])
    line = lines[start[1:]] > lines[end[:-1]]
    mark = np.isin(raw[end - 1], np.frombuffer(b".!?", np.uint8))
    wide = np.flatnonzero((raw[end - 1] & 0xC0) == 0x80)  # the last character of three bytes: an ellipsis or an East Asian full stop
    if len(wide):
        lead, points = lead_points(raw)
        last = np.searchsorted(lead, end[wide], side="right") - 1
        mark[wide] = np.isin(points[last], [ord(c) for c in "…。！？"])
    return np.r_[line | mark[:-1], True], np.r_[line, True]


def cut(raw: np.ndarray, offs: np.ndarray, least: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and end byte of the paragraphs of many texts, by row and place. Words are those that n-grams are made of."""
    none = np.zeros(0, np.int64)
    _, vrow, vstart, vend = words(raw, offs, byte_classes(raw, "visible"), False)
    _, wrow, wstart, wend = words(raw, offs, byte_classes(raw), False)
    if not len(wrow):
        return none, none, none
    ends, lines = _breaks(raw, vstart, vend)
    ends[:-1] |= vrow[1:] != vrow[:-1]
    of = np.cumsum(np.r_[0, ends[:-1]])  # the unit of each visible run: a sentence, or a line
    head = np.flatnonzero(np.r_[True, ends[:-1]])
    tail = np.r_[head[1:], len(of)] - 1
    line_of = np.cumsum(np.r_[0, (lines[:-1] | (vrow[1:] != vrow[:-1]))])[head]
    unit = of[np.searchsorted(vstart, wstart, side="right") - 1]
    size = np.bincount(unit, minlength=len(head))
    some = np.flatnonzero(size)  # units without a word are left out
    row, start, stop, line, size = vrow[head][some], vstart[head][some], vend[tail][some], line_of[some], size[some]
    upto = np.r_[0, np.cumsum(size)]  # words before each unit
    long = size >= least
    m = len(size)
    next_to = (row[1:] == row[:-1]) & (line[1:] == line[:-1])
    pair = np.flatnonzero(next_to & ~long[1:] & ~long[:-1] & (size[1:] + size[:-1] >= least))
    covered = long.copy()
    covered[pair] = covered[pair + 1] = True
    out = [(row[long], start[long], stop[long]), (row[pair], start[pair], stop[pair + 1])]

    rest = ~covered
    first = np.flatnonzero(rest & np.r_[True, ~rest[:-1] | (row[1:] != row[:-1])])
    last = np.flatnonzero(rest & np.r_[~rest[1:] | (row[1:] != row[:-1]), True])
    have = upto[last + 1] - upto[first]
    need = np.where(line[first] == line[last], least, max(least, LINE_WORDS))
    enough = have >= need
    one = np.flatnonzero(enough & ((have < 2 * least) | (first == last)))
    out.append((row[first[one]], start[first[one]], stop[last[one]]))
    many = np.flatnonzero(enough & ~((have < 2 * least) | (first == last)))
    if len(many):
        found = []
        for a, b in zip(first[many].tolist(), (last[many] + 1).tolist(), strict=True):
            hashes = [zlib.crc32(raw[x:y]) for x, y in zip(start[a:b].tolist(), stop[a:b].tolist(), strict=True)]
            at = [a, *(a + i for i in _cuts(hashes, size[a:b].tolist(), least)), b]
            found += zip(at, at[1:], strict=False)
        a, b = np.array(found, np.int64).T
        out.append((row[a], start[a], stop[b - 1]))
    edge_first, edge_last = np.searchsorted(row, np.arange(len(offs) - 1)), np.searchsorted(row, np.arange(len(offs) - 1), side="right") - 1
    few = np.flatnonzero(~enough & ((first > edge_first[row[first]]) | (last < edge_last[row[first]])))
    f, g = first[few], last[few]
    short = np.maximum(2, least - have[few])
    before, behind = upto[f] - upto[edge_first[row[f]]], upto[edge_last[row[f]] + 1] - upto[g + 1]
    between = np.minimum(before, behind) >= short - (least - 4)  # it doesn't hold so much of a neighbour as to be like it
    f, g, short, before, behind = (x[between] for x in (f, g, short, before, behind))
    left = np.minimum(before, np.maximum(short // 2, short - behind))
    right = np.minimum(behind, short - left)
    out.append((row[f], np.where(left > 0, wstart[np.minimum(upto[f] - left, len(wstart) - 1)], start[f]), np.where(right > 0, wend[np.minimum(upto[g + 1] + right - 1, len(wend) - 1)], stop[g])))
    r, a, b = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.lexsort((b, a, r))
    r, a, b = r[order], a[order], b[order]
    for k in few[~between].tolist():  # a word or three at an end of the text: part of the paragraph there
        of_row, x, y = row[first[k]], start[first[k]], stop[last[k]]
        lo, hi = np.searchsorted(r, [of_row, of_row + 1])
        ended = lo + np.flatnonzero(b[lo:hi] <= x)
        if len(ended):
            b[ended[-1]] = y
        elif hi > lo:
            a[lo] = x
    return r, a, b


def _cuts(hashes: list[int], words: list[int], least: int) -> list[int]:
    """Units to cut before: those of the least hash within least words on both sides, so equal lines are cut alike whatever stands before them; no part has fewer words."""
    at = list(itertools.accumulate(words, initial=0))
    out = []
    for i, h in enumerate(hashes):
        if at[i] < least or at[-1] - at[i] < least:
            continue
        j = i - 1
        while j >= 0 and at[i] - at[j] < least and hashes[j] > h:
            j -= 1
        if j >= 0 and at[i] - at[j] < least:
            continue
        j = i + 1
        while j < len(hashes) and at[j] - at[i] < least and hashes[j] >= h:
            j += 1
        if j == len(hashes) or at[j] - at[i] >= least:
            out.append(i)
    return out


def tune(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band, so the fewest chance collisions, whose bands find a pair at the threshold with this recall."""
    best = None
    for rows in range(1, most + 1):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))) if threshold < 1 else 1
        if bands * rows <= most:
            best = (bands, rows)
    if best is None:
        raise ValueError(f"no banding of {most} hashes reaches a recall of {recall} at {threshold}")
    return best


def banding(bands: int, rows: int):
    """A signer for jaccard_pairs: one signature for each band of MinHashes."""
    seeds = mix(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15 >> 1))
    masks, factors = (seeds >> np.uint64(32)).astype(np.uint32), seeds.astype(np.uint32) | np.uint32(1)

    def sign(n: int, threshold: float):
        def run(batches):
            unseen = Unseen()
            for batch in batches:
                for a, b in slices(batch.column(0), 1 << 20):
                    g, r = gram_sets(batch.column(0).slice(a, b - a), n)
                    ha = set_hash(g, r, b - a)[0]
                    new = unseen.of(ha)[r]
                    g, r = g[new], r[new]
                    if not len(g):
                        continue
                    heads = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
                    keys, short = [], (g >> np.uint64(32)).astype(np.uint32)  # grams are mixed, so half of one is as good a hash
                    with np.errstate(over="ignore"):
                        for band in range(bands):
                            key = np.full(len(heads), band, np.uint64)
                            for k in range(band * rows, (band + 1) * rows):
                                h = short ^ masks[k]
                                h *= factors[k]
                                h ^= h >> np.uint32(15)
                                h *= np.uint32(0x2C1B3C6D)
                                key = mix(key * np.uint64(31) + np.minimum.reduceat(h, heads).astype(np.uint64))
                            keys.append(key)
                    yield sent(np.tile(ha[r[heads]], bands), np.concatenate(keys))

        return run

    return sign


def split(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = MIN_WORDS, n: int = GRAM) -> DataFrame:
    """(__wa_key, start, stop, ha, t) of all paragraphs, ha being the hash of the set of n-grams; NULL texts and NULL keys have none."""

    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column(1)):
                raw, offs = buffer_of(batch.column(1).slice(a, b - a))
                row, start, stop = cut(raw, offs, least)
                size = stop - start
                upto = np.cumsum(size) - size
                data = raw[np.arange(int(size.sum())) + np.repeat(start - upto, size)]
                t = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(np.r_[upto, len(data)].astype(np.int64)), pa.py_buffer(data))
                ha = named_sets(t, np.zeros(len(size), np.int64), n)  # a paragraph has words
                chars = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
                base = chars[offs[row]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(pa.array(row)), pa.array(chars[start] - base), pa.array(chars[stop] - base), pa.array(ha), t.cast(pa.string())], names=["__wa_key", "start", "stop", "ha", "t"])

    named = docs.select(F.col(f"`{key}`").alias("__wa_key"), F.col(f"`{text}`").cast("string").alias("__wa_text")).filter("__wa_key is not null and __wa_text is not null")
    return named.mapInArrow(run, f"__wa_key {named.schema[0].dataType.simpleString()}, start bigint, stop bigint, ha bigint, t string")


def duplicate_paragraphs(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = MIN_WORDS, n: int = GRAM, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(key, start, stop, kept_id, kept_start, is_removed): a row for each paragraph that has a near copy, in its own document or in another.

    Paragraphs that chains of similar pairs connect form a cluster. The one with the lowest key, then start, stays, and kept_id
    and kept_start tell which it is; the others are removed. Similarity is the exact Jaccard similarity of
    sets of word n-grams; words are compared in lower case. Copies of one paragraph cost one set, however many.

    NULL keys and texts, empty texts and ones without a paragraph have no row. Rows that repeat a key are documents of
    their own; ties between them are settled by the paragraphs' order in the table. An empty table gives an empty result. Texts are read whole; columns but the two named aren't read.
    """
    store = Stored(docs.sparkSession, "paragraphs")
    parts = store.write(split(docs, text, key, least, n).withColumn("id", F.monotonically_increasing_id()), "parts")
    named = parts.select("id", "__wa_key", "start", "stop", "ha")
    own, linked = linked_sets(store, parts.select("id", "t"), named, ["__wa_key", "start", "id"], n, threshold, False, banding(*tune(threshold, recall)))
    first = first_of_classes(own, linked).filter("size > 1")
    found = named.join(first.hint("merge"), "ha")
    return found.select(
        F.col("__wa_key").alias(key), "start", "stop", F.col("first.__wa_key").alias("kept_id"), F.col("first.start").alias("kept_start"), (F.col("id") != F.col("first.id")).alias("is_removed")
    )
