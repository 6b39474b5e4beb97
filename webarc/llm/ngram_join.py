"""Exact n-gram Jaccard self-join by prefixes in order of rarity (operator 8).

A document is the set of its word n-grams. All grams have one order: rare ones first, as far as counts over a sample of the documents tell,
equally rare ones by how rare their words are, then by their hash. Two sets of Jaccard similarity t share t of the larger one's grams at least, so the first gram that both have is among the first
|x| - ceil(t|x|) + 1 of each. These grams are a set's signatures, and no pair is missed, whatever the counts say: they only decide how many
sets meet without need.

A signature goes with a band of the set's size and with the gram's place in the set. If it is the first gram that two sets share, they share no more than what
comes from there on; pairs for which that is too little don't meet by this gram. The others are candidates. Of each set, the parities of
hashed gram counts are kept, about a bit a gram; sets differ in at least as many grams as parities. Candidates that this doesn't part are compared: their Jaccard similarity is computed exactly.

Equal sets are collapsed first, so copies, however many, cost one set. Of a few sets that share a signature, or of many that are mostly
too different in size or place, the pairs are compared. Others form the group of their least set, the pivot, which each is compared with. Whoever is within half the allowed
distance of the same pivot is similar to each other, by the triangle inequality of the Jaccard distance, and needs no further look: such a home is
counted, not enumerated. Only sets outside a group's largest home meet the others of the group, in tiles of bounded size, and of groups of up to CHECKED sets only those with a
pair that parities don't part. There is no cap
on candidates, and no pair is sent over the network before it is known to be similar.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from math import floor

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_SQL, Stored, buffer_of, byte_classes, components, distinct_per_row, first_of_each, grams, keep_small_side, mix, slices, small_batches, words

GRAM = 2
THRESHOLD = 0.7
#: Grams are counted in documents of about so many bytes, all if the table has no more, into a table of so many bits.
ORDER_BYTES, ORDER_BITS = 160 << 20, 24
#: Words are counted in the same documents, into a table of so many bits.
WORD_BITS = 22
#: Up to so many sets that share a signature are paired; more form the group of a pivot, compared in tiles of so many sets or grams a side.
SMALL, BLOCK, BLOCK_GRAMS = 8, 512, 1 << 20
#: Up to so many are paired if sizes and places leave no more than SPARSE pairs a set.
MANY, SPARSE = 1024, 4
#: Parities of a set.
MOST_BITS = 1 << 16
#: In groups of up to so many sets, parities tell which have to be compared; larger ones are compared as they are.
CHECKED = 2048
#: So many sets are compared with one pivot in a task.
STAR = 4096
#: Documents with a candidate are picked by a broadcast of their ids up to so many; beyond, by a shuffle.
BROADCAST_IDS = 2_000_000
#: Sets are made of about so many bytes of texts at once; their arrays take some 40 times that.
SLICE = 1 << 19
#: Sets whose signatures a task remembers having sent.
REMEMBERED = 1 << 20


@dataclass(frozen=True)
class Band:
    """Sizes of sets that are told as one."""

    low: int
    high: int


def bands(threshold: float, most: int) -> list[Band]:
    """Bands of all sizes up to most, and to a billion fewer than 256: a band is a byte."""
    out, low, grow = [], 1, min(max(threshold, 0.05), 0.7) ** -0.25
    while low <= most:
        out.append(Band(low, max(low, floor(low * grow))))
        low = out[-1].high + 1
    return out


def signatures(g: np.ndarray, row: np.ndarray, rows: int, threshold: float, counts: np.ndarray | None = None, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(signature, row) of the sets given by their sorted grams and rows: the first grams of each, in order. counts tells by a gram's first bits how frequent it is; of equally frequent ones, the light come first."""
    if not len(g):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if counts is not None:
        bits = np.uint64(len(g).bit_length())
        often = counts[(g >> np.uint64(65 - len(counts).bit_length())).astype(np.int64)].astype(np.uint64)
        light = np.zeros(len(g), np.uint64) if weight is None else weight.astype(np.uint64)
        key = (((row.astype(np.uint64) << np.uint64(8) | often) << np.uint64(8) | light) << bits) | np.arange(len(g), dtype=np.uint64)
        g = g[(np.sort(key) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)]  # rows stay where they are
    size = np.bincount(row, minlength=rows)
    first = np.maximum(1, np.minimum(size, size - np.ceil(threshold * size - 1e-6).astype(np.int64) + 1))
    keep = _places(row) < first[row]
    return g[keep], row[keep]


def _places(row: np.ndarray) -> np.ndarray:
    """The number of each entry in its row."""
    heads = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
    return np.arange(len(row)) - np.repeat(heads, np.diff(np.r_[heads, len(row)]))


def _all_bands(threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest size of each band that a byte can name; the last has no end."""
    each = bands(threshold, 10**9)[:256]
    return np.array([b.low for b in each], np.float64), np.array([*(b.high for b in each[:-1]), np.inf], np.float64)


def gram_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Grams and rows of the sets of words in lower case."""
    raw, offs = buffer_of(pc.utf8_lower(texts))
    h, row, _, _ = words(raw, offs, byte_classes(raw))
    g, r, _ = grams(h, row, n)
    return distinct_per_row(g, r)


def weighed_sets(texts: pa.Array, n: int, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """gram_sets, and how heavy each gram is: the sum of its words' weights, 255 at most; 0 for that of a text of fewer than n words."""
    raw, offs = buffer_of(pc.utf8_lower(texts))
    h, row, _, _ = words(raw, offs, byte_classes(raw))
    g, r, at = grams(h, row, n)
    first = first_of_each(g, r)
    at, own = at[first], np.r_[weights[(h >> np.uint64(64 - WORD_BITS)).astype(np.int64)].astype(np.int64), np.zeros(n, np.int64)]
    total = own[at]
    for k in range(1, n):
        total += own[at + k]
    full = np.r_[row, np.full(n, -1)][at + n - 1] == r[first]
    return g[first], r[first], np.where(full, np.minimum(total, 255), 0).astype(np.uint8)


def set_hash(g: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each set, in two columns; equal sets have equal ones."""
    a, b = np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
    if len(g):
        heads = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        with np.errstate(over="ignore"):
            a[row[heads]] = np.add.reduceat(mix(g ^ np.uint64(0x2545F4914F6CDD1D)), heads)
            b[row[heads]] = np.add.reduceat(mix(g ^ np.uint64(0xD6E8FEB86659FD93)), heads)
    return a.view(np.int64), b.view(np.int64)


def parities(g: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, pa.Array]:
    """The size of each set, and for each value of the low bits of its grams' hashes, whether an odd number of grams has it: a bit a gram or more, in a power of two of bits up to MOST_BITS."""
    size = np.bincount(row, minlength=rows)
    bits = np.minimum(64 << np.ceil(np.log2(np.maximum(size, 64) / 64)).astype(np.int64), MOST_BITS)
    ends = np.cumsum(bits)
    hashed = (mix(g ^ np.uint64(0x5851F42D4C957F2D)) & (bits[row] - 1).astype(np.uint64)).astype(np.int64)
    odd = np.bincount((ends - bits)[row] + hashed, minlength=int(ends[-1]) if rows else 0) & 1
    offsets = np.r_[0, ends // 8].astype(np.int32)
    return size, pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(offsets), pa.py_buffer(np.packbits(odd.astype(bool), bitorder="little"))])


def _parted(threshold: float):
    """Leaves out the pairs of sets whose parities differ too often."""

    def run(batches):
        for batch in batches:
            sizes = [np.asarray(batch.column(c)) for c in ("na", "nb")]
            flags = [batch.column(c) for c in ("fa", "fb")]
            lengths = [np.asarray(pc.binary_length(f)).astype(np.int64) for f in flags]
            keep = np.zeros(batch.num_rows, bool)
            kinds, of = np.unique(lengths[0] << 32 | lengths[1], return_inverse=True)
            for k in range(len(kinds)):
                at = np.flatnonzero(of == k)
                least = min(int(x[at[0]]) for x in lengths)
                u, v = (np.bitwise_xor.reduce(np.frombuffer(b"".join(f.take(pa.array(at)).to_pylist()), np.uint8).reshape(len(at), -1, least), axis=1) for f in flags)
                keep[at] = np.bitwise_count(u ^ v).sum(1, dtype=np.int64) <= (1 - threshold) / (1 + threshold) * (sizes[0][at] + sizes[1][at]) + 1e-6
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], names=["a", "b"])

    return run


def named_sets(texts: pa.Array, ids: np.ndarray, n: int) -> np.ndarray:
    """The hash of each text's set; a text without a word has its id instead, so it equals no other."""
    g, r = gram_sets(texts, n)
    ha = set_hash(g, r, len(texts))[0]
    return np.where(np.bincount(r, minlength=len(texts)) > 0, ha, ids)


def _identify(n: int):
    """The rows with the hash of their set, its size and parities instead of the text, which comes last. A text without a word has its id as hash, so it equals no other."""

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for a, b in slices(texts, SLICE):
                part = batch.slice(a, b - a)
                ids = np.asarray(part.column(part.schema.get_field_index("id")))
                g, r = gram_sets(part.columns[-1], n)
                size, odd = parities(g, r, b - a)
                ha = np.where(size > 0, set_hash(g, r, b - a)[0], ids)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(ha), pa.array(size.astype(np.int32)), odd], names=[*part.schema.names[:-1], "ha", "size", "odd"])

    return run


class Unseen:
    """Which of a batch's sets come for the first time in a task, as far as it remembers; most copies then send their signatures once a task."""

    def __init__(self):
        self.known = np.zeros(REMEMBERED, np.int64)

    def of(self, ha: np.ndarray) -> np.ndarray:
        slot = (ha.view(np.uint64) % np.uint64(REMEMBERED)).astype(np.int64)
        first = np.zeros(len(ha), bool)
        first[np.unique(ha, return_index=True)[1]] = True
        first &= self.known[slot] != ha
        self.known[slot] = ha
        return first


def sent(ha: np.ndarray, sig: np.ndarray) -> pa.RecordBatch:
    """Sets with their signatures, cut to 56 bits: in a shuffled row, the byte that is left joins the zeros of the next row's head, so they are compressed together. A chance meeting costs a comparison."""
    return pa.RecordBatch.from_arrays([pa.array(ha), pa.array((sig >> np.uint64(8)).view(np.int64))], names=["ha", "sig"])


def _sampled(n: int):
    """The grams of the sets."""

    def run(batches):
        unseen = Unseen()
        for batch in batches:
            for a, b in slices(batch.column(0), SLICE):
                g, r = gram_sets(batch.column(0).slice(a, b - a), n)
                yield pa.RecordBatch.from_arrays([pa.array(g[unseen.of(set_hash(g, r, b - a)[0])[r]].view(np.int64))], names=["g"])

    return run


def _count(batches):
    """How often each gram comes that comes twice, up to 255, by its first bits."""
    g, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.asarray(b.column(0)).view(np.uint64) for b in batches)]), return_counts=True)
    slot, first = np.unique(g[n > 1] >> np.uint64(64 - ORDER_BITS), return_index=True)
    most = np.maximum.reduceat(n[n > 1], first) if len(first) else first
    yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(np.minimum(most, 255).astype(np.int16))], names=["slot", "n"])


def _counted_words(batches):
    """How often words come, by their hashes' first bits."""
    total = np.zeros(1 << WORD_BITS, np.int32)
    for batch in batches:
        for a, b in slices(batch.column(0), SLICE):
            raw, offs = buffer_of(pc.utf8_lower(batch.column(0).slice(a, b - a)))
            slot, n = np.unique(words(raw, offs, byte_classes(raw))[0] >> np.uint64(64 - WORD_BITS), return_counts=True)
            total[slot.astype(np.int64)] += n.astype(np.int32)
    slot = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(total[slot])], names=["slot", "n"])


def gram_order(texts: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How frequent grams are in a sample of the texts (id, t), by their first ORDER_BITS bits; 0 for those that come once there. And the weight of words, by their hashes' first
    WORD_BITS bits: the logarithm of how often they come there. Of grams that the sample doesn't know, those of rare words are rare."""
    total = texts.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    sample = texts if total <= ORDER_BYTES else texts.filter(F.pmod(F.xxhash64("id", F.lit(8)), F.lit(1 << 20)) < floor(ORDER_BYTES / total * (1 << 20)))
    found = sample.select("t").mapInArrow(_sampled(n), "g bigint").repartition("g").mapInArrow(_count, "slot int, n smallint").toArrow()
    counts = np.zeros(1 << ORDER_BITS, np.uint8)
    np.maximum.at(counts, np.asarray(found.column("slot")), np.asarray(found.column("n")).astype(np.uint8))
    found = sample.select("t").mapInArrow(_counted_words, "slot int, n int").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    weights = np.zeros(1 << WORD_BITS, np.uint8)
    weights[np.asarray(found.column("slot"))] = np.minimum(np.log2(np.asarray(found.column("n")) + 1.0) * 8 / n, 255).astype(np.uint8)
    return counts, weights


def _sign(n: int, threshold: float, order):
    """Signatures of 48 bits, before the byte of the set's band and that of the gram's place; order is a broadcast of what gram_order gives."""

    def run(batches):
        unseen, low, (counts, weights) = Unseen(), _all_bands(threshold)[0], order.value
        for batch in batches:
            for a, b in slices(batch.column(0), SLICE):
                g, r, w = weighed_sets(batch.column(0).slice(a, b - a), n, weights)
                ha, _ = set_hash(g, r, b - a)
                new = unseen.of(ha)[r]
                s, at = signatures(g[new], r[new], b - a, threshold, counts, w[new])
                size = np.bincount(r, minlength=b - a)[at]
                band = np.searchsorted(low, size, side="right") - 1
                place = np.minimum(_places(at) * 256 // np.maximum(size, 1), 255)
                s = mix(s) & ~np.uint64(0xFFFF) | (band << 8 | place).astype(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(ha[at]), pa.array(s.view(np.int64))], names=["ha", "sig"])

    return run


def _may_pair(sig: np.ndarray, threshold: float, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By the bands and places in signatures: the most grams that sets can share from there on, and what two sets need, in two summands."""
    band, place = (sig >> 8) & 255, sig & 255
    return high[band] * (1 - place / 256), threshold / (1 + threshold) * low[band]


def _collide(threshold: float | None):
    """Of rows sorted by (sig, ha): the pairs of sets that share a signature; of more than SMALL sets, only those with the first (wide).

    With a threshold, signatures end with a band and a place: pairs that can't be similar are left out, and the rest of up to MANY sets are pairs if they are few.
    """
    drop = 0 if threshold is None else 16
    low, high = _all_bands(threshold or 1)

    def run(batches):
        s, i = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                s, i = np.r_[s, np.asarray(batch.column(1))], np.r_[i, np.asarray(batch.column(0))]
            if not len(s):
                continue
            new = np.r_[True, (s[1:] != s[:-1]) | (i[1:] != i[:-1])]
            s, i = s[new], i[new]
            cut = len(s) if batch is None else int(np.searchsorted(s >> drop, s[-1] >> drop, side="left"))
            done_s, done_i, s, i = s[:cut], i[:cut], s[cut:], i[cut:]
            if not cut:
                continue
            of = done_s >> drop
            heads = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            sizes = np.diff(np.r_[heads, cut])
            most, need = _may_pair(done_s, threshold, low, high) if drop else (None, None)
            pairs, stars = [np.zeros((0, 2), np.int64)], [np.zeros((0, 2), np.int64)]
            for m in np.unique(sizes[(sizes > 1) & (sizes <= SMALL)]).tolist():
                x, y = (heads[sizes == m][:, None] + k for k in np.triu_indices(m, 1))
                may = np.minimum(most[x], most[y]) >= need[x] + need[y] - 1e-6 if drop else np.ones(x.shape, bool)
                pairs.append(np.stack([done_i[x[may]], done_i[y[may]]], 1))
            for h, m in zip(heads[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
                group = done_i[h : h + m]
                if drop and m <= MANY:
                    p, q = most[h : h + m], need[h : h + m]
                    may = np.minimum(p[:, None], p) >= q[:, None] + q - 1e-6
                    np.fill_diagonal(may, False)
                    if may.sum() <= 2 * SPARSE * m:
                        pairs.append(group[np.stack(np.nonzero(np.triu(may)), 1)])
                        continue
                    group = group[may.any(0)]
                stars.append(np.stack([np.full(len(group), group.min()), group], 1))
            yield _pairs(np.sort(np.concatenate(pairs), 1), False)
            yield _pairs(np.concatenate(stars), True)

    return run


def _pairs(pairs: np.ndarray, wide: bool) -> pa.RecordBatch:
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    if len(pairs):
        pairs = pairs[np.r_[True, (pairs[1:] != pairs[:-1]).any(1)]]
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(np.full(len(pairs), wide))], names=["a", "b", "wide"])


def _sets(n: int):
    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column(0), SLICE):
                g, r = gram_sets(batch.column(0).slice(a, b - a), n)
                ha, _ = set_hash(g, r, b - a)
                offs = np.searchsorted(r, np.arange(b - a + 1))
                yield pa.RecordBatch.from_arrays([pa.array(ha), pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(g.view(np.int64)))], names=["ha", "grams"])

    return run


def _against_pivot(batches):
    """Of rows (p, salt, kind, x, grams), sorted by the first three: how similar each x (kind 1 or 2) is to the pivot (kind 0) before it."""
    pivot, own = None, np.zeros(0, np.uint64)
    for batch in batches:
        p, salt, kind, x = (np.asarray(batch.column(i)) for i in range(4))
        lists = batch.column(4)
        offs, values = np.asarray(lists.offsets), np.asarray(lists.values).view(np.uint64)
        heads = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (salt[1:] != salt[:-1])]) if len(p) else np.zeros(0, np.int64)
        j = np.zeros(len(p))
        for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(p)], strict=True):
            if kind[a] == 0:
                pivot, own = (p[a], salt[a]), values[offs[a] : offs[a + 1]]
                a += 1
            if a == b:
                continue
            assert pivot == (p[a], salt[a]), "a pivot without its set"
            v = values[offs[a] : offs[b]]
            same = own[np.minimum(np.searchsorted(own, v), len(own) - 1)] == v
            upto = np.r_[0, np.cumsum(same)]
            both = upto[offs[a + 1 : b + 1] - offs[a]] - upto[offs[a:b] - offs[a]]
            j[a:b] = both / (len(own) + np.diff(offs[a : b + 1]) - both)
        keep = kind > 0
        yield pa.RecordBatch.from_arrays([pa.array(p[keep]), pa.array(x[keep]), pa.array(kind[keep]), pa.array(j[keep])], names=["p", "x", "kind", "j"])


def _compared(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """(p, x, kind, j): the exact similarity of the pairs (p, x) in edges. A set is sent once a pair, a pivot's once for each STAR pairs."""
    salts = edges.groupBy("p").agg(F.ceil(F.count("*") / F.lit(STAR)).cast("int").alias("salts"))
    salted = edges.join(salts, "p").select("p", "x", "kind", F.pmod(F.hash("x"), F.col("salts")).alias("salt"))
    others = salted.join(sets.select(F.col("ha").alias("x"), "grams").hint("merge"), "x").select("p", "salt", "kind", "x", "grams")
    pivots = salted.select("p", "salt").distinct().join(sets.select(F.col("ha").alias("p"), "grams").hint("merge"), "p").select("p", "salt", F.lit(0).alias("kind"), F.col("p").alias("x"), "grams")
    return others.union(pivots).repartition("p", "salt").sortWithinPartitions("p", "salt", "kind").mapInArrow(_against_pivot, "p bigint, x bigint, kind int, j double")


def _overlaps(values: np.ndarray, owner: np.ndarray, left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """How many grams each of the left sets (numbers) shares with each of the right ones, by products of 0/1 matrices."""
    out = np.zeros((len(left), len(right)), np.float32)
    place = np.full((2, n), -1)
    place[0, left], place[1, right] = np.arange(len(left)), np.arange(len(right))
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    column = np.cumsum(np.r_[False, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)
    both = np.bincount(column, place[0, owner] >= 0).astype(bool) & np.bincount(column, place[1, owner] >= 0).astype(bool) if len(values) else np.zeros(0, bool)
    both &= np.bincount(column) > 1 if len(values) else False
    use = both[column]
    owner, column = owner[use], (np.cumsum(both) - 1)[column[use]]
    for first in range(0, int(both.sum()), 4096):
        a, b = np.searchsorted(column, [first, first + 4096])
        c, o = column[a:b] - first, owner[a:b]
        m = [np.zeros((len(x), 4096), np.float32) for x in (left, right)]
        for k in (0, 1):
            there = place[k, o] >= 0
            m[k][place[k, o[there]], c[there]] = 1
        out += m[0] @ m[1].T
    return out


def _covered(p: int, lists: pa.Array, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which pairs of the left and right sets also meet in the group of a lesser pivot than p, where they are compared."""
    values, owner = np.asarray(lists.flatten()), np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
    owner, values = owner[values < p], values[values < p]
    pivots, at = np.unique(values, return_inverse=True)
    member = np.zeros((len(lists), len(pivots)), np.float32)
    member[owner, at] = 1
    return member[left] @ member[right].T > 0


def _close(size: np.ndarray, odd: pa.Array, threshold: float) -> np.ndarray:
    """Which pairs of sets the parities and sizes don't part; none of a set with itself."""
    out, length = np.zeros((len(size), len(size)), bool), np.asarray(pc.binary_length(odd)).astype(np.int64)
    kinds = {w: np.flatnonzero(length == w) for w in np.unique(length).tolist()}
    bits = {w: np.frombuffer(b"".join(odd.take(pa.array(at)).to_pylist()), np.uint64).reshape(len(at), -1) for w, at in kinds.items()}
    for low, high in itertools.combinations_with_replacement(kinds, 2):
        x, y = kinds[low], kinds[high]
        if size[x].max() < threshold * size[y].min() - 1e-6:
            continue
        v = np.bitwise_xor.reduce(bits[high].reshape(len(y), -1, low // 8), axis=1)
        step = max(1, (1 << 21) // v.size)
        for a in range(0, len(x), step):
            at = x[a : a + step]
            differ = np.bitwise_count(bits[low][a : a + step, None, :] ^ v).sum(2, dtype=np.int64)
            most = (1 - threshold) / (1 + threshold) * (size[at][:, None] + size[y]) + 1e-6
            out[at[:, None], y] = (differ <= most) & (np.abs(size[at][:, None] - size[y]) <= most)
    out |= out.T
    np.fill_diagonal(out, False)
    return out


def _needed(threshold: float):
    """Of the groups (p, x, size, odd, lesser), sorted by p, with the lesser pivots of each x: the sets of pairs that parities don't part and that meet in no lesser pivot's group."""

    def some(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        near, every = _close(np.asarray(rows.column("size")).astype(np.int64), rows.column("odd"), threshold), np.arange(rows.num_rows)
        left = np.flatnonzero(near.any(1))
        need = np.zeros(rows.num_rows, bool)
        if len(left):
            need[left] = (near[left] & ~_covered(rows.column("p")[0].as_py(), rows.column("lesser"), left, every)).any(1)
        return rows.select(["p", "x"]).filter(pa.array(need))

    def run(batches):
        held: list[pa.RecordBatch] = []  # the beginning of the group that the next batch goes on with
        for batch in batches:
            p = np.asarray(batch.column("p"))
            cuts = [0, *(np.flatnonzero(p[1:] != p[:-1]) + 1).tolist(), len(p)] if len(p) else []
            for a, b in zip(cuts, cuts[1:], strict=False):
                if held and held[-1].column("p")[0].as_py() != p[a]:
                    yield some(held)
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield some(held)

    return run


def _compare_tile(threshold: float):
    """Of the pairs between two blocks of a pivot's group that aren't of one home: (u, v, 0) for homes that they connect, (ha, ha, n) for how many each has."""

    def compared(tile: pa.RecordBatch) -> pa.RecordBatch:
        p, low, high = (tile.column(c)[0].as_py() for c in ("p", "low", "high"))
        ha, home, block = (np.asarray(tile.column(c)) for c in ("ha", "home", "block"))
        lists, pivots = tile.column("grams"), tile.column("pivots")
        sizes = np.diff(np.asarray(lists.offsets))
        left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
        same = _overlaps(np.asarray(lists.flatten()), np.repeat(np.arange(len(ha)), sizes), left, right, len(ha))
        near = same.astype(np.float64) / np.maximum(sizes[left][:, None] + sizes[right][None, :] - same, 1) >= threshold
        near &= home[left][:, None] != home[right][None, :]
        near &= ~_covered(p, pivots, left, right)
        if low == high:
            near &= ha[left][:, None] < ha[right][None, :]
        x, y = np.nonzero(near)
        x, y = left[x], right[y]
        count = np.bincount(np.r_[x, y], minlength=len(ha))
        some = np.flatnonzero(count)
        edges = np.unique(np.stack([np.minimum(home[x], home[y]), np.maximum(home[x], home[y])], 1), axis=0)
        names, at = np.unique(edges, return_inverse=True)
        at, root = at.reshape(edges.shape), np.arange(len(names))
        while True:  # each home takes the least number among its neighbours' until nothing changes
            least = root.copy()
            np.minimum.at(least, at[:, 0], root[at[:, 1]])
            np.minimum.at(least, at[:, 1], root[at[:, 0]])
            least = least[least]
            if (least == root).all():
                break
            root = least
        link = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_pydict({"u": np.r_[names[root[link]], ha[some]], "v": np.r_[names[link], ha[some]], "n": np.r_[np.zeros(len(link), np.int64), count[some]]})

    def run(batches):
        held: list[pa.RecordBatch] = []  # the beginning of the tile that the next batch goes on with

        def joined() -> pa.RecordBatch:
            return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

        for batch in batches:
            if not batch.num_rows:
                continue
            key = [np.asarray(batch.column(c)) for c in ("p", "low", "high")]
            cuts = [0, *(np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1).tolist(), batch.num_rows]
            if held and any(held[-1].column(c)[0].as_py() != k[0] for c, k in zip(("p", "low", "high"), key, strict=True)):
                yield compared(joined())
                held.clear()
            for a, b in zip(cuts, cuts[1:], strict=False):
                held.append(batch.slice(a, b - a))
                if b < batch.num_rows:
                    yield compared(joined())
                    held.clear()
        if held:
            yield compared(joined())

    return run


def linked_sets(store: Stored, texts: DataFrame, named: DataFrame, order: list[str], n: int, threshold: float, counted: bool, sign=None) -> tuple[DataFrame, DataFrame]:
    """(ha, class, n_links) of the sets that are similar to others: the connected component, named by one of its sets, and to how many others.

    And (ha, own, n) of all sets: the first member in order, and how many there are. texts has (id, t), named the hash of each text's set (id, ha, and what order names, id among it; without sign also its size and parities, odd). Without counted, n_links is NULL and pairs that would only confirm a
    connection aren't looked at. sign makes the signatures: given n and threshold, a function from batches of texts to (ha, sig) batches; without it, no pair is missed.
    """
    spark = store.spark
    order_of = None if sign else spark.sparkContext.broadcast(gram_order(texts, n))
    signed = texts.select("t").mapInArrow(sign(n, threshold) if sign else _sign(n, threshold, order_of), "ha bigint, sig bigint")
    together = signed.repartition("sig" if sign else F.shiftright("sig", 16)).sortWithinPartitions("sig", "ha")
    met = store.write(together.mapInArrow(_collide(None if sign else threshold), "a bigint, b bigint, wide boolean").distinct(), "met")
    if order_of:
        order_of.unpersist()
    own = store.write(named.groupBy("ha").agg(F.min(F.struct(*order)).alias("own"), F.count("*").alias("n")), "own")
    few, wide = met.filter("not wide").select("a", "b"), met.filter("wide").select("a", "b")
    stars = wide.select(F.col("a").alias("p"), F.col("b").alias("x"))
    group = store.write(stars.union(stars.select("p", F.col("p").alias("x"))).distinct(), "groups")
    pivots = group.groupBy("x").agg(F.array_sort(F.collect_list("p")).alias("pivots"))  # no more than a set has signatures
    least = pivots.select(F.col("pivots")[0].alias("p"), "x").filter("p != x")
    seats = group
    if not sign:
        odd = store.write(named.select("ha", "size", "odd").dropDuplicates(["ha"]), "odd")
        side = lambda x: odd.select(F.col("ha").alias(x), F.col("size").alias(f"n{x}"), F.col("odd").alias(f"f{x}")).hint("merge")
        parted = lambda e: e.join(side("a"), "a").join(side("b"), "b").mapInArrow(_parted(threshold), "a bigint, b bigint")
        few = store.write(parted(few), "few")
        least = store.write(parted(least.select(F.col("p").alias("a"), F.col("x").alias("b"))).select(F.col("a").alias("p"), F.col("b").alias("x")), "stars")
        many = group.join(group.groupBy("p").agg(F.count("*").alias("among")), "p")
        lesser = many.filter(F.col("among") <= CHECKED).join(pivots.hint("merge"), "x").select("p", "x", F.filter("pivots", lambda v: v < F.col("p")).alias("lesser"))
        seen = lesser.join(odd.withColumnRenamed("ha", "x").hint("merge"), "x").select("p", "x", "size", "odd", "lesser")
        fewer = seen.repartition("p").sortWithinPartitions("p").mapInArrow(_needed(threshold), "p bigint, x bigint")
        seats = store.write(fewer.union(many.filter(F.col("among") > CHECKED).select("p", "x")), "seats")
    touched = few.select("a", "b").union(least).union(seats).select(F.explode(F.array("a", "b")).alias("ha")).distinct()
    wanted = store.write(own.select("ha", "own.id").join(touched, "ha"), "wanted")
    small = keep_small_side(wanted.select("id").distinct(), wanted.count(), BROADCAST_IDS)
    sets = store.write(texts.join(small, "id", "left_semi").select("t").mapInArrow(_sets(n), "ha bigint, grams array<bigint>").dropDuplicates(["ha"]), "grams")

    least = least.select("p", "x", F.lit(1).alias("kind"))
    apart = few.join(pivots.select(F.col("x").alias("a"), F.col("pivots").alias("pa")), "a", "left").join(pivots.select(F.col("x").alias("b"), F.col("pivots").alias("pb")), "b", "left")
    pairs = apart.filter(~F.coalesce(F.arrays_overlap("pa", "pb"), F.lit(False))).select(F.col("a").alias("p"), F.col("b").alias("x"), F.lit(2).alias("kind"))
    near = store.write(_compared(least.union(pairs), sets).filter(F.col("j") >= threshold), "near")

    if counted:
        homes = near.filter((F.col("kind") == 1) & (F.col("j") >= (1 + threshold) / 2 + 1e-9)).select(F.col("x").alias("ha"), F.col("p").alias("home"))
    else:
        homes = components(spark, near.select(F.col("p").alias("u"), F.col("x").alias("v"))).select(F.col("node").alias("ha"), F.col("component").alias("home"))
    about = store.write(sets.select("ha", F.size("grams").alias("size")).join(homes, "ha", "left").select("ha", "size", F.coalesce("home", "ha").alias("home")), "homes")

    member = seats.join(about.withColumnRenamed("ha", "x"), "x")
    by_home = member.groupBy("p", "home").agg(F.count("*").alias("n"), F.sum("size").alias("g"))
    most = F.max(F.struct("n", "home", "g")).alias("most")
    cells = lambda n, g: F.ceil(F.greatest(n / F.lit(BLOCK), g / F.lit(BLOCK_GRAMS))).cast("int")
    plan = by_home.groupBy("p").agg(F.sum("n").alias("n"), F.sum("g").alias("g"), most).filter("n > most.n")
    plan = plan.select("p", F.col("most.home").alias("top"), cells(F.col("n") - F.col("most.n"), F.col("g") - F.col("most.g")).alias("outer"), cells(F.col("most.n"), F.col("most.g")).alias("inner"), (cells(F.col("n"), F.col("g")) == 1).alias("whole"))
    seated = member.join(plan, "p").withColumn("inside", (F.col("home") == F.col("top")) & ~F.col("whole")).withColumn("block", F.pmod(F.hash("x"), F.when(F.col("inside"), F.col("inner")).otherwise(F.col("outer"))) + F.when(F.col("inside"), F.col("outer")).otherwise(0))
    spread = seated.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("inside"), F.col("outer")).otherwise(F.col("outer") + F.col("inner")) - 1)))
    tiles = spread.select("p", "x", "home", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    full = tiles.join(sets.select(F.col("ha").alias("x"), "grams").hint("merge"), "x").join(pivots.hint("merge"), "x").select("p", "low", "high", "block", F.col("x").alias("ha"), "home", "pivots", "grams")
    tiled = store.write(full.repartition("p", "low", "high").sortWithinPartitions("p", "low", "high").mapInArrow(_compare_tile(threshold), "u bigint, v bigint, n bigint"), "tiled")

    edges = tiled.filter("n = 0").select("u", "v")
    if counted:
        close = near.filter("kind = 2").join(about.select(F.col("ha").alias("p"), F.col("home").alias("u")), "p").join(about.select(F.col("ha").alias("x"), F.col("home").alias("v")), "x")
        edges = edges.union(close.select("u", "v"))
    joined = components(spark, edges)
    found = about.join(joined.select(F.col("node").alias("home"), "component"), "home", "left").select("ha", "home", F.coalesce("component", "home").alias("class"))
    if not counted:
        return own, store.write(found.select("ha", "class", F.lit(None).cast("bigint").alias("n_links")), "linked")
    pair = near.filter("kind = 2")
    some = tiled.filter("n > 0").select(F.col("u").alias("ha"), "n").union(pair.select("p", F.lit(1).cast("bigint"))).union(pair.select("x", F.lit(1).cast("bigint"))).groupBy("ha").agg(F.sum("n").alias("n"))
    beside = found.groupBy("home").agg((F.count("*") - 1).alias("beside"))
    return own, store.write(found.join(some, "ha", "left").join(beside, "home").select("ha", "class", (F.coalesce("n", F.lit(0)) + F.col("beside")).alias("n_links")), "linked")


def first_of_classes(own: DataFrame, linked: DataFrame) -> DataFrame:
    """(ha, n_links, first, size) for each set: the first member of its class, and how many members that has."""
    over = linked.join(own, "ha").groupBy("class").agg(F.min("own").alias("all"), F.sum("n").alias("size"))
    told = linked.join(over, "class").select("ha", "n_links", "all", "size")
    return own.join(told.hint("merge"), "ha", "left").select("ha", "n_links", F.coalesce("all", "own").alias("first"), F.coalesce("size", "n").alias("size"))


def _rows(docs: DataFrame, text: str, key: str) -> DataFrame:
    """The key, a hash of key and text, and the text ('' for NULL)."""
    k, t = F.col(f"`{key}`"), F.col(f"`{text}`").cast("string")
    return docs.select(k.alias("key"), F.xxhash64(k, t).alias("id"), F.coalesce(t, F.lit("")).alias("t"))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", n: int = GRAM, threshold: float = THRESHOLD) -> DataFrame:
    """(key, class_id, n_links), a row for each row of docs.

    Documents with equal sets, and documents that chains of similar pairs connect, are a class, named by its lowest key
    (class_id). n_links is the number of other sets that the document's set is similar to, with a Jaccard similarity of the threshold at least; copies of
    a set aren't counted.

    Keys can be of any type that has an order. A NULL key is lowest in no class but one of NULL keys. A row with NULL text or without a word is its own class, without links.
    A text of fewer than n words has one gram. Rows that repeat a key, with the same text or others, are rows of their own and are
    told apart by their texts alone. An empty table gives an empty result. Other columns than the two named are not read.
    """
    store = Stored(docs.sparkSession, "ngram")
    texts = _rows(docs, text, key)
    named = store.write(texts.mapInArrow(_identify(n), f"key {texts.schema['key'].dataType.simpleString()}, id bigint, ha bigint, size int, odd binary"), "sets")
    own, linked = linked_sets(store, texts.select("id", "t"), named.withColumn("nokey", F.col("key").isNull()), ["nokey", "key", "id"], n, threshold, True)
    first = first_of_classes(own, linked)
    found = named.join(first.hint("merge"), "ha")
    return found.select(F.col("key").alias(key), F.col("first.key").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def drop_near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", n: int = GRAM, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, but of each class (see near_duplicates) only the document of the lowest key. Columns stay as they are.

    Of a class whose lowest key has several texts, one of them stays. Rows that repeat both key and text stay or go together. NULL keys come last; rows with NULL
    or empty text or without a word stay. Keys of any type; names of other columns don't matter, but those that begin with __wa_ are reserved. An
    empty table stays empty.
    """
    store = Stored(docs.sparkSession, "ngram")
    texts = _rows(docs, text, key)
    named = store.write(texts.mapInArrow(_identify(n), f"key {texts.schema['key'].dataType.simpleString()}, id bigint, ha bigint, size int, odd binary"), "sets")
    own, linked = linked_sets(store, texts.select("id", "t"), named.withColumn("nokey", F.col("key").isNull()), ["nokey", "key", "id"], n, threshold, False)
    first = first_of_classes(own, linked).filter("size > 1")
    goes = store.write(named.join(first.hint("merge"), "ha").filter("id != first.id").select(F.col("id").alias("__wa_goes")).distinct(), "goes")
    small = keep_small_side(goes, goes.count(), BROADCAST_IDS)
    return docs.join(small, F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string")) == F.col("__wa_goes"), "left_anti")


NEAR_DUPLICATES_SQL = rf"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '{WORD_SQL}') AS ws FROM documents),
g AS MATERIALIZED (
  SELECT r, doc_id, list_sort(list_distinct(CASE WHEN len(ws) = 0 THEN [CAST(r AS VARCHAR) || ' lone'] WHEN len(ws) < {GRAM} THEN ws
    ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END)) AS grams
  FROM d),
s AS MATERIALIZED (SELECT min(r) AS s, min(doc_id) AS own, grams FROM g GROUP BY grams),
e AS (SELECT s, len(grams) AS n, unnest(grams) AS x FROM s),
pairs AS MATERIALIZED (
  SELECT a.s AS u, b.s AS v FROM e a JOIN e b ON a.x = b.x AND a.s <> b.s
  GROUP BY a.s, b.s, a.n, b.n HAVING CAST(count(*) AS DOUBLE) / (a.n + b.n - count(*)) >= {THRESHOLD}),
reach AS (SELECT DISTINCT u AS s, u AS other FROM pairs UNION SELECT reach.s, v FROM reach JOIN pairs ON u = reach.other),
class AS (SELECT reach.s, min(own) AS class_id FROM reach JOIN s ON s.s = reach.other GROUP BY reach.s),
links AS (SELECT u AS s, count(*) AS n_links FROM pairs GROUP BY u)
SELECT doc_id, CASE WHEN class.s IS NULL THEN own ELSE class_id END AS class_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links
FROM g JOIN s USING (grams) LEFT JOIN class ON class.s = s.s LEFT JOIN links ON links.s = s.s
"""
