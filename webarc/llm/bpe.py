"""Byte-pair encoding and decoding with a tokenization automaton (operator 5).

The automaton reads tokens and accepts exactly the sequences that the merges produce. It starts as one state that loops on the bytes. Merge
by merge, a gadget is built in: where a merge (a, b) -> c would have joined two neighbours, the arc between them goes, and c gets arcs like a's on the way in and
like b's on the way out. So the state behind a token is told by its right edge (the tokens that end with it and until which merge they
stood there), an arc's label by its left edge, and the gadget of (a, b) takes the arcs from all states whose edge shows a at that time on all labels whose
edge shows b. States and labels with equal edges are one: the table of arcs has a bit for each of some 10,000 by 10,000 of them.

A word is encoded by following all arcs that spell it, from left to right: as each prefix has one tokenization, one arc at most enters each place, and the
path back from the end is the result. There is no search and no backing up. Decoding emits the arcs' labels.
"""

from __future__ import annotations

import json
import os
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, _powers, buffer_of, byte_classes, mix, slices, small_batches

#: Folder of the public tokenizer files and the one that the queries use; both can be given.
FOLDER = os.environ.get("WEBARC_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.json"
#: Words that a task keeps the tokens of.
REMEMBERED = 1 << 18
#: Texts are encoded in about so many bytes at once; arrays over their words take up to 100 times that.
SLICE = 1 << 17
#: Splits a text into words, each encoded on its own; every character belongs to one. split_words says the same for arrays.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_letters() -> dict[str, int]:
    """The printable stand-in that vocabulary files use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Automaton:
    """Compiled from merges; labels maps token ids to bytes."""

    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int, int]]):
        self.labels = labels
        self.single = {v: k for k, v in labels.items() if len(v) == 1}
        self.by_bytes = {v: k for k, v in labels.items()}
        self.parts = {c: (a, b) for a, b, c in merges}
        self.born = {c: i + 1 for i, (_, _, c) in enumerate(merges)}
        made = set(self.single.values()) | set(self.parts)
        self.by_bytes = {v: k for v, k in self.by_bytes.items() if k in made}  # special tokens have no arc
        self.merges, self.cut = merges, {(a, b): i + 1 for i, (a, b, _) in enumerate(merges)}
        self._compile()

    @classmethod
    def from_file(cls, path: str) -> Automaton:
        """A byte-level .json with merges, or a .tiktoken file of ranks, whose merges follow from the ranks."""
        if path.endswith(".json"):
            with open(path, encoding="utf-8") as f:
                model = json.load(f)["model"]
            letter = _byte_letters()
            vocab = model["vocab"]
            labels = {i: bytes(letter[c] for c in t) for t, i in vocab.items() if all(c in letter for c in t)}
            pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
            return cls(labels, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])
        import base64

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return cls.from_ranks(ranks)

    @classmethod
    def from_ranks(cls, ranks: dict[bytes, int]) -> Automaton:
        merges = []
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                continue
            parts = [token[i : i + 1] for i in range(len(token))]
            while len(parts) > 2:
                best = min(((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if ranks.get(a + b, 1 << 60) < rank), default=None)
                if best is None:
                    break
                i = best[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            if len(parts) == 2:
                merges.append((ranks[parts[0]], ranks[parts[1]], rank))
        return cls({v: k for k, v in ranks.items()}, merges)

    def _edges(self, side: int) -> tuple[dict[int, int], list[dict[int, int]]]:
        """By token its class, and by class its edge: how many of each edge token's merges (in order, those with it on this side) come while it shows.

        side 1: right edges, with the token on a merge's left; side 0: left edges. The token itself shows to the end, a part of it until the part's merge.
        A left edge shows one merge longer if that is the part's own: of three equal tokens, the first two merge.
        """
        times: dict[int, list[int]] = {}
        for i, m in enumerate(self.merges):
            times.setdefault(m[1 - side], []).append(i + 1)
        of, edges, known = {}, [], {}
        for t in [*self.single.values(), *self.parts]:
            edge, x, until = {}, t, 1 << 60
            while True:
                if x in times:
                    n = bisect_right(times[x], until) if not side and self.cut.get((x, x)) == until else bisect_left(times[x], until)
                    if n:
                        edge[x] = n
                if x not in self.parts:
                    break
                x, until = self.parts[x][side], self.born[x]
            key = tuple(sorted(edge.items()))
            if key not in known:
                known[key] = len(edges)
                edges.append(edge)
            of[t] = known[key]
        return of, edges

    def _compile(self) -> None:
        """The classes of states and labels, and the table of arcs that gadgets took (a bit each)."""
        self.state_of, states = self._edges(1)
        self.label_of, labels = self._edges(0)
        by_left: dict[int, list[int]] = {}
        by_right: dict[int, list[int]] = {}
        for i, (a, b, _) in enumerate(self.merges):
            by_left.setdefault(a, []).append(i)
            by_right.setdefault(b, []).append(i)
        width = -(-len(labels) // 8)
        shows: list[list[int]] = [[] for _ in self.merges]  # the labels whose edge shows a merge's right token at that time
        for k, edge in enumerate(labels):
            for x, n in edge.items():
                for i in by_right[x][:n]:
                    shows[i].append(k)
        gone = np.zeros((len(states) + 1, width), np.uint8)  # the last state is that before a word
        held: list[list[int]] = [[] for _ in self.merges]
        for k, edge in enumerate(states):
            for x, n in edge.items():
                for i in by_left[x][:n]:
                    held[i].append(k)
        for rows, columns in zip(held, shows, strict=True):  # gadget by gadget
            if rows and columns:
                bits = np.zeros(8 * width, np.uint8)
                bits[columns] = 1
                bits = np.packbits(bits)
                some = np.flatnonzero(bits)
                if len(some) * 8 < width:
                    gone[np.array(rows)[:, None], some] |= bits[some]
                else:
                    gone[rows] |= bits
        self.gone = gone

    def arc(self, a: int, b: int) -> bool:
        """Whether b can follow a."""
        k = self.label_of[b]
        return not self.gone[self.state_of[a], k >> 3] >> (7 - (k & 7)) & 1

    def trie(self) -> tuple[dict[int, int], list[int]]:
        """The table of token beginnings (state << 8 | byte -> state) and the token of each state, of all tokens that are made of their bytes."""
        own: dict[int, bool] = {t: True for t in self.single.values()}
        for _, _, c in self.merges:
            x, y = self.parts[c]
            own[c] = own.get(x, False) and own.get(y, False) and self._met(x, y, self.born[c])
        goto, token_at = {}, [-1]
        for label, token in self.by_bytes.items():
            if not own.get(token):
                continue
            state = 0
            for x in label:
                key = state << 8 | x
                nxt = goto.get(key)
                if nxt is None:
                    nxt = goto[key] = len(token_at)
                    token_at.append(-1)
                state = nxt
            token_at[state] = token
        return goto, token_at

    def _met(self, x: int, y: int, limit: int) -> bool:
        """Whether the arc from x on y was there before the gadget of number limit was built in."""
        while True:
            if self.cut.get((x, y), limit) < limit:
                return False
            bx, by = self.born.get(x, 0), self.born.get(y, 0)
            if not bx and not by:
                return True
            limit = max(bx, by)
            if by > bx:
                y, rest = self.parts[y]
                if x == y == rest:
                    return False
            elif bx > by:
                x = self.parts[x][1]
            else:
                x, y = self.parts[x][1], self.parts[y][0]

    def decode(self, tokens) -> str:
        labels = self.labels
        return b"".join([labels[t] for t in tokens]).decode("utf-8", "replace")


def _rows(values: np.ndarray, offs: np.ndarray, take: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chosen rows of ragged data, one behind the other, and their sizes."""
    size = (offs[1:] - offs[:-1])[take]
    within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    return values[np.repeat(offs[:-1][take], size) + within], size


def _spans(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The values of spans, one behind the other."""
    upto = np.cumsum(size)
    return values[np.arange(int(upto[-1]) if len(upto) else 0) + np.repeat(start - upto + size, size)]


class Known:
    """Words that a task has encoded, by hash, REMEMBERED and a batch's at most; then it begins anew. It changes no result."""

    def __init__(self):
        self.hashes, self.at, self.size, self.tokens = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each is there, and where its tokens are."""
        if not len(self.hashes):
            return np.zeros(len(h), bool), np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        k = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return self.hashes[k] == h, self.at[k], self.size[k]

    def add(self, h: np.ndarray, at: np.ndarray, size: np.ndarray, tokens: np.ndarray) -> None:
        if len(self.hashes) + len(h) > REMEMBERED:
            self.__init__()
            return
        place = np.searchsorted(self.hashes, h)
        self.hashes, self.at, self.size, self.tokens = np.insert(self.hashes, place, h), np.insert(self.at, place, at), np.insert(self.size, place, size), tokens


_CONTRACTED = [*b"sdmt"], [(x[0], x[1]) for x in (b"ll", b"ve", b"re")]


def split_words(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where the words begin that SPLIT cuts texts into, for the bytes of many texts at once. Every byte belongs to a word, and none to two texts' words."""
    n = len(raw)
    kind = byte_classes(raw, "split")  # 1 letters, 2 numbers, 3 white space, 4 others
    edge = np.zeros(n + 1, bool)
    edge[offs] = edge[n] = True
    begin = np.zeros(n + 1, bool)
    begin[:-1] = edge[:-1]
    begin[1:n] |= kind[1:] != kind[:-1]
    start = np.flatnonzero(begin[:n])
    end = np.r_[start[1:], n]
    of = kind[start] if len(start) else np.zeros(0, np.uint8)
    blank = np.flatnonzero((of == 3) & ~edge[end])  # white space with a word behind it: its last character stands alone or leads the word
    last = end[blank] - 1
    for _ in range(3):
        last -= (raw[last] & 0xC0) == 0x80
    begin[last] = True
    begin[end[blank][raw[last] == 0x20]] = False
    quote = np.flatnonzero((of == 4) & (end - start == 1) & ~edge[end] & begin[start])
    quote = quote[(raw[start[quote]] == 0x27) & (of[quote + 1] == 1)] if len(quote) else quote
    if len(quote):
        at, stop = end[quote], end[quote + 1]
        a, b = raw[at], np.where(at + 1 < stop, raw[np.minimum(at + 1, n - 1)], 0)
        one = np.isin(a, _CONTRACTED[0])
        two = ~one & np.any([(a == x) & (b == y) for x, y in _CONTRACTED[1]], axis=0)
        for some, size in ((one, 1), (two, 2)):
            begin[at[some]] = False
            rest = at[some] + size
            begin[rest[rest < stop[some]]] = True
    return np.flatnonzero(begin[:n])


class Encoder:
    """The automaton as arrays: small to ship, and run over all words of many texts at once."""

    def __init__(self, automaton: Automaton):
        goto, token_at = automaton.trie()
        most = max(automaton.labels, default=-1) + 1
        ordered = [automaton.labels.get(i, b"") for i in range(most)]
        self.sizes = np.array([len(x) for x in ordered], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(ordered), np.uint8)
        self.goto = Table(np.fromiter(goto, np.int64, len(goto)), np.fromiter(goto.values(), np.int32, len(goto)))
        self.token_at = np.array(token_at, np.int32)
        self.state_of, self.label_of = np.zeros(most + 1, np.int64), np.zeros(most, np.int64)
        self.state_of[-1] = len(automaton.gone) - 1
        for t, k in automaton.state_of.items():
            self.state_of[t], self.label_of[t] = k, automaton.label_of[t]
        self.width, self.gone = automaton.gone.shape[1], automaton.gone.ravel()

    def arcs(self, last: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether each token can follow the last one; -1 stands for the beginning of a word."""
        label = self.label_of[token]
        return self.gone[self.state_of[last] * self.width + (label >> 3)] >> (7 - (label & 7)).astype(np.uint8) & 1 == 0

    def encode_words(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words, one behind the other, and where each word's begin; no word is empty."""
        stop = np.repeat(offs[1:], np.diff(offs))
        within = np.arange(len(raw)) - np.repeat(offs[:-1], np.diff(offs))
        state, live, step = np.zeros(len(raw), np.int64), np.arange(len(raw)), 0
        at, tokens = [], []  # every token that the bytes spell from each place
        while len(live):
            to = self.goto.get(state << 8 | raw[live + step])
            there = to >= 0
            live, state = live[there], to[there].astype(np.int64)
            token = self.token_at[state]
            full = token >= 0
            at.append(live[full])
            tokens.append(token[full])
            step += 1
            there = live + step < stop[live]
            live, state = live[there], state[there]
        at, tokens = np.concatenate([*at, np.zeros(0, np.int64)]), np.concatenate([*tokens, np.zeros(0, np.int32)]).astype(np.int64)
        order = np.argsort(within[at], kind="stable")
        at, tokens = at[order], tokens[order]
        bounds = np.r_[0, np.cumsum(np.bincount(within[at]))] if len(at) else np.zeros(1, np.int64)
        last = np.full(len(raw) + 1, -1, np.int64)  # by place, the token of the arc that enters it; a word's first place has none
        ends = np.full(len(raw) + 1, -1, np.int64)
        for k in range(len(bounds) - 1):
            a, t = at[bounds[k] : bounds[k + 1]], tokens[bounds[k] : bounds[k + 1]]
            follows = self.arcs(last[a] if k else np.full(len(a), -1), t)
            a, t = a[follows], t[follows]
            behind = a + self.sizes[t]
            inner = behind < stop[a]
            last[behind[inner]] = t[inner]
            ends[behind[~inner]] = t[~inner]  # a word's end is the next word's first place
        taken, place, left = np.full(len(raw), -1, np.int32), offs[1:].copy(), np.arange(len(offs) - 1)
        token = ends[place]
        while len(left):
            place[left] -= self.sizes[token[left]]
            taken[place[left]] = token[left]
            left = left[place[left] > offs[:-1][left]]
            token[left] = last[place[left]]
        found = np.flatnonzero(taken >= 0)
        return taken[found], np.searchsorted(found, offs)

    def encode_many(self, texts: pa.Array, known: Known | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all texts, one behind the other, and how many each has. A word that comes again, or is known from other texts, isn't encoded again.

        Words are told apart by their hashes. As one tokenization spells a word, tokens that spell the texts are the right ones; if they don't, every word is encoded.
        """
        raw, offs = buffer_of(texts)
        start = split_words(raw, offs)
        bounds = np.r_[start, len(raw)]
        p, inv = _powers(len(raw) + 1)
        with np.errstate(over="ignore"):
            total = np.r_[np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * p[: len(raw)])]
            h = mix((total[bounds[1:]] - total[start]) * inv[start] + np.diff(bounds).astype(np.uint64))
        known = Known() if known is None else known
        order = np.argsort(h)
        sorted_h = h[order]
        new = np.r_[True, sorted_h[1:] != sorted_h[:-1]] if len(h) else np.zeros(0, bool)
        which = np.empty(len(h), np.int64)
        which[order] = np.cumsum(new) - 1
        found, at, size = known.look_up(sorted_h[new])
        own, lengths = _rows(raw, bounds, order[new][~found])
        tokens, begins = self.encode_words(own, np.r_[0, np.cumsum(lengths)])
        at[~found], size[~found] = begins[:-1] + len(known.tokens), np.diff(begins)
        pool = np.r_[known.tokens, tokens]
        out = _spans(pool, at[which], size[which])
        known.add(sorted_h[new][~found], at[~found], size[~found], pool)
        per_word = size[which]
        if not np.array_equal(self.labels(out), raw):
            out, begins = self.encode_words(raw, bounds)
            per_word = np.diff(begins)
        row = np.searchsorted(offs, start, side="right") - 1
        return out, np.bincount(row, per_word, len(texts)).astype(np.int64) if len(start) else np.zeros(len(texts), np.int64)

    def encode(self, text: str) -> np.ndarray:
        return self.encode_many(pa.array([text]))[0]

    def labels(self, ids: np.ndarray) -> np.ndarray:
        """The labels' bytes, one after another."""
        return _rows(self.bytes, np.r_[self.starts, len(self.bytes)], ids)[0]

    def decode(self, ids) -> str:
        return self.labels(np.asarray(ids, np.int64)).tobytes().decode("utf-8", "replace")


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each file, on the driver; executors get it by a broadcast of about 10 MB, whatever the corpus."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(Automaton.from_file(path))
    return _ENCODERS[path]


def same_bytes(e: Encoder, ids: np.ndarray, sizes: np.ndarray, texts: pa.Array) -> np.ndarray:
    """For each text, whether its tokens (so many of ids) decode to it."""
    raw, offs = buffer_of(texts)
    row = np.repeat(np.arange(len(sizes)), sizes)
    back = np.bincount(row, e.sizes[ids], len(sizes)).astype(np.int64) if len(ids) else np.zeros(len(sizes), np.int64)
    decoded, good = e.labels(ids), back == np.diff(offs)
    if good.all():
        differ = np.concatenate([[0], np.cumsum(decoded != raw)])[offs]
        return np.diff(differ) == 0
    at = np.r_[0, np.cumsum(back)]
    return np.array([bool(g) and np.array_equal(decoded[at[i] : at[i + 1]], raw[offs[i] : offs[i + 1]]) for i, g in enumerate(good)], bool)


def _encoded(shipped, given: list[str], new: list[str], check: bool):
    """The columns in given, and those named by new, from the text behind them; shipped is a broadcast."""

    def run(batches):
        e, known = shipped.value, Known()
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("__wa_text"))
            for a, b in slices(column, SLICE):
                texts = column.slice(a, b - a)
                missing = np.asarray(texts.is_null())
                values, sizes = e.encode_many(texts, known)
                offs = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32), mask=np.r_[missing, False])
                arrays = [pa.ListArray.from_arrays(offs, pa.array(values)), pa.array(sizes, mask=missing)]
                if check:
                    arrays.append(pa.array(same_bytes(e, values, sizes, texts), mask=missing))
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(a, b - a) for i in range(len(given))] + arrays, names=given + new)

    return run


def tokenize(docs: DataFrame, text: str = "text", path: str | None = None, keep: list[str] | None = None, tokens: str = "tokens", count: str = "n_tokens", check: str | None = "round_trip") -> DataFrame:
    """The columns in keep (all, if None), the token ids of the text, their number, and whether decoding gives the text back.

    A NULL text has NULL in all three; an empty one has no tokens. Texts are encoded whole, and special tokens' names in
    them are ordinary text. A result replaces an input column of the same name. Rows stay as often as they come. The vocabulary
    file is read on the driver, and the compiled automaton is shipped to the executors.
    """
    spark = small_batches(docs.sparkSession)
    shipped = spark.sparkContext.broadcast(encoder(path or os.path.join(FOLDER, VOCABULARY)))
    new = {tokens: "array<int>", count: "bigint"} | ({check: "boolean"} if check else {})
    given = [c for c in (docs.columns if keep is None else keep) if c not in new]
    source = docs.select(*[F.col(f"`{c}`") for c in given], F.col(f"`{text}`").alias("__wa_text"))
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in given] + [f"`{k}` {v}" for k, v in new.items()])

    return source.mapInArrow(_encoded(shipped, given, list(new), bool(check)), schema)


def detokenize(rows: DataFrame, tokens: str = "tokens", path: str | None = None, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """The columns in keep (all, if None) and the text that the token ids stand for; NULL ids give NULL, an unknown id an error."""
    spark = rows.sparkSession
    shipped = spark.sparkContext.broadcast(encoder(path or os.path.join(FOLDER, VOCABULARY)))
    given = [c for c in (rows.columns if keep is None else keep) if c != text]
    schema = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in given] + [f"`{text}` string"])

    def run(batches):
        a = shipped.value
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("__wa_ids"))
            out = pa.array([None if x is None else a.decode(x) for x in ids.to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(given))] + [out], names=[*given, text])

    return rows.select(*[F.col(f"`{c}`") for c in given], F.col(f"`{tokens}`").alias("__wa_ids")).mapInArrow(run, schema)
