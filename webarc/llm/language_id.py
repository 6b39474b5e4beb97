"""Language identification by cross parsing against suffix automata (operator 7).

For each language a suffix automaton of labelled text recognises exactly that text's substrings.
A document is parsed greedily: each phrase is the longest match of the automaton, and the next phrase
starts behind it. The language that needs fewest phrases for the document's characters wins.

Every letter of the labelled text has its own class. An automaton over an alphabet of ordinary size is a dense transition table; a missing
transition is stored as the negated state that the restart reaches, so one table look-up does both. One over thousands of characters is a hash
table. Long texts are parsed in segments at once, each as if a phrase began with it; then the phrase that really crosses its start is followed
until both parses stand in the same state, and the count is put right. So the result is that of one parse of the whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, buffer_of, slices, small_batches

#: Bounds of the labelled sample that the automata are built from; all else covers every row. More languages are an error.
SAMPLE_CHARS = 40_000
MOST_LANGUAGES = 400
#: Texts are parsed in so many units at once; the results don't depend on it.
SEGMENT = 256
#: Above this rate of phrases a character, no language explains the text.
REJECT_RATE = 0.5
#: Alphabets of more letters have a hash table of transitions.
DENSE_LETTERS = 300


@dataclass
class Model:
    labels: list[str]
    classes: np.ndarray  # of each code point: 0 no letter, 1.. the letter, count - 1 a letter unseen in the sample
    count: int
    local: np.ndarray  # by language and class, the column in the language's table; its last column is for letters that it doesn't have
    width: np.ndarray  # by language, the columns of a state; 0 for one with a hash table
    tables: np.ndarray  # next state by language offset + state * width + column; negative: a phrase ended before
    bases: np.ndarray  # by language, the place of its table
    sparse: dict[int, tuple[Table, np.ndarray]]  # by language, the table of state * count + class, and where the root goes by class, negated

    def step(self, lang: np.ndarray, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Where each parse goes on reading its unit; negative if a phrase ended before it."""
        if not self.sparse:
            return self.tables[self.bases[lang] + state * self.width[lang] + self.local[lang, code]]
        to = np.empty(len(lang), np.int64)
        dense = self.width[lang] > 0
        k = lang[dense]
        to[dense] = self.tables[self.bases[k] + state[dense] * self.width[k] + self.local[k, code[dense]]]
        for k in self.sparse:
            mine = lang == k
            to[mine] = self.look_up(k, state[mine], code[mine])
        return to

    def look_up(self, k: int, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        table, again = self.sparse[k]
        to = table.get(state * self.count + code).astype(np.int64)
        return np.where(to > 0, to, again[code])


def _alpha() -> np.ndarray:
    """By code point, its lower-case letter or 0."""
    out = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions by state of the automaton that accepts every substring; its root is state 1."""
    nxt: list[dict[int, int]] = [{}, {}]
    link, length = [0, 0], [0, 0]
    last = 1
    for c in codes:
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if not p:
            link[cur] = 1
        else:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


def model_of(samples: dict[str, str], dense_letters: int | None = None) -> Model:
    """Automata of the samples, by label."""
    most = DENSE_LETTERS if dense_letters is None else dense_letters
    lower, labels = _alpha(), sorted(samples)
    texts = [np.frombuffer(samples[k].encode("utf-32-le"), np.uint32) for k in labels]
    letters = np.unique(np.concatenate([lower[t] for t in texts]))
    letters = letters[letters > 0]
    count = len(letters) + 2
    code_of = np.full(0x110000, count - 1, np.int32)
    code_of[0] = 0
    code_of[letters] = np.arange(1, len(letters) + 1)
    classes = code_of[lower]
    local, width, bases = np.zeros((len(labels), count), np.int32), np.zeros(len(labels), np.int64), np.zeros(len(labels), np.int64)
    tables, sparse, at = [np.zeros(0, np.int32)], {}, 0
    for k, t in enumerate(texts):
        code = classes[t]
        code = code[(code != 0) | (np.r_[0, code[:-1]] != 0)]
        nxt = suffix_automaton(code.tolist())
        state = np.repeat(np.arange(len(nxt)), [len(x) for x in nxt])
        by = np.fromiter((c for x in nxt for c in x), np.int64, len(state))
        to = np.fromiter((c for x in nxt for c in x.values()), np.int64, len(state))
        own = np.unique(np.r_[0, code])
        if len(own) > most:
            again = np.full(count, -1, np.int64)
            again[by[state == 1]] = -to[state == 1]
            sparse[k] = (Table(state * count + by, to.astype(np.int32)), again)
            continue
        w = len(own) + 1
        local[k] = w - 1
        local[k, own] = np.arange(len(own))
        table = np.zeros((len(nxt), w), np.int32)
        table[state, local[k, by]] = to
        again = np.where(table[1] > 0, -table[1], -1)
        tables.append(np.where(table > 0, table, again[None, :]).astype(np.int32).ravel())
        width[k], bases[k] = w, at
        at += table.size
    return Model(labels, classes, count, local, width, np.concatenate(tables), bases, sparse)


def encode(texts: pa.Array, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of letters, with one 0 for each run of others inside a text; offsets by row."""
    raw, offs = buffer_of(texts)
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    at = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[offs]
    code = classes[points]
    before = np.zeros(len(code), code.dtype)
    before[1:] = code[:-1]
    before[at[:-1][at[:-1] < len(code)]] = 0
    keep = (code != 0) | (before != 0)
    return code[keep], np.concatenate([[0], np.cumsum(keep)])[at]


def phrases(code: np.ndarray, offs: np.ndarray, model: Model) -> np.ndarray:
    """Phrases of each row in each language; the last one of a row ends with it."""
    rows, langs = len(offs) - 1, len(model.labels)
    sizes = np.diff(offs)
    lanes = -(-sizes // SEGMENT)
    row = np.repeat(np.arange(rows), lanes)
    first = np.cumsum(lanes) - lanes
    number = np.arange(len(row)) - first[row]
    start = offs[:-1][row] + number * SEGMENT
    size = np.minimum(start + SEGMENT, offs[1:][row]) - start
    order = np.argsort(-size, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    follower = np.full(len(order), -1)  # in order, the lane of the same row behind each
    behind = np.flatnonzero(number > 0)
    follower[place[behind - 1]] = place[behind]
    start, size, row = start[order], size[order], row[order]
    state, found = np.ones((langs, len(row)), np.int64), np.zeros((langs, len(row)), np.int32)
    active = np.searchsorted(-size, -np.arange(SEGMENT), side="left")  # lanes longer than j
    dense = np.flatnonzero(model.width > 0)
    base, width, local = model.bases[dense, None], model.width[dense, None], np.ascontiguousarray(model.local[dense].T)
    states, counts = [], []
    for j in range(SEGMENT):
        n = int(active[j])
        if not n:
            break
        c = code[start[:n] + j]
        to = np.empty((langs, n), np.int64)
        if len(dense):
            to[dense] = model.tables[state[dense, :n] * width + local[c].T + base]
        for k in model.sparse:
            to[k] = model.look_up(k, state[k, :n], c)
        found[:, :n] += to < 0
        state[:, :n] = np.abs(to)
        states.append(state[:, :n].astype(np.int32))
        counts.append(found[:, :n].astype(np.int16))
    alone, real = found.copy(), state.copy()  # of a parse that begins with the lane; where the real one ends
    lang, lane = (x.ravel() for x in np.meshgrid(np.arange(langs), np.flatnonzero(follower >= 0), indexing="ij"))
    while len(lane):  # lanes whose real end has become known or changed: follow it into the next
        now, lane = real[lang, lane], follower[lane]
        live, seen, before = np.arange(len(lane)), np.zeros(len(lane), np.int64), real[lang, lane]
        for j in range(SEGMENT):
            k, at = lang[live], lane[live]
            to = model.step(k, now[live], code[start[at] + j])
            seen[live] += to < 0
            now[live] = np.abs(to)
            met = now[live] == states[j][k, at]
            if met.any():
                x = live[met]
                found[lang[x], lane[x]] = seen[x] + alone[lang[x], lane[x]] - counts[j][lang[x], lane[x]]
                real[lang[x], lane[x]] = state[lang[x], lane[x]]
            over = ~met & (size[at] == j + 1)
            if over.any():
                x = live[over]
                found[lang[x], lane[x]], real[lang[x], lane[x]] = seen[x], now[x]
            live = live[~met & ~over]
            if not len(live):
                break
        on = np.flatnonzero((real[lang, lane] != before) & (follower[lane] >= 0))
        lang, lane = lang[on], lane[on]
    out = np.zeros((rows, langs), np.int64)
    for k in range(langs):
        out[:, k] = np.bincount(row, found[k], rows)
    return out + (sizes > 0)[:, None]


def fit(docs: DataFrame, text: str = "text", label: str = "lang", sample_chars: int = SAMPLE_CHARS) -> Model | None:
    """Automata from a sample of at most sample_chars characters a label; more than MOST_LANGUAGES labels are an error.

    Rows without label or text teach nothing; without any other, there is no model. The sample is
    drawn by a hash of the text, so it doesn't depend on the order of rows. An automaton takes about 500 bytes a character of its sample.
    """
    known = docs.select(F.col(f"`{text}`").cast("string").alias("t"), F.col(f"`{label}`").cast("string").alias("l")).filter("t is not null and l is not null and t != ''")
    total = {r["l"]: r["n"] for r in known.groupBy("l").agg(F.sum(F.length("t")).alias("n")).orderBy(F.desc("n"), "l").limit(MOST_LANGUAGES + 1).collect()}
    if len(total) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} labels in {label}")
    if not total:
        return None
    sample: dict[str, list] = {k: [] for k in total}
    factor, open_ = 4, set(total)
    while open_:
        share = F.create_map(*[x for k in sorted(open_) for x in (F.lit(k), F.lit(min(1.0, factor * sample_chars / total[k])))])
        hashed = F.pmod(F.xxhash64("t"), F.lit(1 << 30)) / F.lit(float(1 << 30))
        rows = known.filter(F.col("l").isin(*sorted(open_))).withColumn("h", hashed).filter(F.col("h") < share[F.col("l")])
        got: dict[str, list] = {k: [] for k in open_}
        for r in rows.select("l", "h", F.substring("t", 1, sample_chars).alias("t")).collect():
            got[r["l"]].append((r["h"], r["t"]))
        for k in list(open_):
            if sum(len(t) for _, t in got[k]) >= sample_chars or factor * sample_chars >= total[k]:
                sample[k] = sorted(set(got[k]))
                open_.discard(k)
        factor *= 8
    texts = {}
    for k, found in sample.items():
        joined, n = [], 0
        for _, t in found:
            if n >= sample_chars:
                break
            joined.append(t[: sample_chars - n])
            n += len(joined[-1])
        texts[k] = " ".join(joined)
    return model_of(texts)


def identify(docs: DataFrame, model: Model | None, text: str = "text", columns: dict[str, str] | None = None, keep: list[str] | None = None, only_accepted: bool = False, reject_rate: float = REJECT_RATE) -> DataFrame:
    """Adds what the parse found to the columns in keep (all, if None).

    columns renames the results, or leaves out those named '': predicted_lang (NULL if rejected), n_units (letters and gaps),
    phrases (of the winner), phrase_rate (phrases a unit), margin (how many more phrases the second
    needs, as a share) and rejected. A result replaces an input column of the same name.

    A text that is NULL, empty or has no letter is rejected, as is one that no language parses in
    at most reject_rate phrases a unit, its last one aside. Ties go to the label that sorts first. Without a model
    all rows are rejected. Rows are kept as often as they come; with only_accepted, rejected ones go. Texts are parsed whole.
    """
    names = {k: k for k in ("predicted_lang", "n_units", "phrases", "phrase_rate", "margin", "rejected")} | (columns or {})
    kinds = {"predicted_lang": "string", "n_units": "bigint", "phrases": "bigint", "phrase_rate": "double", "margin": "double", "rejected": "boolean"}
    wanted = [k for k in kinds if names[k]]
    given = [c for c in (docs.columns if keep is None else keep) if c not in {names[k] for k in wanted}]
    source = docs.select(*[F.col(f"`{c}`") for c in given], F.col(f"`{text}`").alias("__wa_text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "__wa_text"] + [f"`{names[k]}` {kinds[k]}" for k in wanted])
    shipped = small_batches(docs.sparkSession).sparkContext.broadcast(model)

    def run(batches):
        m = shipped.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("__wa_text"))
            parts = []
            for a, b in slices(texts, (1 << 22) // max(4, len(m.labels) if m else 0)):
                n = b - a
                if m is None:
                    parts.append((np.zeros((n, 1), np.int64), np.zeros(n, np.int64)))
                    continue
                code, offs = encode(texts.slice(a, n), m.classes)
                letters = np.add.reduceat(np.r_[code != 0, False].astype(np.int64), offs[:-1]) * (np.diff(offs) > 0) if n else np.zeros(0, np.int64)
                parts.append((phrases(code, offs, m), np.where(letters > 0, np.diff(offs), 0)))
            if not parts:
                continue
            found, units = (np.concatenate(x) for x in zip(*parts, strict=True))
            best = found.argmin(1)
            least = found[np.arange(len(best)), best]
            rate = least / np.maximum(units, 1)
            rejected = (units == 0) | ((least - 1) / np.maximum(units, 1) > reject_rate)  # the last phrase ended with the text
            second = np.sort(found, 1)[:, 1] if found.shape[1] > 1 else least
            labels = pa.array(m.labels if m else [""], pa.string())
            values = {
                "predicted_lang": labels.take(pa.array(best, mask=rejected)),
                "n_units": pa.array(units),
                "phrases": pa.array(least),
                "phrase_rate": pa.array(rate),
                "margin": pa.array((second - least) / np.maximum(least, 1)),
                "rejected": pa.array(rejected),
            }
            out = pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(given))] + [values[k] for k in wanted], names=given + [names[k] for k in wanted])
            yield out.filter(pa.array(~rejected)) if only_accepted else out

    return source.mapInArrow(run, schema)
