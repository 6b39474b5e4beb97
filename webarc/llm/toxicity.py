"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression (operator 10).

Features of a text: densities of a given lexicon and of one learnt from labels, second-person words and their nearness to
lexicon words, capitals, punctuation, and obfuscation (words that enter the lexicon once look-alike
characters are undone). They are computed for a batch of texts at once, on hashes of words.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffer_of, byte_classes, slices, small_batches, words

#: Labelled rows that the model is fitted on, at most; they are picked by a hash. All documents are scored.
SAMPLE_ROWS = 20_000
FLAG_AT = 0.5
NEAR = 5
FOLDS = 3

INSULTS = """
arse arsehole ass asshole bastard bitch brainless clown coward crap creep cretin cunt degenerate dick dimwit dirtbag disgrace disgusting douche
dumb dumbass dunce fag faggot fatso filth filthy fool freak freaks fuck fucked fucker fucking garbage hate hateful hideous hypocrite idiot
idiotic idiots ignorant imbecile incompetent inferior jackass jerk kike lame liar loser losers loathsome lowlife lunatic maggot miserable moron
moronic morons motherfucker nasty nigger nitwit obnoxious parasite pathetic pig prick psycho pussy rat repulsive retard retarded rotten rubbish
savage scum scumbag shit shithead shitty sick sicko simpleton sissy slut smelly snake spineless stupid stupidity suck sucker sucks swine thug
trash traitor troll twat twit ugly useless vermin vile wanker weirdo whore witless worthless wretch
arschloch blödmann depp drecksau dumm dummkopf fotze hurensohn hure idioten miststück scheisse scheiße schlampe schwein trottel vollidiot wichser abschaum versager
abruti batard bâtard con connard connasse crétin débile enculé imbécile merde minable ordure pute putain raclure salaud salope
basura cabrón estúpido gilipollas idiota imbécil inútil mierda payaso pendejo puta puto zorra
""".split()
SECOND_PERSON = "you your yours yourself yourselves u ur ya du dich dir dein deine deiner deinem deinen ihr euch euer tu toi te ton ta tes vous votre vos tú ti tuyo tus usted ustedes vosotros".split()

FEATURES = ("lexicon", "learnt", "distinct", "near_you", "you", "capitals", "shouted", "exclaimed", "punctuation", "obfuscated", "symbols", "repeated", "log_words")

_LOOKALIKE = np.arange(256, dtype=np.uint8)
for _a, _b in zip(b"01345789@$!|+", b"oieastbgasilt", strict=True):
    _LOOKALIKE[_a] = _b
_DROPPED = np.zeros(256, bool)
_DROPPED[np.frombuffer(b"*.-_'\"~^`,;:?%&#()[]{}<>=/\\", np.uint8)] = True
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[np.frombuffer(bytes(set(range(33, 127)) - set(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")), np.uint8)] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = _LETTER[128:] = True


def hashes(terms: list[str]) -> np.ndarray:
    raw, offs = buffer_of(pa.array([t.lower() for t in terms], pa.string()))
    return np.unique(words(raw, offs, byte_classes(raw))[0])


def _among(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table) or not len(h):
        return np.zeros(len(h), bool)
    return table[np.minimum(np.searchsorted(table, h), len(table) - 1)] == h


def features(texts: pa.Array, given: np.ndarray, learnt: np.ndarray, you: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text; zeros for a NULL text and one without words."""
    n = len(texts)
    raw, offs = buffer_of(texts)
    size = np.maximum(np.diff(offs), 1)
    count = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offs])
    low_raw, low_offs = buffer_of(pc.utf8_lower(texts))
    h, row, start, end = words(low_raw, low_offs, byte_classes(low_raw))
    total = np.maximum(np.bincount(row, minlength=n), 1)
    per = lambda mask: np.bincount(row[mask], minlength=n)
    in_given, in_learnt, in_you = _among(h, given), _among(h, learnt), _among(h, you)
    hit = in_given | in_learnt
    near = np.zeros(len(h), bool)
    for k in range(1, NEAR + 1):
        same = row[k:] == row[:-k]
        near[k:] |= in_you[:-k] & same
        near[:-k] |= in_you[k:] & same
    distinct = np.unique(np.stack([row[hit].astype(np.uint64), h[hit]]), axis=1)[0].astype(np.int64) if hit.any() else np.zeros(0, np.int64)

    plain = np.delete(low_raw, np.flatnonzero(_DROPPED[low_raw]))
    plain_offs = np.concatenate([[0], np.cumsum(~_DROPPED[low_raw])])[low_offs]
    oh, orow, _, _ = words(_LOOKALIKE[plain], plain_offs, byte_classes(_LOOKALIKE[plain], "visible"))
    both = np.union1d(given, learnt)
    clear = np.bincount(orow[_among(oh, both)], minlength=n)
    hidden = np.maximum(clear - per(hit), 0)

    upper = _UPPER[raw]
    w_h, w_row, w_start, w_end = words(raw, offs, byte_classes(raw))
    ups = np.concatenate([[0], np.cumsum(upper)])
    shouted = (w_end - w_start >= 3) & (ups[w_end] - ups[w_start] == w_end - w_start)
    wrow = np.bincount(w_row[shouted], minlength=n)
    inner = np.zeros(len(raw), bool)
    if len(raw) > 2:
        inner[1:-1] = _PUNCTUATION[raw[1:-1]] & _LETTER[raw[:-2]] & _LETTER[raw[2:]]
    again = np.zeros(len(raw), bool)
    if len(raw) > 2:
        again[2:] = (low := _LETTER[raw])[2:] & (raw[2:] == raw[1:-1]) & (raw[1:-1] == raw[:-2]) & low[1:-1]
    out = np.stack([
        100 * per(in_given) / total, 100 * per(in_learnt) / total, np.bincount(distinct, minlength=n), per(hit & near) / total * 100, 100 * per(in_you) / total,
        count(upper) / np.maximum(count(_LETTER[raw]), 1), wrow / total, count(raw == 33) / size, count(_PUNCTUATION[raw]) / size, 100 * hidden / total, 100 * count(inner) / size, 100 * count(again) / size,
        np.log1p(np.bincount(row, minlength=n)),
    ], 1)
    return out.astype(np.float64)


@dataclass
class Trees:
    """Depth-wise regression trees on the logistic loss; nodes in heap order."""

    base: float = 0.0
    feature: list[np.ndarray] = field(default_factory=list)
    cut: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        at = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(v)))):
                node = 2 * node + 1 + (x[at, f[node]] > c[node])
            out += v[node - (len(v) - 1)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, smooth: float = 1.0, bins: int = 32, least: float = 2.0) -> Trees:
    cuts = [np.unique(np.quantile(c[c > c.min()], np.linspace(0, 1, bins)[:-1])) if (c > c.min()).any() else np.zeros(0) for c in x.T]
    cuts = [np.unique(np.r_[c.min(), q]) if len(q) else q for c, q in zip(x.T, cuts, strict=True)]  # a cut at the least value parts it from the rest
    binned = np.stack([np.searchsorted(q, c, side="left") for q, c in zip(cuts, x.T, strict=True)], 1)
    width = bins + 2
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    out = Trees(float(np.log(mean / (1 - mean))))
    margin = np.full(len(y), out.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), np.int64)
        feature, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        for level in range(depth):
            k, first = 2**level, 2**level - 1
            best = np.full(k, 1e-6)
            choice = np.full(k, -1)
            for f, q in enumerate(cuts):
                if not len(q):
                    continue
                slot = (node - first) * width + binned[:, f]
                gs = np.bincount(slot, g, k * width).reshape(k, width).cumsum(1)
                hs = np.bincount(slot, h, k * width).reshape(k, width).cumsum(1)
                ga, ha = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + smooth) + (ga - gs) ** 2 / (ha - hs + smooth) - ga**2 / (ha + smooth)
                gain[(hs < least) | (ha - hs < least)] = 0
                gain = gain[:, : len(q)]
                top = gain.argmax(1)
                better = gain[np.arange(k), top] > best
                best[better] = gain[np.arange(k), top][better]
                feature[first + np.flatnonzero(better)] = f
                cut[first + np.flatnonzero(better)] = q[top[better]]
                choice[better] = top[better]
            right = (choice[node - first] >= 0) & (binned[np.arange(len(y)), feature[node]] > choice[node - first])
            node = 2 * node + 1 + right
        place = node - (2**depth - 1)
        value = -rate * np.bincount(place, g, 2**depth) / (np.bincount(place, h, 2**depth) + smooth)
        out.feature.append(feature)
        out.cut.append(cut)
        out.leaf.append(value)
        margin = margin + value[place]
    return out


def fit_isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing function nearest to y (pool adjacent violators); between knots it is linear."""
    values, at = np.unique(score, return_inverse=True)
    weight = np.bincount(at).astype(float)
    mean = np.bincount(at, y) / weight
    stack: list[list[float]] = []  # mean, weight, first and last score
    for v, m, w in zip(values, mean, weight, strict=True):
        stack.append([m, w, v, v])
        while len(stack) > 1 and stack[-2][0] >= stack[-1][0]:
            m2, w2, _, last = stack.pop()
            m1, w1, first, _ = stack.pop()
            stack.append([(m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2, first, last])
    return np.array([x for s in stack for x in s[2:]]), np.array([s[0] for s in stack for _ in range(2)])


@dataclass
class Model:
    given: np.ndarray
    learnt: np.ndarray
    you: np.ndarray
    trees: Trees
    knots: tuple[np.ndarray, np.ndarray]

    def probability(self, texts: pa.Array) -> np.ndarray:
        return self.calibrated(self.trees.margin(features(texts, self.given, self.learnt, self.you)))

    def calibrated(self, margin: np.ndarray) -> np.ndarray:
        return np.interp(margin, *self.knots)


def labelled_sample(docs: DataFrame, labels: DataFrame, text: str, key: str, label: str, rows: int) -> DataFrame:
    """(k, t, y) of at most about so many labelled documents, by a hash of the key; an id with labels of both kinds teaches nothing."""
    known = labels.select(F.col(f"`{key}`").alias("k"), F.col(f"`{label}`").cast("int").alias("y")).filter("k is not null and y in (0, 1)").groupBy("k").agg(F.min("y").alias("y"), F.max("y").alias("z")).filter("y = z").drop("z")
    n = known.count()
    if n > rows:
        known = known.orderBy(F.xxhash64("k"), "k").limit(rows)
    texts = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).filter("t is not null")
    return texts.join(F.broadcast(known), "k")  # its size is bounded by rows


def learn_lexicon(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Which words speak for toxicity: in 3 toxic documents or more, with a smoothed log-odds of 2.5 deviations or more above 1."""
    a, b = toxic + 0.5, clean + 0.5
    odds = np.log(a / (n_toxic - toxic + 0.5)) - np.log(b / (n_clean - clean + 0.5))
    spread = np.sqrt(1 / a + 1 / b)
    return (toxic >= 3) & (odds - 1.0 > 1.2 * spread) & (odds > 2.0)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", rows: int = SAMPLE_ROWS) -> Model | None:
    """A model from labels (1 toxic, 0 not) of at most rows documents; None unless both kinds are there.

    The learnt lexicon of a training document comes from the other folds, and so does the margin that calibration sees.
    """
    sample = labelled_sample(docs, labels, text, key, label, rows).withColumn("fold", F.pmod(F.xxhash64("k", F.lit(7)), F.lit(FOLDS)).cast("int"))

    def word_rows(batches):
        for batch in batches:
            y, fold = (np.asarray(batch.column(i)) for i in (1, 2))
            for a, b in slices(batch.column(0)):
                raw, offs = buffer_of(pc.utf8_lower(batch.column(0).slice(a, b - a)))
                h, r, _, _ = words(raw, offs, byte_classes(raw))
                pairs = np.unique(np.stack([r.astype(np.uint64), h]), axis=1) if len(h) else np.zeros((2, 0), np.uint64)
                r = pairs[0].astype(np.int64) + a
                yield pa.RecordBatch.from_arrays([pa.array(pairs[1].view(np.int64)), pa.array(y[r]), pa.array(fold[r])], names=["h", "y", "fold"])

    sizes = {(r["fold"], r["y"]): r["count"] for r in sample.groupBy("fold", "y").count().collect()}
    if len({y for _, y in sizes}) < 2:
        return None
    cells = [(f, y) for f in range(FOLDS) for y in (0, 1)]
    counted = sample.select("t", "y", "fold").mapInArrow(word_rows, "h bigint, y int, fold int").groupBy("h").agg(*[F.count(F.when((F.col("fold") == f) & (F.col("y") == y), 1)).alias(f"c{f}_{y}") for f, y in cells])
    often = counted.filter(" + ".join(f"c{f}_1" for f in range(FOLDS)) + " >= 3").toPandas()  # of a bounded sample
    h = often["h"].to_numpy(np.int64).view(np.uint64)
    by = {c: often[f"c{c[0]}_{c[1]}"].to_numpy(np.int64) for c in cells}

    def lexicon(without: int | None) -> np.ndarray:
        use = [f for f in range(FOLDS) if f != without]
        t, c = (sum((by[f, y] for f in use), np.zeros(len(h), np.int64)) for y in (1, 0))
        nt, nc = (sum(sizes.get((f, y), 0) for f in use) for y in (1, 0))
        return np.sort(h[learn_lexicon(t, c, nt, nc)])

    given, you = hashes(INSULTS), hashes(SECOND_PERSON)
    learnt = [lexicon(f) for f in range(FOLDS)]

    def feature_rows(batches):
        for batch in batches:
            y, fold = (np.asarray(batch.column(i)) for i in (1, 2))
            for a, b in slices(batch.column(0)):
                texts = batch.column(0).slice(a, b - a)
                x = np.zeros((b - a, len(FEATURES)))
                for f in range(FOLDS):
                    at = np.flatnonzero(fold[a:b] == f)
                    if len(at):
                        x[at] = features(texts.take(pa.array(at)), given, learnt[f], you)
                yield pa.RecordBatch.from_arrays([pa.array(y[a:b]), pa.array(fold[a:b]), *map(pa.array, x.T)], names=["y", "fold", *FEATURES])

    table = sample.select("t", "y", "fold").mapInArrow(feature_rows, "y int, fold int, " + ", ".join(f"{f} double" for f in FEATURES)).toPandas().sort_values(["fold", "y", *FEATURES])
    x, y, fold = table[list(FEATURES)].to_numpy(), table["y"].to_numpy(float), table["fold"].to_numpy()
    margin = np.zeros(len(y))
    for f in range(FOLDS):
        if (fold == f).any():
            margin[fold == f] = fit_trees(x[fold != f], y[fold != f]).margin(x[fold == f]) if (fold != f).any() else 0.0
    return Model(given, lexicon(None), you, fit_trees(x, y), fit_isotonic(margin, y))


def score(docs: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None, flag_at: float = FLAG_AT) -> DataFrame:
    """The columns in keep (all, if None) with toxicity (a calibrated probability) and is_toxic (from flag_at up).

    The whole text counts. A NULL text has NULL in both; an empty one, or one without words, is scored like any other on features of 0.
    Without a model both are NULL. Rows stay as often as they come; the results replace input
    columns of their names.
    """
    given = [c for c in (docs.columns if keep is None else keep) if c not in ("toxicity", "is_toxic")]
    source = docs.select(*[F.col(f"`{c}`") for c in given], F.col(f"`{text}`").alias("__wa_text"))
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in given] + ["toxicity double", "is_toxic boolean"])
    shipped = small_batches(docs.sparkSession).sparkContext.broadcast(model)

    def run(batches):
        m = shipped.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("__wa_text"))
            missing = np.asarray(texts.is_null()) | (m is None)
            parts = [m.probability(texts.slice(a, b - a)) if m else np.zeros(b - a) for a, b in slices(texts)]
            p = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(given))] + [pa.array(p, mask=missing), pa.array(p >= flag_at, mask=missing)], names=[*given, "toxicity", "is_toxic"])

    return source.mapInArrow(run, schema)
