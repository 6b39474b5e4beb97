"""What the corpus operators share: storage for intermediate tables and vectorised text kernels.

The kernels work on the UTF-8 bytes of an Arrow string column as one buffer, so that no Python
object is made for a word or a shingle.
"""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import small_batches

_OWN_DIR: list[str] = []
_LIBC = ctypes.CDLL(None) if hasattr(ctypes.CDLL(None), "malloc_trim") else None


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``); a temporary one where it is unset and one machine does all."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append("file://" + tempfile.mkdtemp(prefix="webarc_shared_"))
    return _OWN_DIR[0]


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is already down; the folder belongs to it
        pass


class Stored:
    """Tables written below the shared folder, so that a lost executor costs no recomputation."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.root = small_batches(spark), f"{shared_dir(spark)}/webarc-{what}-{uuid.uuid4().hex}"
        atexit.register(_delete, spark, self.root)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        tidy = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = self.spark.conf.get(tidy, None)
        self.spark.conf.set(tidy, "true")  # shuffle files go once the table is there, not when the driver happens to collect its garbage
        try:
            df.write.mode("overwrite").options(compression="zstd", **{"parquet.writer.version": "PARQUET_2_0"}).parquet(path)
        finally:
            self.spark.conf.unset(tidy) if before is None else self.spark.conf.set(tidy, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        _delete(self.spark, f"{self.root}/{name}")


def keep_small_side(small: DataFrame, rows: int, limit: int) -> DataFrame:
    """Marks a side for broadcasting only if its counted rows are within the limit; else a shuffle joins it."""
    return F.broadcast(small) if rows <= limit else small.hint("merge")


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, component) of an undirected graph given by its edges (u, v); a component is named by its lowest node.

    Alternates large-star and small-star steps; ends after a number of rounds that grows with the logarithm of the nodes. A node's
    least neighbour comes from a partial aggregation and is joined back, so that a node with a large share of all edges
    can be split over tasks. NULLs and loops are dropped, repeated edges count once.
    """
    store = Stored(spark, "components")
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v and u is not null and v is not null").distinct()
    now, at, before = store.write(now, "0"), 0, None
    mark = lambda e: e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    with_least = lambda e: e.join(e.groupBy("u").agg(F.min("v").alias("m")).hint("merge"), "u")
    while (state := mark(now)) != before and state["n"]:
        before = state
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        low = with_least(large.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        small = low.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u != v").distinct()
        at += 1
        now = store.write(small, str(at))
        store.drop(str(at - 1))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


# ---- bytes ---------------------------------------------------------------------------------

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}

#: Scripts written without blanks; each of their characters is a word.
_SCRIPTS = ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar")


def _word_pattern(script: str, letters: str = "LNM") -> str:
    lone = "".join(rf"\p{{{script}{x}}}" for x in _SCRIPTS)
    return f"[{lone}]|(?:" + "|".join(rf"[^\P{{{x}}}{lone}]" for x in letters) + ")+"


#: A word: a run of letters, digits and marks, or one character of those scripts. The same in SQL and in Java's dialect.
WORD_SQL, WORD_JAVA = _word_pattern(""), _word_pattern("Is")
#: What stands between words.
BLANK_SQL = r"[^\p{L}\p{N}\p{M}" + "".join(rf"\p{{{x}}}" for x in _SCRIPTS) + "]+"
#: Classes of characters, later ones first: words and words of one character; what is visible; letters, numbers, white space and the rest.
_KINDS = {"word": {1: r"[\p{L}\p{N}\p{M}]+", 2: "[" + "".join(rf"\p{{{x}}}" for x in _SCRIPTS) + "]+"}, "visible": {1: r"\S+"}, "split": {4: r"(?s:.+)", 1: r"\p{L}+", 2: r"\p{N}+", 3: r"\s+"}}
_CLASSES: dict[str, np.ndarray] = {}


def _class_table(what: str) -> np.ndarray:
    """By code point, its class."""
    if what not in _CLASSES:
        table = np.zeros(0x110000, np.uint8)
        every = np.r_[:0xD800, 0xE000:0x110000].astype("<u4").tobytes().decode("utf-32-le")  # a list of its characters would take 150 MB in each worker
        for value, pattern in _KINDS[what].items():
            for m in regex.finditer(pattern, every):
                a, b = (x + 0x800 * (x >= 0xD800) for x in m.span())
                table[a:b] = value
        table[0xD800:0xE000] = 0
        _CLASSES[what] = table
    return _CLASSES[what]


def lead_points(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and code points of the characters outside ASCII."""
    lead = np.flatnonzero(raw >= 0xC0)
    if not len(lead):
        return lead, lead
    b = np.zeros((4, len(lead)), np.uint32)
    for k in range(4):
        b[k] = raw[np.minimum(lead + k, len(raw) - 1)]
    two, three = (b[0] & 0x1F) << 6 | b[1] & 0x3F, (b[0] & 0x0F) << 12 | (b[1] & 0x3F) << 6 | b[2] & 0x3F
    four = (b[0] & 0x07) << 18 | (b[1] & 0x3F) << 12 | (b[2] & 0x3F) << 6 | b[3] & 0x3F
    return lead, np.minimum(np.where(b[0] < 0xE0, two, np.where(b[0] < 0xF0, three, four)), 0x10FFFF)


def byte_classes(raw: np.ndarray, what: str = "word") -> np.ndarray:
    """The class of the character that each byte of UTF-8 belongs to, by words or by what is visible."""
    table = _class_table(what)
    out = table[:256][raw]
    lead, points = lead_points(raw)
    if len(lead):
        of, first = table[points], raw[lead]
        for k in range(4):
            more = np.flatnonzero(first >= (0, 0, 0xE0, 0xF0)[k])
            out[np.minimum(lead[more] + k, len(raw) - 1)] = of[more]
    return out


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _POWERS or len(_POWERS["p"]) < n:
        size = max(n, 1 << 16)
        for key, base in (("p", _P), ("i", _P_INV)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            with np.errstate(over="ignore"):
                np.cumprod(a, out=a)
            _POWERS[key] = a
    return _POWERS["p"][:n], _POWERS["i"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string array; nulls count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_string())
    offs = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset) if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def slices(column: pa.Array, most_bytes: int = 2 << 20):
    """(start, stop) row ranges whose texts hold about so many bytes, one row at least."""
    n = len(column)
    if not n:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64)
    group = np.cumsum(sizes) // most_bytes
    cuts = np.flatnonzero(np.diff(group)) + 1
    yield from zip([0, *cuts.tolist()], [*cuts.tolist(), n], strict=True)
    release()


def release() -> None:
    """Gives memory that batches no longer use back to the machine; allocators would keep it for as long as the worker lives."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def words(raw: np.ndarray, offs: np.ndarray, kinds: np.ndarray, hashed: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words by the classes of the bytes, never across rows: hash (none, unless hashed), row, first byte, end byte of each."""
    n = len(raw)
    if not n:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z, z
    inside = kinds > 0
    first = inside.copy()
    alone = (kinds == 2) & ((raw & 0xC0) != 0x80)
    first[1:] &= (kinds[1:] != kinds[:-1]) | alone[1:]
    starts_rows = offs[:-1][(offs[:-1] < n) & (np.diff(offs) > 0)]
    first[starts_rows] = inside[starts_rows]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not hashed:
        return np.zeros(0, np.uint64), np.searchsorted(offs, start, side="right") - 1, start, end
    p, inv = _powers(n)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * p, out=total[1:])
        h = mix((total[end] - total[start]) * inv[start] + (end - start).astype(np.uint64))
    return h, np.searchsorted(offs, start, side="right") - 1, start, end


def grams(h: np.ndarray, row: np.ndarray, n: int, short: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and index of the first word of each n-gram. With short, a row of under n words has one gram of all its words."""
    m = len(h)
    if not m:
        return h, row, np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        g = np.zeros(max(0, m - n + 1), np.uint64)
        for k in range(n):
            g = mix(g * np.uint64(31) + h[k : k + len(g)])
    at = np.flatnonzero(row[: len(g)] == row[n - 1 : n - 1 + len(g)]) if len(g) else np.zeros(0, np.int64)
    g, r = g[at], row[at]
    if short:
        head = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        count = np.diff(np.r_[head, m])
        few = np.flatnonzero(count < n)
        if len(few):
            own = np.zeros(len(few), np.uint64)
            with np.errstate(over="ignore"):
                for k in range(n - 1):
                    has = count[few] > k
                    own[has] = mix(own[has] * np.uint64(31) + h[head[few[has]] + k])
            g, r, at = np.r_[g, own], np.r_[r, row[head[few]]], np.r_[at, head[few]]
            order = np.argsort(at, kind="stable")
            g, r, at = g[order], r[order], at[order]
    return g, r, at


def distinct_per_row(g: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The set of grams of each row, sorted by row, then by gram; rows come in order."""
    at = first_of_each(g, row)
    return g[at], row[at]


def first_of_each(g: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Where a gram of each set of grams is found, in the order of distinct_per_row."""
    if not len(g):
        return np.zeros(0, np.int64)
    bits = int(row[-1] - row[0]).bit_length()
    order = np.argsort((row - row[0]).astype(np.uint64) << np.uint64(64 - bits) | g >> np.uint64(bits) if bits else g)
    a, r = g[order], row[order]
    if len(a) > 1 and (falls := (a[1:] < a[:-1]) & (r[1:] == r[:-1])).any():  # grams that begin with the same bits
        near = np.zeros(len(a), bool)
        near[1:] |= falls
        for i in np.flatnonzero(near).tolist():
            lo, hi = np.searchsorted(r, [r[i], r[i] + 1])
            order[lo:hi] = order[lo:hi][np.argsort(g[order[lo:hi]])]
        a = g[order]
    return order[np.r_[True, (a[1:] != a[:-1]) | (r[1:] != r[:-1])]]


class Table:
    """A hash table from non-negative 64-bit keys to 32-bit values, looked up for many keys at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(3 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, -1, np.int32)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[at[left]] < 0
            slots, first = np.unique(at[left[free]], return_index=True)
            placed = left[free][first]
            self.keys[slots], self.values[slots] = keys[placed], values[placed]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values; -1 for keys that aren't there."""
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], -1)
        left = np.flatnonzero((found != keys) & (found >= 0))
        while len(left):
            at[left] = (at[left] + 1) & (len(self.keys) - 1)
            found = self.keys[at[left]]
            same = found == keys[left]
            out[left[same]] = self.values[at[left[same]]]
            left = left[~same & (found >= 0)]
        return out
