"""Exact deduplication by distributed most-significant-digit radix partitioning (operator 6).

The first digit is the byte length with the first bytes. Digits are counted (partial sums first); a document whose digit is its own needs no
further look and is moved nowhere. A digit that holds many documents is split by the next, longer run of bytes, and so on over the
cluster, until its groups are small or have ended: the documents of a group that has ended are equal, and its least id is known from the
count, so they aren't moved either. The small groups are partitioned and sorted by their digits, and each descends a radix tree in its
task. Two documents that end together are equal: no digest is taken anywhere, and bytes are compared only as deep as another document
shares them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored

FIRST_BYTES = 16
#: Each digit of a large group ends so many times deeper than the one before.
DEEPER = 16
#: A group is split over the cluster if it has more documents than this and more than a fourth of an even partition.
LEAST_HOT = 1000
#: Digits that documents share are broadcast up to so many (else all documents are partitioned), those of large groups up to so many bytes (else the rest is left to the tasks).
BROADCAST_DIGITS, BROADCAST_BYTES = 1_000_000, 64 << 20


class RadixTree:
    """Documents of one length and first digit; holds each distinct one once."""

    def __init__(self, depth: int):
        self.top = (depth, 16, {})

    def place(self, data: bytes, row_id):
        """(whether an equal document came before, the id of the first of its equals)."""
        depth, width, table = self.top
        while True:
            digit = data[depth : depth + width]
            there = table.get(digit)
            if there is None:
                table[digit] = (data, row_id)
                return False, row_id
            if len(there) == 2:
                if depth + width >= len(data):
                    return True, there[1]
                child = (depth + width, 4 * width, {there[0][depth + width : depth + 5 * width]: there})
                table[digit] = child
                there = child
            depth, width, table = there


def _digit(level: int):
    """Of the documents' bytes, the run that the level adds."""
    start = FIRST_BYTES * DEEPER ** (level - 1) if level else 0
    return F.substring("__wa_data", start + 1, FIRST_BYTES * DEEPER**level - start)


def _split(store: Stored, rows: DataFrame, shared: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """rows with, for each level k of large groups, the group (g<k>, NULL outside), whether it has ended (e<k>) and its least id (f<k>); and the number of levels.

    There are no more large groups on a level than documents over the limit, so the tables that are broadcast are small.
    """
    level, found = 0, shared.filter(F.col("n") > limit).select("size", F.col("head").alias("digit"), "first", F.lit(None).cast("bigint").alias("parent"))
    while True:
        end = FIRST_BYTES * DEEPER**level
        groups = store.write(found.coalesce(1).withColumn("gid", F.monotonically_increasing_id()).withColumn("ended", F.col("size") <= end), f"groups{level}")
        told = groups.agg(F.count("*").alias("n"), F.sum(F.octet_length("digit")).alias("bytes"), F.max((~F.col("ended")).cast("int")).alias("open")).first()
        if not told["n"] or told["bytes"] > BROADCAST_BYTES:
            return rows, level
        named = F.broadcast(groups.select(F.col("size").alias("__s"), F.col("parent").alias("__p"), F.col("digit").alias("__d"), F.col("gid").alias(f"__wa_g{level}"), F.col("ended").alias(f"__wa_e{level}"), F.col("first").alias(f"__wa_f{level}")))
        same = (F.col("__wa_size") == F.col("__s")) & (_digit(level) == F.col("__d"))
        rows = rows.join(named, same & (F.col(f"__wa_g{level - 1}") == F.col("__p")) if level else same, "left").drop("__s", "__p", "__d")
        level += 1
        if not told["open"]:
            return rows, level
        deeper = rows.filter(f"__wa_g{level - 1} is not null and not __wa_e{level - 1}").groupBy(F.col("__wa_size").alias("size"), F.col(f"__wa_g{level - 1}").alias("parent"), _digit(level).alias("digit"))
        found = deeper.agg(F.count("*").alias("n"), F.min("__wa_id").alias("first")).filter(F.col("n") > limit).select("size", "digit", "first", "parent")


def mark_exact_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", keep: list[str] | None = None, only_kept: bool = False, keeper: str | None = "keep_id", flag: str | None = "is_duplicate") -> DataFrame:
    """The columns in keep (all, if None), with the id of the document that stands for all equal ones, and whether this one goes.

    Texts are compared byte by byte. The document with the lowest id stays (NULL ids come last;
    of rows with the same id and text, one stays). A NULL text equals no other; empty texts equal
    each other. keeper and flag replace input columns of the same name; None leaves them out.
    With only_kept, the documents that go are left out. An empty table gives an empty result. Ids can be of any type that has an order; names that begin with __wa_ are
    reserved. docs is read several times, so it should be a table.
    """
    store = Stored(docs.sparkSession, "exact")
    kind = docs.schema[key].dataType.simpleString()
    new = {keeper: kind, flag: "boolean"}
    new.pop(None, None)
    given = [c for c in (docs.columns if keep is None else keep) if c not in new]
    columns = [F.col(f"`{c}`") for c in given]
    rows = docs.select(*columns, F.col(f"`{key}`").alias("__wa_id"), F.encode(F.col(f"`{text}`"), "UTF-8").alias("__wa_data"))
    rows = rows.withColumn("__wa_size", F.octet_length("__wa_data"))
    shared = rows.filter("__wa_data is not null").groupBy(F.col("__wa_size").alias("size"), _digit(0).alias("head")).agg(F.count("*").alias("n"), F.min("__wa_id").alias("first"))
    shared = store.write(shared.filter("n > 1"), "digits")
    told = shared.agg(F.count("*").alias("digits"), F.sum("n").alias("rows")).first()
    limit = max(LEAST_HOT, (told["rows"] or 0) // (4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    rows = rows.withColumn("__wa_shared", F.col("__wa_data").isNotNull())
    if told["digits"] <= BROADCAST_DIGITS:
        small = F.broadcast(shared.select(F.col("size").alias("__s"), F.col("head").alias("__d"), F.lit(True).alias("__wa_shared")))
        rows = rows.drop("__wa_shared").join(small, (F.col("__wa_size") == F.col("__s")) & (_digit(0) == F.col("__d")), "left").drop("__s", "__d")
    placed, levels = _split(store, rows, shared, limit)
    ended, least, deep = F.lit(False), F.lit(None).cast(kind), F.lit(b"")
    for k in range(levels):
        ended = ended | F.coalesce(F.col(f"__wa_e{k}"), F.lit(False))
        least = F.when(F.coalesce(F.col(f"__wa_e{k}"), F.lit(False)), F.col(f"__wa_f{k}")).otherwise(least)
        deep = F.when(F.col(f"__wa_g{k}").isNotNull(), _digit(k + 1)).otherwise(deep)
    placed = placed.withColumns({"__wa_ended": ended, "__wa_least": least, "__wa_digit": F.concat(_digit(0), deep)})
    goes = F.col("__wa_ended") & ~F.col("__wa_id").eqNullSafe(F.col("__wa_least"))

    result = lambda of, stays, gone: of.select(*columns, *[{keeper: stays, flag: F.lit(gone)}[c].alias(c) for c in new])
    alone = result(rows.filter(~F.coalesce(F.col("__wa_shared"), F.lit(False))), F.col("__wa_id"), False)
    known = result(placed.filter(goes), F.col("__wa_least"), True)
    here = text if text in given else "__wa_data"
    parts = placed.filter(F.col("__wa_shared") & ~goes).select(*columns, "__wa_id", *(["__wa_data"] if here != text else []), "__wa_size", "__wa_digit")
    parts = parts.repartition("__wa_size", "__wa_digit").sortWithinPartitions("__wa_size", "__wa_digit", F.col("__wa_id").asc_nulls_last())
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in given] + [f"`{k}` {v}" for k, v in new.items()])

    def run(batches):
        tree, now = None, None
        for number, batch in enumerate(batches):
            n = batch.num_rows
            if not n:
                continue
            size, head = (batch.column(batch.schema.get_field_index(f"__wa_{x}")) for x in ("size", "digit"))
            ids, datas = batch.column(batch.schema.get_field_index("__wa_id")), batch.column(batch.schema.get_field_index(here)).cast(pa.binary())
            start = np.ones(n, bool)
            if n > 1:
                start[1:] = ~pc.and_(pc.equal(size[1:], size[:-1]), pc.equal(head[1:], head[:-1])).to_numpy(zero_copy_only=False)
            goes, stays = np.zeros(n, bool), np.arange(n)
            outside: dict[int, object] = {}
            edges = np.flatnonzero(start)
            sizes = np.diff(np.r_[edges, n])
            look = np.repeat((sizes > 1) | (edges == 0) | (edges == edges[-1]), sizes)
            for i in np.flatnonzero(look).tolist():
                if start[i]:
                    digit = (size[i].as_py(), head[i].as_py())
                    if digit != now:
                        tree, now = RadixTree(FIRST_BYTES), digit
                # The tree keeps a batch-independent id; rows of this batch are found by their place. id(batch) wouldn't tell batches apart: it is used again once a batch is freed.
                dup, first = tree.place(datas[i].as_py(), (ids[i].as_py(), number, i))
                if dup:
                    goes[i] = True
                    if first[1] == number:
                        stays[i] = first[2]
                    else:
                        outside[i] = first[0]
            arrays = [batch.column(k) for k in range(len(given))]
            if keeper:
                kept = ids.take(pa.array(stays))
                if outside:
                    values = kept.to_pylist()
                    for i, v in outside.items():
                        values[i] = v
                    kept = pa.array(values, kept.type)
                arrays.append(kept)
            if flag:
                arrays.append(pa.array(goes))
            out = pa.RecordBatch.from_arrays(arrays, names=given + list(new))
            yield out.filter(pa.array(~goes)) if only_kept else out

    out = parts.mapInArrow(run, schema).union(alone)
    return out if only_kept else out.union(known)
