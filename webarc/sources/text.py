"""Lines of text files, read leniently: bytes that aren't UTF-8 are taken for cp1252, compressed files are decoded too."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.encoding import bytes_to_str
from .codecs import codec_of_name, members
from .files import ALLOW_IF_WILDCARD, match_files, open_file, splits_of

SPLIT, LEAST = 64 << 20, 1 << 20
#: Bytes that a task reads, if there are more than a shuffle has tasks for.
TASK = 16 << 20
_BATCH = 1 << 20


def read_text(spark: SparkSession, pattern: str, empty: str = ALLOW_IF_WILDCARD, desired_split_size: int = SPLIT, min_split_size: int = LEAST, shuffle_splits: bool = True, encoding: str | None = None) -> DataFrame:
    """(path, line) of the files that match. With an encoding, bytes are decoded strictly by it first."""
    return read_all_text(match_files(spark, pattern, empty), desired_split_size, min_split_size, shuffle_splits, encoding)


def text_splits(files: DataFrame, desired: int = SPLIT, least: int = LEAST) -> DataFrame:
    """(path, start, stop, size) of the splits of files (path, size); a compressed file is one split."""
    spec = "array<struct<start:bigint,stop:bigint>>"

    def cut(batches):
        for batch in batches:
            paths, sizes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            found = [[(0, n)] if codec_of_name(p) not in (None, "none") else splits_of(n, desired, least) for p, n in zip(paths, sizes, strict=True)]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([[{"start": a, "stop": b} for a, b in f] for f in found], kind)], names=["path", "size", "s"])

    return files.select("path", "size").mapInArrow(cut, f"path string, size bigint, s {spec}").select("path", "size", F.explode("s").alias("s")).select("path", "s.start", "s.stop", "size")


def read_all_text(files: DataFrame, desired: int = SPLIT, least: int = LEAST, shuffle: bool = True, encoding: str | None = None) -> DataFrame:
    """(path, line) of files (path, size). A line belongs to the split in which it starts; the last one needs no line end."""
    splits = text_splits(files, desired, least)
    if shuffle:
        total = files.agg(F.sum("size")).first()[0] or 0  # the splits' own bytes don't tell Spark how much there is to read
        splits = splits.repartition(max(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // TASK), F.xxhash64("path", "start"))

    def run(batches):
        for batch in batches:
            for path, start, stop, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held, n = [], 0
                for line in _lines(path, start, stop, size):
                    held.append(bytes_to_str(line, encoding or "utf-8", strip_bom=False))
                    n += len(line)
                    if n > _BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array([path] * len(held)), pa.array(held, pa.string())], names=["path", "line"])
                        held, n = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(held)), pa.array(held, pa.string())], names=["path", "line"])

    return splits.mapInArrow(run, "path string, line string")


def _lines(path: str, start: int, stop: int, size: int):
    codec = codec_of_name(path)
    with open_file(path) as f:
        if codec not in (None, "none"):
            rest = b""
            for _, block in members(f, codec):
                *done, rest = (rest + block).split(b"\n")
                yield from done
            if rest:
                yield rest
            return
        at = start
        if start:
            f.seek(start - 1)
            at = start - 1 + len(f.readline())
        while at < stop and (line := f.readline()):
            at += len(line)
            yield line[:-1] if line.endswith(b"\n") else line
