"""Listing files and cutting them into splits."""

from __future__ import annotations

import glob
import os
from typing import BinaryIO

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ALLOW, DISALLOW, ALLOW_IF_WILDCARD = "allow", "disallow", "allow_if_wildcard"
_WILD = set("*?[{")


def _local(path: str) -> str | None:
    if path.startswith("file:"):
        return path[5:] if not path.startswith("file://") else path[7:]
    return path if "://" not in path else None


def is_pattern(path: str) -> bool:
    return any(c in _WILD for c in path)


def list_files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files that a path, folder or pattern names, sorted; names that start with . or _ don't count in folders."""
    local = _local(path)
    if local is not None:
        found = glob.glob(local, recursive=True) if is_pattern(local) else [local] if os.path.exists(local) else []
        out = []
        for p in found:
            if os.path.isdir(p):
                out += [os.path.join(d, n) for d, _, names in os.walk(p) for n in names if n[0] not in "._"]
            else:
                out.append(p)
        return sorted((p, os.path.getsize(p)) for p in set(out))
    base = path.split("*", 1)[0].rsplit("/", 1)[0] if is_pattern(path) else path
    fs, root = pafs.FileSystem.from_uri(base)
    info = fs.get_file_info(root)
    infos = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
    head = base[: len(base) - len(root)]
    import fnmatch

    return sorted((head + i.path, i.size) for i in infos if i.type == pafs.FileType.File and i.base_name[0] not in "._" and (not is_pattern(path) or fnmatch.fnmatch(head + i.path, path)))


def open_file(path: str) -> BinaryIO:
    local = _local(path)
    if local is not None:
        return open(local, "rb", buffering=1 << 20)
    fs, p = pafs.FileSystem.from_uri(path)
    return fs.open_input_file(p)


class Folder:
    """A folder to write files into, on this machine's file system or on one named by a URI (as pyarrow.fs knows them)."""

    def __init__(self, path: str):
        local = _local(path)
        self.fs, self.root = (pafs.LocalFileSystem(), os.path.abspath(local)) if local is not None else pafs.FileSystem.from_uri(path)

    def open(self, name: str) -> BinaryIO:
        self.fs.create_dir(self.root, recursive=True)
        return self.fs.open_output_stream(f"{self.root}/{name}", compression=None, buffer_size=1 << 20)

    def rename(self, name: str, new: str) -> None:
        self.fs.move(f"{self.root}/{name}", f"{self.root}/{new}")

    def names(self) -> set[str]:
        return {i.base_name for i in self.fs.get_file_info(pafs.FileSelector(self.root, allow_not_found=True)) if i.type == pafs.FileType.File}

    def delete(self, name: str) -> None:
        self.fs.delete_file(f"{self.root}/{name}")


def match_files(spark: SparkSession, pattern: str, empty: str = ALLOW_IF_WILDCARD, shuffle: int | None = None) -> DataFrame:
    """(path, size). No match is an error, but where empty allows it; shuffle spreads the rows over so many partitions."""
    found = list_files(pattern)
    if not found and (empty == DISALLOW or (empty == ALLOW_IF_WILDCARD and not is_pattern(pattern))):
        raise FileNotFoundError(f"no files match {pattern}")
    df = spark.createDataFrame(found, "path string, size bigint")
    return df.repartition(shuffle, F.xxhash64("path")) if shuffle else df


def splits_of(size: int, desired: int, least: int) -> list[tuple[int, int]]:
    """(start, stop) of pieces of the desired size; a rest below least joins the piece before."""
    out = [(a, min(size, a + desired)) for a in range(0, size, desired)]
    if len(out) > 1 and out[-1][1] - out[-1][0] < least:
        last = out.pop()
        out[-1] = (out[-1][0], last[1])
    return out
