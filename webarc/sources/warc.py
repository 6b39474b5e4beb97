"""The data source "warc": batch and streaming reads, and a writer with one member a record.

    register(spark)
    spark.read.format("warc").option("recordTypes", "response").load("/archive/*.warc.gz")
    records.write.format("warc").option("compression", "zstd").mode("append").save("/out")

Files whose members can be found on their own are cut into splits, so one large file is read by many tasks. A split owns the
records whose members start in it. Only the columns of the schema that is asked for are made. What to read is said by options
(recordTypes, minContentLength, maxContentLength, streamPos, verifyDigests), which act before a record's body is read. Filters aren't taken
from Spark's planner: in 4.1 a relation keeps what one query pushed down, and other queries on the same DataFrame would lose rows.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .. import prepare
from .codecs import Buffered, codec_of_name, compress, dictionary_frame, members, next_member, sniff
from .files import Folder, list_files, open_file, splits_of
from .records import ANY_TYPE, RECORD_TYPES, Record, Scan, content_charset, first, new_record_id, parse_date, parse_http_date, record_bytes, status_parts

PAIRS = "array<struct<key:string,value:string>>"
SCHEMA = f"""path string, stream_pos bigint, record_length bigint, warc_version string, record_id string, record_type string, record_type_code int,
record_date timestamp, target_uri string, block_length bigint, content_length bigint, headers {PAIRS}, is_http boolean, http_parsed boolean, http_status_line string, http_status int,
http_reason string, http_headers {PAIRS}, http_content_type string, http_charset string, http_date timestamp, http_last_modified timestamp, block_digest_status string, payload_digest_status string,
block_sha1 string, payload binary, raw_warc_headers binary, raw_http_headers binary, corrupt_reason string"""
BATCH_BYTES = 8 << 20
SPLIT, LEAST_SPLIT = 128 << 20, 16 << 20
#: Splits of fewer bytes share a task, but with few bytes there are about so many tasks.
LEAST_TASK, TASKS = 4 << 20, 64


def type_mask(value: str | int | None) -> int:
    """Of type names with commas or bars between, or of a number."""
    if value is None or str(value).strip().lower() in ("", "any", "any_type"):
        return ANY_TYPE
    if str(value).strip().isdigit():
        return int(value)
    out = 0
    for name in str(value).replace("|", ",").split(","):
        if name.strip().lower() not in RECORD_TYPES:
            raise ValueError(f"unknown record type {name.strip()}")
        out |= RECORD_TYPES[name.strip().lower()]
    return out


def _flag(options: dict, name: str, default: bool) -> bool:
    return str(options.get(name, default)).strip().lower() in ("true", "1", "yes")


def scan_of(options: dict) -> Scan:
    o = {k.lower(): v for k, v in options.items()}
    keep = _flag(o, "alwayskeepmeta", False)
    return Scan(
        type_mask(o.get("recordtypes")), _flag(o, "parsehttp", True), int(o.get("mincontentlength", -1)), int(o.get("maxcontentlength", -1)), o.get("lengthbasis", "block"), _flag(o, "verifydigests", False),
        _flag(o, "quirksmode", False), o.get("autodecode", "none"), int(o.get("maxheaderlen", 32 << 10)), _flag(o, "payload", True), keep, int(o["streampos"]) if "streampos" in o else None, o.get("mode", "PERMISSIVE").upper() != "FAILFAST",
    )


def _pairs(v):
    return [{"key": k, "value": x} for k, x in v]


def _status(name: str):
    from .records import check_digest

    if name == "block":
        return lambda r, _: check_digest(r.block, r.get("WARC-Block-Digest"))
    return lambda r, _: check_digest(r.payload if r.http_parsed else None, r.get("WARC-Payload-Digest"))


def _sha1(r: Record, _):
    import hashlib

    return None if r.block is None else hashlib.sha1(r.block).hexdigest()


#: How each column comes from a record and its path.
COLUMNS = {
    "path": lambda r, p: p, "stream_pos": lambda r, p: r.stream_pos, "record_length": lambda r, p: r.record_length, "warc_version": lambda r, p: r.warc_version, "record_id": lambda r, p: r.get("WARC-Record-ID"),
    "record_type": lambda r, p: r.record_type, "record_type_code": lambda r, p: r.code, "record_date": lambda r, p: parse_date(r.get("WARC-Date")), "target_uri": lambda r, p: r.get("WARC-Target-URI"),
    "block_length": lambda r, p: r.block_length, "content_length": lambda r, p: r.content_length, "headers": lambda r, p: _pairs(r.headers), "is_http": lambda r, p: r.is_http, "http_parsed": lambda r, p: r.http_parsed,
    "http_status_line": lambda r, p: r.http_status_line, "http_status": lambda r, p: status_parts(r.http_status_line)[0], "http_reason": lambda r, p: status_parts(r.http_status_line)[1],
    "http_headers": lambda r, p: _pairs(r.http_headers) if r.http_parsed else None, "http_content_type": lambda r, p: (first(r.http_headers, "Content-Type") or "").split(";")[0].strip() or None,
    "http_charset": lambda r, p: content_charset(first(r.http_headers, "Content-Type")), "http_date": lambda r, p: parse_http_date(first(r.http_headers, "Date")), "http_last_modified": lambda r, p: parse_http_date(first(r.http_headers, "Last-Modified")),
    "block_digest_status": _status("block"), "payload_digest_status": _status("payload"), "block_sha1": _sha1, "payload": lambda r, p: r.payload,
    "raw_warc_headers": lambda r, p: r.raw_headers, "raw_http_headers": lambda r, p: r.raw_http_headers, "corrupt_reason": lambda r, p: r.corrupt_reason,
}
_NEED_BLOCK = {"payload", "block_digest_status", "payload_digest_status", "block_sha1"}
_NEED_HTTP = {c for c in COLUMNS if c.startswith("http_") or c in ("content_length", "payload", "payload_digest_status", "raw_http_headers")}


@dataclass
class Split(InputPartition):
    path: str
    start: int
    stop: int
    size: int


@dataclass
class Splits(InputPartition):
    """Small splits that a task reads one after the other."""

    parts: list[Split]


def packed(splits: list[Split]) -> list[Splits]:
    """Splits in order, so many together that a task has about LEAST_TASK bytes, if TASKS tasks have work then: a task has a cost of its own, however little it reads."""
    least = min(LEAST_TASK, sum(s.stop - s.start for s in splits) // TASKS)
    out: list[Splits] = []
    held = least
    for s in splits:
        if not out or held + s.stop - s.start > least:
            out.append(Splits([]))
            held = 0
        out[-1].parts.append(s)
        held += s.stop - s.start
    return out


def read_split(split: Split, scan: Scan, names: list[str], codec: str | None = None) -> Iterator[tuple]:
    """A row (values of the named columns) for each record of the split. Errors in opening a file give a row that tells it, but in strict mode."""
    get = [COLUMNS.get(n, lambda r, p: None) for n in names]
    try:
        with open_file(split.path) as f:
            if codec in (None, "auto"):
                known = codec_of_name(split.path)
                f.seek(0)
                found = sniff(f.read(4))
                codec = known if known == "brotli" else found
            start = split.start
            if start:
                at = next_member(f, codec, start, split.stop)
                if at is None:
                    return
                start = at
            elif scan.only_pos is not None and scan.only_pos and codec != "brotli":
                start = scan.only_pos
            stream = Buffered(members(f, codec, start), start if codec == "none" else 0)
            stop = None if split.stop >= split.size else split.stop
            if "record_length" not in names:
                for r in scan.records(stream, stop):
                    yield tuple(g(r, split.path) for g in get)
                return
            held = None
            every = Scan(**{**scan.__dict__, "type_mask": ANY_TYPE, "min_length": -1, "max_length": -1, "only_pos": None, "verify_digests": False})
            for r in every.records(stream, None):
                if held is not None:
                    held.record_length = r.stream_pos - held.stream_pos
                    if _wanted(scan, held):
                        yield tuple(g(held, split.path) for g in get)
                held = r
                if stop is not None and r.stream_pos >= stop:
                    return
            if held is not None:
                held.record_length = split.size - held.stream_pos
                if _wanted(scan, held):
                    yield tuple(g(held, split.path) for g in get)
    except (OSError, ValueError) as e:
        if not scan.permissive:
            raise
        broken = Record(split.start, corrupt_reason=f"{type(e).__name__}: {e}")
        yield tuple(g(broken, split.path) for g in get)


def _wanted(scan: Scan, r: Record) -> bool:
    from .records import check_digest

    length = r.block_length if scan.length_basis == "block" else r.content_length
    return bool((scan.type_mask == ANY_TYPE or r.code & scan.type_mask) and scan._length_ok(length) and (scan.only_pos is None or r.stream_pos == scan.only_pos) and (not scan.verify_digests or check_digest(r.block, r.get("WARC-Block-Digest")) == "ok"))


def batches_of(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    at = schema.get_field_index("payload")
    for row in rows:
        held.append(row)
        size += 600 + (len(row[at] or b"") if at >= 0 else 0)
        if size >= BATCH_BYTES:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.options = {k.lower(): v for k, v in options.items()}
        self.arrow = to_arrow_schema(schema)
        self.names = schema.names
        self.scan = scan_of(options)
        if not _NEED_BLOCK & set(self.names):
            self.scan.payload = False
        if not _NEED_HTTP & set(self.names) and self.scan.length_basis == "block":
            self.scan.parse_http = False

    def partitions(self):
        return packed(self.splits()) or [Splits([])]

    def splits(self) -> list[Split]:
        path = self.options.get("path")
        if not path:
            raise ValueError("no path")
        split = int(self.options.get("splitsize", SPLIT))
        raw = _flag(self.options, "splituncompressed", False)
        out = []
        for p, size in list_files(path):
            kind = codec_of_name(p)
            whole = kind == "brotli" or self.scan.only_pos is not None or (kind in (None, "none") and not raw) or self.options.get("compression", "auto") == "brotli"
            out += [Split(p, a, b, size) for a, b in ([(0, size)] if whole else splits_of(size, split, min(LEAST_SPLIT, split)))]
        return out

    def read(self, partition: Splits):
        codec = self.options.get("compression")
        yield from batches_of(itertools.chain.from_iterable(read_split(s, self.scan, self.names, codec) for s in partition.parts), self.arrow)


class WarcStreamReader(DataSourceStreamReader):
    """New files of a folder or pattern. A file counts as new if its path sorts behind all that were read, so names must rise as files come (by date, say)."""

    def __init__(self, schema: StructType, options: dict):
        self.reader = WarcReader(schema, options)

    def initialOffset(self):
        return {"upto": ""}

    def latestOffset(self):
        return {"upto": max((p for p, _ in list_files(self.reader.options["path"])), default="")}

    def partitions(self, start, end):
        return packed([s for s in self.reader.splits() if start["upto"] < s.path <= end["upto"]])

    def read(self, partition):
        yield from self.reader.read(partition)


@dataclass
class Wrote(WriterCommitMessage):
    path: str | None
    temporary: str | None
    records: int
    bytes: int


class WarcWriter(DataSourceWriter):
    """A file for each task; it appears under its own name only once all tasks are done."""

    def __init__(self, options: dict, overwrite: bool):
        self.options = {k.lower(): v for k, v in options.items()}
        self.codec = self.options.get("compression", "gzip")
        self.folder = self.options["path"]
        self.overwrite, self.run = overwrite, uuid.uuid4().hex[:8]
        self.checksum = _flag(self.options, "checksumdata", True)

    def write(self, iterator):
        from pyspark import TaskContext

        ending = {"gzip": ".warc.gz", "zstd": ".warc.zst", "lz4": ".warc.lz4", "brotli": ".warc.br", "none": ".warc"}[self.codec]
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{self.run}{ending}"
        temporary = f"_{name}.{task.taskAttemptId()}"
        folder = Folder(self.folder)
        level = int(self.options["level"]) if "level" in self.options else None
        dictionary = bytes.fromhex(self.options["dictionaryhex"]) if self.options.get("dictionaryhex") else None
        n = size = 0
        with folder.open(temporary) as out:
            if dictionary and self.codec == "zstd":
                size += out.write(dictionary_frame(dictionary))
            for row in iterator:
                size += out.write(compress(self.encode(row.asDict(), f"{name}:{n}"), self.codec, level, dictionary))
                n += 1
        if not n:
            folder.delete(temporary)
            return Wrote(None, None, 0, 0)
        return Wrote(name, temporary, n, size)

    def encode(self, row: dict, seed: str) -> bytes:
        headers = [(h["key"], h["value"]) for h in row.get("headers") or []]
        have = {k.lower() for k, _ in headers}
        made = []
        for name, value in (
            ("WARC-Type", row.get("record_type") or "resource"), ("WARC-Record-ID", row.get("record_id") or new_record_id(seed)),
            ("WARC-Date", None if row.get("record_date") is None else row["record_date"].astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")), ("WARC-Target-URI", row.get("target_uri")),
            ("Content-Type", f"application/http; msgtype={row.get('record_type')}" if row.get("is_http") else None),
        ):
            if name.lower() not in have and value is not None:
                made.append((name, value))
        http = row.get("http_headers")
        raw = row.get("raw_http_headers")
        line = row.get("http_status_line") if raw is None else None
        if raw is None and line is None and http:
            line = "HTTP/1.1 200 OK"
        return record_bytes(row.get("warc_version") or "WARC/1.1", made + headers, bytes(row.get("payload") or b""), line, [(h["key"], h["value"]) for h in http or []], None if raw is None else bytes(raw), self.checksum)

    def commit(self, messages):
        folder, keep = Folder(self.folder), {m.path for m in messages if m and m.path}
        if self.overwrite:
            for n in folder.names():
                if n.startswith("part-") and n not in keep:
                    folder.delete(n)
        for m in messages:
            if m and m.path:
                folder.rename(m.temporary, m.path)

    def abort(self, messages):
        folder = Folder(self.folder)
        there = folder.names()
        for m in messages:
            if m and m.temporary in there:
                folder.delete(m.temporary)


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(schema, dict(self.options))

    def streamReader(self, schema):
        return WarcStreamReader(schema, dict(self.options))

    def writer(self, schema, overwrite):
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> SparkSession:
    """Makes the format known."""
    prepare(spark)
    spark.dataSource.register(WarcSource)
    return spark


def _options_of(where: dict) -> dict[str, str]:
    """Options of the format that say the same as conditions on columns."""
    out: dict[str, str] = {}
    for name, value in where.items():
        if name == "record_type":
            out["recordTypes"] = value if isinstance(value, str) else "|".join(value)
        elif name == "stream_pos":
            out["streamPos"] = str(int(value))
        elif name in ("content_length", "block_length"):
            low, high = value
            out |= {"lengthBasis": "payload" if name == "content_length" else "block"} | ({} if low is None else {"minContentLength": str(low)}) | ({} if high is None else {"maxContentLength": str(high)})
        elif name == "block_digest_status" and value == "ok":
            out["verifyDigests"] = "true"
        else:
            raise ValueError(f"the reader can't choose by {name}; filter the records instead")
    if "content_length" in where and "block_length" in where:
        raise ValueError("one length at a time")
    return out


def read_warcs(spark: SparkSession, path: str, columns: list[str] | None = None, where: dict | None = None, **options) -> DataFrame:
    """Records of all files; columns asks for a part of the schema, and options are those of the format.

    where has conditions that the reader applies before it keeps a record's body: record_type (a name or several), stream_pos, content_length or
    block_length (least, most; None for no bound), and block_digest_status "ok". Each call makes a relation of its own, so nothing is left of them for other queries.
    """
    register(spark)
    reader = spark.read.format("warc")
    if columns:
        parts = StructType.fromDDL(SCHEMA)
        reader = reader.schema(StructType([parts[c] for c in columns]))
    return reader.options(**_options_of(where or {}), **{k: str(v) for k, v in options.items()}).load(path)


def read_all_warcs(files: DataFrame, path: str = "path", columns: list[str] | None = None, split_size: int = SPLIT, tasks: int | None = None, **options) -> DataFrame:
    """Records of the files that a column of paths names. Files are cut into splits where their codec allows it, and the splits spread over tasks (as many as a shuffle has, if not said), so that one large file is read by many.

    NULL paths are left out; a path that isn't there gives a row that tells so, or ends the job in mode FAILFAST.
    """
    schema = StructType.fromDDL(SCHEMA)
    if columns:
        schema = StructType([schema[c] for c in columns])
    scan, names, arrow = scan_of(options), schema.names, to_arrow_schema(schema)
    raw = _flag({k.lower(): v for k, v in options.items()}, "splituncompressed", False)

    def cut(batches):
        for batch in batches:
            rows = []
            for p in batch.column(0).to_pylist():
                for name, size in (list_files(p) or [(p, 0)]) if p is not None else []:
                    kind = codec_of_name(name)
                    whole = kind == "brotli" or scan.only_pos is not None or (kind in (None, "none") and not raw) or not size
                    rows += [(name, a, b, size) for a, b in ([(0, size)] if whole else splits_of(size, split_size, min(LEAST_SPLIT, split_size)))]
            yield pa.RecordBatch.from_pydict({n: pa.array([r[k] for r in rows], pa.int64() if k else pa.string()) for k, n in enumerate(("path", "start", "stop", "size"))})

    def run(batches):
        for batch in batches:
            for p, a, b, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield from batches_of(read_split(Split(p, a, b, size), scan, names), arrow)

    splits = files.select(path).mapInArrow(cut, "path string, start bigint, stop bigint, size bigint")
    spread = splits.repartition(tasks or int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path", "start")
    return spread.mapInArrow(run, schema)


def extract_record(spark: SparkSession, path: str, offset: int, **options) -> DataFrame:
    """The record at a place of a file: the reader goes straight there."""
    return read_warcs(spark, path, streamPos=int(offset), **options)


def parse_record(data: bytes, http: bool = True, decode: str = "none") -> Record | None:
    """One record from its bytes."""
    scan = Scan(parse_http=http, decode=decode, permissive=False, quirks=True)
    return next(scan.records(Buffered(iter([(None, data)]))), None)
