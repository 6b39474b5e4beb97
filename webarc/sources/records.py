"""Parsing and writing of archive records: header blocks, HTTP messages, payload encodings."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from base64 import b32encode
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone
from email.utils import parsedate_to_datetime

import pyarrow as pa
import zstandard

from .codecs import Buffered

#: Bit flags of record types; masks combine them.
RECORD_TYPES = {"warcinfo": 2, "response": 4, "resource": 8, "request": 16, "metadata": 32, "revisit": 64, "conversion": 128, "continuation": 256, "unknown": 32768}
ANY_TYPE, NO_TYPE = 65535, 0
#: Names of header fields, as the standard writes them.
HEADERS = (
    "WARC-Type WARC-Record-ID WARC-Date Content-Length Content-Type WARC-Concurrent-To WARC-Block-Digest WARC-Payload-Digest WARC-IP-Address WARC-Refers-To "
    "WARC-Refers-To-Target-URI WARC-Refers-To-Date WARC-Target-URI WARC-Truncated WARC-Warcinfo-ID WARC-Filename WARC-Profile WARC-Identified-Payload-Type WARC-Segment-Origin-ID WARC-Segment-Number WARC-Segment-Total-Length"
).split()
MOST_HEADER = 32 << 10
DECODE_MODES = ("none", "content", "transfer", "all")

Pairs = list[tuple[str, str]]


class RecordError(ValueError):
    """A record that can't be parsed."""


def header_pairs(lines: list[bytes], encoding: str) -> Pairs:
    """Name and value of each line; a line that starts with white space goes on with the one before; others without a colon count for nothing."""
    out: Pairs = []
    for text in b"\r\n".join(lines).decode(encoding, "replace").split("\r\n") if lines else ():
        if text[:1] in (" ", "\t"):
            if out and (more := text.strip()):
                out[-1] = (out[-1][0], f"{out[-1][1]} {more}".strip())
            continue
        name, colon, value = text.partition(":")
        if colon:
            out.append((name.strip(), value.strip()))
    return out


def first(pairs: Pairs, name: str) -> str | None:
    low = name.lower()
    return next((v for k, v in pairs if k.lower() == low), None)


def read_block(stream: Buffered, quirks: bool = False, most: int = MOST_HEADER) -> tuple[list[bytes], bytes]:
    """Lines up to an empty one, without their ends, and all the bytes. Lines end in CR LF; in quirks mode a bare LF does too."""
    if not quirks:
        if stream.starts(b"\r\n"):
            return [], stream.read(2)
        if block := stream.until(b"\r\n\r\n", most):
            return block[:-4].split(b"\r\n"), block
    lines, raw, size = [], [], 0
    part = b""
    while line := stream.readline():
        raw.append(line)
        size += len(line)
        if size > most:
            raise RecordError("Maximum header length exceeded.")
        part += line
        if not quirks and not part.endswith(b"\r\n"):
            continue
        part = part.rstrip(b"\r\n") if quirks else part[:-2]
        if not part:
            break
        lines.append(part)
        part = b""
    return lines, b"".join(raw)


def parse_date(value: str | None) -> datetime | None:
    if not value:
        return None
    try:
        found = datetime.fromisoformat(value.strip().replace("Z", "+00:00"))
    except ValueError:
        return None
    return found.replace(tzinfo=timezone.utc) if found.tzinfo is None else found.astimezone(timezone.utc)


#: A date of a year with more than four digits, which datetime has not.
_FAR = re.compile(r"\+?(\d{5,6})(-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d+)?(?:Z|[+-]\d\d:?\d\d)?)")


def date_micros(value: str | None) -> int | None:
    """What parse_date reads, also of years beyond 9999, in microseconds since 1970."""
    eras, far = 0, _FAR.fullmatch((value or "").strip())
    if far:
        eras = (int(far[1]) - 2000) // 400  # the calendar repeats every 400 years of 146,097 days
        value = f"{int(far[1]) - 400 * eras}{far[2]}"
    found = parse_date(value)
    return None if found is None else (found - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1) + eras * 146_097 * 86_400_000_000


def parse_http_date(value: str | None) -> datetime | None:
    if not value:
        return None
    try:
        found = parsedate_to_datetime(value)
    except (ValueError, TypeError, IndexError):
        return None
    return found.replace(tzinfo=timezone.utc) if found.tzinfo is None else found.astimezone(timezone.utc)


def status_parts(line: str | None) -> tuple[int | None, str | None]:
    """Code and reason of a line that starts with HTTP/."""
    if not line or not line.startswith("HTTP/"):
        return None, None
    parts = line.split(" ", 2)
    code = int(parts[1]) if len(parts) > 1 and parts[1].isascii() and parts[1].isdigit() and int(parts[1]) < 65536 else None
    return code, parts[2].strip() if len(parts) > 2 else None


def content_charset(value: str | None) -> str | None:
    if not value:
        return None
    low = value.lower()
    i = low.find("charset=")
    return low[i + 8 :].split(";", 1)[0].strip().strip("\"'") or None if i >= 0 else None


def decode_chunked(data: bytes, strict: bool = False) -> bytes:
    """A body in chunks. Not strict: a bad size or short data ends it; strict: they are errors."""
    return b"".join(chunks_of(data, strict))


def chunks_of(data: bytes, strict: bool = False) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            if strict:
                raise RecordError("a chunk's size is cut off")
            break
        digits = data[at:end].split(b";")[0].strip()
        try:
            size = int(digits, 16)
        except ValueError:
            if strict:
                raise RecordError(f"bad chunk size {digits[:20]!r}") from None
            break
        if size <= 0:
            break
        chunk = data[end + 1 : end + 1 + size]
        if len(chunk) < size and strict:
            raise RecordError("a chunk is cut off")
        if chunk:
            out.append(chunk)
        at = end + 1 + size
        at += 2 if data[at : at + 2] == b"\r\n" else 1 if data[at : at + 1] == b"\n" else 0
    return out


def decode_one(data: bytes, name: str) -> bytes:
    name = name.strip().lower()
    try:
        if name in ("", "identity"):
            return data
        if name in ("gzip", "x-gzip"):
            return zlib.decompressobj(47).decompress(data)
        if name == "deflate":
            try:
                return zlib.decompressobj().decompress(data)
            except zlib.error:
                return zlib.decompressobj(-15).decompress(data)
        if name == "zstd":
            return zstandard.ZstdDecompressor().decompressobj().decompress(data)
        if name == "br":
            return pa.input_stream(pa.py_buffer(data), compression="brotli").read()
        if name == "chunked":
            return decode_chunked(data)
    except (zlib.error, zstandard.ZstdError, OSError, pa.ArrowException) as e:
        raise RecordError(f"{name}: {e}") from e
    raise RecordError(f"unknown encoding {name}")


def decode_payload(data: bytes, transfer: str | None, content: str | None, mode: str = "all") -> bytes:
    """Undoes the encodings that headers name, last first: those of transfer, then those of content, as far as mode says."""
    for value, when in ((transfer, ("transfer", "all")), (content, ("content", "all"))):
        if value and mode in when:
            for name in reversed(value.split(",")):
                data = decode_one(data, name)
    return data


# ---- digests -----------------------------------------------------------------------------------


def digest(data: bytes, algorithm: str = "sha1") -> str:
    return f"{algorithm}:{b32encode(hashlib.new(algorithm, data).digest()).decode()}"


def check_digest(data: bytes | None, value: str | None) -> str:
    """ok, fail, missing, unsupported, format or no_payload. Values are Base32 or hexadecimal."""
    if value is None:
        return "missing"
    if data is None:
        return "no_payload"
    name, colon, text = value.partition(":")
    if not colon:
        return "format"
    name = name.strip().lower().replace("sha-", "sha")
    if name not in ("md5", "sha1", "sha256", "sha512"):
        return "unsupported"
    raw, text = hashlib.new(name, data).digest(), text.strip()
    if text.upper().rstrip("=") == b32encode(raw).decode().rstrip("=") or text.lower() == raw.hex():
        return "ok"
    clean = text.rstrip("=")
    base32 = all(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567abcdefghijklmnopqrstuvwxyz" for c in clean)
    hexed = all(c in "0123456789abcdefABCDEF" for c in text)
    sizes = {-(-len(raw) * 8 // 5)} if base32 else set()
    return "fail" if clean and (len(clean) in sizes or (hexed and len(text) == 2 * len(raw))) else "format"


# ---- records -----------------------------------------------------------------------------------


@dataclass
class Record:
    stream_pos: int = 0
    record_length: int | None = None
    warc_version: str | None = None
    headers: Pairs = field(default_factory=list)
    raw_headers: bytes = b""
    block_length: int = 0
    content_length: int = 0
    record_type: str | None = None
    is_http: bool = False
    http_parsed: bool = False
    http_status_line: str | None = None
    http_headers: Pairs = field(default_factory=list)
    raw_http_headers: bytes | None = None
    block: bytes | None = None
    payload: bytes | None = None
    corrupt_reason: str | None = None

    @property
    def code(self) -> int:
        return RECORD_TYPES.get(self.record_type, NO_TYPE) if self.record_type else NO_TYPE

    def get(self, name: str) -> str | None:
        return first(self.headers, name)


def _start(stream: Buffered, quirks: bool) -> tuple[str, bytes, int] | None:
    while True:
        place = stream.place()
        line = stream.readline(256)
        if not line:
            return None
        text = line.strip()
        if not text:
            continue
        if text in (b"WARC/1.0", b"WARC/1.1") or (text.startswith(b"WARC/0.") and len(text) <= 9):
            return text.decode(), line, place
        if not quirks:
            raise RecordError(f"no record at {place}")


def read_record(stream: Buffered, quirks: bool = False, most: int = MOST_HEADER) -> Record | None:
    """A record's headers; its block is next in the stream. None at the end."""
    begun = _start(stream, quirks)
    if begun is None:
        return None
    version, line, place = begun
    lines, raw = read_block(stream, quirks, most)
    pairs = header_pairs(lines, "utf-8")
    kind, length, content = first(pairs, "WARC-Type"), first(pairs, "Content-Length"), first(pairs, "Content-Type")
    size = int(length) if length and length.isascii() and length.isdigit() else 0
    http = bool(content) and (content == "application/http" or content.startswith("application/http;"))
    name = None if kind is None else kind.strip().lower()
    return Record(place, None, version, pairs, line + raw, size, size, name if name is None or name in RECORD_TYPES else "unknown", http)


def parse_http(r: Record, decode: str = "none", quirks: bool = False, most: int = MOST_HEADER) -> Record:
    """Parts a record's block into HTTP headers and payload; a no-op if it isn't HTTP, or is parsed."""
    if not r.is_http or r.http_parsed or r.block is None:
        return r
    stream = Buffered(iter([(None, r.block)]))
    lines, raw = read_block(stream, quirks or b"\r\n" not in r.block[:MOST_HEADER], most)
    r.http_status_line = lines[0].decode("latin-1").strip() if lines else None
    r.http_headers = header_pairs(lines[1:], "latin-1")
    r.raw_http_headers, r.http_parsed = raw, True
    r.payload = r.block[len(raw) :]
    r.content_length = len(r.payload)
    if decode != "none":
        r.payload = decode_payload(r.payload, first(r.http_headers, "Transfer-Encoding"), first(r.http_headers, "Content-Encoding"), decode)
    return r


@dataclass
class Scan:
    """What a scan keeps and parses. type_mask, min_length and max_length look at the length that length_basis names (block or payload)."""

    type_mask: int = ANY_TYPE
    parse_http: bool = True
    min_length: int = -1
    max_length: int = -1
    length_basis: str = "block"
    verify_digests: bool = False
    quirks: bool = False
    decode: str = "none"
    max_header: int = MOST_HEADER
    payload: bool = True
    keep_meta: bool = False
    only_pos: int | None = None
    permissive: bool = True

    def _length_ok(self, n: int) -> bool:
        return (self.min_length < 0 or n >= self.min_length) and (self.max_length < 0 or n <= self.max_length)

    def records(self, stream: Buffered, stop: int | None = None) -> Iterator[Record]:
        """Up to the first record that starts at stop or later. In permissive mode, an error ends the file with a row that tells it."""
        while True:
            try:
                r = read_record(stream, self.quirks, self.max_header)
            except ValueError as e:
                if not self.permissive:
                    raise
                yield Record(stream.position(), corrupt_reason=str(e))
                return
            if r is None or (stop is not None and r.stream_pos >= stop):
                return
            large = self.keep_meta and self.max_length >= 0 and r.block_length > self.max_length
            wanted = (self.type_mask == ANY_TYPE or r.code & self.type_mask) and (self.only_pos is None or r.stream_pos == self.only_pos)
            if self.length_basis == "block" and not large:
                wanted = wanted and self._length_ok(r.block_length)
            need = wanted and not large and (self.payload or self.parse_http and r.is_http or self.verify_digests)
            try:
                if need:
                    r.block = stream.read(r.block_length)
                    if len(r.block) < r.block_length:
                        raise RecordError("the record is cut off")
                else:
                    stream.skip(r.block_length)
                if not wanted:
                    continue
                if self.verify_digests and check_digest(r.block, r.get("WARC-Block-Digest")) != "ok":
                    continue
                r.payload = r.block
                if self.parse_http:
                    parse_http(r, self.decode, self.quirks, self.max_header)
                if self.length_basis == "payload" and not large and not self._length_ok(r.content_length):
                    continue
            except ValueError as e:
                if not self.permissive:
                    raise
                r.corrupt_reason = str(e)
            yield r
            if self.only_pos is not None and r.stream_pos == self.only_pos:
                return


def new_record_id(seed: str) -> str:
    """The same for the same seed, so that a task that runs again writes the same file."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, seed)}>"


def clean(text: str, name: bool = False) -> str:
    """A header's name or value as it may be written: on one line, names without a colon."""
    text = text.strip().replace("\r", "").replace("\n", " ")
    return text.replace(":", "") if name else text


def record_bytes(version: str, headers: Pairs, body: bytes, http_status_line: str | None = None, http_headers: Pairs | None = None, raw_http: bytes | None = None, checksum: bool = False) -> bytes:
    """A whole record; its length is set, and with checksum its digests."""
    http = raw_http
    if http is None and http_status_line is not None:
        lines = [http_status_line, *(f"{clean(k, True)}: {clean(v)}" if k else clean(v) for k, v in http_headers or [])]
        http = ("\r\n".join(lines) + "\r\n\r\n").encode("latin-1", "replace")
    block = (http or b"") + body
    new = {"Content-Length": str(len(block))}
    if checksum:
        new["WARC-Block-Digest"] = digest(block)
        if http is not None:
            new["WARC-Payload-Digest"] = digest(body)
    out, seen = [], set()
    for k, v in headers:
        known = next((n for n in new if n.lower() == k.lower()), None)
        if known:
            if known in seen:
                continue
            seen.add(known)
            v = new[known]
        out.append(f"{clean(k, True)}: {clean(v)}" if k else clean(v))
    out += [f"{k}: {v}" for k, v in new.items() if k not in seen]
    return (version + "\r\n" + "\r\n".join(out) + "\r\n\r\n").encode() + block + b"\r\n\r\n"
