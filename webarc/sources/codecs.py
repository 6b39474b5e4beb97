"""Compressed members: sniffing, reading with the place of each member, writing one member a record.

Readers are generators of (place of the member in the file, decompressed bytes); the place is None where a file isn't compressed.
LZ4 and Brotli use the codecs that come with Arrow.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import zstandard

BLOCK = 1 << 18
EXTENSIONS = {".gz": "gzip", ".zst": "zstd", ".zstd": "zstd", ".lz4": "lz4", ".br": "brotli", ".warc": "none"}
_DICTIONARY_MAGIC = b"\x5d\x2a\x4d\x18"
_MOST_DICTIONARY = 1 << 20


class CodecError(ValueError):
    """Data that a codec can't read."""


def codec_of_name(name: str) -> str | None:
    """By the end of a file's name; None if it tells nothing."""
    return next((c for e, c in EXTENSIONS.items() if name.lower().endswith(e)), None)


def sniff(head: bytes) -> str:
    """By the first bytes; what no codec claims is uncompressed."""
    if head[:3] == b"\x1f\x8b\x08":
        return "gzip"
    if head[:4] in (b"\x28\xb5\x2f\xfd", _DICTIONARY_MAGIC):
        return "zstd"
    return "lz4" if head[:4] == b"\x04\x22\x4d\x18" else "none"


def _raw(f: BinaryIO, at: int) -> Iterator[tuple[int | None, bytes]]:
    while block := f.read(BLOCK):
        yield None, block


def _gzip(f: BinaryIO, at: int) -> Iterator[tuple[int | None, bytes]]:
    data = f.read(BLOCK)
    while data:
        if data[:1] == b"\0":  # padding between members
            rest = data.lstrip(b"\0")
            at += len(data) - len(rest)
            data = rest or f.read(BLOCK)
            continue
        while len(data) < 3 and (more := f.read(BLOCK)):
            data += more
        if data[:2] != b"\x1f\x8b":
            raise CodecError(f"no gzip member at {at}")
        one, start = zlib.decompressobj(31), at
        while True:
            try:
                out = one.decompress(data)
            except zlib.error as e:
                raise CodecError(f"member at {start}: {e}") from e
            at += len(data) - len(one.unused_data)
            if out:
                yield start, out
            if one.eof:
                data = one.unused_data or f.read(BLOCK)
                break
            data = f.read(BLOCK)
            if not data:
                raise CodecError(f"member at {start} is cut off")


def _zstd(f: BinaryIO, at: int) -> Iterator[tuple[int | None, bytes]]:
    dictionary, data = None, f.read(BLOCK)
    if at and data:
        dictionary = _leading_dictionary(f, at)
        f.seek(at + len(data))

    def need(n: int) -> bool:
        nonlocal data
        while len(data) < n and (more := f.read(BLOCK)):
            data += more
        return len(data) >= n

    while need(1):
        if not need(4):
            raise CodecError(f"frame at {at} is cut off")
        if 0x184D2A50 <= struct.unpack("<I", data[:4])[0] <= 0x184D2A5F:
            if not need(8) or not need(8 + (n := struct.unpack("<I", data[4:8])[0])):
                raise CodecError(f"frame at {at} is cut off")
            if data[:4] == _DICTIONARY_MAGIC and at == 0:
                dictionary = _dictionary(data[8 : 8 + n])
            data, at = data[8 + n :], at + 8 + n
            continue
        one = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj() if dictionary else zstandard.ZstdDecompressor().decompressobj()
        start = at
        while True:
            try:
                out = one.decompress(data)
            except zstandard.ZstdError as e:
                raise CodecError(f"frame at {start}: {e}") from e
            at += len(data) - len(one.unused_data)
            if out:
                yield start, out
            if one.eof:
                data = one.unused_data
                break
            data = f.read(BLOCK)
            if not data:
                raise CodecError(f"frame at {start} is cut off")


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict:
    if len(data) > _MOST_DICTIONARY:
        raise CodecError("the dictionary is too large")
    if data[:4] == b"\x28\xb5\x2f\xfd":
        data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
    return zstandard.ZstdCompressionDict(data)


def _leading_dictionary(f: BinaryIO, back: int) -> zstandard.ZstdCompressionDict | None:
    f.seek(0)
    head = f.read(8)
    if head[:4] != _DICTIONARY_MAGIC or len(head) < 8:
        return None
    return _dictionary(f.read(struct.unpack("<I", head[4:8])[0]))


def _lz4(f: BinaryIO, at: int) -> Iterator[tuple[int | None, bytes]]:
    while True:
        frame = _lz4_frame(f, at)
        if frame is None:
            return
        if frame[:4] == b"\x04\x22\x4d\x18":
            try:
                with pa.input_stream(io.BytesIO(frame), compression="lz4") as s:
                    while out := s.read(BLOCK):
                        yield at, out
            except (OSError, pa.ArrowException) as e:
                raise CodecError(f"frame at {at}: {e}") from e
        at += len(frame)


def _lz4_frame(f: BinaryIO, at: int) -> bytes | None:
    """The bytes of the next frame, by the sizes of its blocks."""

    def take(n: int) -> bytes:
        b = f.read(n)
        if len(b) < n:
            raise CodecError(f"frame at {at} is cut off")
        return b

    magic = f.read(4)
    if not magic:
        return None
    if len(magic) == 4 and 0x184D2A50 <= struct.unpack("<I", magic)[0] <= 0x184D2A5F:
        n = take(4)
        return magic + n + take(struct.unpack("<I", n)[0])
    if magic != b"\x04\x22\x4d\x18":
        raise CodecError(f"no LZ4 frame at {at}")
    parts = [magic, take(2)]
    flags = parts[1][0]
    parts.append(take(1 + 8 * bool(flags & 8) + 4 * bool(flags & 1)))
    while True:
        parts.append(take(4))
        n = struct.unpack("<I", parts[-1])[0] & 0x7FFFFFFF
        if not n:
            break
        parts.append(take(n + 4 * bool(flags & 16)))
    if flags & 4:
        parts.append(take(4))
    return b"".join(parts)


def _brotli(f: BinaryIO, at: int) -> Iterator[tuple[int | None, bytes]]:
    with pa.input_stream(f, compression="brotli") as s:
        while out := s.read(BLOCK):
            yield at, out


_READERS = {"none": _raw, "gzip": _gzip, "zstd": _zstd, "lz4": _lz4, "brotli": _brotli}
CODECS = tuple(_READERS)


def members(f: BinaryIO, codec: str = "auto", at: int = 0) -> Iterator[tuple[int | None, bytes]]:
    """From a place in a file, which must be where a member starts."""
    f.seek(at)
    if codec == "auto":
        codec = sniff(f.read(4))
        f.seek(at)
    if codec not in _READERS:
        raise CodecError(f"unknown codec {codec}")
    return _READERS[codec](f, at)


def next_member(f: BinaryIO, codec: str, at: int, stop: int) -> int | None:
    """The first place from at on, below stop, where a member that holds a record starts."""
    if at == 0:
        return 0
    magic = {"gzip": b"\x1f\x8b\x08", "zstd": b"\x28\xb5\x2f\xfd", "lz4": b"\x04\x22\x4d\x18", "none": b"\r\n\r\nWARC/1."}[codec]
    f.seek(at)
    window, base = b"", at
    while base < stop:
        block = f.read(BLOCK)
        window += block
        i = window.find(magic)
        while i >= 0 and base + i < stop:
            place = base + i + (4 if codec == "none" else 0)
            if codec == "none" or _holds_record(f, codec, place):
                return place if place < stop else None
            f.seek(base + len(window))
            i = window.find(magic, i + 1)
        if not block:
            return None
        base += max(0, len(window) - len(magic) + 1)
        window = window[-(len(magic) - 1) :]
        f.seek(base + len(window))
    return None


def _holds_record(f: BinaryIO, codec: str, at: int) -> bool:
    try:
        return next(members(f, codec, at))[1].lstrip(b"\r\n")[:5] == b"WARC/"
    except (CodecError, StopIteration):
        return False


def compress(data: bytes, codec: str, level: int | None = None, dictionary: bytes | None = None) -> bytes:
    """One member."""
    if codec == "none":
        return data
    if codec == "gzip":
        one = zlib.compressobj(9 if level is None else level, zlib.DEFLATED, 31)
        return one.compress(data) + one.flush()
    if codec == "zstd":
        known = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        return zstandard.ZstdCompressor(level=3 if level is None else level, **known).compress(data)
    if codec in ("lz4", "brotli"):
        out = pa.BufferOutputStream()
        with pa.CompressedOutputStream(out, codec) as s:
            s.write(data)
        return out.getvalue().to_pybytes()
    raise CodecError(f"unknown codec {codec}")


def dictionary_frame(dictionary: bytes, compressed: bool = False) -> bytes:
    """The frame at the start of a file that carries its dictionary."""
    body = zstandard.ZstdCompressor().compress(dictionary) if compressed else dictionary
    return _DICTIONARY_MAGIC + struct.pack("<I", len(body)) + body


def train_dictionary(samples: list[bytes], size: int = 112 << 10) -> bytes:
    return zstandard.train_dictionary(size, samples).as_bytes()


class Buffered:
    """Decompressed bytes with a place: what a record parser reads from."""

    def __init__(self, chunks: Iterator[tuple[int | None, bytes]], at: int = 0):
        self.chunks, self.buf, self.base, self.off = chunks, bytearray(), at, 0
        self.marks: list[tuple[int, int]] = []

    def _fill(self) -> bool:
        got = next(self.chunks, None)
        if got is None:
            return False
        if self.off > 1 << 20 or self.off == len(self.buf):
            self.base += self.off
            del self.buf[: self.off]
            self.off = 0
        place, data = got
        if place is not None and (not self.marks or self.marks[-1][1] != place):
            self.marks.append((self.base + len(self.buf), place))
        self.buf += data
        return True

    def place(self) -> int:
        """Of the member that holds the next byte, or of the byte itself if there are no members."""
        if self.off == len(self.buf):
            self._fill()
        at = self.base + self.off
        while len(self.marks) > 1 and self.marks[1][0] <= at:
            del self.marks[0]
        return self.marks[0][1] if self.marks else at

    def position(self) -> int:
        return self.base + self.off

    def readline(self, most: int = 1 << 16) -> bytes:
        start = self.off
        while True:
            i = self.buf.find(b"\n", start, self.off + most)
            if i >= 0:
                break
            if len(self.buf) - self.off >= most:
                i = self.off + most - 1
                break
            done = len(self.buf) - self.off
            if not self._fill():
                i = len(self.buf) - 1
                break
            start = self.off + done
        line = bytes(self.buf[self.off : i + 1])
        self.off = i + 1
        return line

    def starts(self, mark: bytes) -> bool:
        while len(self.buf) - self.off < len(mark) and self._fill():
            pass
        return self.buf.startswith(mark, self.off)

    def until(self, mark: bytes, most: int) -> bytes | None:
        """Bytes up to and with a mark; None, and nothing read, if it doesn't come within so many bytes."""
        start = self.off
        while True:
            i = self.buf.find(mark, start, self.off + most)
            if i >= 0:
                out = bytes(self.buf[self.off : i + len(mark)])
                self.off = i + len(mark)
                return out
            have = len(self.buf) - self.off
            if have >= most or not self._fill():
                return None
            start = self.off + max(0, have - len(mark) + 1)

    def read(self, n: int) -> bytes:
        while len(self.buf) - self.off < n and self._fill():
            pass
        out = bytes(self.buf[self.off : self.off + n])
        self.off += len(out)
        return out

    def skip(self, n: int) -> int:
        left = n
        while left:
            have = min(left, len(self.buf) - self.off)
            self.off += have
            left -= have
            if left and not self._fill():
                break
        return n - left
