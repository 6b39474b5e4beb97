"""Bytes and text: encoding labels, detection of encodings and MIME types, lenient decoding, chunked bodies."""

from __future__ import annotations

import codecs
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.records import RecordError, chunks_of, decode_chunked, decode_payload

MOST_BYTES = 131072
#: Python codec by the labels that HTML5 knows for it.
_LABELS = {
    "utf-8": "unicode-1-1-utf-8 unicode11utf8 unicode20utf8 utf-8 utf8 x-unicode20utf8",
    "ibm866": "866 cp866 csibm866 ibm866",
    "iso8859-2": "csisolatin2 iso-8859-2 iso-ir-101 iso8859-2 iso88592 iso_8859-2 iso_8859-2:1987 l2 latin2",
    "iso8859-3": "csisolatin3 iso-8859-3 iso-ir-109 iso8859-3 iso88593 iso_8859-3 iso_8859-3:1988 l3 latin3",
    "iso8859-4": "csisolatin4 iso-8859-4 iso-ir-110 iso8859-4 iso88594 iso_8859-4 iso_8859-4:1988 l4 latin4",
    "iso8859-5": "csisolatincyrillic cyrillic iso-8859-5 iso-ir-144 iso8859-5 iso88595 iso_8859-5 iso_8859-5:1988",
    "iso8859-6": "arabic asmo-708 csiso88596e csiso88596i csisolatinarabic ecma-114 iso-8859-6 iso-8859-6-e iso-8859-6-i iso-ir-127 iso8859-6 iso88596 iso_8859-6 iso_8859-6:1987",
    "iso8859-7": "csisolatingreek ecma-118 elot_928 greek greek8 iso-8859-7 iso-ir-126 iso8859-7 iso88597 iso_8859-7 iso_8859-7:1987 sun_eu_greek",
    "iso8859-8": "csiso88598e csisolatinhebrew hebrew iso-8859-8 iso-8859-8-e iso-ir-138 iso8859-8 iso88598 iso_8859-8 iso_8859-8:1988 visual csiso88598i iso-8859-8-i logical",
    "iso8859-10": "csisolatin6 iso-8859-10 iso-ir-157 iso8859-10 iso885910 l6 latin6",
    "iso8859-13": "iso-8859-13 iso8859-13 iso885913",
    "iso8859-14": "iso-8859-14 iso8859-14 iso885914",
    "iso8859-15": "csisolatin9 iso-8859-15 iso8859-15 iso885915 iso_8859-15 l9",
    "iso8859-16": "iso-8859-16",
    "koi8-r": "cskoi8r koi koi8 koi8-r koi8_r",
    "koi8-u": "koi8-ru koi8-u",
    "mac-roman": "csmacintosh mac macintosh x-mac-roman",
    "cp874": "dos-874 iso-8859-11 iso8859-11 iso885911 tis-620 windows-874",
    "cp1250": "cp1250 windows-1250 x-cp1250",
    "cp1251": "cp1251 windows-1251 x-cp1251",
    "cp1252": "ansi_x3.4-1968 ascii cp1252 cp819 csisolatin1 ibm819 iso-8859-1 iso-ir-100 iso8859-1 iso88591 iso_8859-1 iso_8859-1:1987 l1 latin1 us-ascii windows-1252 x-cp1252",
    "cp1253": "cp1253 windows-1253 x-cp1253",
    "cp1254": "cp1254 csisolatin5 iso-8859-9 iso-ir-148 iso8859-9 iso88599 iso_8859-9 iso_8859-9:1989 l5 latin5 windows-1254 x-cp1254",
    "cp1255": "cp1255 windows-1255 x-cp1255",
    "cp1256": "cp1256 windows-1256 x-cp1256",
    "cp1257": "cp1257 windows-1257 x-cp1257",
    "cp1258": "cp1258 windows-1258 x-cp1258",
    "mac-cyrillic": "x-mac-cyrillic x-mac-ukrainian",
    "gbk": "chinese csgb2312 csiso58gb231280 gb2312 gb_2312 gb_2312-80 gbk iso-ir-58 x-gbk",
    "gb18030": "gb18030",
    "big5": "big5 big5-hkscs cn-big5 csbig5 x-x-big5",
    "euc_jp": "cseucpkdfmtjapanese euc-jp x-euc-jp",
    "iso2022_jp": "csiso2022jp iso-2022-jp",
    "shift-jis": "csshiftjis ms932 ms_kanji shift-jis shift_jis sjis windows-31j x-sjis",
    "euc-kr": "cseuckr csksc56011987 euc-kr iso-ir-149 korean ks_c_5601-1987 ks_c_5601-1989 ksc5601 ksc_5601 windows-949",
    "utf-16-be": "unicodefffe utf-16be",
    "utf-16-le": "csunicode iso-10646-ucs-2 ucs-2 unicode unicodefeff utf-16 utf-16le",
}
LABELS = {label: codec for codec, labels in _LABELS.items() for label in labels.split()}
_BOMS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe\0\0", "utf-32-le"), (b"\0\0\xfe\xff", "utf-32-be"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))
_META = re.compile(rb"""<meta[^>]{0,200}?charset\s*=\s*["']?\s*([\w.:\-]+)""", re.I)


def map_label(label: str | None, fallback_utf8: bool = True) -> str | None:
    got = LABELS.get((label or "").strip().casefold())
    return got or ("utf-8" if fallback_utf8 else None)


def _bom(data: bytes) -> str | None:
    return next((c for b, c in _BOMS if data.startswith(b)), None)


#: Bytes of UTF-8 that begin no character.
_WITHIN = bytes(range(0x80, 0xC0))


def _utf8(data: bytes) -> bool:
    try:
        codecs.getincrementaldecoder("utf-8")().decode(data)  # a character that the end cuts is no error
    except UnicodeDecodeError:
        return False
    return True


#: Single-byte codecs and, by language, the letters beyond ASCII that are frequent in it, the most frequent first.
_TYPICAL = {
    "cp1252": ("éèàêçùâîôûëïœÉÀÈÇ", "üäößÜÄÖ", "óíáéñúü¿¡Ñ", "ãçáéóíêõâúà", "åäöøæÅÄÖØÆ", "àèéìòù"),
    "iso8859-2": ("ąęłóśżćńźŁŚŻ", "áíéřěšžčýůúňťďóŠŽČŘ", "áéíóöőúüűÁÉÖ", "ščžćđŠČŽ", "ăâîşţ"),
    "cp1250": ("ąęłóśżćńźŁŚŻ", "áíéřěšžčýůúňťďóŠŽČŘ", "áéíóöőúüűÁÉÖ", "ščžćđŠČŽ", "ăâîşţ"),
    "cp1251": ("оеаинтсрвлкмдпуяызьбгчйхжшюцщэфъё", "оаинвертсікудмлпзяьбгйчхцїжшющєґ"),
    "koi8-r": ("оеаинтсрвлкмдпуяызьбгчйхжшюцщэфъё",),
    "cp1253": ("αοιετσνηυρπκμλςωγδθχφβξζψάέήίόύώ",),
    "cp1255": ("יוהלאתרמבשנעדחקפגצכזטסםןךףץ",),
    "cp1256": ("اليمنورتبةعدسفهكقحجشصطخغذئزثءؤض",),
    "cp874": ("านรอกเงมยลวดทสตะปบคหแจพชขใไโผ",),
}
_LATIN = ("cp1252", "iso8859-2", "cp1250")


def _multibyte(data: bytes) -> str | None:
    """Of the East Asian codecs that read the data, the one that explains most of its high bytes by common characters."""
    best, most = None, 0.0
    for name in ("shift-jis", "euc_jp", "gb18030", "big5", "euc-kr"):
        try:
            text = codecs.getincrementaldecoder(name)().decode(data)
        except UnicodeDecodeError:
            continue
        wide = [c for c in text if c > "\x7f"]
        if not wide:
            continue
        kana = sum("぀" <= c <= "ヿ" for c in wide)
        hangul = sum("가" <= c <= "힣" for c in wide)
        common = sum("一" <= c <= "翿" for c in wide)
        half = sum("｡" <= c <= "ﾟ" for c in wide)
        score = {"shift-jis": 1.5 * kana + common, "euc_jp": 1.5 * kana + common, "gb18030": common, "big5": 0.98 * common, "euc-kr": 1.5 * hangul}[name]
        score = (score - 2 * half - 2 * sum("" <= c <= "" for c in wide)) / len(wide)
        if score > most:
            best, most = name, score
    return best if most > 0.6 else None


class EncodingDetector:
    """Takes bytes piece by piece."""

    def __init__(self):
        self.reset()

    def reset(self) -> None:
        self.data = b""

    def update(self, data: bytes) -> EncodingDetector:
        self.data += data
        return self

    def encoding(self, most: int | None = None) -> str | None:
        """ASCII and UTF-8 are told by all bytes; of input of more than most bytes, the rest by the first and the last ones."""
        every = data = self.data
        ends = [data]
        if most and len(data) > most:
            ends = [data[: most // 2], data[-(most // 2) :]]
            data = b"".join(ends)
        if not data:
            return None
        if bom := _bom(data):
            return "utf-16" if bom == "utf-16-le" else bom
        if b"\x1b$" in data or b"\x1b(J" in data:
            return "iso2022_jp"
        if every.isascii() and b"\0" not in every:
            return "ascii"
        zeros = (data[0::2].count(0), data[1::2].count(0))
        if max(zeros) > 0.4 * (len(data) / 2):
            return "utf-16-le" if zeros[1] > zeros[0] else "utf-16-be"
        if _utf8(every) or len(ends) > 1 and not data.isascii() and _utf8(ends[0]) and _utf8(ends[1].lstrip(_WITHIN)):
            return "utf-8"
        if wide := _multibyte(ends[0]) or len(ends) > 1 and _multibyte(ends[1].partition(b"\n")[2]):  # no character of several bytes has a line end in it
            return wide
        best, most = None, 0.0
        high = max(1, sum(b > 127 for b in data))
        for name, sets in _TYPICAL.items():
            text = data.decode(name, "replace")
            wrong = 2 * text.count("�")
            if name in _LATIN:
                wrong += len(re.findall(r"[a-zß-ÿ][A-ZÀ-Þ]", text))
            else:
                wrong += 2 * len(re.findall(r"[A-Za-z][^\W\d_A-Za-z]|[^\W\d_A-Za-z][A-Za-z]|[а-я][А-Я]", text))
            worth = max(sum(1 - 0.5 * letters.index(c) / len(letters) for c in text if c in letters) for letters in sets)
            score = (worth - wrong) / high
            if score > most + (0.15 if name in _LATIN and best else 0):  # Western letters have their places in the other Latin sets too
                best, most = name, score
        return best


def detect_encoding(data: bytes | None, max_len: int = MOST_BYTES, html5: bool = True, from_meta: bool = False) -> str | None:
    """A codec name. With html5 it is one that HTML5 knows (cp1252 for ASCII and Latin-1), utf-8 if nothing tells; else None."""
    data = bytes(data or b"")
    if from_meta and (m := _META.search(data[:1024])) and (got := map_label(m.group(1).decode("latin-1"), False)):
        return got
    got = EncodingDetector().update(data).encoding(max_len)
    if not html5:
        return got
    return map_label(got) if got and got.casefold() in LABELS else got or "utf-8"


def bytes_to_str(data: bytes | None, encoding: str = "utf-8", errors: str = "ignore", fallback: tuple[str, ...] = ("utf-8", "cp1252"), strip_bom: bool = True) -> str | None:
    """Each codec is tried strictly; if none reads the data, the first decodes what it can."""
    if data is None:
        return None
    data = bytes(data)
    out = None
    for name in dict.fromkeys([encoding, *fallback]):
        try:
            out = data.decode(name)
            break
        except (UnicodeDecodeError, LookupError):
            continue
    if out is None:
        try:
            out = data.decode(encoding, errors)
        except LookupError:
            out = data.decode("utf-8", errors)
    return out.lstrip("﻿") if strip_bom else out


#: (type, beginnings), in the order in which they are tried.
_MAGIC = [
    ("text/plain", "efbbbf fffe feff 0efeff 2b2f7638 2b2f7639 2b2f762b 2b2f762f"),
    ("text/html", [b"<!DOCTYPE html", b"<!DOCTYPE HTML", b"<!doctype html", b"<!doctype HTML"]),
    ("image/svg+xml", [b"<!DOCTYPE svg", b"<!doctype svg", b"<!DOCTYPE SVG", b"<!doctype SVG"]),
    ("application/xml", [b"<?xml ", "<?xml ".encode("utf-16-be")]),
    ("application/rtf", [b"{\\rtf1"]),
    ("application/msword", "d0cf11e0a1b11ae1"),
    ("image/jpeg", "ffd8ffe0 ffd8ffe1 ffd8ffe2 ffd8ffe8 ffd8ffee"),
    ("image/png", "89504e470d0a1a0a"),
    ("image/gif", [b"GIF87a"]),
    ("image/tiff", "49492a00 4d4d002a"),
    ("image/x-icon", "00000100"),
    ("image/icns", [b"icns"]),
    ("image/jp2", "0000000c6a5020200d0a870a ff4fff51"),
    ("image/bmp", [b"BM"]),
    ("image/webp", [b"RIFF"]),
    ("image/x-xpixmap", [b"/* XPM */"]),
    ("application/pdf", [b"%PDF-"]),
    ("application/postscript", [b"%!PS"]),
    ("image/vnd.adobe.photoshop", [b"8BPS"]),
    ("application/zip", "504b0304 504b0506 504b0708"),
    ("application/x-tar", [b"ustar\x0000", b"ustar  \0"]),
    ("application/x-7z-compressed", "377abcaf271c"),
    ("application/gzip", "1f8b"),
    ("application/x-bzip2", [b"INDX", b"BZh"]),
    ("application/x-lz4", "04224d18"),
    ("application/x-xz", "fd377a585a00"),
    ("application/vnd.rar", [b"Rar!\x1a\x07\0", b"Rar!\x1a\x07\x01\0"]),
    ("font/woff", [b"wOFF"]),
    ("font/woff2", [b"wOF2"]),
    ("font/ttf", "0001000000"),
    ("application/vnd.iccprofile", [b"KCMS"]),
    ("application/ogg", [b"OggS"]),
    ("audio/flac", [b"fLaC"]),
    ("audio/aiff", [b"FORM"]),
    ("audio/mpeg", "fffb fff2 494433"),
    ("video/mp4", [b"ftypisom"]),
    ("video/mpeg", "000001b3 000001ba"),
    ("video/x-matroska", "1a45dfa3"),
    ("application/x-shockwave-flash", [b"CWS", b"FWS"]),
    ("application/x-elf", [b"\x7fELF"]),
    ("application/vnd.ms-cab-compressed", [b"MSCF"]),
    ("application/x-iso9660-image", [b"CD001"]),
    ("application/x-mach-binary", "feedface feedfacf cefaedfe cffaedfe"),
    ("application/wasm", [b"\0asm"]),
    ("application/vnd.debian.binary-package", [b"!<arch>\n"]),
    ("application/java-vm", "cafebabe"),
    ("application/vnd.ms-htmlhelp", [b"ITSF\x03\0\0\0`\0\0\0"]),
]
MAGIC = [(m, kind) for kind, marks in _MAGIC for m in (map(bytes.fromhex, marks.split()) if isinstance(marks, str) else marks)]
_PRINTABLE = bytes(range(32, 127))


def detect_mime(data: bytes | None, max_unprintable: float = 0.05) -> str | None:
    """By the beginning, then by the share of bytes that aren't printable ASCII."""
    if data is None:
        return None
    data = bytes(data)
    head = data[:128]
    low = head.lstrip(b" \t\n\r\f\v")
    for mark, kind in MAGIC:
        if head.startswith(mark) or low.startswith(mark):
            if kind in ("text/html", "application/xml") and b'"-//W3C//DTD XHTML' in low:
                return "application/xhtml+xml"
            if kind == "application/xml" and (b"<svg " in low or b'"-//W3C//DTD SVG' in low):
                return "image/svg+xml"
            return kind
    odd = len(data) - len(data.translate(None, bytes(set(range(256)) - set(_PRINTABLE)))) if data else 0
    return "application/octet-stream" if odd > int(len(data) * max_unprintable) else "text/plain"


# ---- columns --------------------------------------------------------------------------------------


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def encoding_label(label: Column | str, fallback_utf8: bool = True) -> Column:
    """The codec of an HTML5 label: a built-in expression over a constant map."""
    table = F.create_map(*[F.lit(x) for kv in sorted(LABELS.items()) for x in kv])
    got = F.try_element_at(table, F.lower(F.trim(_c(label))))
    return F.coalesce(got, F.lit("utf-8")) if fallback_utf8 else got


def encoding_of(data: Column | str, max_len: int = MOST_BYTES, html5: bool = True, from_meta: bool = False) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda d: None if d is None else detect_encoding(d, max_len, html5, from_meta))

    return run(_c(data))


def decoded(data: Column | str, encoding: Column | str | None = None, errors: str = "ignore", fallback: tuple[str, ...] = ("utf-8", "cp1252"), strip_bom: bool = True) -> Column:
    """Text of binary data; encoding is a column of codec names (detected, if left out)."""

    @F.pandas_udf("string")
    def run(s: pd.Series, e: pd.Series) -> pd.Series:
        return pd.Series([bytes_to_str(d, x or "utf-8", errors, fallback, strip_bom) for d, x in zip(s, e, strict=True)], dtype=object)

    return run(_c(data), encoding_of(data) if encoding is None else _c(encoding))


def mime_of(data: Column | str, max_unprintable: float = 0.05) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda d: detect_mime(d, max_unprintable))

    return run(_c(data))


def dechunked(data: Column | str, strict: bool = False) -> Column:
    """The body that chunks carry. Strict: NULL where they are broken."""

    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda d: None if d is None else _or_none(decode_chunked, bytes(d), strict))

    return run(_c(data))


def http_chunks(data: Column | str) -> Column:
    @F.pandas_udf("array<binary>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda d: None if d is None else chunks_of(bytes(d)))

    return run(_c(data))


def decoded_payload(data: Column | str, transfer: Column | str, content: Column | str, mode: str = "all") -> Column:
    """The payload without the encodings that its headers name; NULL where they are unknown or don't fit."""

    @F.pandas_udf("binary")
    def run(s: pd.Series, t: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([None if d is None else _or_none(decode_payload, bytes(d), a, b, mode) for d, a, b in zip(s, t, c, strict=True)], dtype=object)

    return run(_c(data), _c(transfer), _c(content))


def _or_none(f, *args):
    try:
        return f(*args)
    except RecordError:
        return None
