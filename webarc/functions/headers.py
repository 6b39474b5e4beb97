"""Header blocks as columns: ordered multimaps of key and value, matched without regard to ASCII case. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Name = Column | str


def _c(c: Name) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _is(h: Column, name: str) -> Column:
    return F.lower(h["key"]) == name.lower()


def header_get_all(headers: Name, name: str) -> Column:
    return F.transform(F.filter(_c(headers), lambda h: _is(h, name)), lambda h: h["value"])


def header_get(headers: Name, name: str, default: str | None = None) -> Column:
    """The first value."""
    got = F.get(header_get_all(headers, name), F.lit(0))
    return got if default is None else F.coalesce(got, F.lit(default))


def header_contains(headers: Name, name: str) -> Column:
    return F.exists(_c(headers), lambda h: _is(h, name))


def header_keys(headers: Name) -> Column:
    return F.transform(_c(headers), lambda h: h["key"])


def header_values(headers: Name) -> Column:
    return F.transform(_c(headers), lambda h: h["value"])


def header_to_map(headers: Name) -> Column:
    """Values of repeated keys are joined with commas; keys are as they were first written."""
    h = _c(headers)
    keys = F.array_distinct(F.transform(h, lambda x: F.lower(x["key"])))
    of = lambda k: F.filter(h, lambda x: F.lower(x["key"]) == k)
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(F.get(of(k), F.lit(0))["key"].alias("key"), F.array_join(F.transform(of(k), lambda x: x["value"]), ",").alias("value"))))


def sanitize(text: Name, name: bool = False) -> Column:
    """On one line, without carriage returns; names also without colons."""
    out = F.replace(F.replace(F.trim(_c(text)), F.lit("\r"), F.lit("")), F.lit("\n"), F.lit(" "))
    return F.replace(out, F.lit(":"), F.lit("")) if name else out


def _entry(name: str, value: Name | Column) -> Column:
    return F.struct(sanitize(F.lit(name), True).alias("key"), sanitize(value).alias("value"))


def header_append(headers: Name, name: str, value: Column) -> Column:
    return F.concat(_c(headers), F.array(_entry(name, value)))


def header_remove(headers: Name, name: str) -> Column:
    return F.filter(_c(headers), lambda h: ~_is(h, name))


def header_set(headers: Name, name: str, value: Column) -> Column:
    """In the place of the first such key, without the others; at the end, if there is none."""
    h = _c(headers)
    at = F.array_position(F.transform(h, lambda x: F.lower(x["key"])), name.lower())
    before, behind = F.slice(h, F.lit(1), F.greatest(at.cast("int") - 1, F.lit(0))), F.slice(h, at.cast("int") + 1, F.size(h))
    return F.when(at > 0, F.concat(before, F.array(_entry(name, value)), header_remove(behind, name))).otherwise(header_append(h, name, value))


def header_block(headers: Name, status_line: Column | None = None) -> Column:
    """The block as text, with line ends, without the empty line that closes it."""
    lines = F.transform(_c(headers), lambda h: F.when(F.length(h["key"]) > 0, F.concat(h["key"], F.lit(": "), h["value"])).otherwise(h["value"]))
    text = F.concat(F.array_join(lines, "\r\n"), F.when(F.size(_c(headers)) > 0, F.lit("\r\n")).otherwise(F.lit("")))
    return text if status_line is None else F.concat(status_line, F.lit("\r\n"), text)


def parse_headers(block: Name, charset: str = "UTF-8") -> Column:
    """Pairs of a binary block; a line that starts with white space goes on with the one before, and lines without a colon don't count."""
    text = F.regexp_replace(F.decode(_c(block), charset), r"\r?\n[ \t]+", " ")
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: F.instr(x, ":") > 0)
    return F.transform(lines, lambda x: F.struct(F.trim(F.split_part(x, F.lit(":"), F.lit(1))).alias("key"), F.trim(F.substr(x, F.instr(x, ":") + 1)).alias("value")))


def status_code(line: Name) -> Column:
    code = F.get(F.split(_c(line), " ", 3), F.lit(1))
    return F.when(F.startswith(_c(line), F.lit("HTTP/")) & F.rlike(code, F.lit("^[0-9]{1,5}$")) & (code.try_cast("int") < 65536), code.try_cast("int"))


def reason_phrase(line: Name) -> Column:
    return F.when(F.startswith(_c(line), F.lit("HTTP/")), F.trim(F.get(F.split(_c(line), " ", 3), F.lit(2))))


def content_type(value: Name) -> Column:
    return F.nullif(F.trim(F.split_part(_c(value), F.lit(";"), F.lit(1))), F.lit(""))


def content_charset(value: Name) -> Column:
    return F.nullif(F.lower(F.regexp_extract(_c(value), r"(?i)charset=[ \"']*([^;\"' ]+)", 1)), F.lit(""))


# ---- predicates on records -----------------------------------------------------------------------


def has_record_type(mask: int, code: Name = "record_type_code") -> Column:
    return _c(code).bitwiseAND(F.lit(mask)) != 0


def has_content_length_lte(n: int, length: Name = "content_length") -> Column:
    return _c(length) <= n


def has_content_length_gte(n: int, length: Name = "content_length") -> Column:
    return _c(length) >= n


def is_warc_10(version: Name = "warc_version") -> Column:
    return _c(version) == "WARC/1.0"


def is_warc_11(version: Name = "warc_version") -> Column:
    return _c(version) == "WARC/1.1"


def has_block_digest(headers: Name = "headers") -> Column:
    return header_contains(headers, "WARC-Block-Digest")


def has_payload_digest(headers: Name = "headers") -> Column:
    return header_contains(headers, "WARC-Payload-Digest")


def is_concurrent(headers: Name = "headers") -> Column:
    return header_contains(headers, "WARC-Concurrent-To")


def has_valid_block_digest(status: Name = "block_digest_status") -> Column:
    return _c(status) == "ok"


def has_valid_payload_digest(status: Name = "payload_digest_status") -> Column:
    return _c(status) == "ok"
