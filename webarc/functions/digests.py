"""Digests of binary columns, in Base32 as archives write them; all are built-in expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ALGORITHMS = {"md5": 128, "sha1": 160, "sha256": 256, "sha512": 512}


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hex_digest(data: Column | str, algorithm: str = "sha1") -> Column:
    d = _c(data)
    return {"md5": F.md5(d), "sha1": F.sha1(d)}.get(algorithm) if algorithm in ("md5", "sha1") else F.sha2(d, int(algorithm[3:]))


def base32_of_hex(text: Column, bits: int) -> Column:
    """Ten hexadecimal digits are eight of Base32; the last group is filled up with zeros and cut."""
    full, rest = divmod(bits // 4, 10)
    parts = [F.substring(text, 10 * i + 1, 10) for i in range(full)] + ([F.rpad(F.substring(text, 10 * full + 1, rest), 10, "0")] if rest else [])
    digits = [F.translate(F.lpad(F.conv(p, 16, 32), 8, "0"), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for p in parts]
    if rest:
        n = math.ceil(rest * 4 / 5)
        digits[-1] = F.rpad(F.substring(digits[-1], 1, n), 8, "=")
    return F.concat(*digits)


def digest_of(data: Column | str, algorithm: str = "sha1") -> Column:
    """algorithm:BASE32"""
    return F.concat(F.lit(f"{algorithm}:"), base32_of_hex(hex_digest(data, algorithm), ALGORITHMS[algorithm]))


def digest_status(data: Column | str, value: Column | str) -> Column:
    """ok, fail, missing, unsupported, format or no_payload, for a digest in Base32 or hexadecimal."""
    d, v = _c(data), F.trim(_c(value))
    name = F.replace(F.lower(F.trim(F.split_part(v, F.lit(":"), F.lit(1)))), F.lit("sha-"), F.lit("sha"))
    text = F.trim(F.substr(v, F.instr(v, ":") + 1))
    plain = F.rtrim(F.translate(F.upper(text), "=", " "))
    out = F.lit("unsupported")
    for a, bits in ALGORITHMS.items():
        own = hex_digest(d, a)
        ok = (F.lower(text) == own) | (plain == F.rtrim(F.translate(base32_of_hex(own, bits), "=", " ")))
        shaped = F.rlike(text, F.lit(rf"^(?:[0-9A-Fa-f]{{{bits // 4}}}|[A-Za-z2-7]{{{math.ceil(bits / 5)}}}=*)$"))
        out = F.when(name == a, F.when(ok, "ok").when(shaped, "fail").otherwise("format")).otherwise(out)
    return F.when(v.isNull(), "missing").when(d.isNull(), "no_payload").when(F.instr(v, ":") == 0, "format").otherwise(out)
