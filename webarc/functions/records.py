"""Whole records in binary columns: parsing and making them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.records import RecordError, check_digest, date_micros, record_bytes, status_parts
from ..sources.warc import parse_record
from .headers import header_set

PAIRS = "array<struct<key:string,value:string>>"
RECORD = f"struct<warc_version:string,record_id:string,record_type:string,record_date:timestamp,target_uri:string,block_length:bigint,content_length:bigint,headers:{PAIRS},is_http:boolean,http_status:int,http_headers:{PAIRS},block_digest_status:string,payload:binary,error:string>"
_NAMES = [x.split(":")[0] for x in RECORD[7:-1].replace(PAIRS, "x").split(",")]


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _fields(data: bytes, http: bool, decode: str) -> dict:
    try:
        r = parse_record(data, http, decode)
    except (RecordError, ValueError) as e:
        return dict.fromkeys(_NAMES) | {"error": str(e)}
    if r is None:
        return dict.fromkeys(_NAMES) | {"error": "no record"}
    pairs = lambda v: [{"key": k, "value": x} for k, x in v]
    return {
        "warc_version": r.warc_version, "record_id": r.get("WARC-Record-ID"), "record_type": r.record_type, "record_date": date_micros(r.get("WARC-Date")), "target_uri": r.get("WARC-Target-URI"), "block_length": r.block_length,
        "content_length": r.content_length, "headers": pairs(r.headers), "is_http": r.is_http, "http_status": status_parts(r.http_status_line)[0], "http_headers": pairs(r.http_headers),
        "block_digest_status": check_digest(r.block, r.get("WARC-Block-Digest")), "payload": r.payload, "error": None,
    }


def parse_warc_record(data: Column | str, http: bool = True, decode: str = "none") -> Column:
    """STRUCT of the first record in the data; error tells what is wrong with it. NULL stays NULL."""

    @F.pandas_udf(RECORD)
    def run(s: pd.Series) -> pd.DataFrame:
        rows = [dict.fromkeys(_NAMES) if d is None else _fields(bytes(d), http, decode) for d in s]
        out = pd.DataFrame({n: pd.Series([r[n] for r in rows], dtype=object) for n in _NAMES})
        dates = pd.Series(np.array([r["record_date"] for r in rows], "datetime64[us]"))  # in nanoseconds, years end with 2262
        return out.assign(http_status=out["http_status"].astype("Int32"), block_length=out["block_length"].astype("Int64"), content_length=out["content_length"].astype("Int64"), record_date=dates.dt.tz_localize("UTC"))

    return F.when(_c(data).isNotNull(), run(_c(data)))


def record_id(*parts: Column | str) -> Column:
    """<urn:uuid:...> that is the same for the same parts: a task that runs again gives records the ids it gave before."""
    h = F.md5(F.concat_ws("\x01", *[_c(p).cast("string") for p in parts]))
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", cut(1, 8), cut(9, 4), F.concat(F.lit("3"), cut(14, 3)), F.concat(F.lit("8"), cut(18, 3)), cut(21, 12)), F.lit(">"))


def warc_date(at: Column | str) -> Column:
    """In UTC, as headers write it."""
    return F.date_format(F.to_utc_timestamp(_c(at), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def record_headers(record_type: Column | str, id: Column | str, date: Column | str | None = None, is_http: Column | None = None, content_length: Column | None = None) -> Column:
    """The headers that every record has, as pairs."""
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))
    kind = F.when(F.lower(_c(record_type)).isin("any", "any_type"), F.lit("unknown")).otherwise(F.lower(_c(record_type)))
    out = F.array(pair("WARC-Type", kind), pair("WARC-Record-ID", _c(id)), *([pair("WARC-Date", warc_date(date))] if date is not None else []))
    if is_http is not None:
        side = F.when(kind == "request", "request").otherwise("response")
        out = F.when(is_http, header_set(out, "Content-Type", F.concat(F.lit("application/http; msgtype="), side))).otherwise(out)
    return out if content_length is None else header_set(out, "Content-Length", content_length.cast("string"))


def to_record(version: str, headers: Column | str, payload: Column | str, status_line: Column | str | None = None, http_headers: Column | str | None = None, checksum: bool = True) -> Column:
    """The record's bytes; lengths and, with checksum, digests are set."""

    @F.pandas_udf("binary")
    def run(h: pd.Series, p: pd.Series, line: pd.Series, hh: pd.Series) -> pd.Series:
        pairs = lambda v: [(x["key"], x["value"]) for x in v] if v is not None else []
        return pd.Series([record_bytes(version, pairs(a), bytes(b or b""), c, pairs(d), None, checksum) for a, b, c, d in zip(h, p, line, hh, strict=True)], dtype=object)

    none = F.lit(None)
    return run(_c(headers), _c(payload), none.cast("string") if status_line is None else _c(status_line), none.cast(PAIRS) if http_headers is None else _c(http_headers))
