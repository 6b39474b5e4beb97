"""Queries over archives of many kinds of records: types, wrong and missing digests, encoded payloads, other character sets, dates, splits, dictionaries, places; and over records and headers as columns."""

from __future__ import annotations

import gzip
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..functions import digests, encoding, headers, records
from ..operators import archive, bulk
from ..sources.codecs import train_dictionary
from ..sources.shared import shared_folder
from ..sources.warc import extract_record, read_warcs, register

FILES = 4
#: The types that the records take in turn.
TYPES = ("response", "request", "resource", "metadata", "warcinfo", "revisit", "conversion", "continuation")
_CODES = {"warcinfo": 2, "response": 4, "resource": 8, "request": 16, "metadata": 32, "revisit": 64, "conversion": 128, "continuation": 256}


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pair(key: str, value: Column) -> Column:
    return F.struct(F.lit(key).alias("key"), value.cast("string").alias("value"))


def _of(values: tuple[str, ...], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at % len(values)).cast("int") + 1)


def _write(spark: SparkSession, rows: DataFrame, codec: str = "gzip", **options) -> str:
    register(spark)
    path = shared_folder(spark, "records")
    rows.repartition(FILES, F.xxhash64("target_uri")).write.format("warc").options(compression=codec, **{k: str(v) for k, v in options.items()}).mode("append").save(path)
    return path


def _at() -> Column:
    return F.timestamp_seconds(F.lit(1704067200) + 3607 * F.col("page_id"))


def record_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all types and both versions, some of them concurrent to others, each told by the reader's columns and the predicates."""
    at = F.col("page_id")
    kind = _of(TYPES, at)
    concurrent = F.when(at % 3 == 0, F.array(_pair("WARC-Concurrent-To", F.lit("<urn:uuid:0>")))).otherwise(F.array().cast(records.PAIRS))
    http = kind.isin("request", "response")
    rows = _pages(spark, sf_dir).select(
        kind.alias("record_type"), F.concat(F.lit("page:"), at.cast("string")).alias("target_uri"), _at().alias("record_date"), F.when(at % 2 == 0, "WARC/1.0").otherwise("WARC/1.1").alias("warc_version"), concurrent.alias("headers"),
        http.alias("is_http"), F.when(http, F.when(kind == "request", "GET / HTTP/1.1").otherwise("HTTP/1.1 404 Not  here")).alias("http_status_line"), F.encode("html", "UTF-8").alias("payload"),
    )
    columns = ["target_uri", "record_type", "record_type_code", "record_date", "warc_version", "is_http", "headers", "http_status", "http_reason", "content_length", "block_digest_status", "payload_digest_status", "record_id"]
    r = read_warcs(spark, _write(spark, rows, "zstd"), columns)
    return r.select(
        "target_uri", "record_type", "record_type_code", F.unix_timestamp("record_date").alias("at"), headers.is_warc_10().alias("is_10"), headers.is_warc_11().alias("is_11"), "is_http", headers.is_concurrent().alias("is_concurrent"), "http_status", "http_reason",
        headers.has_block_digest().alias("has_block"), headers.has_payload_digest().alias("has_payload"), headers.has_valid_block_digest().alias("good_block"), F.coalesce(headers.has_valid_payload_digest(), F.lit(False)).alias("good_payload"),
        headers.has_content_length_lte(2500).alias("is_short"), F.rlike("record_id", F.lit("^<urn:uuid:[0-9a-f-]{36}>$")).alias("has_id"), headers.has_record_type(4 | 16 | 2).alias("is_listed"),
    )


def records_of_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types chosen while reading, by name and by mask, with a length limit on the block."""
    rows = _pages(spark, sf_dir).select(_of(TYPES, F.col("page_id")).alias("record_type"), F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("target_uri"), F.lit(False).alias("is_http"), F.encode("html", "UTF-8").alias("payload"))
    path = _write(spark, rows, "lz4")
    by_name = read_warcs(spark, path, ["target_uri", "record_type", "block_length"], recordTypes="metadata, warcinfo|revisit", minContentLength=1500)
    by_mask = read_warcs(spark, path, ["target_uri", "record_type", "block_length"], recordTypes=_CODES["conversion"] | _CODES["resource"], maxContentLength=5000)
    return by_name.union(by_mask)


def _judged(spark: SparkSession, sf_dir: str) -> str:
    """Resources whose digests are right, wrong, missing, of an unknown kind or out of shape, in turn."""
    at, data = F.col("page_id"), F.encode("html", "UTF-8")
    digest = F.when(at % 6 == 0, digests.digest_of(data, "sha1")).when(at % 6 == 1, digests.digest_of(data, "sha256")).when(at % 6 == 2, digests.digest_of(F.encode(F.lit("other"), "UTF-8"), "md5")).when(at % 6 == 3, F.lit("crc:ABCD")).when(at % 6 == 4, F.lit("sha1:short"))
    value = F.when(digest.isNotNull(), F.array(_pair("WARC-Block-Digest", digest))).otherwise(F.array().cast(records.PAIRS))
    rows = _pages(spark, sf_dir).select(F.lit("resource").alias("record_type"), F.concat(F.lit("page:"), at.cast("string")).alias("target_uri"), F.lit(False).alias("is_http"), value.alias("headers"), data.alias("payload"))
    return _write(spark, rows, checksumData="false")


def block_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_warcs(spark, _judged(spark, sf_dir), ["target_uri", "block_digest_status", "block_sha1"])


def verified_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only records whose block digest is right."""
    return read_warcs(spark, _judged(spark, sf_dir), ["target_uri", "content_length"], verifyDigests="true")


def failing_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = read_warcs(spark, _judged(spark, sf_dir), ["record_id", "block_digest_status", "payload_digest_status"])
    return r.groupBy("block_digest_status").agg(F.count("*").alias("n")).join(archive.digest_summary(archive.digest_report(r)).agg(F.sum("n").alias("n_all"), F.sum(F.when(F.contains("status", F.lit("FAIL")), F.col("n"))).alias("n_fail")), F.lit(True))


_ENCODED = ("", "gzip", "chunked", "deflate+chunked", "zstd")


@F.pandas_udf(BinaryType())
def _packed(data: pd.Series, how: pd.Series) -> pd.Series:
    import zstandard

    def one(b: bytes, h: str) -> bytes:
        b = bytes(b)
        if "gzip" in h:
            b = gzip.compress(b, mtime=0)
        if "deflate" in h:
            b = zlib.compress(b)
        if "zstd" in h:
            b = zstandard.ZstdCompressor().compress(b)
        if "chunked" in h:
            b = b"".join(b"%x\r\n%b\r\n" % (len(b[i : i + 1000]), b[i : i + 1000]) for i in range(0, len(b), 1000)) + b"0\r\n\r\n"
        return b

    return pd.Series([one(b, h) for b, h in zip(data, how, strict=True)], dtype=object)


def encoded_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads in chunks and compressed, decoded by the reader."""
    how = _of(_ENCODED, F.col("page_id"))
    content = F.regexp_replace(how, r"\+?chunked", "")
    head = F.filter(F.array(F.when(content != "", _pair("Content-Encoding", content)), F.when(F.contains(how, F.lit("chunked")), _pair("Transfer-Encoding", F.lit("chunked"))), _pair("Content-Type", F.lit("text/html"))), lambda x: x.isNotNull())
    rows = _pages(spark, sf_dir).select(F.lit("response").alias("record_type"), F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("target_uri"), F.lit(True).alias("is_http"), F.lit("HTTP/1.1 200 OK").alias("http_status_line"), head.alias("http_headers"), _packed(F.encode("html", "UTF-8"), how).alias("payload"))
    path = _write(spark, rows)
    whole = read_warcs(spark, path, ["target_uri", "payload"], autoDecode="all").select("target_uri", F.md5("payload").alias("md5"))
    kept = read_warcs(spark, path, ["target_uri", "payload", "http_headers", "http_content_type"])
    by_column = encoding.decoded_payload("payload", headers.header_get("http_headers", "transfer-encoding"), headers.header_get("http_headers", "content-encoding"))
    return whole.join(kept.select("target_uri", "http_content_type", F.md5(by_column).alias("column_md5"), F.size("http_headers").alias("n_headers")), "target_uri")


def other_charsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages in Latin-1, UTF-8 and UTF-16, decoded by the header's character set, and the last two also by what is detected (few letters outside ASCII tell single-byte sets apart only by guess)."""
    at, text = F.col("page_id"), F.regexp_replace("html", "[^\\x{20}-\\x{FF}\n]", "?")
    name = _of(("ISO-8859-1", "UTF-8", "UTF-16LE"), at)
    data = F.when(at % 3 == 0, F.encode(text, "ISO-8859-1")).when(at % 3 == 1, F.encode(text, "UTF-8")).otherwise(F.concat(F.unhex(F.lit("FFFE")), F.encode(text, "UTF-16LE")))
    head = F.array(_pair("Content-Type", F.concat(F.lit("text/html; Charset=\""), name, F.lit("\""))))
    rows = _pages(spark, sf_dir).select(F.lit("response").alias("record_type"), F.concat(F.lit("page:"), at.cast("string")).alias("target_uri"), F.lit(True).alias("is_http"), F.lit("HTTP/1.0 200 OK").alias("http_status_line"), head.alias("http_headers"), data.alias("payload"))
    r = read_warcs(spark, _write(spark, rows), ["target_uri", "http_charset", "payload"])
    by_header = encoding.decoded("payload", encoding.encoding_label("http_charset"))
    return r.select("target_uri", "http_charset", F.md5(F.encode(by_header, "UTF-8")).alias("by_header"), F.when(F.col("http_charset") != "iso-8859-1", F.md5(F.encode(encoding.decoded("payload"), "UTF-8"))).alias("by_detection"))


def http_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of HTTP headers."""
    text = F.concat(F.date_format(_at(), "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    head = F.array(_pair("Date", text), _pair("Last-Modified", F.when(F.col("page_id") % 4 == 0, F.lit("never")).otherwise(text)), _pair("Content-Type", F.lit("Text/HTML ; charset=x")))
    rows = _pages(spark, sf_dir).select(F.lit("response").alias("record_type"), F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("target_uri"), F.lit(True).alias("is_http"), F.lit("HTTP/1.1 200").alias("http_status_line"), head.alias("http_headers"), F.encode(F.lit("x"), "UTF-8").alias("payload"))
    r = read_warcs(spark, _write(spark, rows, "none"), ["target_uri", "http_date", "http_last_modified", "http_status", "http_content_type"])
    return r.select("target_uri", F.unix_timestamp("http_date").alias("at"), F.unix_timestamp("http_last_modified").alias("changed"), "http_status", "http_content_type")


def _plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select(F.lit("resource").alias("record_type"), F.col("url").alias("target_uri"), F.lit(False).alias("is_http"), F.encode("html", "UTF-8").alias("payload"))


def small_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files cut into splits far smaller than they are, of three codecs: each record comes once."""
    out = None
    for codec in ("gzip", "zstd", "lz4"):
        r = read_warcs(spark, _write(spark, _plain(spark, sf_dir), codec), ["target_uri", "payload"], splitSize=20_000).select(F.lit(codec).alias("codec"), "target_uri", F.md5("payload").alias("md5"))
        out = r if out is None else out.union(r)
    return out


def zstd_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members compressed with a dictionary that leads each file; it is trained from a few pages."""
    samples = [bytes(r["b"]) for r in _pages(spark, sf_dir).select(F.encode("html", "UTF-8").alias("b")).orderBy("page_id").limit(200).collect()]
    path = _write(spark, _plain(spark, sf_dir), "zstd", dictionaryHex=train_dictionary(samples, 4096).hex())
    return read_warcs(spark, path, ["target_uri", "payload"], splitSize=30_000).select("target_uri", F.md5("payload").alias("md5"))


def records_by_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last record of each file, read again from its place alone."""
    path = _write(spark, _plain(spark, sf_dir))
    last = read_warcs(spark, path, ["path", "stream_pos", "target_uri"]).groupBy("path").agg(F.max("stream_pos").alias("stream_pos"), F.max_by("target_uri", "stream_pos").alias("target_uri")).collect()
    out = None
    for x in last:
        r = extract_record(spark, x["path"], x["stream_pos"]).select((F.col("target_uri") == x["target_uri"]).alias("same"), "block_digest_status", (F.col("stream_pos") == x["stream_pos"]).alias("there"))
        out = r if out is None else out.union(r)
    return out


def record_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records made as binary columns, with headers that need cleaning, and parsed again."""
    c = _table(spark, sf_dir, "customer")
    head = records.record_headers(F.lit("Response"), records.record_id("c_custkey", "c_name"), F.timestamp_seconds(F.col("c_custkey") * 86400), F.lit(True))
    head = headers.header_append(headers.header_set(head, "WARC-Target-URI", F.concat(F.lit("c:\r\n"), F.col("c_custkey").cast("string"))), "X:Seg", F.col("c_mktsegment"))
    data = records.to_record("WARC/1.1", head, F.encode("c_name", "UTF-8"), F.lit("HTTP/1.1 201 Made"), F.array(_pair("A", F.col("c_nationkey")), _pair("a", F.lit("é"))))
    r = c.select("c_custkey", records.parse_warc_record(data).alias("r"), records.parse_warc_record(F.substring(data, 6, 10_000)).alias("bad"))
    return r.select(
        "c_custkey", "r.record_type", "r.warc_version", "r.record_id", "r.target_uri", F.unix_timestamp("r.record_date").alias("at"), "r.http_status", "r.content_length", "r.block_digest_status", F.decode("r.payload", "UTF-8").alias("name"),
        headers.header_get(F.col("r.headers"), "xseg").alias("segment"), F.array_join(headers.header_get_all(F.col("r.http_headers"), "A"), "+").alias("both"), F.col("bad.error").isNotNull().alias("is_bad"), headers.header_contains(F.col("r.headers"), "WARC-Payload-Digest").alias("summed"),
    )


def header_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header blocks built, written, parsed and changed, for each order."""
    o = _table(spark, sf_dir, "orders")
    h = F.array(_pair("Status", F.col("o_orderstatus")), _pair("Priority", F.col("o_orderpriority")), _pair("status", F.col("o_custkey")))
    block = headers.header_block(headers.header_append(h, "Name", F.concat(F.lit("  a\nb:"), F.col("o_orderkey").cast("string"), F.lit("\r "))), F.lit("HTTP/1.1 204 Nothing"))
    again = headers.parse_headers(F.encode(F.substring(block, F.instr(block, "\n") + 1, 10_000), "UTF-8"))
    folded = headers.parse_headers(F.encode(F.concat(F.lit("One: 1\r\n  more\nno colon\nTwo :2:"), F.col("o_custkey").cast("string")), "UTF-8"))
    return o.select(
        "o_orderkey", block.alias("block"), F.array_join(headers.header_keys(again), ",").alias("keys"), F.array_join(headers.header_values(again), "|").alias("values"), headers.header_get(again, "missing", "none").alias("missing"), F.size(again).alias("n"),
        F.array_join(headers.header_values(headers.header_set(h, "STATUS", F.lit("z"))), "|").alias("after_set"), F.array_join(headers.header_values(folded), "|").alias("folded"), headers.content_type(F.lit(" text/x ; q=1")).alias("type"),
        headers.content_charset(F.concat(F.lit("a; CHARSET='K"), F.col("o_orderstatus"), F.lit("'"))).alias("charset"), headers.status_code(F.concat(F.lit("HTTP/1.1 "), (F.col("o_orderkey") * 37).cast("string"), F.lit(" x"))).alias("code"),
    )


_KINDS = (
    ("%PDF-1.4 x", "application/pdf"), ("GIF87a......", "image/gif"), ("  <!DOCTYPE html><p>", "text/html"), ("<?xml version='1.0'?><a/>", "application/xml"), ("<?xml version='1.0'?><svg >", "image/svg+xml"), ("PK\u0003\u0004....", "application/zip"), ("just text", "text/plain"),
    ("\u0001\u0002\u0003\u0004", "application/octet-stream"),
)


def mime_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of data by its first bytes."""
    data = _of(tuple(k for k, _ in _KINDS), F.col("n_nationkey"))
    return _table(spark, sf_dir, "nation").select("n_nationkey", encoding.mime_of(F.encode(data, "UTF-8")).alias("mime"))


_LABELS = (
    ("windows-1251", "cp1251"), ("x-sjis", "shift-jis"), ("ms_kanji", "shift-jis"), ("gb2312", "gbk"), ("big5-hkscs", "big5"), ("EUC-KR", "euc-kr"), ("korean", "euc-kr"), ("unicode-1-1-utf-8", "utf-8"), ("l2", "iso8859-2"), ("latin5", "cp1254"), ("ascii", "cp1252"), ("dos-874", "cp874"),
    ("x-cp1250", "cp1250"), ("visual", "iso8859-8"), ("cyrillic", "iso8859-5"), ("greek8", "iso8859-7"), ("macintosh", "mac-roman"), ("tis-620", "cp874"), ("ibm866", "ibm866"), ("koi8-u", "koi8-u"), ("utf-16", "utf-16-le"), ("csisolatin1", "cp1252"), ("gb18030", "gb18030"), ("euc-jp", "euc_jp"), ("unknown", None),
)


def label_codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codecs of a label for each nation; NULL for an unknown one."""
    return _table(spark, sf_dir, "nation").select("n_nationkey", encoding.encoding_label(_of(tuple(k for k, _ in _LABELS), F.col("n_nationkey")), fallback_utf8=False).alias("codec"))


def document_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How digests of each algorithm are judged, in both notations, wrong, out of shape and missing."""
    d = _table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("data"))
    at = F.col("doc_id")
    value = F.when(at % 7 == 0, F.concat(F.lit("SHA256: "), F.upper(F.sha2("data", 256)))).when(at % 7 == 1, digests.digest_of("data", "sha512")).when(at % 7 == 2, F.concat(F.lit("md5:"), F.md5(F.lit("x").cast("binary")))).when(at % 7 == 3, F.lit("no colon")).when(at % 7 == 4, F.lit("sha1:%%%")).when(at % 7 == 5, F.lit("tiger:AAAA"))
    return d.select("doc_id", digests.digest_status("data", value).alias("status"))


def bulk_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates and deletions as actions."""
    r = _table(spark, sf_dir, "region")
    return bulk.update_action(r, "r_regionkey", "regions").union(bulk.delete_action(r, "r_regionkey", "regions"))


QUERIES = [
    record_kinds, records_of_types, block_digests, verified_records, failing_digests, encoded_payloads, other_charsets, http_dates, small_splits, zstd_dictionary, records_by_place, record_columns, header_edits, mime_kinds, label_codecs, document_sums, bulk_changes,
]

# ---- SQL ------------------------------------------------------------------------------------------------

_LIST = lambda values: "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"
_KIND = f"{_LIST(TYPES)}[page_id % {len(TYPES)} + 1]"
_CODE = "CASE {} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _CODES.items()) + " END"
_URI = "'page:' || page_id AS target_uri"
_SIZE = "octet_length(encode(html))"
_UUID = "'<urn:uuid:' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-3' || substr(h, 14, 3) || '-8' || substr(h, 18, 3) || '-' || substr(h, 21, 12) || '>'"
_CLEAN = "regexp_replace(html, '[^\\x{20}-\\x{FF}\n]', '?', 'g')"


def oracle_sql() -> dict[str, str]:
    http = "k IN ('request', 'response')"
    return {
        "record_kinds": f"""
SELECT {_URI}, k AS record_type, CAST({_CODE.format('k')} AS INT) AS record_type_code, 1704067200 + 3607 * page_id AS "at", page_id % 2 = 0 AS is_10, page_id % 2 = 1 AS is_11, {http} AS is_http, page_id % 3 = 0 AS is_concurrent,
  CASE WHEN k = 'response' THEN 404 END AS http_status, CASE WHEN k = 'response' THEN 'Not  here' END AS http_reason, true AS has_block, {http} AS has_payload, true AS good_block, {http} AS good_payload,
  {_SIZE} <= 2500 AS is_short, true AS has_id, k IN ('request', 'response', 'warcinfo') AS is_listed
FROM (SELECT *, {_KIND} AS k FROM pages)""",
        "records_of_types": f"""
SELECT {_URI}, k AS record_type, {_SIZE} AS block_length FROM (SELECT *, {_KIND} AS k FROM pages)
WHERE (k IN ('metadata', 'warcinfo', 'revisit') AND {_SIZE} >= 1500) OR (k IN ('conversion', 'resource') AND {_SIZE} <= 5000)""",
        "block_digests": f"SELECT {_URI}, ['ok', 'ok', 'fail', 'unsupported', 'format', 'missing'][page_id % 6 + 1] AS block_digest_status, sha1(html) AS block_sha1 FROM pages",
        "verified_records": f"SELECT {_URI}, {_SIZE} AS content_length FROM pages WHERE page_id % 6 < 2",
        "failing_digests": """
SELECT ['ok', 'ok', 'fail', 'unsupported', 'format', 'missing'][page_id % 6 + 1] AS block_digest_status, count(*) AS n, (SELECT count(*) FROM pages) AS n_all, (SELECT count(*) FROM pages WHERE page_id % 6 IN (2, 3, 4)) AS n_fail
FROM pages GROUP BY ALL""",
        "encoded_payloads": f"SELECT {_URI}, md5(html) AS md5, 'text/html' AS http_content_type, md5(html) AS column_md5, CAST([1, 2, 2, 3, 2][page_id % 5 + 1] AS INT) AS n_headers FROM pages",
        "other_charsets": f"SELECT {_URI}, ['iso-8859-1', 'utf-8', 'utf-16le'][page_id % 3 + 1] AS http_charset, md5({_CLEAN}) AS by_header, CASE WHEN page_id % 3 != 0 THEN md5({_CLEAN}) END AS by_detection FROM pages",
        "http_dates": f"SELECT {_URI}, 1704067200 + 3607 * page_id AS \"at\", CASE WHEN page_id % 4 != 0 THEN 1704067200 + 3607 * page_id END AS changed, 200 AS http_status, 'Text/HTML' AS http_content_type FROM pages",
        "small_splits": "SELECT codec, url AS target_uri, md5(html) AS md5 FROM pages, (SELECT unnest(['gzip', 'zstd', 'lz4']) AS codec)",
        "zstd_dictionary": "SELECT url AS target_uri, md5(html) AS md5 FROM pages",
        "records_by_place": f"SELECT true AS same, 'ok' AS block_digest_status, true AS there FROM range({FILES})",
        "record_columns": f"""
SELECT c_custkey, 'response' AS record_type, 'WARC/1.1' AS warc_version, {_UUID} AS record_id, 'c: ' || c_custkey AS target_uri, c_custkey * 86400 AS "at", 201 AS http_status, octet_length(encode(c_name)) AS content_length, 'ok' AS block_digest_status,
  c_name AS name, c_mktsegment AS segment, c_nationkey || '+é' AS "both", true AS is_bad, true AS summed
FROM (SELECT *, md5(c_custkey || chr(1) || c_name) AS h FROM customer)""",
        "header_edits": """
SELECT o_orderkey, 'HTTP/1.1 204 Nothing' || e || 'Status: ' || o_orderstatus || e || 'Priority: ' || o_orderpriority || e || 'status: ' || o_custkey || e || 'Name: a b:' || o_orderkey || e AS block,
  'Status,Priority,status,Name' AS keys, o_orderstatus || '|' || o_orderpriority || '|' || o_custkey || '|a b:' || o_orderkey AS "values", 'none' AS missing, 4 AS n, 'z|' || o_orderpriority AS after_set, '1 more|2:' || o_custkey AS folded,
  'text/x' AS type, 'k' || lower(o_orderstatus) AS charset, CASE WHEN o_orderkey * 37 < 65536 THEN CAST(o_orderkey * 37 AS INT) END AS code
FROM (SELECT *, chr(13) || chr(10) AS e FROM orders)""",
        "mime_kinds": f"SELECT n_nationkey, {_LIST([k for _, k in _KINDS])}[n_nationkey % {len(_KINDS)} + 1] AS mime FROM nation",
        "label_codecs": f"SELECT n_nationkey, {_LIST([k for _, k in _LABELS])}[n_nationkey % {len(_LABELS)} + 1] AS codec FROM nation",
        "document_sums": "SELECT doc_id, CASE WHEN doc_id % 7 = 6 THEN 'missing' WHEN text IS NULL THEN 'no_payload' ELSE ['ok', 'ok', 'fail', 'format', 'format', 'unsupported'][doc_id % 7 + 1] END AS status FROM documents",
        "bulk_changes": """
SELECT 'update' AS op_type, 'regions' AS "index", CAST(r_regionkey AS VARCHAR) AS id, '{"r_name":' || to_json(r_name) || '}' AS doc FROM region
UNION ALL SELECT 'delete', 'regions', CAST(r_regionkey AS VARCHAR), NULL FROM region""",
    }
