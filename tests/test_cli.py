"""The command line, whole records in columns, and character data."""

import io
import json

import pytest
from pyspark.sql import functions as F
from test_records import warc, write_file

from webarc.__main__ import parser, run
from webarc.functions import lang, records
from webarc.html.dom import COMMENT, TEXT, Node
from webarc.sources.warc import read_warcs


def call(spark, *words):
    out = io.StringIO()
    return run(spark, parser().parse_args([str(w) for w in words]), out), out.getvalue()


def test_archives(spark, tmp_path):
    source, bad = tmp_path / "a.warc.gz", tmp_path / "bad.warc"
    write_file(source, [warc(n=1, body=b"<title>x</title>"), warc("request", n=2)], "gzip")
    write_file(bad, [warc(n=3, extra=[("WARC-Block-Digest", "sha1:" + "A" * 32)], checksum=False)], "none")
    assert call(spark, "check", source) == (0, "2\tOK\n") and call(spark, "check", bad) == (1, "1\tFAIL\n")
    assert call(spark, "check", source, "--payloads", "--report", tmp_path / "report") == (0, "2\tOK, PAYLOAD_OK\n") and spark.read.parquet(str(tmp_path / "report")).count() == 2
    assert call(spark, "recompress", source, tmp_path / "out", "--codec", "zstd")[1] == "2 records\n"
    assert call(spark, "index", source, tmp_path / "index", "--fields", "offset,length,warc-record-id")[0] == 0
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "index")).collect()]
    assert sorted(x["warc-record-id"] for x in lines) == ["<urn:uuid:1>", "<urn:uuid:2>"]
    second = max(int(x["offset"]) for x in lines)
    assert call(spark, "extract", source, second, "--payload") == (0, "hello\n") and call(spark, "extract", source, second, "--headers")[1].startswith("WARC/1.1\r\nWARC-Type: request")
    assert call(spark, "extract", source, second + 1)[0] in (0, 1)
    assert call(spark, "benchmark", source)[1].startswith("2 records") and call(spark, "html-benchmark", source)[1].startswith("1 records")


def test_languages(spark, tmp_path):
    rows = [(k, f"{v} {v} {v}") for k, v in lang._PARAGRAPHS.items() for _ in range(2)]
    spark.createDataFrame(rows, "lang string, text string").write.parquet(str(tmp_path / "texts"))
    assert call(spark, "lang-train", tmp_path / "texts", tmp_path / "profiles")[0] == 0
    out = call(spark, "lang-evaluate", tmp_path / "texts", "--profiles", tmp_path / "profiles")[1].splitlines()
    assert len(out) == len(lang._PARAGRAPHS) and all(x.endswith("1.0000\t1.0000\t1.0000") for x in out)
    assert len(call(spark, "lang-evaluate", tmp_path / "texts", "--truncate", 150)[1].splitlines()) >= 17
    assert call(spark, "lang-dataset", tmp_path / "texts", tmp_path / "set")[0] == 0 and spark.read.parquet(str(tmp_path / "set")).filter("lang = 'fr' and length(text) < 200").count() == 0 and spark.read.parquet(str(tmp_path / "set")).count() == 16


def test_record_columns(spark, tmp_path):
    df = spark.createDataFrame([(warc(),), (b"nonsense",), (None,), (warc("metadata", b"m", http=False, n=5),)], "d binary").select(records.parse_warc_record("d").alias("r"))
    a, b, c, d = [r.r for r in df.collect()]
    assert (a.record_id, a.record_type, a.http_status, bytes(a.payload), a.block_digest_status, a.error) == ("<urn:uuid:0>", "response", 200, b"hello", "ok", None) and a.record_date.isoformat() == "2024-02-03T04:05:06"
    assert b.error and b.record_id is None and c is None and (d.record_type, d.is_http, d.http_status, bytes(d.payload)) == ("metadata", False, None, b"m")
    made = spark.createDataFrame([("u1", b"body"), ("u2", None)], "u string, p binary").select("u", "p", records.record_headers(F.lit("Response"), records.record_id("u"), F.timestamp_seconds(F.lit(0)), F.lit(True)).alias("h"))
    raw = made.select("u", records.to_record("WARC/1.1", "h", "p", F.lit("HTTP/1.1 200 OK"), F.array(F.struct(F.lit("A").alias("key"), F.lit("b").alias("value")))).alias("d"))
    back = [r.r for r in raw.orderBy("u").select(records.parse_warc_record("d").alias("r")).collect()]
    assert [bytes(r.payload) for r in back] == [b"body", b""] and all(r.block_digest_status == "ok" and r.is_http and r.record_date.isoformat() == "1970-01-01T00:00:00" for r in back)
    assert len({r.record_id for r in back}) == 2 and all(len(r.record_id) == 47 for r in back)
    (tmp_path / "x.warc").write_bytes(b"".join(bytes(r.d) for r in raw.collect()))
    assert read_warcs(spark, str(tmp_path / "x.warc")).count() == 2


def test_record_dates_of_far_years(spark):
    """Nanoseconds end in 2262, datetime in 9999."""
    days = [0, 106_752, 899_999, 2_932_897, 5_399_999]
    made = spark.createDataFrame([(d,) for d in days], "d bigint").select("d", records.record_headers(F.lit("resource"), records.record_id("d"), F.timestamp_seconds(F.col("d") * 86400)).alias("h"))
    read = made.select("d", records.parse_warc_record(records.to_record("WARC/1.1", "h", F.lit(b"x"))).alias("r"))
    assert sorted(tuple(r) for r in read.select("d", F.unix_timestamp("r.record_date")).collect()) == [(d, d * 86400) for d in days]


def test_character_data():
    n = Node(TEXT, "#text", "abcdef")
    n.insert_data(1, "X")
    n.delete_data(0, 1)
    n.replace_data(4, 9, "!")
    n.append_data("?")
    assert n.value == "Xbcd!?" and n.substring_data(1, 2) == "bc" and Node(COMMENT, "#comment", "c").substring_data(0, 5) == "c"
    for bad, error in ((lambda: n.insert_data(99, "x"), IndexError), (lambda: Node("element", "p").append_data("x"), ValueError)):
        with pytest.raises(error):
            bad()
