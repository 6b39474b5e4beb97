"""Record parsing, codecs and the data source, on small files made here."""

import gzip
import io
import random
import zlib

import pytest
import zstandard
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from webarc.sources import codecs, text
from webarc.sources.codecs import Buffered, CodecError, compress, members, next_member, sniff
from webarc.sources.records import RecordError, Scan, check_digest, chunks_of, content_charset, decode_chunked, decode_payload, digest, header_pairs, parse_date, parse_http_date, record_bytes, status_parts
from webarc.sources.warc import Split, WarcReader, extract_record, packed, parse_record, read_all_warcs, read_warcs, register, type_mask
from webarc.sources.files import match_files, splits_of
from webarc.sources.text import read_text


def warc(kind="response", body=b"hello", http=True, version="WARC/1.1", extra=(), checksum=True, n=0):
    headers = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{n}>"), ("WARC-Date", "2024-02-03T04:05:06Z"), *extra]
    if http:
        headers.append(("Content-Type", f"application/http; msgtype={kind}"))
    return record_bytes(version, headers, body, "HTTP/1.1 200 OK" if http else None, [("Content-Type", "text/html; charset=ISO-8859-1"), ("Date", "Sat, 03 Feb 2024 04:05:06 GMT")] if http else None, None, checksum)


def scan(data, **options):
    return list(Scan(**options).records(Buffered(members(io.BytesIO(data)))))


def write_file(path, records, codec):
    path.write_bytes(b"".join(compress(r, codec) for r in records))


@pytest.mark.parametrize("codec", ["none", "gzip", "zstd", "lz4", "brotli"])
def test_codec_round_trip(codec):
    data = [bytes([i]) * (i * 1000) for i in range(1, 5)]
    if codec == "brotli":
        assert b"".join(x for _, x in members(io.BytesIO(compress(b"".join(data), codec)), codec)) == b"".join(data)
        return
    packed = [compress(d, codec) for d in data]
    got = list(members(io.BytesIO(b"".join(packed)), codec))
    assert b"".join(x for _, x in got) == b"".join(data)
    if codec != "none":
        starts = [sum(map(len, packed[:i])) for i in range(4)]
        assert list(dict.fromkeys(p for p, _ in got)) == starts
        assert sniff(packed[0][:4]) == codec
        with pytest.raises(CodecError):
            list(members(io.BytesIO(b"".join(packed)[:-3]), codec))


def test_zstd_dictionary():
    samples = [f"WARC/1.1 WARC-Type: response number {i % 7} and {i}".encode() * 3 for i in range(2000)]
    dictionary = codecs.train_dictionary(samples, 2000)
    for packed in (False, True):
        data = codecs.dictionary_frame(dictionary, packed) + b"".join(compress(s, "zstd", dictionary=dictionary) for s in samples[:5])
        got = list(members(io.BytesIO(data)))
        assert [x for _, x in got] == samples[:5]
        assert got[0][0] == len(codecs.dictionary_frame(dictionary, packed))
        second = got[1][0]
        assert next(members(io.BytesIO(data), "zstd", second))[1] == samples[1]


def test_gzip_padding_and_next_member():
    one, two = compress(warc(n=1), "gzip"), compress(warc(n=2), "gzip")
    data = one + b"\0" * 7 + two
    assert len(list(members(io.BytesIO(data)))) == 2
    assert next_member(io.BytesIO(data), "gzip", 1, len(data)) == len(one) + 7
    assert next_member(io.BytesIO(data), "gzip", 1, len(one)) is None


def test_headers():
    pairs = header_pairs([b"A: 1", b"B : two", b" more", b"nothing", b"a: 3", b"C:"], "utf-8")
    assert pairs == [("A", "1"), ("B", "two more"), ("a", "3"), ("C", "")]
    assert status_parts("HTTP/1.1 404 Not Found") == (404, "Not Found")
    assert status_parts("HTTP/1.1 x y") == (None, "y") and status_parts("GET / HTTP/1.1") == (None, None)
    assert content_charset("text/html; charset=UTF-8; x=y") == "utf-8" and content_charset("text/html") is None
    assert parse_date("2024-01-02T03:04:05Z").isoformat() == "2024-01-02T03:04:05+00:00" and parse_date("soon") is None
    assert parse_http_date("Sat, 03 Feb 2024 04:05:06 GMT").isoformat() == "2024-02-03T04:05:06+00:00" and parse_http_date("x") is None


def test_record_fields():
    (r,) = scan(warc())
    assert (r.record_type, r.code, r.is_http, r.http_parsed, r.payload) == ("response", 4, True, True, b"hello")
    assert r.block_length > r.content_length == 5
    assert check_digest(r.block, r.get("warc-block-digest")) == "ok" and check_digest(r.payload, r.get("WARC-Payload-Digest")) == "ok"
    (r,) = scan(warc(), parse_http=False)
    assert not r.http_parsed and r.content_length == r.block_length


def test_unknown_and_missing_type():
    assert scan(warc("strange", http=False))[0].record_type == "unknown"
    assert scan(record_bytes("WARC/1.0", [("WARC-Record-ID", "x")], b"b"))[0].record_type is None


def test_short_header_blocks():
    one = b"WARC/1.0\r\nContent-Length: 7\r\n\r\na\r\n\r\nbc\r\n\r\n"
    none = b"WARC/1.0\r\n\r\n\r\n\r\n"
    assert [(len(r.headers), r.block) for r in scan(one + none + one)] == [(1, b"a\r\n\r\nbc"), (0, b""), (1, b"a\r\n\r\nbc")]
    body = b"HTTP/1.0 204 No\r\n\r\nx\r\n\r\ny"
    r = scan(record_bytes("WARC/1.1", [("WARC-Type", "response"), ("Content-Type", "application/http")], body))[0]
    assert (r.http_status_line, r.http_headers, r.payload) == ("HTTP/1.0 204 No", [], b"x\r\n\r\ny")


def test_quirks_and_errors():
    loose = b"WARC/0.18\nWARC-Type: response\nContent-Length: 3\n\nabc\n\n"
    assert scan(loose, quirks=True)[0].payload == b"abc"
    assert scan(b"garbage\r\n" + warc(), permissive=True)[0].corrupt_reason
    with pytest.raises(RecordError):
        scan(b"garbage\r\n" + warc(), permissive=False)
    assert scan(b"garbage\r\n" + warc(), quirks=True)[0].payload == b"hello"
    assert "cut off" in scan(warc()[:-10])[0].corrupt_reason
    assert "Maximum header length" in scan(warc(extra=[("X", "y" * 5000)]), max_header=1000)[0].corrupt_reason


def test_filters():
    data = warc("request", b"a" * 10, n=1) + warc("response", b"b" * 1000, n=2) + warc("metadata", b"c", http=False, n=3) + warc("response", b"bad", n=4, checksum=False)
    ids = lambda **o: [r.get("WARC-Record-ID")[10:-1] for r in scan(data, **o)]
    assert ids() == ["1", "2", "3", "4"]
    assert ids(type_mask=type_mask("request,metadata")) == ["1", "3"]
    assert ids(min_length=1000) == ["2"] and ids(max_length=10) == ["3"]
    assert ids(length_basis="payload", max_length=10) == ["1", "3", "4"]
    assert ids(verify_digests=True) == ["1", "2", "3"]
    kept = scan(data, max_length=10, keep_meta=True)
    assert [r.payload is None for r in kept] == [True, True, False, True]
    assert type_mask("any") == 65535 and type_mask("48") == 48
    with pytest.raises(ValueError):
        type_mask("nonsense")


def test_digests():
    import base64
    import hashlib

    assert digest(b"ABC") == "sha1:" + base64.b32encode(hashlib.sha1(b"ABC").digest()).decode()

    for a in ("md5", "sha1", "sha256", "sha512"):
        raw = hashlib.new(a, b"ABC").digest()
        assert check_digest(b"ABC", f"{a}:{base64.b32encode(raw).decode()}") == "ok"
        assert check_digest(b"ABC", f"{a}:{raw.hex()}") == "ok"
        assert check_digest(b"ABD", f"{a}:{raw.hex()}") == "fail"
    assert check_digest(b"ABC", None) == "missing" and check_digest(None, "sha1:AA") == "no_payload"
    assert check_digest(b"ABC", "sha1") == "format" and check_digest(b"ABC", "crc:00") == "unsupported" and check_digest(b"ABC", "sha1:!!") == "format"


def test_payload_decoding():
    raw = b"text " * 100
    zipped, deflated, zst = gzip.compress(raw), zlib.compress(raw), zstandard.compress(raw)
    assert decode_payload(zipped, None, "gzip") == raw == decode_payload(deflated, None, "deflate") == decode_payload(zst, None, "zstd")
    assert decode_payload(compress(raw, "brotli"), None, "br") == raw
    chunked = b"%x\r\n%s\r\n0\r\n\r\n" % (len(zipped), zipped)
    assert decode_payload(chunked, "chunked", "gzip") == raw
    assert decode_payload(chunked, "gzip, chunked", None, "transfer") == raw
    assert decode_payload(chunked, "chunked", "gzip", "transfer") == zipped
    assert decode_payload(zipped, None, "identity") == zipped
    with pytest.raises(RecordError):
        decode_payload(raw, None, "rot13")
    with pytest.raises(RecordError):
        decode_payload(raw, None, "gzip")


def test_chunks():
    body = b"4\r\nWiki\r\n5;x=y\r\npedia\r\nE\r\n in\r\n\r\nchunks.\r\n0\r\n\r\n"
    assert decode_chunked(body) == b"Wikipedia in\r\n\r\nchunks."
    assert len(chunks_of(body)) == 3
    assert decode_chunked(b"zz\r\nabc") == b"" and decode_chunked(b"5\r\nabc") == b"abc" and decode_chunked(b"") == b""
    for bad in (b"zz\r\nabc", b"5\r\nabc", b"5"):
        with pytest.raises(RecordError):
            decode_chunked(bad, strict=True)


def test_parse_record():
    r = parse_record(warc())
    assert r.payload == b"hello" and parse_record(b"") is None


@pytest.mark.parametrize("codec,ending", [("gzip", ".warc.gz"), ("zstd", ".warc.zst"), ("lz4", ".warc.lz4"), ("none", ".warc")])
def test_splits_cover_each_record_once(spark, tmp_path, codec, ending):
    write_file(tmp_path / f"a{ending}", [warc(body=bytes([65 + i % 20]) * (50 * i), n=i) for i in range(60)], codec)
    df = read_warcs(spark, str(tmp_path), ["record_id", "stream_pos", "content_length"], splitSize=700, splitUncompressed="true")
    assert df.rdd.getNumPartitions() > 1
    rows = df.orderBy("stream_pos").collect()
    assert [r.record_id for r in rows] == [f"<urn:uuid:{i}>" for i in range(60)] and [r.content_length for r in rows] == [50 * i for i in range(60)]
    path = str(tmp_path / f"a{ending}")
    assert extract_record(spark, path, rows[7].stream_pos).first().record_id == "<urn:uuid:7>"


def test_wide_schema_and_dates(spark, tmp_path):
    write_file(tmp_path / "a.warc.gz", [warc()], "gzip")
    r = read_warcs(spark, str(tmp_path)).first()
    assert (r.http_status, r.http_reason, r.http_content_type, r.http_charset) == (200, "OK", "text/html", "iso-8859-1")
    assert r.record_date.isoformat() == r.http_date.isoformat() == "2024-02-03T04:05:06"
    assert r.block_digest_status == r.payload_digest_status == "ok" and r.record_length == (tmp_path / "a.warc.gz").stat().st_size
    assert bytes(r.raw_warc_headers).startswith(b"WARC/1.1\r\n")


def test_broken_file_is_told_not_lost(spark, tmp_path):
    write_file(tmp_path / "good.warc.gz", [warc(n=1)], "gzip")
    (tmp_path / "bad.warc.gz").write_bytes(compress(warc(n=2), "gzip")[:-20])
    df = read_warcs(spark, str(tmp_path), ["record_id", "corrupt_reason"])
    rows = df.collect()
    assert sum(r.corrupt_reason is None for r in rows) >= 1 and sum(r.corrupt_reason is not None for r in rows) == 1
    with pytest.raises(Exception, match="cut off"):
        read_warcs(spark, str(tmp_path), ["record_id"], mode="FAILFAST").collect()


def test_lossless_headers_when_written(spark, tmp_path):
    register(spark)
    write_file(tmp_path / "a.warc.gz", [warc(extra=[("X-Twice", "1"), ("x-twice", "2")])], "gzip")
    src = read_warcs(spark, str(tmp_path / "a.warc.gz"))
    src.write.format("warc").option("compression", "zstd").mode("append").save(str(tmp_path / "out"))
    a, b = src.select("headers", "http_headers", "payload").first(), read_warcs(spark, str(tmp_path / "out")).select("headers", "http_headers", "payload").first()
    assert a.http_headers == b.http_headers and bytes(a.payload) == bytes(b.payload)
    assert sorted(map(tuple, a.headers)) == sorted(map(tuple, b.headers))
    src.write.format("warc").mode("overwrite").save(str(tmp_path / "out"))
    assert read_warcs(spark, str(tmp_path / "out")).count() == 1


def test_read_all_and_match(spark, tmp_path):
    for i in range(3):
        write_file(tmp_path / f"{i}.warc.gz", [warc(n=i)], "gzip")
    files = match_files(spark, str(tmp_path / "*.warc.gz"))
    assert files.count() == 3 and read_all_warcs(files, columns=["record_id"]).count() == 3
    assert match_files(spark, str(tmp_path / "*.nothing")).count() == 0
    with pytest.raises(FileNotFoundError):
        match_files(spark, str(tmp_path / "nothing"))
    assert match_files(spark, str(tmp_path / "nothing"), empty="allow").count() == 0
    with pytest.raises(FileNotFoundError):
        match_files(spark, str(tmp_path / "*.nothing"), empty="disallow")


@pytest.mark.parametrize("desired,least", [(64, 16), (7, 1), (100000, 1)])
def test_text_splits(spark, tmp_path, desired, least):
    lines = [f"line {i} " + "é" * (i % 9) for i in range(100)] + ["", "last without end"]
    (tmp_path / "a.txt").write_text("\n".join(lines), encoding="utf-8")
    (tmp_path / "b.txt.gz").write_bytes(gzip.compress("\n".join(lines).encode("cp1252")))
    got = read_text(spark, str(tmp_path / "a.txt"), desired_split_size=desired, min_split_size=least).collect()
    assert sorted(r.line for r in got) == sorted(lines)
    got = read_text(spark, str(tmp_path / "b.txt.gz"), desired_split_size=desired, min_split_size=least).collect()
    assert sorted(r.line for r in got) == sorted(lines)


def test_splits_of():
    assert splits_of(100, 40, 30) == [(0, 40), (40, 100)] and splits_of(100, 40, 10) == [(0, 40), (40, 80), (80, 100)] and splits_of(0, 40, 10) == []


def test_empty_archive(spark, tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(b"")
    assert read_warcs(spark, str(tmp_path)).agg(F.count("*").alias("n")).first().n == 0


def test_where_says_the_same_as_a_filter(spark, tmp_path):
    write_file(tmp_path / "a.warc.gz", [warc("request", b"a" * 10, n=1), warc(body=b"b" * 1000, n=2), warc("metadata", b"c" * 70, http=False, n=3)], "gzip")
    every = read_warcs(spark, str(tmp_path), ["record_id", "record_type", "stream_pos", "content_length", "block_length"])
    rows = every.collect()
    for where, same in (
        ({"record_type": "request"}, lambda r: r.record_type == "request"), ({"record_type": ["request", "metadata"]}, lambda r: r.record_type != "response"), ({"stream_pos": rows[1].stream_pos}, lambda r: r.stream_pos == rows[1].stream_pos),
        ({"content_length": (50, 500)}, lambda r: 50 <= r.content_length <= 500), ({"block_length": (500, None)}, lambda r: r.block_length >= 500),
    ):
        got = read_warcs(spark, str(tmp_path), ["record_id"], where).collect()
        assert {r.record_id for r in got} == {r.record_id for r in rows if same(r)}
    with pytest.raises(ValueError):
        read_warcs(spark, str(tmp_path), where={"target_uri": "x"})


def test_all_files_in_splits_and_written_by_uri(spark, tmp_path):
    """Paths in a column, large files read by many tasks, a folder named by a URI, and what isn't there."""
    register(spark)
    rows = [("resource", f"u:{i}", False, bytes([65 + i % 26]) * 900) for i in range(300)]
    df = spark.createDataFrame(rows, "record_type string, target_uri string, is_http boolean, payload binary").coalesce(1)
    for codec in ("gzip", "lz4"):
        df.write.format("warc").option("compression", codec).mode("append").save(f"file://{tmp_path}/out")
    df.limit(3).write.format("warc").option("compression", "zstd").mode("overwrite").save(f"file://{tmp_path}/again")
    df.limit(5).write.format("warc").option("compression", "zstd").mode("overwrite").save(f"file://{tmp_path}/again")
    assert read_warcs(spark, f"{tmp_path}/again", ["target_uri"]).count() == 5
    names = sorted(str(p) for p in (tmp_path / "out").iterdir())
    assert len(names) == 2 and not any("/_" in n for n in names)
    files = spark.createDataFrame([(n,) for n in names] + [(None,), (str(tmp_path / "none.warc.gz"),)], "path string")
    got = read_all_warcs(files, columns=["path", "target_uri", "payload", "corrupt_reason"], split_size=2000, tasks=5).collect()
    assert sorted((r.path, r.target_uri, bytes(r.payload)) for r in got if r.target_uri) == sorted((n, u, p) for n in names for _, u, _, p in rows)
    assert [r.path for r in got if r.corrupt_reason] == [str(tmp_path / "none.warc.gz")]


def test_small_splits_share_tasks(spark, tmp_path):
    """Each split is read on its own, but many by one task."""
    for k in range(2):
        write_file(tmp_path / f"{k}.warc.gz", [warc(n=100 * k + i, body=bytes(random.Random(i).randbytes(2000))) for i in range(100)], "gzip")
    reader = WarcReader(StructType([StructField("record_id", StringType())]), {"path": str(tmp_path), "splitSize": "500"})
    splits, tasks = reader.splits(), reader.partitions()
    assert [s for t in tasks for s in t.parts] == splits and len(splits) > 700 and len(tasks) <= 100
    assert packed([Split("a", 0, 128 << 20, 256 << 20), Split("a", 128 << 20, 256 << 20, 256 << 20)])[1].parts[0].start == 128 << 20 and packed([]) == []
    r = read_warcs(spark, str(tmp_path), ["record_id"], splitSize=500)
    assert r.rdd.getNumPartitions() <= 100 and r.count() == r.distinct().count() == 200


def test_lines_are_read_by_tasks_by_their_bytes(spark, tmp_path, monkeypatch):
    """Splits are small rows; how much there is to read behind them tells how many tasks there are."""
    monkeypatch.setattr(text, "TASK", 2000, raising=False)
    (tmp_path / "a.txt").write_text("".join(f"line {i}\n" for i in range(5000)))
    lines = read_text(spark, str(tmp_path / "a.txt"), desired_split_size=500, min_split_size=100)
    assert lines.rdd.getNumPartitions() >= 20 and sorted(r.line for r in lines.collect()) == sorted(f"line {i}" for i in range(5000))
